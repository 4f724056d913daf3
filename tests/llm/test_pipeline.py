"""The pipeline, stage by stage, each against what its input calls for."""

import collections

import numpy as np
import public_tokenizers
from helpers import SF, near_duplicates, odd_documents, passages

import corpus_pipeline
from pagequarry.llm import base, mixing, queries


def test_stages_on_their_own_inputs(spark):
    import sentencepiece

    base.prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = base.written(stage(spark, docs, SF))
        tables[name] = (docs, out)
        docs = out
    assert all(out.columns == columns for _, out in list(tables.values())[:-1])

    before, after = tables["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert sum(labels.get(i) == 0 for i in gone) <= 2
    marked = {r["doc_id"] for r in before.collect() if labels.get(r["doc_id"]) == 1}
    assert marked and len(marked & gone) >= 0.95 * len(marked)

    before, after = tables["minhash_near_dedup"]
    of = near_duplicates([(r["doc_id"], r["text"]) for r in before.collect()], 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in of.items() if i == c}

    before, after = tables["substring_dedup"]
    wanted = {i: " ".join(w for w, g in zip(words, flags, strict=True) if not g) for i, words, flags in passages([(r["doc_id"], r["text"]) for r in before.collect()])}
    same = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert " ".join(r["text"].split()) == wanted[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert r["text"] == same[r["doc_id"]] or wanted[r["doc_id"]] != " ".join(same[r["doc_id"]].split())

    before, after = tables["mixing"]
    assert collections.Counter(before.collect()) == collections.Counter(after.collect())

    before, after = tables["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in after.collect())
    assert after.count() == before.count()
    assert queries.registry()["pipeline"](spark, SF).count() == after.count()


def test_odd_documents_pass(spark, tmp_path):
    docs = odd_documents(base.prepare(spark))
    spark.createDataFrame([(1, 0), (7, 1), (None, None), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.filter("false")):
        out = rows
        for name, stage in corpus_pipeline.STAGES:
            out = base.written(stage(spark, out, str(tmp_path)))
            assert name == "sentencepiece" or out.columns == docs.columns
        assert out.count() == (0 if rows is not docs else 11)
    assert np.isfinite(corpus_pipeline.TOXIC)


def test_mixture_is_in_the_rows(spark):
    """Shares after any number of slots, from the rows of ``run`` after they were written and read again."""
    base.prepare(spark)
    rows = base.written(corpus_pipeline.run(spark, SF)).select("doc_id", "source", "slot", "block", "deadline").collect()
    assert rows
    pool = lambda s: s if s in queries.MIX else mixing.REST
    at = {}  # the slot of each block of a source
    for r in rows:
        key = (pool(r["source"]), r["block"])
        assert at.setdefault(key, (r["slot"], r["deadline"])) == (r["slot"], r["deadline"]) and r["slot"] < r["deadline"]
    assert len({slot for slot, _ in at.values()}) == len(at)
    assert max(collections.Counter((pool(r["source"]), r["block"]) for r in rows).values()) <= mixing.BLOCK_ROWS
    quota = mixing.quotas(queries.MIX, queries.MIX_REST)
    for name, q in quota.items():
        slots = sorted(slot for (p, _), (slot, _) in at.items() if p == name)
        assert [at[name, k][0] for k in range(len(slots))] == slots
        taken = 0
        for n in range(1, slots[-1] + 2 if slots else 1):  # while the source has blocks left
            taken += taken < len(slots) and slots[taken] < n
            assert abs(taken - n * q / mixing.RESOLUTION) < 1

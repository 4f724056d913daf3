"""Language, quality, toxicity, token counts, encoding, passages, near duplicates, mixing."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHING, LONG, SF, digest, near_duplicates, odd_documents, passages
from pyspark.sql import functions as F

from pagequarry.llm import base, language_id, minhash, mixing, pieces, quality, queries, substrings, token_counts, toxicity

SF01 = "/root/testdata/sf0.01"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(base.prepare(spark)).cache()


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_language_is_right_for_held_out_documents(spark):
    found = queries.registry()["op1_language_id"](spark, SF01)
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.97 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_of_odd_documents(spark, odd):
    found = by_id(language_id.identify(odd, language_id.profiles(odd)))
    assert len(found) == 13
    of = {r["doc_id"]: r for r in found if r["doc_id"]}
    assert {k for k, r in of.items() if r["lang_pred"] == "und"} == {2, 3, 4, 6} and of[2]["score"] == 0
    assert of[7]["lang_pred"] == of[8]["lang_pred"] == "la" and of[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = odd.filter("false")
    assert language_id.identify(nothing, language_id.profiles(nothing)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.profiles(nothing)).collect()} == {"und"}


def test_grams_are_those_of_padded_words():
    (hashes, counts), = language_id.grams(["Ab, a"])
    # " ab " and " a ": a, b, " a", "ab", "b ", "a ", " ab", "ab ", " a ", " ab ".
    assert len(hashes) == 10 and sorted(counts) == [1] * 8 + [2, 2]


def test_out_of_place_distance_by_hand():
    known, table = np.array([5, 7, 9], np.uint64), np.array([[0, -1], [1, 0], [-1, 1]])
    name, score = language_id._nearest(np.array([7, 5], np.uint64), known, table, ["a", "b"], 10)
    assert (name, score) == ("a", 10 / 12)  # a: 1 + 1; b: 0 + 10
    assert language_id._nearest(np.array([11], np.uint64), known, table, ["a", "b"], 10) == ("a", 0.5)


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.93), ("op9_toxicity", "toxic", 0.95)])
def test_learned_scores_hold_out(spark, name, label, least):
    found = queries.registry()[name](spark, "/root/testdata/sf0.1" if label == "toxic" else SF01).filter("held_out")
    truth = spark.read.parquet(f"{'/root/testdata/sf0.1' if label == 'toxic' else SF01}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = found.join(truth, "doc_id").collect()
    assert sum(r["predicted"] == r["y"] for r in rows) > least * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_of_odd_documents(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 0), (5, None), (None, 1), (99, 1)], "doc_id long, label int")
    model = quality.train(odd, labels)
    found = quality.score(odd, model).collect()
    assert len(found) == 13 and len({round(r["score"], 9) for r in found if r["doc_id"] in (2, 3)}) == 1
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels.filter("false"))).collect()} == {0.5}
    assert quality.score(odd.filter("false"), model).count() == 0


def test_field_marginals_equal_enumeration():
    model = toxicity.Model(np.zeros(1), np.array([0.3, -0.4]), np.array([[0.2, -0.7], [0.1, 0.5]]), np.zeros(4))
    rng = np.random.default_rng(1)
    sequences = [rng.normal(0, 2, n) for n in (1, 2, 5, 7, 1)]
    wanted = []
    for scores in sequences:
        weights = np.zeros((len(scores), 2))
        for states in itertools.product((0, 1), repeat=len(scores)):
            total = model.start[states[0]] + sum(s * x for s, x in zip(scores, states, strict=True)) + sum(model.moves[a, b] for a, b in itertools.pairwise(states))
            for t, s in enumerate(states):
                weights[t, s] += np.exp(total)
        wanted.append(weights[:, 1] / weights.sum(axis=1))
    begins = np.concatenate([[True] + [False] * (len(s) - 1) for s in sequences])
    for lanes in (1, 3, 5, 100):
        assert np.allclose(toxicity.marginals(np.concatenate(sequences), begins, model, lanes), np.concatenate(wanted))


def test_field_finds_spans_and_passes_odd_documents(spark, odd):
    random.seed(4)
    plain = "stone river cloud meadow lantern harbor window garden silver autumn".split()
    rows, labels = [], []
    for k in range(400):
        words = random.choices(plain, k=40)
        if k % 2:
            for _ in range(3):
                words[random.randrange(40)] = random.choice(("vileword", "nastyword"))
        rows.append((k + 100, " ".join(words)))
        labels.append((k + 100, k % 2))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    model = toxicity.train(docs, truth)
    text = "A calm river. What a VILEWORD, nastyword garden vileword"
    (score, spans, _, _), (clean, none, _, _) = toxicity.tag([text, "A calm river"], model)
    assert score > 0.9 > 0.2 > clean and not none
    assert [text[a:b] for a, b in spans] == ["VILEWORD, nastyword", "vileword"]
    assert toxicity.score(odd, model).filter("predicted = 1").count() == 0 and toxicity.score(odd, model).count() == 13
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == 13
    assert toxicity.reject(docs, model).count() == 200
    assert toxicity.train(docs, truth.filter("label = 0")) is None and {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(odd.filter("false"), model).count() == 0


def test_token_counts_are_the_librarys(spark, odd, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    mine = token_counts.counter(BPE)
    random.seed(6)
    some = texts + ["".join(random.choice("aábc  e'st\n!1Z日🙂") for _ in range(random.randint(0, 60))) for _ in range(300)] + ["<|endoftext|> a<|endoftext|>", "don't we'LL 's", " " * 999, "é́" * 30]
    assert [mine.count(t) for t in some] == [len(e) for e in library.encode_batch(some, add_special_tokens=False)]
    for t in some[-300:]:
        ends, counts = mine.prefixes(t)
        for n in range(0, len(t) + 1, 5):
            assert mine.at(t, ends, counts, n) == len(library.encode(t[:n], add_special_tokens=False)), (t, n)
        cut = mine.budget(ends, counts, 7)
        assert not cut or mine.at(t, ends, counts, cut) <= 7
    found = token_counts.token_counts(odd, BPE, limit=10, prefixes=True).collect()
    assert len(found) == 13
    for r in found:
        assert r["over_limit"] == (r["n_tokens"] > 10) and (r["piece_tokens"][-1] if r["piece_tokens"] else 0) == r["n_tokens"]
    assert {(r["n_bytes"], r["n_tokens"]) for r in found if r["doc_id"] in (2, 3)} == {(0, 0)}
    assert next(r for r in found if r["doc_id"] == 7)["n_tokens"] == len(library.encode(LONG))
    assert token_counts.token_counts(odd.filter("false"), BPE).count() == 0


def test_every_prefix_has_its_tokens(spark):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(BPE), token_counts.counter(BPE)
    random.seed(7)
    some = ["".join(random.choice(["a", "b c", "  ", "'", "'re", "'ll", "!", "\n\n", "日", "<|endoftext|>", "<|", "1", "🙂"]) for _ in range(random.randint(1, 25))) for _ in range(150)]
    some += ["日本語の文章は空白がない" * 15, "QmFzZTY0IGlzIGxvbmc" * 15, "=-" * 150, "", "a \n\n\nb<|endoftext|>", "a   <|endoftext|>"]
    for t in some:
        brute = [len(e) for e in library.encode_batch([t[:n] for n in range(len(t) + 1)], add_special_tokens=False)]
        ends, counts = mine.prefixes(t)
        assert [mine.at(t, ends, counts, n) for n in range(len(t) + 1)] == brute, t
        for tokens in (0, 1, 7, 40):
            assert mine.budget(ends, counts, tokens) == max(n for n, c in enumerate(brute) if c <= tokens), (t, tokens)
    found = queries.registry()["op10_token_counts"](spark, SF).collect()
    assert found and all(len(r["piece_tokens"]) >= r["n_bytes"] / 4 and (not r["piece_tokens"] or r["piece_tokens"][-1] == r["n_tokens"]) for r in found)


def test_pieces_are_the_librarys_and_decode(spark, odd, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mine = pieces.pieces(PIECES)
    random.seed(7)
    some = texts + ["".join(random.choice("aábc  e'st\n!1Z日🙂▁.") for _ in range(random.randint(0, 60))) for _ in range(500)] + [" " * 37 + "x" + " " * 100, "<s> <unk> <0x0A>", "\x00\t", ""]
    assert [np.frombuffer(b, np.int32).tolist() for b in mine.encode(some)] == library.encode(some)
    assert all(mine.decode(ids) == t.replace("▁", " ") for ids, t in zip(library.encode(some), some, strict=True))
    found = pieces.encode_and_check(odd, PIECES).collect()
    assert len(found) == 13 and all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert collections.Counter(r["text"] for r in pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()) == collections.Counter((r["text"] or "").replace("▁", " ") for r in odd.collect())
    assert pieces.encode(odd.filter("false"), PIECES).count() == 0


def test_passages_of_odd_documents(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    wanted = collections.Counter((i, len(w), sum(g), digest(w, g)) for i, w, g in passages(rows))
    assert collections.Counter(tuple(r) for r in substrings.digests(odd).collect()) == wanted
    cut = substrings.drop_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == 13
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[7] == LONG and texts[8] == "" and texts[2] is None and texts[4] == " \n\t "
    assert substrings.digests(odd.filter("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, monkeypatch, seed):
    """Few different words, so that repeats overlap, nest and start anywhere; many groups and buckets."""
    monkeypatch.setattr(substrings, "GROUP_ROWS", 7)
    monkeypatch.setattr(substrings, "TASK_HASHES", 50)
    random.seed(seed)
    pool = [" ".join(random.choices("abcdef", k=random.randint(5, 40))) for _ in range(12)]
    rows = [(random.choice([None, *range(60)]) if k % 9 == 0 else k, "  ".join(random.choices(pool, k=random.randint(0, 3)) + random.choices("xyz\n", k=random.randint(0, 3)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = collections.Counter((i, len(w), sum(g), digest(w, g)) for i, w, g in passages(rows))
    assert sum(w[2] for w in wanted) > 100
    assert collections.Counter(tuple(r) for r in substrings.digests(docs).collect()) == wanted
    kept = collections.Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in substrings.drop_repeats(docs).collect())
    assert kept == collections.Counter((i, " ".join(w for w, g in zip(words, gone, strict=True) if not g)) for i, words, gone in passages(rows))


def test_near_duplicates_of_odd_documents(spark, odd):
    found = minhash.near_duplicates(odd, 80).collect()
    wanted = near_duplicates([(r["doc_id"], r["text"]) for r in odd.collect()], 80)
    assert len(found) == 13
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == wanted[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    kept = minhash.keep_one(odd, 80)
    assert kept.columns == odd.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([1, 1, 2, 3, 4, 5, 6, 7, None, None, 10])
    assert minhash.near_duplicates(odd.filter("false")).count() == 0


def test_ids_with_different_texts_lose_no_links(spark, monkeypatch):
    """Rows (1, A), (1, B), (2, near A), (3, near B): all in one class, also where only leftover pairs join them."""
    base.prepare(spark)
    random.seed(21)
    words = lambda: [f"v{random.randrange(10**6)}" for _ in range(120)]
    near = lambda w: " ".join([*w[:60], "other", *w[61:]])
    for block in (minhash.BLOCK, 2):
        monkeypatch.setattr(minhash, "BLOCK", block)
        rows, wanted = [], {}
        for k in range(0, 300, 10):
            a, b = words(), words()
            rows += [(k + 1, " ".join(a)), (k + 1, " ".join(b)), (k + 2, near(a)), (k + 3, near(b)), (k + 4, " ".join(words()))]
            wanted.update({k + 1: k + 1, k + 2: k + 1, k + 3: k + 1, k + 4: k + 4})
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
        assert len(found) == len(rows) and {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_long_texts_make_more_groups(spark, monkeypatch):
    """Groups follow bytes as well as rows, so that long texts do not share a task."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", 1000)
    docs = spark.createDataFrame([(k, "the same passage of words that is long enough to be seen as a repeat here " * 30) for k in range(6)], "doc_id long, text string")
    assert substrings.repeats(docs)[1] >= 13
    wanted = collections.Counter((i, len(w), sum(g), digest(w, g)) for i, w, g in passages([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert collections.Counter(tuple(r) for r in substrings.digests(docs).collect()) == wanted


def test_near_duplicates_equal_brute_force_in_a_large_group(spark, monkeypatch):
    """One text with many copies that are edited more and more: some link with the first, some only with each other."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TASK_ROWS", 100)
    random.seed(9)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(160):
        own = list(words)
        for _ in range(k % 8):
            own[random.randrange(150)] = f"x{random.randrange(9)}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join(random.choices(words, k=60))) for k in range(30)] + [(300, rows[3][1].upper()), (301, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = near_duplicates(rows, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 85).collect()} == wanted


def test_mixture_never_strays_a_block():
    quota = mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.0001}, 0.2, 1000)
    assert sum(quota.values()) == 1000 and quota["c"] == 1
    plan = mixing.period(quota)
    slots = sorted((slot, name) for name, blocks in plan.items() for _, _, slot in blocks)
    assert [s for s, _ in slots] == list(range(1000))
    taken = collections.Counter()
    for slot, name in slots:
        taken[name] += 1
        assert all(abs(taken[n] - quota[n] * (slot + 1) / 1000) < 1 for n in quota)
    assert all(release <= slot < due for blocks in plan.values() for release, due, slot in blocks)
    for bad in ({"a": 0.0}, {"a": -1.0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.quotas(bad, 0.1)
    with pytest.raises(ValueError):
        mixing.quotas({"a": 1.0, "b": 1.0}, 1.0, 2)


def test_mixture_of_odd_documents(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    placed = mixing.place(odd, {"src0": 0.5, "src1": 0.3}, 0.2, block_rows=2, resolution=10).collect()
    assert len(placed) == 13
    blocks = collections.Counter((r["_pool"], r["_block"]) for r in placed)
    assert max(blocks.values()) == 2 and {p for p, _ in blocks} == {"", "src0", "src1"}
    assert all(r["_release"] <= r["_slot"] < r["_due"] for r in placed)
    ordered = mixing.in_order(odd, {"src0": 0.5, "src1": 0.3}, 0.2, block_rows=2, resolution=10)
    assert ordered.columns == odd.columns
    slot = {}
    for r in placed:
        slot.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["_slot"])
    seen = [max(slot[(r["doc_id"], r["text"], r["source"])]) for r in ordered.collect() if len(set(slot[(r["doc_id"], r["text"], r["source"])])) == 1]
    assert seen == sorted(seen)
    assert mixing.place(odd.filter("false"), {"src0": 1.0}, 1.0).count() == 0
    assert CLASHING[0] in ordered.columns

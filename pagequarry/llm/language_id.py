"""Language identification by rank-order n-gram profiles.

Every language has a profile: its most frequent n-grams of 1 to 5 letters, in order of frequency. A document gets a
profile of its own whole text, and the language whose ranks are least out of place with it wins.

Words are runs of letters in lower case, each with one blank before and after; n-grams never span two words. A 64-bit
hash stands for an n-gram. Profiles are learned from a bounded sample of the labelled rows; the bound is a parameter.

Defined results: a text that is null, empty or without letters is ``und`` with score 0. Ties between languages go to the
smaller name, ties between n-grams to the smaller hash. Repeated rows get the same answer each, a null ``doc_id`` stays
null, other columns are ignored, texts of any length count whole. Without any labelled row every text is ``und``.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm import base, text

#: Longest n-gram, and how many n-grams a profile keeps.
LONGEST, RANKS = 5, 400
#: Rows per language that profiles are learned from (on average; rows are chosen by a hash of their id).
SAMPLE_ROWS = 2000

#: Languages a model may have, which bounds the profiles that travel to the tasks; more are an error.
MOST_LANGUAGES = 1000

_BLANK = np.uint32(32)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct n-grams as hashes, and how often each occurs."""
    is_letter, lower = text.letters()
    for one in texts:
        codes, offsets = text.code_points([one])
        yield _grams(lower[codes], is_letter[codes])


def _grams(codes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not keep.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Runs of other characters become one blank; the text starts and ends with one.
    shown = keep.copy()
    shown[1:] |= keep[:-1]
    codes = np.where(keep, codes, _BLANK)[shown]
    codes = np.concatenate([[_BLANK], codes, [_BLANK]]).astype(np.uint64)
    if codes[1] == _BLANK:
        codes = codes[1:]
    blank = codes == _BLANK
    total, found = codes.copy(), [codes[~blank]]
    inside = np.ones(len(codes), dtype=bool)
    for n in range(2, LONGEST + 1):
        if len(total) < 2:
            break
        total = total[:-1] * np.uint64(text.PRIME) + codes[n - 1 :]
        # An n-gram may begin or end with a blank, but has none within.
        inside = inside[:-1] if n == 2 else inside[:-1] & ~blank[n - 2 : -1]
        ok = inside if n > 2 else ~(blank[:-1] & blank[1:])
        found.append(total[ok])
    every = np.concatenate(found)
    every.sort()
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[at], np.diff(np.append(at, len(every)))


def top(hashes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent hashes, most frequent first, ties by hash."""
    if len(counts) > 4 * most:  # all that can be among the first, without a full sort
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        hashes, counts = hashes[counts >= least], counts[counts >= least]
    return hashes[np.lexsort((hashes, -counts))[:most]]


def profiles(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, ranks: int = RANKS) -> DataFrame:
    """``(lang, rank, gram)``: the profile of each language in ``labelled(doc_id, text, lang)``."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wanted = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], sample_rows / r["count"])]) if sizes else F.create_map().cast("map<string,double>")
    share = F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)) / F.lit(float(1 << 63))
    sample = rows.filter((share + 1) / 2 < wanted[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch["lang"].to_pylist()):
                texts = batch.filter(pc.equal(batch["lang"], lang))["text"].to_pylist()
                found = list(grams(texts))
                hashes, back = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
                sums = np.bincount(back, weights=np.concatenate([c for _, c in found]), minlength=len(hashes))
                columns = [pa.array([lang] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(sums.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The hash as an unsigned number breaks ties, as in document profiles.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks).select("lang", "rank", "gram")


def identify(docs: DataFrame, profile: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row. ``score`` is 0.5 where two languages are equally near, 1 at a perfect fit."""
    model: dict[str, list[int]] = {}
    for row in profile.orderBy("lang", "rank").collect():  # as many rows as languages times ranks
        model.setdefault(row["lang"], []).append(row["gram"])
    names = sorted(model)
    known = np.unique(np.array([g for grams_ in model.values() for g in grams_], dtype=np.int64).view(np.uint64))
    # Rank of each known n-gram in each language; a missing one is as far away as can be.
    table = np.full((len(known), len(names)), -1, dtype=np.int64)
    for k, name in enumerate(names):
        table[np.searchsorted(known, np.array(model[name], dtype=np.int64).view(np.uint64)), k] = np.arange(len(model[name]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_found, scores = [], []
            for hashes, counts in grams([t or "" for t in batch["text"].to_pylist()]):
                name, score = _nearest(top(hashes, counts, ranks), known, table, names, ranks)
                names_found.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names_found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _nearest(own: np.ndarray, known: np.ndarray, table: np.ndarray, names: list[str], ranks: int) -> tuple[str, float]:
    if not len(own) or not names:
        return "und", 0.0
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    theirs = np.where((known[at] == own)[:, None], table[at], -1)
    apart = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))[:, None]), ranks).sum(axis=0)
    best = int(np.argmin(apart))
    others = np.delete(apart, best)
    second = int(others.min()) if len(others) else ranks * len(own)
    total = second + int(apart[best])
    return names[best], second / total if total else 0.5

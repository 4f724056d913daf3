"""Lines that many documents share: they stay in one document and go from the others.

Texts are exploded into lines at ``\\n``. A line's key is the line without blanks at both ends, A-Z in lower case; a key is
handled as two independent 64-bit hashes. Distinct documents are counted per key. Positions of lines to drop are found by a
join of occurrences with the frequent keys, collected per text, and the text is put together again from the positions that
are left. Built-in functions only.

Only hashes, ids and positions are shuffled for counting; a text is shuffled once, to meet its positions. Counts are
combined before each shuffle. Keys with more than one in ``HOT`` of the occurrences of frequent lines are at most ``HOT``
keys, so they are broadcast; no other key can fill a task of its own.

Defined results: null or empty text is one empty line; a row with a null ``doc_id`` is no document, it counts for nothing and
keeps its lines; rows that share a ``doc_id`` are one document when documents are counted, and each keeps or loses its own
lines; the largest ``doc_id`` of a key keeps every line with it, repeats included. Lines and texts of any length are read
whole. Other columns, whatever their names, pass through :func:`drop_lines`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import written

#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than this share of all occurrences of frequent lines is joined by broadcast: there are at most so many.
HOT = 4096


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(id, row, pos, h1, h2)``: each line whose key has ``least_chars`` characters; ``row`` tells texts of one id apart."""
    cut = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long = cut.filter(F.char_length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least_chars)
    return long.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent(found: DataFrame, least_docs: int) -> DataFrame:
    """``(h1, h2, n_docs, n_lines, last)``: keys that at least ``least_docs`` documents hold, and the largest id among them."""
    per_doc = found.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
    per_key = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("id").alias("last"))
    return per_key.filter(F.col("n_docs") >= least_docs)


def dropped(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``(id, row, gone)``: for each text that loses lines, their positions from 0."""
    found = written(occurrences(docs, least_chars))
    keys = written(frequent(found, least_docs))
    total = keys.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.col("n_lines") * HOT > total
    last = keys.filter(hot).select("h1", "h2", "last"), keys.filter(~hot).select("h1", "h2", "last")
    met = found.join(F.broadcast(last[0]), ["h1", "h2"]).unionByName(found.join(last[1], ["h1", "h2"]))
    return written(met.filter("id <> last").groupBy("id", "row").agg(F.collect_set("pos").alias("gone")))


def _reassembled(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``(doc, n_lines, n_dropped, kept)``: each row of ``docs``, its lines and what is left of its text; a null text stays null."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"))
    met = keyed.join(gone, ["id", "row"], "left").withColumn("lines", lines_of(F.col("doc.text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(left, lambda at: F.element_at("lines", at + 1)), "\n"))
    return met.select("doc", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def drop_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` with the text that is left; all rows and columns stay."""
    cut = _reassembled(docs, dropped(docs, least_chars, least_docs))
    return cut.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    cut = _reassembled(docs, dropped(docs, least_chars, least_docs))
    return cut.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))

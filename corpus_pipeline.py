"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated passages are cut, sources are
mixed to target weights, and the texts are encoded.

Each stage takes the whole of what the one before it kept, as a Parquet table, and all but the last return the columns
of ``documents``. Rows with a null ``doc_id`` and null or empty texts pass every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import base, minhash, mixing, pieces, substrings, toxicity
from pagequarry.llm.queries import MIX, MIX_REST

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """A stage that sets what its operators rely on, such as the size of Arrow batches, also when it is called alone."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(base.prepare(spark), docs, sf_dir)

    return run_stage


#: A document with this toxicity score or more is rejected.
TOXIC = 0.7
#: Similarity of near duplicates, per cent of the union of their five-word shingles.
SIMILAR = 80
#: Words of a passage that is cut when an earlier document has it.
PASSAGE = 13


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, learned from ``labels``, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.reject(docs, toxicity.train(docs, labels), TOXIC)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class."""
    return minhash.keep_one(docs, SIMILAR)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a document with a smaller id has; ``n_chars`` follows the text."""
    cut = substrings.drop_repeats(docs, PASSAGE)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text"))).select(*docs.columns) if "n_chars" in docs.columns else cut


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the schedule. Spark's scan does not keep the order of files: :func:`encoded` gives it as columns."""
    return mixing.in_order(docs, MIX, MIX_REST)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, slot, block, deadline, n_tokens, ids)``: the mixture is the order of ``slot``.

    The schedule follows from ids and sources alone, so it is derived again here instead of being taken from the files.
    """
    placed = mixing.place(docs.select("doc_id", "lang", "source", "text"), MIX, MIX_REST)
    timed = placed.select("doc_id", "lang", "source", F.col("_slot").alias("slot"), F.col("_block").alias("block"), F.col("_due").alias("deadline"), "text")
    return pieces.encode(timed, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source", "slot", "block", "deadline"))


STAGES = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The stages learn models and build components, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    base.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = base.written(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

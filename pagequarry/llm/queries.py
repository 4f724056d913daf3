"""The registered queries of these operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import base

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(base.prepare(spark), sf)

    run.__doc__ = fn.__doc__
    _REGISTRY[fn.__name__] = run
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _labels(spark: SparkSession, sf: str, label: str) -> DataFrame:
    return _table(spark, sf, "labels").select("doc_id", F.col(label).alias("label"))


def _learned_from(df: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return df.filter(~base.held_out("doc_id", modulus, remainder))


@query
def op1_language_id(spark, sf):
    """Language of every text; profiles come from rows with crc32(doc_id) mod 3 other than 1."""
    from pagequarry.llm import language_id as L

    docs = _table(spark, sf, "documents")
    profile = L.profiles(_learned_from(docs, 3, 1))
    return L.identify(docs, profile).withColumn("held_out", base.held_out("doc_id", 3, 1)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_quality(spark, sf):
    """Quality score of every text; learned from rows with crc32(doc_id) mod 4 other than 2."""
    from pagequarry.llm import quality as Q

    docs = _table(spark, sf, "documents")
    model = Q.train(_learned_from(docs, 4, 2), _learned_from(_labels(spark, sf, "quality"), 4, 2))
    return Q.score(docs, model).withColumn("held_out", base.held_out("doc_id", 4, 2)).select("doc_id", "held_out", "score", "predicted")


@query
def op9_toxicity(spark, sf):
    """Toxicity score and spans of every text; learned from rows with crc32(doc_id) mod 3 other than 1."""
    from pagequarry.llm import toxicity as T

    docs = _table(spark, sf, "documents")
    model = T.train(_learned_from(docs, 3, 1), _learned_from(_labels(spark, sf, "toxic"), 3, 1))
    return T.score(docs, model).withColumn("held_out", base.held_out("doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted", "spans")


@query
def op10_token_counts(spark, sf):
    """Tokens of every text and of each of its prefixes by the 50k byte-level vocabulary."""
    import public_tokenizers

    from pagequarry.llm import token_counts as C

    return C.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024, prefixes=True)


@query
def op8_minhash(spark, sf):
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    from pagequarry.llm import minhash as M

    return M.near_duplicates(_table(spark, sf, "documents"), threshold=85, size=5)


@query
def op4_substrings(spark, sf):
    """Words of each document left after repeats of 13 words or more are removed."""
    from pagequarry.llm import substrings as S

    return S.digests(_table(spark, sf, "documents"), size=13)


#: Target weights of the mixture: one large source held back, four preferred, the others even.
MIX = {"src0": 0.15, **{f"src{k}": 0.1 for k in range(1, 5)}, **{f"src{k}": 0.028 for k in range(5, 20)}}
MIX_REST = 0.03


@query
def op2_mixing(spark, sf):
    """Slot of every document in the mixture of sources."""
    from pagequarry.llm import mixing as X

    placed = X.place(_table(spark, sf, "documents").select("doc_id", "source"), MIX, MIX_REST)
    return placed.select("doc_id", "source", F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_due").alias("deadline"), F.col("_slot").alias("slot"))


@query
def op5_nearest(spark, sf):
    """Five nearest vectors of every 50th vector."""
    from pagequarry.llm import nearest as N

    vectors = _table(spark, sf, "embeddings")
    return N.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query
def op3_embedding_duplicates(spark, sf):
    """Links and classes of vectors of one label with a cosine of 0.98 or more."""
    from pagequarry.llm import hamming as H

    return H.links(_table(spark, sf, "embeddings"), least=0.98)


@query
def op7_pieces(spark, sf):
    """Ids of every text by the 32k vocabulary, and whether they decode to the text."""
    import public_tokenizers

    from pagequarry.llm import pieces as S

    return S.encode_and_check(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_line_dedup(spark, sf):
    """Lines left in each document after those of 40 characters or more that five documents share are dropped from all but the last."""
    from pagequarry.llm import lines as N

    return N.digests(_table(spark, sf, "documents"), least_chars=40, least_docs=5)


@query
def op12_whitening(spark, sf):
    """Every vector on the first four whitened components."""
    from pagequarry.llm import whitening as W

    return W.whiten(_table(spark, sf, "embeddings"), components=4)


@query
def op13_lexical_search(spark, sf):
    """The ten best documents for each item of ``benchmark``."""
    from pagequarry.llm import lexical as S

    return S.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=10)


@query
def pipeline(spark, sf):
    """The stages of ``corpus_pipeline.py`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)

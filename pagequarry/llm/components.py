"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import written


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; the component is the smallest id that links lead to.

    Each round hangs every id's neighbours on the smallest id among them, first the larger ones, then the smaller ones.
    Rounds grow with the logarithm of the longest path. Round tables go to the shared folder, so a lost executor costs
    one round at most. Minima are combined before each shuffle, so an id with very many links is no problem.
    """
    edges = written(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct())
    before = _mark(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)))
        after = _mark(edges)
        if after == before:
            break
        before = after
    hung = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return written(hung.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    edges = written(edges)
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()

"""Page sources: crawled pages and pasted content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import trim


def read_pages(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """``(page_id, url, html)`` from parquet, failed responses left out."""
    return clean_pages(spark.read.parquet(path), max_chars)


def clean_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The fetch rules on a page table; ``status`` (HTTP status) is honoured where the table has it.

    Bodies are whole; ``max_chars=rules.MAX_HTML_CHARS`` cuts them where a fetcher would have.
    """
    if "status" in pages.columns:
        pages = pages.filter(F.col("status").between(200, 299))
    return pages.select("page_id", "url", (F.substring("html", 1, max_chars) if max_chars else F.col("html")).alias("html"))


def paste_to_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pasted text as pages: markup is kept, plain text is wrapped; the hash is of the raw paste."""
    raw = F.col(text)
    html = F.when(trim(raw).startswith("<"), raw).otherwise(F.concat(F.lit("<html><body>"), raw, F.lit("</body></html>")))
    return docs.filter(F.length(raw) > 0).select(
        F.col(key).alias("page_id"), F.lit("").alias("url"), html.alias("html"), F.md5(raw).alias("content_hash")
    )

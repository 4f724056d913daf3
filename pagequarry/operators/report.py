"""The combined result of a page, and its Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import not_blank
from pagequarry.operators.scoring import ENTITY, RECOMMENDATION


def assemble_results(
    pages: DataFrame, entities: DataFrame, generated: DataFrame | None = None, fanout: DataFrame | None = None
) -> DataFrame:
    """One record per page from its parts; a missing part gives defaults, so partial results survive a failed step.

    ``pages(page_id, url, main_topic, …)``, ``entities(page_id, entities)``, ``generated(page_id, jsonld,
    recommendations, salience, tips, irrelevant)``, ``fanout(page_id, analysis, chunks_extracted, error)``.
    """
    out = pages.join(entities.select("page_id", "entities"), "page_id", "left")
    generated = generated if generated is not None else _nothing(pages, GENERATED)
    fanout = fanout if fanout is not None else _nothing(pages, FANOUT)
    out = out.join(generated.select("page_id", *GENERATED), "page_id", "left").join(fanout.select("page_id", *FANOUT), "page_id", "left")
    ms = F.coalesce("processing_time_ms", F.lit(0)) if "processing_time_ms" in pages.columns else F.lit(0)
    cached = F.coalesce("cached", F.lit(False)) if "cached" in pages.columns else F.lit(False)
    return out.select(
        "page_id",
        "url",
        F.coalesce("main_topic", F.lit("")).alias("main_topic"),
        F.coalesce("entities", F.array().cast(f"array<{ENTITY.simpleString()}>")).alias("entities"),
        F.coalesce("jsonld", F.lit("{}")).alias("jsonld"),
        F.coalesce("recommendations", F.array().cast(RECOMMENDATION)).alias("recommendations"),
        F.coalesce("salience", F.lit(0)).alias("salience"),
        F.coalesce("tips", F.array().cast("array<string>")).alias("tips"),
        F.coalesce("irrelevant", F.array().cast("array<string>")).alias("irrelevant"),
        "analysis",
        "chunks_extracted",
        "error",
        ms.alias("processing_time_ms"),
        cached.alias("cached"),
    )


GENERATED = {
    "jsonld": "string", "recommendations": RECOMMENDATION, "salience": "int", "tips": "array<string>", "irrelevant": "array<string>",
}
FANOUT = {"analysis": "string", "chunks_extracted": "int", "error": "string"}


def _nothing(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    return pages.filter(F.lit(False)).select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def _block(heading: str, lines: Column, wanted: Column) -> Column:
    """A section with a blank line after its heading and after its lines; nothing when not wanted."""
    return F.when(wanted, F.concat(F.array(F.lit(heading), F.lit("")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def report(results: DataFrame) -> DataFrame:
    """``(page_id, report)``: a Markdown report per page."""
    dash = lambda c: F.coalesce(not_blank(c), F.lit("-"))
    header = F.array(
        F.lit("# Analysis Report"),
        F.lit(""),
        F.concat(F.lit("**Processing Time:** "), F.col("processing_time_ms").cast("string"), F.lit("ms")),
        F.concat(F.lit("**Main Topic:** "), F.coalesce(not_blank(F.col("main_topic")), F.lit("N/A"))),
        F.concat(F.lit("**Salience Score:** "), F.col("salience").cast("string")),
        F.concat(F.lit("**Cached:** "), F.when(F.col("cached"), F.lit("Yes")).otherwise(F.lit("No"))),
        F.lit(""),
    )
    row = lambda e: F.concat(
        F.lit("| "), e["name"], F.lit(" | "), e["type"], F.lit(" | "), e["confidence"].cast("string"), F.lit("% | "),
        dash(e["wikipedia_url"]), F.lit(" | "), dash(e["wikidata_url"]), F.lit(" |"),
    )
    table = F.concat(
        F.array(F.lit("| Name | Type | Confidence | Wikipedia | Wikidata |"), F.lit("|------|------|-----------|-----------|----------|")),
        F.transform("entities", row),
    )
    advice = F.transform(
        "recommendations",
        lambda r, i: F.concat(
            (i + 1).cast("string"), F.lit(". "),
            F.coalesce(F.concat(F.lit("**["), not_blank(r["category"]), F.lit("]** ")), F.lit("")), r["advice"],
        ),
    )
    tips = F.transform("tips", lambda t: F.concat(F.lit("- "), t))
    outcome = (
        F.when(not_blank(F.col("error")).isNotNull(), F.concat(F.lit("> **Fan-out unavailable:** "), "error"))
        .when(not_blank(F.col("analysis")).isNotNull(), F.col("analysis"))
        .otherwise(F.lit("> No fan-out analysis was generated."))
    )
    fanout = F.array(F.concat(F.lit("Semantic chunks extracted: "), F.col("chunks_extracted").cast("string")), F.lit(""), outcome)
    lines = F.concat(
        header,
        _block("## Entities", table, F.size("entities") > 0),
        _block("## JSON-LD", F.array(F.lit("```json"), F.col("jsonld"), F.lit("```")), F.col("jsonld") != "{}"),
        _block("## Recommendations", advice, F.size("recommendations") > 0),
        _block("## Salience Tips", tips, F.size("tips") > 0),
        _block("## Fan-out Analysis", fanout, F.col("chunks_extracted").isNotNull()),
    )
    return results.select("page_id", F.array_join(lines, "\n").alias("report"))


def write_reports(results: DataFrame, path: str, buckets: int = 64) -> None:
    """Reports as JSON lines ``{page_id, report}`` in folders by page bucket: one readable file set, any number of pages."""
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    report(results).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").json(path)

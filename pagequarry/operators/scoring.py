"""Salience, irrelevant entities, tips, recommendations, bands.

These work on one row per page: ``entities`` is an array of structs ``(name, type, confidence, wikipedia_url, …)`` in
input order, next to the page text. :func:`page_entities` builds that row; the rest are column expressions, so the page
is shuffled once, when its entities come home.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import rules
from pagequarry.functions import text as X

ENTITY = T.StructType(
    [T.StructField("pos", T.IntegerType())]
    + [
        T.StructField(n, T.StringType())
        for n in ("name", "type", "wikipedia_url", "wikidata_url", "google_kg_url", "product_ontology_url", "linkedin_url")
    ]
    + [T.StructField("confidence", T.IntegerType())]
)


def entities_by_page(linked: DataFrame) -> DataFrame:
    """``(page_id, entities)`` in input order. A page's list is as long as its mentions: the extraction's cap, or its text, bounds it."""
    if "linkedin_url" not in linked.columns:
        linked = linked.withColumn("linkedin_url", F.lit(None))
    row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTITY.fields])
    return linked.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("entities"))


def page_entities(pages: DataFrame, linked: DataFrame) -> DataFrame:
    """``pages`` plus ``entities`` (an empty array where the page has none)."""
    empty = F.array().cast(T.ArrayType(ENTITY))
    return pages.join(entities_by_page(linked), "page_id", "left").withColumn("entities", F.coalesce("entities", empty))


def salience_score(entities: Column) -> Column:
    """Half average confidence, 35 % share of 85 or more, 15 % share with a graph id; 0 without entities."""
    n = F.size(entities)
    total = F.aggregate(entities, F.lit(0), lambda acc, e: acc + e["confidence"])
    high = F.size(F.filter(entities, lambda e: e["confidence"] >= 85))
    graph = F.size(F.filter(entities, lambda e: F.coalesce(F.contains(e["google_kg_url"], F.lit("kgmid=")), F.lit(False))))
    score = total / n * 0.5 + high / n * 100 * 0.35 + graph / n * 100 * 0.15
    return F.when(n == 0, F.lit(0)).otherwise(X.js_round(score)).cast("int")


def salience_by_row(linked: DataFrame) -> DataFrame:
    """The same from entity rows: ``(page_id, salience)``; the sums are combined before the shuffle."""
    graph = F.coalesce(F.contains("google_kg_url", F.lit("kgmid=")), F.lit(False)).cast("int")
    score = (
        F.sum("confidence") / F.count("*") * 0.5
        + F.sum((F.col("confidence") >= 85).cast("int")) / F.count("*") * 100 * 0.35
        + F.sum(graph) / F.count("*") * 100 * 0.15
    )
    return linked.groupBy("page_id").agg(X.js_round(score).alias("salience"))


def topic_patterns(topic: Column) -> Column:
    """Relevance regex of the first topic group that applies, NULL if none does."""
    low = F.lower(F.coalesce(topic, F.lit("")))
    out = F.lit(None).cast("string")
    for needles, patterns in reversed(rules.TOPIC_PATTERNS):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(low, F.lit(needle))
        out = F.when(hit, F.lit("|".join(patterns))).otherwise(out)
    return out


def _topic_relevant(topic: Column, name: Column) -> Column:
    """Does ``name`` match the patterns of the topic's group? NULL when the topic has no group."""
    low = F.lower(F.coalesce(topic, F.lit("")))
    out = F.lit(None).cast("boolean")
    for needles, patterns in reversed(rules.TOPIC_PATTERNS):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(low, F.lit(needle))
        out = F.when(hit, X.hits_any(name, patterns)).otherwise(out)
    return out


def irrelevant_entities(entities: Column, title: Column, headings: Column, body: Column, topic: Column) -> Column:
    """Names below confidence 80 that the page hardly mentions, or that do not fit its topic."""
    low = F.struct(
        F.lower(body).alias("body"), F.lower(title).alias("title"), F.transform(headings, lambda h: F.lower(h["text"])).alias("headings")
    )
    return X.let(low, lambda page: _irrelevant(entities, page, topic))


def _irrelevant(entities: Column, page: Column, topic: Column) -> Column:
    low_topic = F.lower(F.coalesce(topic, F.lit("")))
    seo_topic = F.contains(low_topic, F.lit("seo")) | F.contains(low_topic, F.lit("search"))

    def irrelevant(e: Column) -> Column:
        return X.let(F.lower(e["name"]), lambda name: judge(e, name))

    def judge(e: Column, name: Column) -> Column:
        named = X.contains(page["title"], name) | F.exists(page["headings"], lambda h: F.contains(h, name))
        absent = ~named & (X.count_occurrences(page["body"], name) <= 1)
        relevant = _topic_relevant(topic, name)
        example = seo_topic & X.hits(name, rules.EXAMPLE_SCHOOL) & ~X.hits(name, rules.SEO_NAME)
        off_topic = relevant.isNotNull() & (((e["confidence"] < 40) & ~relevant) | example)
        return (e["confidence"] < 80) & (absent | F.coalesce(off_topic, F.lit(False)))

    return F.transform(F.filter(entities, irrelevant), lambda e: e["name"])


def salience_tips(entities: Column, topic: Column, irrelevant: Column) -> Column:
    """Two or three tips in order."""
    topic = F.coalesce(topic, F.lit(""))
    subject = F.get(F.filter(entities, lambda e: F.lower(e["name"]) == F.lower(topic)), F.lit(0))
    is_person = F.coalesce(subject["type"] == "Person", F.lit(False))
    context = F.transform(F.filter(entities, lambda e: e["type"].isin(*rules.CONTEXT_TYPES)), lambda e: e["name"])

    def fill(template: str, value: Column) -> Column:
        before, after = template.split("%s")
        return F.concat(F.lit(before), value, F.lit(after))

    middle = F.when(is_person, F.when(F.size(context) > 0, fill(rules.TIP_CONTEXT, F.array_join(context, ", ")))).otherwise(
        F.when(F.size(irrelevant) > 0, fill(rules.TIP_ALIGN, F.array_join(irrelevant, ", ")))
    )
    return F.array_compact(F.array(fill(rules.TIP_FREQUENCY, topic), middle, fill(rules.TIP_DETAIL, topic)))


RECOMMENDATION = "array<struct<category:string,advice:string>>"


def recommend_basic(entities: Column, title: Column, description: Column, headings: Column, body: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """The first ``limits.recommendations`` rule-based recommendations of a page."""
    before, after = rules.ADVICE_ENTITY[1].split("%s")
    rare = X.let(F.lower(body), lambda low: F.filter(entities, lambda e: X.count_occurrences(low, F.lower(e["name"])) <= 1))
    per_entity = F.transform(
        X.head(rare, limits.recommendations),
        lambda e: F.struct(F.lit(rules.ADVICE_ENTITY[0]).alias("category"), F.concat(F.lit(before), e["name"], F.lit(after)).alias("advice")),
    )

    def advice(pair: tuple[str, str], needed: Column) -> Column:
        return F.when(needed, F.struct(F.lit(pair[0]).alias("category"), F.lit(pair[1]).alias("advice")))

    page_level = F.array_compact(
        F.array(
            advice(rules.ADVICE_TITLE, F.coalesce(title, F.lit("")) == ""),
            advice(rules.ADVICE_DESCRIPTION, F.coalesce(description, F.lit("")) == ""),
            advice(rules.ADVICE_H1, ~F.exists(headings, lambda h: h["level"] == 1)),
            advice(rules.ADVICE_FEW, F.size(entities) < 3),
        )
    )
    found = F.concat(per_entity.cast(RECOMMENDATION), page_level.cast(RECOMMENDATION))
    general = F.array(F.struct(F.lit(rules.ADVICE_NONE[0]).alias("category"), F.lit(rules.ADVICE_NONE[1]).alias("advice")))
    return X.let(found, lambda f: X.head(F.when(F.size(f) > 0, f).otherwise(general.cast(RECOMMENDATION)), limits.recommendations))


# ── recommendation requests and responses ─────────────────────────────────────

DEFAULT_RECOMMENDATION_PROMPT = (
    "You advise on semantic search optimisation. Read the page summary and its main entities and recommend how to "
    "improve its topical depth and authority.\n\n**Page Text Summary:**\n"
)
DEFAULT_RECOMMENDATION_TASK = (
    "\n\n**Your Task:**\nReturn only a JSON object with one key, `recommendations`: an array of objects with the keys "
    "`category` (for example 'Semantic Gaps', 'Content Depth', 'Strategic Guidance') and `advice`. Focus on content, "
    "missing entities and strategy; do not recommend structured data that is already there."
)


def schema_context(jsonld: Column) -> Column:
    """What structured data the page already has, as prompt text; only top-level keys count. Empty if nothing."""
    main = F.get_json_object(jsonld, "$.mainEntity")
    items = F.from_json(
        F.when(main.startswith("["), main).when(main.startswith("{"), F.concat(F.lit("["), main, F.lit("]"))),
        "array<map<string,string>>",
    )
    own = F.get_json_object(jsonld, "$['@type']")
    types = F.array_distinct(
        F.array_compact(F.concat(F.array(X.not_blank(own)), F.coalesce(F.transform(items, lambda i: X.not_blank(i["@type"])), F.array())))
    )
    present = [
        F.when(F.coalesce(F.get_json_object(jsonld, f"$.{key}"), F.lit("")) != "", F.lit(label)) for key, label in rules.CONTEXT_FEATURES
    ]
    features = F.array_compact(F.array(*present))
    lines = F.array_compact(
        F.array(
            F.when(F.size(types) > 0, F.concat(F.lit("Schema types: "), F.array_join(types, ", "))),
            F.when(F.size(features) > 0, F.concat(F.lit("Features: "), F.array_join(features, ", "))),
        )
    )
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(
        F.concat(F.lit(rules.CONTEXT_HEAD), F.array_join(lines, "\n"), F.lit(rules.CONTEXT_TAIL))
    )


def recommendation_requests(
    pages: DataFrame, prompt: str = DEFAULT_RECOMMENDATION_PROMPT, task: str = DEFAULT_RECOMMENDATION_TASK, limits: rules.Limits = rules.LIMITS
) -> DataFrame:
    """One request per page: the start of the body, the first entities above 50, the schema context; ``limits`` says how much.

    ``pages`` has ``page_id``, ``body``, ``entities`` and ``jsonld``.
    """
    top = X.head(F.filter("entities", lambda e: e["confidence"] > 50), limits.request_entities)
    settings = rules.EXTRACTION_MODEL
    return pages.select(
        "page_id",
        F.concat(
            F.lit(prompt),
            X.cut(F.col("body"), limits.request_chars),
            F.lit("...\n\n**Most Salient Topical Entities Identified:**\n"),
            F.array_join(F.transform(top, lambda e: e["name"]), ", "),
            schema_context(F.col("jsonld")),
            F.lit(task),
        ).alias("prompt"),
        F.lit(settings["model"]).alias("model"),
        F.lit(settings["max_tokens"]).alias("max_tokens"),
        F.lit(settings["temperature"]).alias("temperature"),
    )


def parse_recommendations(body: Column, fallback: Column) -> Column:
    """``recommendations`` of a response, all of them; ``fallback`` when the response is missing or unusable."""
    parsed = F.from_json(body, f"recommendations {RECOMMENDATION}")["recommendations"]
    return F.coalesce(parsed.cast(RECOMMENDATION), fallback.cast(RECOMMENDATION))


def recommendation_rows(pages: DataFrame, column: str = "recommendations") -> DataFrame:
    """``(page_id, rank, category, advice)``."""
    return pages.select("page_id", F.posexplode_outer(column).alias("rank", "r")).filter("rank IS NOT NULL").select(
        "page_id", (F.col("rank") + 1).alias("rank"), "r.category", "r.advice"
    )


def confidence_band(score: Column) -> Column:
    return F.when(score >= 70, F.lit("high")).when(score >= 40, F.lit("medium")).otherwise(F.lit("low"))


def salience_band(score: Column) -> Column:
    out = F.lit("Limited")
    for floor, label in reversed(rules.SALIENCE_BANDS):
        out = F.when(score >= floor, F.lit(label)).otherwise(out)
    return out


def score_bands(linked: DataFrame, salience: DataFrame) -> DataFrame:
    """Corpus distribution ``(kind, band, n)`` of entity confidence and page salience."""
    entity = linked.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))
    page = salience.groupBy(salience_band(F.col("salience")).alias("band")).agg(F.count("*").alias("n"))
    return entity.select(F.lit("confidence").alias("kind"), "band", "n").unionByName(
        page.select(F.lit("salience").alias("kind"), "band", "n")
    )

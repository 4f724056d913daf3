"""Entity mentions: pattern extraction, response parsing, aliases."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import rules
from pagequarry.functions import text as X
from pagequarry.functions.skew import spread_join

#: Letters one by one: a set of characters is a table, ranges are tested in turn.
_LETTERS = string.ascii_letters
_WORD = rf"[A-Z][{_LETTERS}&]+"
_EDGE = X.BOUNDARY
#: A run of capitalised words. The loop is possessive: a page-long run costs one pass and no stack. A boundary before a
#: word character only has to look back. The look-ahead keeps a word that can end the phrase in sight: one capital with
#: ampersands cannot end it, but may stand inside.
PHRASE = rf"(?<!\w)(?:{_WORD}{X.SPACE}+(?=(?:[A-Z]&+{X.SPACE}+)*+{_WORD}{_EDGE}))*+{_WORD}{_EDGE}"
_ANY = rf"[{_LETTERS}][{_LETTERS}]+"
_SUFFIX = "(?:" + "|".join(rules.PRODUCT_SUFFIXES) + ")"
#: A run of words, for :func:`product_names`.
WORD_RUN = rf"(?<!\w){_ANY}(?:{X.SPACE}++{_ANY}+)*+\w*+"


def capitalised_phrases(text: Column) -> Column:
    """Runs of capitalised words, trimmed length 3 to 49, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), X.trim)
    return F.filter(found, lambda p: F.length(p).between(3, 49))


def product_names(text: Column) -> Column:
    """Words up to and including a product suffix; case is ignored, so ordinary words are captured as well.

    One greedy match runs from the start of a run of words to the last suffix in it. The run is found first, with a
    possessive loop, and cut at the last suffix: the same matches as backtracking over the run, in linear time.
    """
    runs = F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))
    upto = F.transform(runs, lambda r: F.regexp_extract(r, rf"(?is)^(.*{X.SPACE}{_SUFFIX}){_EDGE}", 1))
    return F.filter(F.transform(upto, X.trim), lambda p: p != "")


def is_common(name: Column) -> Column:
    """A stop word (exact case), digits only, or one or two capital letters."""
    return name.isin(*rules.COMMON_WORDS) | X.hits_any(name, (r"^\d+$", r"^[A-Z]$", r"^[A-Z]\s*[A-Z]$"), "")


def candidate_names(text: Column) -> Column:
    """Distinct names in first-seen order, phrases before product names, common words left out.

    ``array_distinct`` keeps first occurrences in order, so the page's list never leaves its row.
    """
    names = F.array_distinct(F.concat(capitalised_phrases(text), product_names(text)))
    return F.filter(names, lambda n: ~is_common(n))


def leading_names(text: Column, cap: int | None = rules.MAX_MENTIONS) -> Column:
    """The first ``cap`` candidate names, all of them for ``None``; the default is the reference behaviour."""
    names = candidate_names(text)
    return names if cap is None else F.slice(names, 1, cap)


def mentions(pages: DataFrame, text: Column | str = "full_text", cap: int | None = rules.MAX_MENTIONS) -> DataFrame:
    """``(page_id, pos, name)``: the first ``cap`` names of each page (``None``: all), ``pos`` from 0."""
    text = F.col(text) if isinstance(text, str) else text
    return _one_by_one(pages.select("page_id", leading_names(text, cap).alias("names")))


def _one_by_one(pages: DataFrame) -> DataFrame:
    """A row with ``pos`` and ``name`` for each of ``names``. A plain explode would have the names found twice, the first time to see whether there are any."""
    rest = [c for c in pages.columns if c != "names"]
    return pages.select(*rest, F.posexplode_outer("names").alias("pos", "name")).filter("pos IS NOT NULL")


# ── extraction requests and responses ─────────────────────────────────────────

DEFAULT_EXTRACTION_PROMPT = """List the entities on this web page and name its main topic.

Main topic: the primary service, product or subject in 2-6 words, with the location if the service is tied to one.
Entities: 15-20 names of 1-4 words that are notable enough for an encyclopedia article (companies, brands, people,
places, products, technologies, well-defined concepts). Leave out abstract virtues, generic business terms, template
elements and research papers, and do not add qualifiers that are not part of the name.

Return JSON format:
{"main_topic": "...", "entities": ["Entity 1", "Entity 2", ...]}

Content:
"""


def extraction_requests(pages: DataFrame, prompt: str = DEFAULT_EXTRACTION_PROMPT, chars: int | None = rules.EXTRACTION_TEXT_CHARS) -> DataFrame:
    """One request row per content hash: prompt plus the first ``chars`` characters (``None``: all), and the model settings.

    ``pages`` holds cache misses, ``(content_hash, full_text)``; pages that share a hash share the request.
    """
    settings = rules.EXTRACTION_MODEL
    return pages.groupBy("content_hash").agg(
        F.min(F.substring("full_text", 1, chars) if chars else F.col("full_text")).alias("content")
    ).select(
        "content_hash",
        F.concat(F.lit(prompt), "content").alias("prompt"),
        F.lit(settings["model"]).alias("model"),
        F.lit(settings["max_tokens"]).alias("max_tokens"),
        F.lit(settings["temperature"]).alias("temperature"),
    )


_USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
_ENVELOPE = T.StructType(
    [
        T.StructField(
            "choices",
            T.ArrayType(T.StructType([T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))])),
        ),
        T.StructField("usage", _USAGE),
    ]
)
_CONTENT = T.StructType(
    [T.StructField("main_topic", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType()))]
)


def parse_extraction(responses: DataFrame) -> DataFrame:
    """Response bodies to topic, names, confidence, tokens and cost; NULL names mark an unusable response."""
    envelope = responses.withColumn("e", F.from_json("body", _ENVELOPE))
    usage = F.col("e.usage")
    given = [F.coalesce(usage[n], F.lit(0)) for n in ("prompt_tokens", "completion_tokens")]
    valid = F.col("c.entities").isNotNull()
    spent = valid & usage.isNotNull()
    cost = given[0] * F.lit(rules.USD_PER_INPUT_TOKEN) + given[1] * F.lit(rules.USD_PER_OUTPUT_TOKEN)
    return envelope.withColumn("c", F.from_json(F.get("e.choices", F.lit(0))["message"]["content"], _CONTENT)).select(
        "content_hash",
        F.when(valid, F.coalesce("c.main_topic", F.lit(""))).alias("main_topic"),
        F.when(valid, F.lit(rules.EXTRACTION_CONFIDENCE)).alias("confidence"),
        F.col("c.entities").alias("names"),
        F.when(spent, F.coalesce(usage["total_tokens"], given[0] + given[1])).alias("tokens"),
        F.when(spent, cost).alias("cost_usd"),
    )


def extract_entities(pages: DataFrame, extracted: DataFrame | None = None, cap: int | None = rules.MAX_MENTIONS) -> DataFrame:
    """``pages`` with ``main_topic``, ``confidence`` and ``names``: the parsed response if usable, else the patterns.

    ``pages`` has ``page_id``, ``content_hash`` and ``full_text``; its other columns are kept. Pages that share a hash
    share the response; a hash that many pages share is spread over tasks. ``cap`` limits the names found by pattern.
    """
    by_pattern = leading_names(F.col("full_text"), cap)
    if extracted is None:
        return pages.select("*", F.lit("").alias("main_topic"), F.lit(0.0).alias("confidence"), by_pattern.alias("names"))
    usable = extracted.filter(F.col("names").isNotNull()).select("content_hash", "main_topic", "confidence", "names")
    return spread_join(pages, usable, ["content_hash"], "page_id").select(
        *pages.columns,
        F.coalesce("main_topic", F.lit("")).alias("main_topic"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("names").isNotNull(), F.col("names")).otherwise(by_pattern).alias("names"),
    )


def explode_names(extracted: DataFrame) -> DataFrame:
    """``(page_id, main_topic, pos, name)`` from :func:`extract_entities`."""
    return _one_by_one(extracted.select("page_id", "main_topic", "names"))


def cost_rollup(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and cost per ``keys`` and overall: ``calls`` has ``tokens`` and ``cost_usd``."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")
    )


# ── aliases ───────────────────────────────────────────────────────────────────


def alias_table(spark: SparkSession) -> DataFrame:
    """``(alias, canonical, variants)``: for every alias the first group that holds it. Fixed size."""
    seen: dict[str, tuple[str, list[str]]] = {}
    for key, aliases in rules.SYNONYMS:
        for alias in aliases:
            seen.setdefault(alias, (key, list(aliases)))
    rows = [(alias, key, variants) for alias, (key, variants) in seen.items()]
    return spark.createDataFrame(rows, "alias string, canonical string, variants array<string>")


def canonical_entities(names: DataFrame) -> DataFrame:
    """Adds ``canonical`` (the alias group's key, else the lower-case name) and ``variants``."""
    lowered = X.trim(F.lower("name"))
    aliases = alias_table(names.sparkSession)
    return names.withColumn("_alias", lowered).join(
        F.broadcast(aliases.withColumnRenamed("alias", "_alias")), "_alias", "left"
    ).select(
        *names.columns,
        F.coalesce("canonical", "_alias").alias("canonical"),
        F.coalesce("variants", F.array("_alias")).alias("variants"),
    )


def entity_variants(names: DataFrame) -> DataFrame:
    """One row per variant of each name, ``pos`` in list order."""
    columns = [c for c in names.columns]
    return canonical_entities(names).select(*columns, F.posexplode("variants").alias("variant_pos", "variant"))


def main_topic(
    title: Column, text: Column, names: Column, service_type: Column | None = None, strategy: str = "strict"
) -> Column:
    """The page's topic where the response gave none. Strategies: ``strict``, ``title``, ``frequent``, ``pattern``."""
    from_title = X.name_from_title(title)
    ordered = F.transform(names, lambda n, i: F.struct((-i).alias("early"), n.alias("name")))

    def counted(some: Column) -> Column:
        hits = lambda low, n: X.count_occurrences(low, F.lower(n)).alias("hits")
        return X.let(F.lower(text), lambda low: F.transform(some, lambda c: F.struct(hits(low, c["name"]), c["early"], c["name"])))

    if strategy == "title":
        return from_title
    if strategy == "frequent":
        return F.coalesce(F.array_max(counted(ordered))["name"], from_title)
    if strategy == "pattern":
        found = F.nullif(service_type, F.lit(rules.DEFAULT_SERVICE_TYPE))
        return F.coalesce(found, from_title)
    # Only names of the title can win, so only they are counted.
    titled = F.filter(ordered, lambda c: F.contains(F.lower(title), F.lower(c["name"])))
    return F.coalesce(F.array_max(counted(titled))["name"], from_title)



"""Entity linking against knowledge-base snapshot tables.

Candidates, scores and best matches are computed once per distinct name. Only two things depend on the page topic:
person-shaped names (their match must fit the topic) and the name "academic programs"; every other name is linked with
an empty topic key, so a name that fills a third of the mentions is linked once.

Snapshot tables: ``kb_pages(title, url, extract, wikibase_item, rank)``, ``kb_items(id, label, description, p31, rank,
lookup)``, ``kg_entries(mid, name, description, rank, lookup)``, ``known_urls(url)``. ``lookup`` is the text the entry is
found by; ``rank`` is its order among hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X
from pagequarry.functions.skew import spread_join

#: Entries that a search term finds unless asked otherwise.
HITS_PER_SEARCH = 5


@dataclass(frozen=True)
class KnowledgeBase:
    """The four snapshot tables, and where they were built, stored search indexes by ``pages``, ``items`` and ``graph``."""

    pages: DataFrame
    items: DataFrame
    graph: DataFrame
    urls: DataFrame
    index: Mapping[str, SearchIndex] = field(default_factory=dict)


@dataclass(frozen=True)
class SearchIndex:
    """A stored :func:`search_index`, bucketed and sorted by key: a search shuffles its terms, never the snapshot."""

    table: DataFrame
    hits: int


# ── which names are linked, and their base score ──────────────────────────────


def is_skipped(name: Column) -> Column:
    """More than five words, a template or generic word, or one of the non-entity patterns."""
    low, count = F.lower(name), F.size(X.words(name))
    return (
        (count > 5)
        | low.isin(*rules.TEMPLATE_ENTITIES)
        | ((count == 1) & low.isin(*rules.GENERIC_SINGLE_WORDS))
        | X.hits_any(low, rules.UNLIKELY_ENTITIES)
        | X.hits_any(low, rules.NON_ENTITIES)
    )


def base_score(mentions: DataFrame, batch_size: int | None = rules.BATCH_SIZE, most: int | None = rules.MAX_LINKED) -> DataFrame:
    """Adds ``batch`` and ``base`` to ``(page_id, pos, name, …)``; skipped and cached names drop out.

    ``(n - i) / n * 70`` with the position among the names that remain in the batch. ``batch_size=None`` takes the
    whole page as one batch. ``most`` names of a batch are linked (``None``: all). A ``cached`` column, where present,
    removes cache hits before that. The windows run inside a page.
    """
    rows = mentions.filter(~F.coalesce(F.col("cached"), F.lit(False))) if "cached" in mentions.columns else mentions
    batch = F.lit(0) if batch_size is None else F.floor(F.col("pos") / batch_size).cast("int")
    group = Window.partitionBy("page_id", "batch")
    ordered = group.orderBy("pos")
    rows = rows.withColumn("batch", batch)
    rows = rows.withColumn("_cap", F.row_number().over(ordered)).filter(F.lit(True) if most is None else F.col("_cap") <= most)
    rows = rows.filter(~is_skipped(F.col("name")))
    total, at = F.count("*").over(group), F.row_number().over(ordered) - 1
    return rows.withColumn("base", (total - at) / total * 70).drop("_cap")


def known_table(spark: SparkSession) -> DataFrame:
    """Names with fixed links. Fixed size."""
    rows = [(n, rules.WIKIPEDIA + t, rules.WIKIDATA + i, k) for n, t, i, k in rules.KNOWN_ENTITIES]
    return spark.createDataFrame(rows, "known string, known_wikipedia string, known_wikidata string, known_type string")


def known_entities(names: DataFrame) -> DataFrame:
    """Adds ``known_wikipedia``, ``known_wikidata`` and ``known_type`` (NULL for other names)."""
    known = F.broadcast(known_table(names.sparkSession))
    return names.withColumn("known", X.trim(F.lower("name"))).join(known, "known", "left").drop("known")


# ── candidate retrieval ───────────────────────────────────────────────────────


def search_index(table: DataFrame, lookup: str, hits: int = HITS_PER_SEARCH, asked: DataFrame | None = None) -> DataFrame:
    """``table`` by search key: every run of leading words of ``lookup``, with its ``hits`` best-ranked entries.

    Search is then an equi-join on the key. With ``asked(key)`` only those keys are ranked, in the exchange that ranking
    needs anyway. The row limit per key is applied per task before the shuffle, so a first word shared by a third of the
    table costs ``hits`` rows per task.
    """
    prefixes = lambda t: F.transform(t, lambda _, i: F.array_join(F.slice(t, F.lit(1), i + 1), " "))
    per_key = table.withColumn("key", F.explode(X.let(X.real_words(F.lower(lookup)), prefixes)))
    per_key = per_key if asked is None else per_key.join(asked, "key", "left_semi")
    best = Window.partitionBy("key").orderBy("rank")
    return per_key.withColumn("hit", F.row_number().over(best)).filter(F.col("hit") <= hits)


def store_index(table: DataFrame, lookup: str, folder: str, buckets: int, hits: int = HITS_PER_SEARCH) -> SearchIndex:
    """Build the index of ``table`` once, as a table in ``folder`` with ``buckets`` files, bucketed and sorted by key."""
    keys = search_index(table, lookup, hits).repartition(buckets, "key")
    name = f"search_{uuid.uuid4().hex}"
    keys.write.bucketBy(buckets, "key").sortBy("key", "hit").option("path", folder).saveAsTable(name)
    return SearchIndex(keys.sparkSession.table(name), hits)


def open_index(spark: SparkSession, folder: str, buckets: int, hits: int = HITS_PER_SEARCH) -> SearchIndex:
    """An index that another session stored in ``folder``."""
    name = f"search_{uuid.uuid4().hex}"
    fields = spark.read.parquet(folder).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key, hit) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return SearchIndex(spark.table(name), hits)


#: What a search needs of each snapshot table, and the column it is found by.
SEARCHED = {
    "pages": (("title", "url", "wikibase_item", "rank"), "title"),
    "items": (("id", "label", "description", "lookup", "rank"), "lookup"),
    "graph": (("mid", "name", "description", "lookup", "rank"), "lookup"),
}


def indexed(kb: KnowledgeBase, folder: str, buckets: int = 512, hits: int = HITS_PER_SEARCH) -> KnowledgeBase:
    """``kb`` with its search indexes stored under ``folder``. Take at least as many buckets as shuffle partitions."""
    build = lambda name, columns, lookup: store_index(getattr(kb, name).select(*columns), lookup, f"{folder}/{name}", buckets, hits)
    return replace(kb, index={name: build(name, *spec) for name, spec in SEARCHED.items()})


def search(terms: DataFrame, table: DataFrame, lookup: str, hits: int = HITS_PER_SEARCH, index: SearchIndex | None = None) -> DataFrame:
    """``terms(…, term)`` with the entries of ``table`` that each term finds, as ``hit`` 1 to ``hits``.

    With a stored ``index`` of as many hits, its buckets are read; else keys that are asked for are ranked now.
    """
    keyed = terms.withColumn("key", F.array_join(X.real_words(F.lower("term")), " "))
    if index is not None and index.hits >= hits:
        return keyed.join(index.table.filter(F.col("hit") <= hits), "key").drop("key")
    return keyed.join(search_index(table, lookup, hits, keyed.select("key").distinct()), "key").drop("key")


def is_academic(name: Column, topic: Column) -> Column:
    return (F.lower(name) == rules.ACADEMIC_NAME) & X.contains(F.lower(topic), "education")


def topic_key(name: Column, topic: Column) -> Column:
    """The part of the topic that can change the links of ``name``."""
    topic = F.coalesce(topic, F.lit(""))
    return F.when(X.person_shaped(name), topic).when(is_academic(name, topic), F.lit("education")).otherwise(F.lit(""))


def wiki_search_terms(names: DataFrame) -> DataFrame:
    """``(name, academic)`` with its encyclopedia search terms in order: ``(term_pos, term)``."""
    name, low = F.col("name"), F.lower("name")
    bare = X.trim(F.regexp_replace(name, X.rx(r"\s+airport$", "i"), ""))
    plain = (
        F.when(F.col("academic"), F.lit(rules.ACADEMIC_WIKI_TERM))
        .when(low.isin(*rules.OHARE_NAMES), F.lit(rules.OHARE_TERM))
        .when(X.hits(name, r"(.+)\s+airport$"), F.concat(bare, F.lit(" International Airport")))
        .otherwise(name)
    )
    seo = F.array(*[F.lit(t) for t in rules.SEO_SEARCH_TERMS], name)
    terms = F.when(low == "seo", seo).otherwise(F.array(plain))
    return names.select("name", "academic", F.posexplode(terms).alias("term_pos", "term"))


def wiki_candidates(names: DataFrame, pages: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """Up to five titles per search term: ``(name, academic, term_pos, term, hit, title, url, wikibase_item)``."""
    return search(wiki_search_terms(names), pages.select("title", "url", "wikibase_item", "rank"), "title", index=index).drop("rank")


def wiki_rejected(name: Column, title: Column) -> Column:
    """Title is a known mismatch for the name, or matches an irrelevant pattern without being equal to it."""
    entity, low = X.trim(F.lower(name)), F.lower(title)
    mismatch = F.lit(False)
    for pattern, forbidden in rules.TITLE_MISMATCHES:
        bad = F.lit(False)
        for f in forbidden:
            bad = bad | F.contains(low, F.lit(f))
        mismatch = mismatch | (F.contains(entity, F.lit(pattern)) & bad)
    seoul = (entity == "seo") & F.contains(low, F.lit("seoul"))
    return mismatch | seoul | (X.hits_any(low, rules.IRRELEVANT_TITLES) & (entity != low))


def _shared(entity_words: Column, other_words: Column) -> Column:
    return X.let(other_words, lambda other: F.size(F.filter(entity_words, lambda w: F.array_contains(other, w))))


def wiki_score(name: Column, title: Column) -> Column:
    """How well a title matches a name, before verification."""
    entity, low = X.trim(F.lower(name)), F.lower(title)
    strip = lambda c: X.trim(F.replace(F.replace(c, F.lit("airport"), F.lit("")), F.lit("international"), F.lit("")))
    e_air, t_air = strip(entity), strip(low)
    airport = (
        F.when(e_air == t_air, F.lit(95.0))
        .when(F.contains(t_air, e_air) | F.contains(e_air, t_air), F.lit(85.0))
        .otherwise(F.lit(0.0))
    )
    extra = F.size(X.words(low)) - F.size(X.words(entity))
    content = lambda c: F.filter(X.words(c), lambda w: (w != "") & ~w.isin(*rules.TITLE_STOP_WORDS))
    e_words, t_words = content(entity), content(low)
    common = _shared(e_words, t_words)
    e_ratio, t_ratio = common / F.size(e_words), common / F.size(t_words)
    average = (e_ratio + t_ratio) / 2
    overlap = F.when((F.least(e_ratio, t_ratio) >= 0.7) & (average >= 0.8), average * 50).otherwise(F.lit(0.0))
    overlap = F.when((F.size(e_words) == 0) | (F.size(t_words) == 0), F.lit(0.0)).otherwise(overlap)
    both_airports = F.contains(entity, F.lit("airport")) & F.contains(low, F.lit("airport"))
    score = (
        F.when(entity == low, F.lit(100.0))
        .when(both_airports, airport)
        .when(F.contains(low, entity), F.when(extra <= 2, F.lit(85.0)).otherwise(F.lit(60.0)))
        .when(F.contains(entity, low), F.lit(75.0))
        .otherwise(overlap)
    )
    capital = F.when(X.hits(title, "^[A-Z][a-z]", ""), F.lit(5)).otherwise(F.lit(0))
    long = F.when(F.length(title) > F.length(entity) * 2.5, F.lit(-30)).otherwise(F.lit(0))
    place = ~X.hits(entity, rules.PLACE_WORDS) & X.hits(low, rules.PLACE_WORDS)
    return F.greatest(F.lit(0.0), score + capital + long + F.when(place, F.lit(-40)).otherwise(F.lit(0)))


def wiki_scored(candidates: DataFrame) -> DataFrame:
    """Candidates that are not rejected, with ``score``."""
    kept = candidates.filter(~wiki_rejected(F.col("name"), F.col("title")))
    return kept.withColumn("score", wiki_score(F.col("name"), F.col("title")))


def plain_extract(extract: Column) -> Column:
    """First paragraph without tags, lower case."""
    return F.lower(F.regexp_replace(extract, "<[^>]+>", ""))


def in_extract(name: Column, extract: Column) -> Column:
    """The extract holds the name, or at least half of its words of more than two letters."""
    entity = X.trim(F.lower(name))
    long = F.filter(X.words(entity), lambda w: F.length(w) > 2)
    found = F.size(F.filter(long, lambda w: F.contains(extract, w)))
    enough = F.when(F.size(long) > 0, found / F.size(long) >= 0.5).otherwise(F.lit(False))
    return F.coalesce((extract != "") & (F.contains(extract, entity) | enough), F.lit(False))


def with_extract(rows: DataFrame, pages: DataFrame, wanted: Column) -> DataFrame:
    """``rows`` with the ``extract`` of their ``url`` where ``wanted``, in one pass.

    The others carry a key that no page has, and that differs from row to row, so they spread over the tasks.
    """
    probe = F.when(wanted, F.col("url")).otherwise(F.concat(F.lit("-"), F.col("name"), F.col("url")))
    extracts = pages.select(F.col("url").alias("_probe"), "extract")
    return rows.withColumn("_probe", probe).join(extracts, "_probe", "left").drop("_probe")


def wiki_verified(scored: DataFrame, pages: DataFrame) -> DataFrame:
    """``score`` after the content check: above 70 it gains 10 or loses 30.

    Only candidates above 70 meet the wide ``extract`` column; tags are stripped after the join, from those alone.
    """
    high = F.col("score") > 70
    fits = X.let(plain_extract(F.col("extract")), lambda e: in_extract(F.col("name"), e))
    change = F.when(high, F.when(fits, F.lit(10.0)).otherwise(F.lit(-30.0))).otherwise(F.lit(0.0))
    return with_extract(scored, pages, high).withColumn("score", F.col("score") + change).drop("extract")


def wiki_best(verified: DataFrame) -> DataFrame:
    """The page of each ``(name, academic)``: first term with a match, then score, then search order."""
    title = F.lower("title")
    penalty = F.when(F.contains(title, F.lit("disambiguation")), F.lit(50)).otherwise(F.lit(0)) + F.when(
        F.contains(title, F.lit("redirect")) | F.contains(title, F.lit("stub")), F.lit(30)
    ).otherwise(F.lit(0))
    needed = F.when(F.contains(F.col("title"), F.lit("(")), F.lit(85)).otherwise(F.lit(65))
    order = Window.partitionBy("name", "academic").orderBy("term_pos", F.col("score").desc(), "hit")
    return (
        verified.withColumn("score", F.col("score") - penalty)
        .filter(F.col("score") >= needed)
        .withColumn("_rn", F.row_number().over(order))
        .filter("_rn = 1")
        .select("name", "academic", "title", "url", "wikibase_item", "score")
    )


# ── topic fit of person-shaped names ──────────────────────────────────────────


def topic_words(topic: Column) -> Column:
    """Words of the topic that count: four letters or more, no stop words."""
    plain = X.trim(X.collapse(F.regexp_replace(F.lower(topic), f"[^a-z0-9{X.SPACE_CLASS}]", " ")))
    return F.filter(F.split(plain, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*rules.TOPIC_STOP_WORDS))


def _fits(words: Column, text: Column, single: Column) -> Column:
    """Two adjacent topic words occur in ``text`` (a longer phrase implies a pair), or the rule for short topics."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    phrase = F.exists(pairs, lambda p: F.contains(text, p))
    return F.when(F.size(words) >= 2, phrase).when(F.size(words) == 1, single).otherwise(F.lit(True))


def person_fits_extract(name: Column, topic: Column, extract: Column) -> Column:
    """May the page found for ``name`` be used on a page about ``topic``?"""
    words, text = topic_words(topic), F.coalesce(extract, F.lit(""))
    fits = (text != "") & _fits(words, text, F.contains(text, F.get(words, F.lit(0))))
    return ~X.person_shaped(name) | (F.coalesce(topic, F.lit("")) == "") | F.coalesce(fits, F.lit(False))


def person_fits_description(name: Column, topic: Column, description: Column) -> Column:
    """The same for a knowledge-graph description; an empty one passes, and a short topic also rejects professions."""
    words, text = topic_words(topic), F.lower(F.coalesce(description, F.lit("")))
    profession = text.rlike("|".join(rules.PROFESSIONS))
    fits = _fits(words, text, F.contains(text, F.get(words, F.lit(0))) & ~profession)
    free = ~X.person_shaped(name) | (F.coalesce(topic, F.lit("")) == "") | (text == "")
    return free | F.coalesce(fits, F.lit(False))


# ── items, graph entries, product pages ───────────────────────────────────────


def label_score(entity: Column, label: Column, description: Column) -> Column:
    """100 equal, 80 or 70 contained, else shared words; plus up to 20 for name words in the description.

    ``entity`` and ``label`` are lower case.
    """
    label = F.coalesce(label, F.lit(""))
    e_words, l_words = X.real_words(entity), X.real_words(label)
    ratio = _shared(e_words, l_words) / F.greatest(F.size(e_words), F.size(l_words))
    score = (
        F.when(entity == label, F.lit(100.0))
        .when(F.contains(label, entity), F.lit(80.0))
        .when(F.contains(entity, label), F.lit(70.0))
        .otherwise(ratio * 60)
    )

    def bonus(text: Column) -> Column:
        found = F.size(F.filter(e_words, lambda w: (F.length(w) > 2) & F.contains(text, w)))
        return F.when(text != "", found / F.greatest(F.size(e_words), F.lit(1)) * 20).otherwise(F.lit(0.0))

    return score + X.let(F.lower(F.coalesce(description, F.lit(""))), bonus)


def academic_mismatch(label: Column, description: Column) -> Column:
    """Research papers and their like: nine patterns, or a label of over 100 characters and ten words."""
    low = F.lower(F.coalesce(label, F.lit("")))
    full = F.concat_ws(" ", low, F.lower(F.coalesce(description, F.lit(""))))
    long = (F.length(low) > 100) & (F.size(X.words(low)) > 10)
    return X.hits_any(full, rules.ACADEMIC_ITEMS) | long


def wikidata_from_page(best: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``page_item``: the page's item if the title is an airport or its label fits the page title (50 or more).

    The page title is the last part of the URL, underscores included.
    """
    labels = items.select(F.col("id").alias("_item_key"), F.lower("label").alias("_label"))
    page = F.lower(F.try_url_decode(F.replace(F.substring_index("url", "/", -1), F.lit("+"), F.lit("%2B"))))
    verified = (F.coalesce("_label", F.lit("")) != "") & (label_score(page, F.col("_label"), F.lit("")) >= 50)
    accepted = (F.coalesce("wikibase_item", F.lit("")) != "") & (F.contains(page, F.lit("airport")) | verified)
    return (
        best.withColumn("_item_key", F.coalesce("wikibase_item", F.concat(F.lit("none "), "url")))
        .join(labels, "_item_key", "left")
        .withColumn("page_item", F.when(accepted, F.concat(F.lit(rules.WIKIDATA), "wikibase_item")))
        .drop("_label", "_item_key")
    )


def wikidata_direct(names: DataFrame, items: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """``(name, academic, direct_item)``: best item of 75 or more, from the first search term that has one."""
    academic = F.array(*[F.lit(t) for t in rules.ACADEMIC_DATA_TERMS], F.col("name"))
    terms = F.when(F.col("academic"), academic).otherwise(F.array("name"))
    asked = names.select("name", "academic", F.posexplode(terms).alias("term_pos", "term"))
    found = search(asked, items.select("id", "label", "description", "lookup", "rank"), "lookup", index=index).filter(~academic_mismatch(F.col("label"), F.col("description")))
    scored = found.withColumn("score", label_score(F.lower("name"), F.lower("label"), F.col("description")))
    order = Window.partitionBy("name", "academic").orderBy("term_pos", F.col("score").desc(), "hit")
    return (
        scored.filter(F.col("score") >= 75)
        .withColumn("_rn", F.row_number().over(order))
        .filter("_rn = 1")
        .select("name", "academic", F.concat(F.lit(rules.WIKIDATA), "id").alias("direct_item"), "score")
    )


def graph_best(names: DataFrame, graph: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """``(name, mid, kg_description, kg_score)``: best of five entries per name, whatever its score above 0."""
    asked = names.select("name").distinct().select(F.col("name").alias("asked"), F.col("name").alias("term"))
    found = search(asked, graph.select("mid", "name", "description", "lookup", "rank"), "lookup", index=index)
    scored = found.withColumnRenamed("name", "kg_name").withColumnRenamed("asked", "name")
    scored = scored.withColumn("kg_score", label_score(X.trim(F.lower("name")), F.lower("kg_name"), F.col("description")))
    order = Window.partitionBy("name").orderBy(F.col("kg_score").desc(), "hit")
    return (
        scored.filter(F.col("kg_score") > 0)
        .withColumn("_rn", F.row_number().over(order))
        .filter("_rn = 1")
        .select("name", "mid", F.col("description").alias("kg_description"), "kg_score")
    )


def google_kg_url(name: Column, topic: Column, mid: Column, description: Column, score: Column) -> Column:
    """The graph URL if the best entry scores 60 and fits, else a plain search URL; never NULL."""
    usable = (score >= 60) & (F.coalesce(mid, F.lit("")) != "") & person_fits_description(name, topic, description)
    return F.when(usable, F.concat(F.lit(rules.KG_URL), F.regexp_replace(mid, "^(.*?)kg:", "$1"))).otherwise(
        F.concat(F.lit(rules.KG_FALLBACK_URL), X.encode_uri_component(name))
    )


def product_slugs(name: Column) -> Column:
    """Distinct page names to try, in order."""
    low = F.lower(name)
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    joined = lambda sep: F.regexp_replace(low, X.SPACE + "+", sep)
    return F.array_distinct(
        F.array(
            F.array_join(F.transform(X.words(low), upper_first), "_"), joined("-"), joined("_"), upper_first(low), F.upper(name)
        )
    )


def product_ontology(names: DataFrame, urls: DataFrame) -> DataFrame:
    """``(name, product_ontology_url)``: first probe that exists; person-shaped names are not tried."""
    slugs = product_slugs(F.col("name"))
    under = lambda path: F.transform(slugs, lambda s: F.concat(F.lit(rules.PRODUCT_URL + path), s))
    probes = F.concat(*[under(path) for path in rules.PRODUCT_PATHS])
    asked = names.select("name").distinct().filter(~X.person_shaped(F.col("name"))).select("name", F.posexplode(probes).alias("pos", "url"))
    return asked.join(urls.select("url"), "url", "left_semi").groupBy("name").agg(F.min_by("url", "pos").alias("product_ontology_url"))


def entity_type(name: Column, known_type: Column, p31: Column) -> Column:
    """Known type, else by the item's class, else by the shape of the name."""
    by_class = F.lit(None).cast("string")
    for item, kind in rules.P31_TYPES:
        by_class = F.when(p31 == item, F.lit(kind)).otherwise(by_class)
    shape = (
        F.when(X.hits(name, "^[A-Z][a-z]+ [A-Z][a-z]+$", ""), F.lit("Person"))
        .when(X.hits(name, "university|school"), F.lit("Organization"))
        .otherwise(F.lit("Thing"))
    )
    return F.coalesce(known_type, by_class, shape)


def confidence(base: Column, wikipedia: Column, wikidata: Column, graph: Column, product: Column, kind: Column) -> Column:
    """0 to 100: base score plus source, agreement and type bonuses."""
    flags = [wikipedia.isNotNull(), wikidata.isNotNull(), F.coalesce(F.contains(graph, F.lit("kgmid=")), F.lit(False)), product.isNotNull()]
    one = [F.when(f, F.lit(1)).otherwise(F.lit(0)) for f in flags]
    sources = one[0] + one[1] + one[2] + one[3]
    bonus = one[0] * 15 + one[1] * 10 + one[2] * 15 + one[3] * 5
    agree = F.when(sources >= 3, F.lit(20)).when(sources >= 2, F.lit(10)).otherwise(F.lit(0))
    by_type = (
        F.when(kind.isin("Person", "Organization"), F.lit(10))
        .when(kind == "Place", F.lit(8))
        .when(kind.isin("Product", "Service"), F.lit(6))
        .otherwise(F.lit(3))
    )
    return F.least(F.lit(100), X.js_round(base + bonus + agree + by_type)).cast("int")


# ── the whole linking step ────────────────────────────────────────────────────


def name_links(names: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """All that depends on the name alone, one row per ``(name, academic)``: page, items, graph entry, product page.

    Every join here is between distinct names and distinct snapshot keys.
    """
    best = wikidata_from_page(wiki_best(wiki_verified(wiki_scored(wiki_candidates(names, kb.pages, kb.index.get("pages"))), kb.pages)), kb.items)
    direct = wikidata_direct(names, kb.items, kb.index.get("items")).drop("score")
    best = with_extract(best, kb.pages, X.person_shaped(F.col("name"))).withColumn("page_extract", plain_extract(F.col("extract")))
    classes = kb.items.select(F.concat(F.lit(rules.WIKIDATA), "id").alias("_item"), "p31")
    by_class = lambda column, alias: classes.select(F.col("_item").alias(f"_{column.removesuffix('_item')}_key"), F.col("p31").alias(alias))
    return (
        names.join(best.select("name", "academic", F.col("url").alias("page_url"), "page_item", "page_extract"), ["name", "academic"], "left")
        .join(direct, ["name", "academic"], "left")
        .join(graph_best(names, kb.graph, kb.index.get("graph")), "name", "left")
        .join(product_ontology(names, kb.urls), "name", "left")
        # A name without an item asks for its own name, which is no item: the missing ones do not share a task.
        .withColumns({f"_{k}_key": F.coalesce(f"{k}_item", F.concat(F.lit("none "), "name")) for k in ("page", "direct")})
        .join(by_class("page_item", "page_p31"), "_page_key", "left")
        .join(by_class("direct_item", "direct_p31"), "_direct_key", "left")
        .drop("_page_key", "_direct_key")
    )


def link_names(keys: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Links for distinct ``(name, topic_key)``: four URLs and the type."""
    keyed = known_entities(keys).withColumn("academic", is_academic(F.col("name"), F.col("topic_key")))
    names = keyed.select("name", "academic").distinct()
    joined = spread_join(keyed, name_links(names, kb), ["name", "academic"], "topic_key")
    name, topic, known = F.col("name"), F.col("topic_key"), F.col("known_wikipedia").isNotNull()
    fits = person_fits_extract(name, topic, F.col("page_extract"))
    page = F.when(~known & fits, F.col("page_url"))
    from_page = F.when(page.isNotNull(), F.col("page_item"))
    item = F.when(known, F.col("known_wikidata")).otherwise(F.coalesce(from_page, F.col("direct_item")))
    p31 = F.when(~known, F.when(from_page.isNotNull(), F.col("page_p31")).otherwise(F.col("direct_p31")))
    graph = google_kg_url(name, topic, F.col("mid"), F.col("kg_description"), F.col("kg_score"))
    return joined.select(
        "name",
        "topic_key",
        entity_type(name, F.col("known_type"), p31).alias("type"),
        F.coalesce("known_wikipedia", page).alias("wikipedia_url"),
        item.alias("wikidata_url"),
        graph.alias("google_kg_url"),
        "product_ontology_url",
    )


LINK_COLUMNS = ("type", "wikipedia_url", "wikidata_url", "google_kg_url", "product_ontology_url")


def scored_keys(mentions: DataFrame, batch_size: int | None = rules.BATCH_SIZE) -> DataFrame:
    """Mentions that are linked, with their base score and the key ``(name, topic_key)`` that their links depend on."""
    return base_score(mentions, batch_size).withColumn("topic_key", topic_key(F.col("name"), F.col("main_topic")))


def link_mentions(mentions: DataFrame, kb: KnowledgeBase, batch_size: int | None = rules.BATCH_SIZE) -> DataFrame:
    """``mentions(page_id, pos, name, main_topic[, cached])`` to linked entities with ``confidence``.

    Skipped names and cache hits are not in the result; :func:`merge_cached` puts them back.
    """
    scored = scored_keys(mentions, batch_size)
    return with_links(scored, link_names(scored.select("name", "topic_key").distinct(), kb))


def with_links(scored: DataFrame, links: DataFrame) -> DataFrame:
    """:func:`scored_keys` with their ``links(name, topic_key, …)`` and ``confidence``."""
    linked = spread_join(scored, links, ["name", "topic_key"], "page_id")
    score = confidence(*[F.col(c) for c in ("base", "wikipedia_url", "wikidata_url", "google_kg_url", "product_ontology_url", "type")])
    return linked.select("page_id", "pos", "batch", "name", *LINK_COLUMNS, score.alias("confidence"))


def rank_entities(linked: DataFrame) -> DataFrame:
    """Adds ``rank`` within the page: confidence descending, input order on ties."""
    order = Window.partitionBy("page_id").orderBy(F.col("confidence").desc(), "pos")
    return linked.withColumn("rank", F.row_number().over(order))


ENTITY_FIELDS = ("name", *LINK_COLUMNS, "confidence")


def merge_cached(mentions: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every mention with its entity: the cached row, else the freshly linked one, else a Thing with confidence 0.

    ``cached`` has one row per ``lower_name`` with an ``entity`` struct of :data:`ENTITY_FIELDS`. Names that differ in
    case only share, within a batch, the fresh row with the highest confidence.
    """
    entity = F.struct(*ENTITY_FIELDS)
    new = fresh.groupBy("page_id", "batch", F.lower("name").alias("lower_name")).agg(
        F.min_by(entity, F.struct((-F.col("confidence")).alias("c"), F.col("pos"))).alias("_fresh")
    )
    keyed = mentions.withColumns({"lower_name": F.lower("name"), "batch": F.floor(F.col("pos") / rules.BATCH_SIZE).cast("int")})
    joined = spread_join(keyed, cached.select("lower_name", F.col("entity").alias("_cached")), ["lower_name"], "page_id")
    joined = joined.join(new, ["page_id", "batch", "lower_name"], "left")
    default = F.struct(
        F.col("name"), F.lit("Thing").alias("type"), *[F.lit(None).cast("string").alias(c) for c in LINK_COLUMNS[1:]],
        F.lit(0).alias("confidence"),
    )
    kind = joined.schema["_fresh"].dataType
    chosen = F.coalesce(F.col("_cached").cast(kind), F.col("_fresh"), default.cast(kind))
    return joined.select("page_id", "pos", chosen.alias("e")).select("page_id", "pos", "e.*")


# ── LinkedIn links on the page ────────────────────────────────────────────────


def _best_link(anchors: Column, score, url) -> Column:
    """URL of the highest-scoring anchor of at least 40; the first wins a tie."""
    rated = F.transform(anchors, lambda a, i: F.struct(score(a).alias("score"), (-i).alias("early"), url(a).alias("url")))
    best = F.array_max(F.filter(rated, lambda r: r["url"].isNotNull()))
    return X.let(best, lambda b: F.when(b["score"] >= 40, b["url"]))


def _points(hit: Column, points: int) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def person_anchors(text: Column, nodes: Column) -> Column:
    """Links to personal profiles on a page: ``url``, ``label``, ``aria``, ``title``, and nearby text where it is short."""
    short = lambda t, n: F.when(F.length(t) < n, t)

    def one(a: Column) -> Column:
        up = N.parent(nodes, a)
        path = X.first_match(a["attrs"]["href"], rules.LINKEDIN_PERSON)
        return F.struct(
            X.let(path, lambda p: F.concat(F.lit("https://linkedin.com"), F.substring(p, F.lit(13), F.length(p)))).alias("url"),
            N.node_text(text, a).alias("label"),
            a["attrs"]["aria-label"].alias("aria"),
            a["attrs"]["title"].alias("title"),
            short(N.node_text(text, up), 600).alias("near"),
            short(N.node_text(text, N.parent(nodes, up)), 1200).alias("far"),
        )

    return F.transform(N.select(nodes, 'a[href*="linkedin.com/in/"]'), one)


def person_link(anchors: Column, name: Column) -> Column:
    """Of :func:`person_anchors`, the profile that belongs to ``name``; NULL without a strong signal."""
    points = (("label", 80), ("aria", 60), ("title", 50), ("url", 40), ("near", 30), ("far", 15))

    def score(a: Column) -> Column:
        return reduce(add, [_points(X.name_in(name, a[field]), n) for field, n in points])

    return F.when(X.starts_like_person(name), _best_link(anchors, score, lambda a: a["url"]))


def linkedin_person(text: Column, nodes: Column, name: Column) -> Column:
    """Profile link on the page that belongs to ``name``; NULL without a strong signal."""
    return X.let(person_anchors(text, nodes), lambda anchors: person_link(anchors, name))


def linkedin_company(text: Column, nodes: Column, name: Column) -> Column:
    """The same for an organisation's company page."""
    anchors = N.select(nodes, 'a[href*="linkedin.com/company/"]')
    link = lambda a: F.concat(F.lit("https://"), X.first_match(a["attrs"]["href"], rules.LINKEDIN_COMPANY))

    def score(a: Column) -> Column:
        near = N.node_text(text, N.parent(nodes, a))
        return (
            _points(X.name_in(name, N.node_text(text, a)), 80)
            + _points(X.name_in(name, link(a)), 40)
            + _points((F.length(near) < 600) & X.name_in(name, near), 20)
        )

    return F.when(F.coalesce(name, F.lit("")) != "", _best_link(anchors, score, link))

"""Inputs of the registered queries that the given tables do not hold: derived from them, row for row.

Markup is added to the given pages, caches and profiles come from ``events``, knowledge-base snapshots and pasted pages
from ``documents``, response bodies from page and document keys. Everything grows with the tables.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.operators import dom
from pagequarry.operators import mentions as M
from pagequarry.operators import page_text as P
from pagequarry.operators.linking import KnowledgeBase, indexed
from pagequarry.session import checkpoint_dir, settle
from pagequarry.sources.pages import clean_pages


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: the given tables are single files, and a page's work is far dearer than moving it once."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(clean_pages(table(spark, sf, "pages")))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return dom.parse_pages(pages(spark, sf))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_text(parsed(spark, sf))


HEAD_MARKUP = """
concat(
  '<meta name="description" content="About page ', page_id, '">',
  CASE WHEN page_id % 3 = 0 THEN '<meta name="author" content="Ada Byron">' ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN concat('<meta property="og:site_name" content="Site ', page_id, '">') ELSE '' END,
  CASE WHEN page_id % 5 <> 0 THEN concat('<meta property="og:image" content="/img/', page_id, '.png">') ELSE '' END
)"""

BODY_MARKUP = """
concat(
  '<div class="contact-info">', page_id + 1, ' Main Street, Springfield, IL ', lpad(page_id % 100000, 5, '0'), ' USA</div>',
  '<p>Call (312) 555-', lpad(page_id % 10000, 4, '0'), '</p>',
  '<a href="https://twitter.com/t', page_id, '">t</a><a href="/facebook.com">x</a>',
  '<a href="https://facebook.com/f', page_id, '">f</a><a href="https://twitter.com/t', page_id, '">again</a>',
  '<div><a href="https://www.linkedin.com/in/ada-byron-', page_id, '">Ada Byron</a></div>',
  '<span class="byline">By Grace Brewster Murray Hopper</span><div class="brand">Brand ', page_id, '</div>',
  '<div class="faq"><h3>What is item ', page_id, '</h3><p>Item ', page_id, ' is a part of the corpus of pages.</p>',
  '<h3>Q: How big is it?</h3><p>no</p><p>Answer: It has ', length(html), '  characters of source.</p></div>',
  '<div class="howto"><h2>How to file page ', page_id, '</h2><p class="intro">Filing takes a moment and needs two tools.</p>',
  '<ol><li><h4>Step 1: Open</h4>Open folder number ', page_id, ' in the cabinet.</li>',
  '<li>Spend ', page_id % 50 + 1, ' minutes to put page ', page_id, ' in.</li></ol>',
  '<ul class="tools"><li>Folder</li><li>Label ', page_id, '</li><li>Pen</li></ul></div>'
)"""


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages with contact, social, author, FAQ and how-to markup added to head and body."""
    marked = pages(spark, sf).selectExpr("*", f"{HEAD_MARKUP} AS _head", f"{BODY_MARKUP} AS _body")
    html = F.replace("html", F.lit('<meta charset="utf-8">'), F.concat(F.lit('<meta charset="utf-8">'), "_head"))
    html = F.replace(html, F.lit("<body>"), F.concat(F.lit("<body>"), "_body"))
    return marked.select("page_id", "url", html.alias("html"))


#: What the description of a page says besides, by page, so that every page type occurs.
TYPE_WORDS = """CASE page_id % 5 WHEN 1 THEN ': SEO services of an agency for universities' WHEN 2 THEN ': restaurant and shop, phone, address and opening hours'
  WHEN 3 THEN ': a degree program with its tuition and curriculum' WHEN 4 THEN ': a guide by its author, published in a blog' ELSE '' END"""
#: What stands at the start of an education page's article.
PROGRAM = "<article><div>It takes 18 months online, a certificate for 30 credits.</div>"


def typed(spark: SparkSession, sf: str) -> DataFrame:
    """The annotated pages with descriptions, and on some a programme, that make them pages of the five types."""
    words = F.expr(f"concat('content=\"About page ', page_id, {TYPE_WORDS}, '\"')")
    html = F.replace("html", F.concat(F.lit('content="About page '), "page_id", F.lit('"')), words)
    program = F.when(F.col("page_id") % 5 == 3, F.replace(html, F.lit("<article>"), F.lit(PROGRAM))).otherwise(html)
    return annotated(spark, sf).withColumn("html", program)


def part_pages(spark: SparkSession, sf: str, html: str | Column, *keep: str) -> DataFrame:
    """A small page per row of ``part``, parsed; ``html`` is its markup, ``keep`` names columns to keep beside it."""
    markup = F.expr(html) if isinstance(html, str) else html
    return dom.parse_pages(spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("page_id"), *keep, markup.alias("html")))


def annotated_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return dom.parse_pages(annotated(spark, sf))


def text_mentions(spark: SparkSession, sf: str, cap: int | None = rules.MAX_MENTIONS) -> DataFrame:
    """``(page_id, pos, name)`` over the cleaned page text."""
    return M.mentions(pages(spark, sf), P.clean_text(F.col("html")), cap=cap)


def scored_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with links and confidence made from the name's length and position: stand-ins for linked entities."""
    return text_mentions(spark, sf).selectExpr(
        "page_id",
        "pos",
        "name",
        "CASE length(name) % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' WHEN 2 THEN 'Place' ELSE 'Thing' END AS type",
        "CASE WHEN length(name) % 3 = 0 THEN concat('https://en.wikipedia.org/wiki/', replace(name, ' ', '_')) END AS wikipedia_url",
        "CASE WHEN length(name) % 5 = 0 THEN concat('https://www.wikidata.org/wiki/Q', pos) END AS wikidata_url",
        "CASE WHEN length(name) % 2 = 0 THEN concat('https://www.google.com/search?kgmid=/m/', pos) "
        "ELSE concat('https://www.google.com/search?q=', replace(name, ' ', '%20')) END AS google_kg_url",
        "CASE WHEN length(name) % 7 = 0 THEN concat('http://www.productontology.org/id/', name) END AS product_ontology_url",
        "CAST((length(name) * 13 + pos * 7) % 101 AS INT) AS confidence",
    )


# ── knowledge base from documents ─────────────────────────────────────────────


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct capitalised phrases of ``documents`` with the lowest document that holds each, ranked by text."""
    docs = spread(table(spark, sf, "documents"))
    found = docs.select("doc_id", F.explode(M.capitalised_phrases(F.col("text"))).alias("phrase"))
    return found.groupBy("phrase").agg(F.min("doc_id").alias("doc_id"))


_BUILT: dict[tuple[str, str], KnowledgeBase] = {}


def knowledge_base(spark: SparkSession, sf: str) -> KnowledgeBase:
    """The snapshot of ``sf`` with stored search indexes, built once a session, as a snapshot is once for many runs."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _BUILT:
        buckets = min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        _BUILT[at] = indexed(snapshot(spark, sf), f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", buckets)
    return _BUILT[at]


def snapshot(spark: SparkSession, sf: str) -> KnowledgeBase:
    """Snapshot tables. ``rank`` orders hits by the text itself, so it needs no global numbering."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("extract"))
    base = settle(phrases(spark, sf))
    number = "conv(substring(md5(phrase), 1, 12), 16, 10)"
    kb_pages = base.join(docs, "doc_id").selectExpr(
        "phrase AS title",
        "concat('https://en.wikipedia.org/wiki/', replace(phrase, ' ', '_')) AS url",
        "extract",
        f"concat('Q', {number}) AS wikibase_item",
        "concat(lpad(length(phrase), 3, '0'), phrase) AS rank",
    )
    kb_items = base.selectExpr(
        f"concat('Q', {number}) AS id",
        "CASE WHEN length(phrase) % 11 = 0 THEN '' ELSE phrase END AS label",
        "CASE WHEN length(phrase) % 2 = 0 THEN concat('the ', lower(phrase), ' of page ', doc_id) ELSE '' END AS description",
        "CASE length(phrase) % 6 WHEN 0 THEN 'Q5' WHEN 1 THEN 'Q43229' WHEN 2 THEN 'Q571' WHEN 3 THEN 'Q12737077' END AS p31",
        "concat(lpad(length(phrase), 3, '0'), phrase) AS rank",
        "phrase AS lookup",
    )
    graph = base.filter("length(phrase) % 3 <> 1").selectExpr(
        f"concat('kg:/m/', {number}) AS mid",
        "phrase AS name",
        "CASE WHEN length(phrase) % 2 = 0 THEN concat('a singer of ', lower(phrase)) ELSE '' END AS description",
        "concat(lpad(length(phrase), 3, '0'), phrase) AS rank",
        "phrase AS lookup",
    )
    urls = base.filter("length(phrase) % 5 <> 0").selectExpr(
        "concat('http://www.productontology.org', CASE WHEN length(phrase) % 2 = 0 THEN '/id/' ELSE '/doc/' END, "
        "CASE WHEN length(phrase) % 3 = 0 THEN replace(lower(phrase), ' ', '-') ELSE upper(phrase) END) AS url"
    )
    return KnowledgeBase(kb_pages, kb_items, graph, urls.distinct())


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct mention names of the corpus, ``academic`` false."""
    return text_mentions(spark, sf).select("name").distinct().withColumn("academic", F.lit(False))


# ── events: caches, profiles, runs ────────────────────────────────────────────

AS_OF = "TIMESTAMP_NTZ '2024-01-29 12:00:00'"
AS_OF_TIME = datetime(2024, 1, 29, 12)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def requests(spark: SparkSession, sf: str, which: Column | None = None) -> DataFrame:
    """One request per event (those that ``which`` holds for) with the keys of every tier; errors ask for a fresh run."""
    found = events(spark, sf)
    return (found if which is None else found.filter(which)).selectExpr(
        "event_id", "ts", "user_id",
        "md5(concat('https://example.org/u/', user_id)) AS url_hash",
        "md5(concat('content ', user_id % 97)) AS content_hash",
        "md5(concat('name ', user_id % 41)) AS entity_hash",
        "event_type = 'error' AS clear_cache",
    )


def cache_of(spark: SparkSession, sf: str, kind: str, key: str, ttl: str) -> DataFrame:
    """A cache written by the events of one type: per key the last write before the reference time."""
    asked = requests(spark, sf, F.col("event_type") == kind)
    return (
        asked.filter(f"ts < {AS_OF}")
        .groupBy(key)
        .agg(F.max("ts").alias("written_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("payload"))
        .withColumn("expires_at", F.expr(f"written_at + INTERVAL {ttl}"))
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A profile for every user whose first event was not an error."""
    first = F.min_by("event_type", F.struct("ts", "event_id")).alias("first")
    return (
        events(spark, sf).groupBy("user_id").agg(first).filter("first <> 'error'")
        .selectExpr(
            "user_id",
            "concat('u', user_id, CASE WHEN user_id % 10 = 0 THEN '@Partner.example' ELSE '@mail.example' END) AS email",
            "CAST(user_id % 8 AS INT) AS free_analyses_used",
            "CAST(date_add(DATE '2024-01-01', CAST(user_id % 40 AS INT)) AS TIMESTAMP_NTZ) AS free_analyses_reset_at",
        )
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis runs from events: some lack a type, counts and times may be missing."""
    return events(spark, sf).selectExpr(
        "user_id",
        "concat('https://example.org/u/', user_id) AS url",
        "CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'fanout_only' WHEN 'purchase' THEN 'paste' WHEN 'signup' THEN 'full' END AS analysis_type",
        "CASE WHEN event_id % 3 = 0 THEN 'byok' ELSE 'free_tier' END AS key_source",
        "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 20 AS INT) END AS entities_found",
        "CASE WHEN event_id % 7 <> 0 THEN CAST(value * 10 AS INT) END AS processing_time_ms",
        "ts AS created_at",
    )


# ── model responses ───────────────────────────────────────────────────────────


def extraction_responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response body per document: valid, without usage, with a bad list, or not JSON at all."""
    return table(spark, sf, "documents").selectExpr(
        "md5(concat('doc ', doc_id)) AS content_hash",
        """CASE doc_id % 5
             WHEN 0 THEN 'not json'
             WHEN 1 THEN concat('{"choices":[{"message":{"content":"{\\\\"main_topic\\\\":\\\\"Topic ', doc_id, '\\\\",\\\\"entities\\\\":[\\\\"A', doc_id, '\\\\",\\\\"B\\\\"]}"}}]}')
             WHEN 2 THEN concat('{"choices":[{"message":{"content":"{\\\\"entities\\\\":[\\\\"C', doc_id, '\\\\"]}"}}],"usage":{"prompt_tokens":', n_chars, ',"completion_tokens":', doc_id, '}}')
             WHEN 3 THEN concat('{"choices":[{"message":{"content":"{\\\\"main_topic\\\\":\\\\"X\\\\"}"}}],"usage":{"total_tokens":7}}')
             ELSE concat('{"choices":[{"message":{"content":"{\\\\"main_topic\\\\":\\\\"T\\\\",\\\\"entities\\\\":[]}"}}],"usage":{"prompt_tokens":', n_chars, ',"completion_tokens":10,"total_tokens":', n_chars + 11, '}}')
           END AS body""",
        "doc_id", "n_chars", "lang",
    )


def recommendation_responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response per page: valid with six items, empty object, or broken."""
    item = """concat('{"category":"C', page_id, '","advice":"advice ', page_id, '"}')"""
    return table(spark, sf, "pages").selectExpr(
        "page_id",
        f"""CASE page_id % 3
             WHEN 0 THEN concat('{{"recommendations":[', {item}, ',', {item}, ',', {item}, ',', {item}, ',', {item}, ',', {item}, ']}}')
             WHEN 1 THEN '{{}}' ELSE 'broken {{' END AS body""",
    )


FANOUT_BODY = r"""
concat(
  CASE WHEN page_id % 2 = 0 THEN '**PRIMARY ENTITY: Page ' ELSE 'primary entity: Page ' END, page_id,
  '\n\n## FAN-OUT QUERIES:\n',
  '• What is page ', page_id, '? - Coverage: Yes - Why: title ', page_id, ' names it\n',
  '- How to read ', page_id, ':. - Coverage: Partial\n',
  '* Compare ', page_id, ' [No] Why: nothing there\n',
  '1. Cost of ', page_id, ' – Yes\n',
  CASE WHEN page_id % 3 = 0 THEN '• bare item\n' ELSE '' END,
  'FOLLOW-UP QUESTIONS:\n• Next ', page_id, '\n2. Then what\n',
  'COVERAGE SCORE: ', page_id % 7, '/', page_id % 5, ' queries\n',
  '**RECOMMENDATIONS:** add more\n- a table\nand a list'
)"""


def fanout_responses(spark: SparkSession, sf: str) -> DataFrame:
    """A fan-out response per page in every accepted line form."""
    return table(spark, sf, "pages").selectExpr("md5(concat('page ', page_id)) AS content_hash", f"{FANOUT_BODY} AS body", "page_id")

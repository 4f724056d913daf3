"""The registered queries: every operator run over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X
from pagequarry.operators import caches as K
from pagequarry.operators import classify as C
from pagequarry.operators import dom
from pagequarry.operators import fanout as G
from pagequarry.operators import jsonld as J
from pagequarry.operators import linking as L
from pagequarry.operators import mentions as M
from pagequarry.operators import page_text as P
from pagequarry.operators import report as R
from pagequarry.operators import scoring as E
from pagequarry.operators import structured as S
from pagequarry.operators import usage as U
from pagequarry.operators.stores import CacheStore, purge_stores
from pagequarry.plans import corpus
from pagequarry.plans import fixtures as fx
from pagequarry.session import apply_settings, settle
from pagequarry.sources.pages import clean_pages, paste_to_pages
from pagequarry.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

DOMAINS = ("partner.example",)
#: Rows of the report of most frequent names.
TOP = 100


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        apply_settings(spark)
        return fn(spark, sf)

    run.__doc__ = fn.__doc__
    _REGISTRY[fn.__name__] = run
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _as_of() -> Column:
    return F.expr(fx.AS_OF)


# ── sources and caches ────────────────────────────────────────────────────────


@query
def read_pages(spark, sf):
    return clean_pages(fx.table(spark, sf, "pages")).select("page_id", "url", F.md5("html").alias("html_md5"), F.length("html").alias("chars"))


@query
def paste_pages(spark, sf):
    docs = fx.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN concat(' \n<p>', text, '</p>') ELSE text END AS text")
    return paste_to_pages(docs).select("page_id", "url", F.md5("html").alias("html_md5"), "content_hash")


def _lookup(spark, sf):
    return K.cache_lookup(fx.requests(spark, sf), fx.cache_of(spark, sf, "view", "url_hash", "24 HOURS"), "url_hash", _as_of())


@query
def cache_hits(spark, sf):
    return _lookup(spark, sf)[0].select("event_id", "url_hash", "payload", "expires_at")


@query
def cache_misses(spark, sf):
    return _lookup(spark, sf)[1].select("event_id", "url_hash")


@query
def cache_lookup_batch(spark, sf):
    part = fx.table(spark, sf, "part")
    cache = part.filter("p_type <> 'SMALL'").groupBy(X.md5_key(F.col("p_name")).alias("entity_hash")).agg(F.min("p_brand").alias("data"))
    cache = cache.withColumn("expires_at", F.expr(f"{fx.AS_OF} + CASE WHEN data < 'Brand#2' THEN INTERVAL 1 HOURS ELSE INTERVAL 0 HOURS END"))
    asked = part.select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("name"))
    return K.cache_lookup_batch(asked, cache, _as_of()).select("p_partkey", "lower_name", "data")


@query
def cache_upsert(spark, sf):
    old = fx.cache_of(spark, sf, "view", "url_hash", "24 HOURS")
    new = fx.events(spark, sf).filter("event_type = 'click'").selectExpr(
        "CASE WHEN user_id % 9 = 0 THEN '' ELSE md5(concat('https://example.org/u/', user_id)) END AS url_hash", "ts AS written_at", "event_id AS payload"
    )
    return K.cache_upsert(old, new, "url_hash", rules.URL_TTL)


@query
def cache_upsert_entities(spark, sf):
    written = fx.scored_mentions(spark, sf).withColumn("written_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id) + make_dt_interval(0, 0, 0, pos * 0.001)"))
    empty = K.expiring(K.entity_rows(written.filter("false")), rules.ENTITY_TTL)
    return K.cache_upsert_entities(empty, written).select("entity_hash", "entity_name", F.get_json_object("data", "$.confidence").cast("int").alias("confidence"), "expires_at")


def _replay(spark, sf):
    asked = fx.events(spark, sf).select("event_id", "user_id", "ts")
    low, high = asked.agg(F.min("ts"), F.max("ts")).first()
    return K.replay_ttl(asked, "user_id", "ts", "event_id", timedelta(days=7), low, high)


@query
def replay_ttl(spark, sf):
    return _replay(spark, sf).select("event_id", "hit", "entry_id")


@query
def cache_hit_counts(spark, sf):
    return K.cache_hit_counts(_replay(spark, sf), "user_id")


_CACHES = {
    "entity": ("signup", "entity_hash", "7 DAYS"),
    "analysis": ("view", "url_hash", "1 HOURS"),
    "url": ("click", "url_hash", "6 HOURS"),
    "extraction": ("purchase", "content_hash", "24 HOURS"),
}


@query
def purge_expired(spark, sf):
    tables = {f"{name}_cache": fx.cache_of(spark, sf, *spec) for name, spec in _CACHES.items()}
    return K.purge_expired({**tables, "fanout_cache": None}, _as_of())[1]


@query
def purge_kept(spark, sf):
    kept, _ = K.purge_expired({"url_cache": fx.cache_of(spark, sf, *_CACHES["url"])}, _as_of())
    return kept["url_cache"].select("url_hash", "payload")


def _store(spark, name, key, ttl):
    """An empty stored cache in a folder of its own."""
    return CacheStore(spark, f"{ST.run_folder(spark, 'store')}/{name}", key, ttl, "payload bigint", buckets=4)


def _stored(spark, sf, name):
    kind, key, ttl = _CACHES[name]
    store = _store(spark, name, key, ttl)
    store.upsert(fx.cache_of(spark, sf, kind, key, ttl))
    return store


@query
def store_upsert(spark, sf):
    """Two writes of a stored cache: the last one of each key is its entry."""
    store = _stored(spark, sf, "analysis")
    new = fx.events(spark, sf).filter("event_type = 'click'").selectExpr(
        "CASE WHEN user_id % 9 = 0 THEN '' ELSE md5(concat('https://example.org/u/', user_id)) END AS url_hash", "ts AS written_at", "event_id AS payload"
    )
    store.upsert(new)
    return store.entries()


@query
def store_lookup(spark, sf):
    """Every request with the live entry of a stored cache; the payload is NULL on a miss."""
    found = _stored(spark, sf, "entity").lookup(fx.requests(spark, sf), _as_of())
    return found.select("event_id", "entity_hash", "_entry.payload", "_entry.expires_at")


@query
def store_purge(spark, sf):
    """What a purge leaves of stored caches, and how many entries went from each."""
    as_of, rows = fx.AS_OF_TIME, None
    for name, (_, key, _) in _CACHES.items():
        store = _stored(spark, sf, name)
        gone = purge_stores({name: store}, as_of)[name]
        left = store.entries().select(F.lit(f"{name}_cache").alias("cache_name"), F.col(key).alias("key"), "payload", F.lit(gone).cast("long").alias("deleted"))
        rows = left if rows is None else rows.unionByName(left)
    return rows


@query
def cache_tiers(spark, sf):
    tiers = [(n, _CACHES[n][1], fx.cache_of(spark, sf, *_CACHES[n])) for n in ("analysis", "url", "extraction", "entity")]
    tiers.append(("fanout", "content_hash", fx.cache_of(spark, sf, "error", "content_hash", "1 HOURS")))
    return K.partition_by_cache_tier(fx.requests(spark, sf), tiers, _as_of()).select("event_id", "tier")


@query
def fanout_cacheable(spark, sf):
    results = fx.events(spark, sf).selectExpr(
        "event_id",
        "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN '' ELSE props END AS analysis",
        "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN '' END AS error",
    )
    return K.fanout_cacheable(results).select("event_id", "analysis")


# ── usage ─────────────────────────────────────────────────────────────────────


@query
def append_log(spark, sf):
    """Runs of both key sources appended to the log one after the other, and the log as it is read back."""
    runs, path = fx.runs(spark, sf), ST.run_folder(spark, "log")
    for source in ("byok", "free_tier"):
        U.append_log(runs.filter(F.col("key_source") == source), path)
    return spark.read.parquet(path).select(*U.log_rows(runs).columns)


@query
def check_usage(spark, sf):
    users = fx.events(spark, sf).select("user_id").distinct()
    return U.check_usage(users, fx.profiles(spark, sf), _as_of(), DOMAINS)


@query
def quota_replay(spark, sf):
    return U.quota_replay(fx.events(spark, sf)).select("event_id", "user_id", "month", "allowed")


@query
def unlimited_users(spark, sf):
    return fx.profiles(spark, sf).select("user_id", U.email_domain(F.col("email")).alias("domain"), U.is_unlimited(F.col("email"), DOMAINS).alias("unlimited"))


@query
def monthly_reset(spark, sf):
    return U.monthly_reset(fx.profiles(spark, sf), _as_of())


@query
def increment_usage(spark, sf):
    return U.increment_usage(fx.profiles(spark, sf), fx.events(spark, sf), DOMAINS).select("user_id", "free_analyses_used")


@query
def insert_profiles(spark, sf):
    """Profiles after the sign-ups of the log: users without one get it, the others keep theirs."""
    signups = fx.events(spark, sf).filter("event_type = 'signup'").selectExpr("user_id", "concat('new', user_id, '@mail.example') AS email", "ts AS signed_up_at")
    return U.insert_profiles(fx.profiles(spark, sf), signups, _as_of())


@query
def usage_report(spark, sf):
    return U.usage_report(U.log_rows(fx.runs(spark, sf)))


@query
def user_report(spark, sf):
    return U.user_report(U.log_rows(fx.runs(spark, sf)))


# ── keys and page text ────────────────────────────────────────────────────────


@query
def url_key(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.md5_key(F.concat(F.lit(" "), F.upper("url"))).alias("url_hash"))


@query
def entity_key(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", X.md5_key(F.concat(F.initcap("p_name"), F.lit("\t "))).alias("entity_hash"))


@query
def clean_text(spark, sf):
    return fx.pages(spark, sf).select("page_id", P.clean_text(F.col("html")).alias("clean_text"))


@query
def content_hash(spark, sf):
    return fx.pages(spark, sf).select("page_id", P.content_hash(F.col("html")).alias("content_hash"))


@query
def content_groups(spark, sf):
    return P.content_groups(paste_to_pages(fx.spread(fx.table(spark, sf, "documents"))).drop("content_hash"))


@query
def page_title(spark, sf):
    parsed = fx.parsed(spark, sf)
    return parsed.select("page_id", P.page_title(F.col("text"), F.col("nodes")).alias("title"))


@query
def page_description(spark, sf):
    return fx.annotated_parsed(spark, sf).select("page_id", P.page_description(F.col("nodes")).alias("description"))


@query
def page_headings(spark, sf):
    found = fx.annotated_parsed(spark, sf).select("page_id", F.explode(P.page_headings(F.col("text"), F.col("nodes"))).alias("h"))
    return found.select("page_id", "h.pos", "h.level", "h.text")


@query
def strip_boilerplate(spark, sf):
    stripped = P.strip_boilerplate(fx.parsed(spark, sf))
    root = F.get("nodes", F.lit(0))
    return stripped.select("page_id", F.size("removed").alias("removed_subtrees"), F.md5(N.kept_text(F.col("text"), F.col("removed"), root)).alias("kept_md5"))


@query
def main_content(spark, sf):
    stripped = P.strip_boilerplate(fx.annotated_parsed(spark, sf))
    return stripped.select("page_id", P.main_content(F.col("text"), F.col("nodes"), F.col("removed")).alias("content"))


@query
def body_text(spark, sf):
    return fx.page_texts(spark, sf).select("page_id", "body")


@query
def full_text(spark, sf):
    text = P.full_text(*[F.col(c) for c in ("title", "description", "headings", "body")])
    return P.page_text(fx.annotated_parsed(spark, sf)).select("page_id", text.alias("full_text"))


@query
def site_ids(spark, sf):
    urls = fx.table(spark, sf, "pages").selectExpr("page_id", "CASE WHEN page_id % 10 = 3 THEN 'no url' WHEN page_id % 10 = 4 THEN '' ELSE url END AS url")
    return urls.select("page_id", P.site_ids(F.col("url")).alias("s")).select("page_id", "s.*")


@query
def name_from_title(spark, sf):
    titled = fx.table(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, CASE p_size % 4 WHEN 0 THEN ' | ' WHEN 1 THEN '-' WHEN 2 THEN ' ' ELSE ' - a | ' END, p_brand, CASE WHEN p_size = 7 THEN '' ELSE ' x' END) AS t")
    return titled.select("p_partkey", X.name_from_title(F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("- "), "t")).otherwise(F.col("t"))).alias("name"))


@query
def name_in(spark, sf):
    pairs = fx.table(spark, sf, "part").selectExpr("p_partkey", "p_name", "concat(upper(replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN '  ' WHEN 1 THEN '' ELSE '_' END)), ' ', p_brand) AS hay")
    return pairs.select("p_partkey", X.name_in(F.col("p_name"), F.col("hay")).alias("found"))


@query
def count_occurrences(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"), "lang")
    counts = [X.count_occurrences(F.col("t"), F.lit(n)).alias(a) for n, a in (("the", "n_the"), ("ee", "n_ee"), ("", "n_empty"))]
    return docs.select("doc_id", *counts, X.count_occurrences(F.col("t"), F.col("lang")).alias("n_lang"))


# ── mentions ──────────────────────────────────────────────────────────────────


@query
def capitalised_phrases(spark, sf):
    found = fx.spread(fx.table(spark, sf, "documents")).select("doc_id", F.posexplode(M.capitalised_phrases(F.col("text"))).alias("pos", "phrase"))
    return found


@query
def product_names(spark, sf):
    text = "concat('The ', p_name, ' ', p_type, CASE p_size % 3 WHEN 0 THEN ' pro edition' WHEN 1 THEN ' Air, mini max' ELSE ' plus1 Lite' END)"
    found = fx.table(spark, sf, "part").selectExpr("p_partkey", f"{text} AS t")
    return found.select("p_partkey", F.posexplode(M.product_names(F.col("t"))).alias("pos", "name"))


@query
def product_names_documents(spark, sf):
    found = fx.spread(fx.table(spark, sf, "documents")).selectExpr("doc_id", "replace(text, 'the', 'studio') AS t")
    return found.select("doc_id", F.posexplode(M.product_names(F.col("t"))).alias("pos", "name"))


@query
def drop_common(spark, sf):
    words = fx.spread(fx.table(spark, sf, "documents")).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+"), F.lit(0)))).alias("name"))
    words = words.withColumn("name", F.when(F.length("name") == 1, F.upper("name")).when(F.length("name") == 2, F.concat(F.upper(F.substring("name", 1, 1)), F.lit(" "), F.upper(F.substring("name", 2, 1)))).otherwise(F.initcap("name")))
    return words.filter(~M.is_common(F.col("name"))).groupBy("name").agg(F.count("*").alias("docs"))


@query
def mentions(spark, sf):
    return fx.text_mentions(spark, sf)


@query
def top_mentions(spark, sf):
    """A report of the :data:`TOP` names on most pages."""
    return fx.text_mentions(spark, sf, cap=None).groupBy("name").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).orderBy(F.col("pages").desc(), "name").limit(TOP)


@query
def extract_entities(spark, sf):
    pages = fx.spread(fx.table(spark, sf, "documents")).select(F.col("doc_id").alias("page_id"), F.md5(F.concat(F.lit("doc "), F.col("doc_id"))).alias("content_hash"), F.col("text").alias("full_text"))
    found = M.extract_entities(pages, M.parse_extraction(fx.extraction_responses(spark, sf)))
    return found.select("page_id", "main_topic", "confidence", F.array_join("names", "|").alias("names"))


@query
def extraction_requests(spark, sf):
    pages = fx.table(spark, sf, "documents").select(F.md5("text").alias("content_hash"), F.col("text").alias("full_text"))
    asked = M.extraction_requests(pages, prompt="Name the entities.\n")
    return asked.select("content_hash", F.md5("prompt").alias("prompt_md5"), "model", "max_tokens", "temperature")


@query
def parse_extraction(spark, sf):
    return M.parse_extraction(fx.extraction_responses(spark, sf)).withColumn("names", F.array_join("names", "|"))


@query
def cost_rollup(spark, sf):
    responses = fx.extraction_responses(spark, sf)
    calls = M.parse_extraction(responses).join(responses.select("content_hash", "lang"), "content_hash")
    return M.cost_rollup(calls, "lang")


def _alias_names(spark, sf):
    texts = "CASE p_partkey % 6 WHEN 0 THEN ' SEO ' WHEN 1 THEN 'College' WHEN 2 THEN 'social media marketing' WHEN 3 THEN 'Pay Per Click' WHEN 4 THEN 'content marketing' ELSE p_name END"
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{texts} AS name")


@query
def canonical_entity(spark, sf):
    return M.canonical_entities(_alias_names(spark, sf)).select("p_partkey", "canonical")


@query
def entity_variants(spark, sf):
    return M.entity_variants(_alias_names(spark, sf)).select("p_partkey", "variant_pos", "variant")


# ── linking ───────────────────────────────────────────────────────────────────


def _skip_names(spark, sf):
    texts = """CASE p_partkey % 12 WHEN 0 THEN 'Local SEO' WHEN 1 THEN concat(p_name, ' Pricing') WHEN 2 THEN 'Newsletter' WHEN 3 THEN 'Areas' WHEN 4 THEN 'Public'
      WHEN 5 THEN concat('a b c d ', p_name) WHEN 6 THEN 'Meet & Greet' WHEN 7 THEN 'Wonder' WHEN 8 THEN concat('Wonder ', p_name) WHEN 9 THEN concat(p_name, ' report')
      WHEN 10 THEN 'Schema Markups' ELSE p_name END"""
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{texts} AS name")


@query
def skip_filter(spark, sf):
    return _skip_names(spark, sf).select("p_partkey", "name", L.is_skipped(F.col("name")).alias("skipped"))


@query
def base_score(spark, sf):
    asked = fx.text_mentions(spark, sf).withColumn("cached", F.expr("length(name) % 6 = 0"))
    return L.base_score(asked).select("page_id", "pos", "batch", "base")


@query
def base_score_page(spark, sf):
    return L.base_score(fx.text_mentions(spark, sf), batch_size=None).select("page_id", "pos", "base")


@query
def known_entities(spark, sf):
    texts = "CASE p_partkey % 5 WHEN 0 THEN ' Instagram' WHEN 1 THEN 'X (formerly Twitter)' WHEN 2 THEN 'MOZ' WHEN 3 THEN 'Machine Learning' ELSE p_name END"
    return L.known_entities(fx.table(spark, sf, "part").selectExpr("p_partkey", f"{texts} AS name"))


@query
def wiki_search_terms(spark, sf):
    texts = """CASE p_partkey % 6 WHEN 0 THEN concat('SEO', CASE WHEN p_size > 25 THEN '' ELSE 'x' END) WHEN 1 THEN "O'Hare" WHEN 2 THEN concat(initcap(p_name), ' Airport')
      WHEN 3 THEN 'Academic Programs' ELSE p_name END"""
    named = fx.table(spark, sf, "part").selectExpr(f"{texts} AS name", "CASE WHEN p_size % 2 = 0 THEN 'Higher Education' ELSE 'Rings' END AS topic").distinct()
    asked = named.select("name", "topic", L.is_academic(F.col("name"), F.col("topic")).alias("academic"))
    return L.wiki_search_terms(asked.select("name", "academic").distinct())


@query
def search_index(spark, sf):
    """The stored index of page titles: each run of leading words with its best entries."""
    return fx.knowledge_base(spark, sf).index["pages"].table.select("key", "hit", "title")


def _candidates(spark, sf):
    kb = fx.knowledge_base(spark, sf)
    return L.wiki_candidates(fx.names(spark, sf), kb.pages, kb.index["pages"])


@query
def wiki_candidates(spark, sf):
    found = _candidates(spark, sf)
    return found.select("name", "hit", "title", "url")


@query
def wiki_reject(spark, sf):
    pairs = fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 7 WHEN 0 THEN 'AI SEO' WHEN 1 THEN 'Analytics' WHEN 2 THEN 'SEO' WHEN 3 THEN 'Content Marketing' ELSE p_name END AS name",
        """concat(CASE p_size % 6 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Web Analytics' WHEN 2 THEN 'Marketing Strategy' WHEN 3 THEN concat(p_name, ' (', p_brand, ')') WHEN 4 THEN p_name ELSE 'Rings in Texas' END) AS title""",
    )
    return pairs.select("p_partkey", L.wiki_rejected(F.col("name"), F.col("title")).alias("rejected"))


@query
def wiki_score(spark, sf):
    found = L.wiki_scored(_candidates(spark, sf))
    return found.select("name", "title", "score")


@query
def wiki_score_forms(spark, sf):
    pairs = fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' airport') WHEN 1 THEN concat('big ', p_name, ' airport') WHEN 2 THEN 'green airport' WHEN 3 THEN concat(p_name, ' of the ring')
           WHEN 4 THEN concat(p_name, ' zz') WHEN 5 THEN p_name WHEN 6 THEN concat('the ', p_name, ' aa bb') ELSE p_name END AS name""",
        """CASE p_partkey % 8 WHEN 0 THEN concat(initcap(p_name), ' International Airport') WHEN 1 THEN concat(p_name, ' Airport') WHEN 2 THEN concat(p_brand, ' Airport') WHEN 3 THEN initcap(p_name)
           WHEN 4 THEN p_name WHEN 5 THEN concat(p_name, ' in California') WHEN 6 THEN concat('bb aa ', p_name) ELSE concat(initcap(p_name), ' aa bb cc dd ee ff gg hh ii jj kk ll') END AS title""",
    )
    return pairs.select("p_partkey", L.wiki_score(F.col("name"), F.col("title")).alias("score"))


def _verified(spark, sf):
    kb = fx.knowledge_base(spark, sf)
    return L.wiki_verified(L.wiki_scored(_candidates(spark, sf)), kb.pages), kb


@query
def wiki_verify(spark, sf):
    return _verified(spark, sf)[0].select("name", "title", "score")


@query
def wiki_best(spark, sf):
    return L.wiki_best(_verified(spark, sf)[0]).select("name", "title", "url", "score")


@query
def wikidata_from_page(spark, sf):
    verified, kb = _verified(spark, sf)
    return L.wikidata_from_page(L.wiki_best(verified), kb.items).select("name", "page_item")


@query
def wikidata_direct(spark, sf):
    kb = fx.knowledge_base(spark, sf)
    return L.wikidata_direct(fx.names(spark, sf), kb.items, kb.index["items"]).select("name", "direct_item", "score")


@query
def label_score(spark, sf):
    pairs = fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name AS entity",
        "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat('a ', p_name) WHEN 2 THEN split(p_name, ' ')[0] WHEN 3 THEN '' ELSE concat(split(p_name, ' ')[1], ' xx') END AS label",
        "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat('some ', split(p_name, ' ')[1]) ELSE upper(p_name) END AS description",
    )
    return pairs.select("p_partkey", L.label_score(F.col("entity"), F.col("label"), F.col("description")).alias("score"))


@query
def academic_mismatch(spark, sf):
    pairs = fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 4 WHEN 0 THEN repeat(concat(p_name, ' '), 6) WHEN 1 THEN repeat(replace(p_name, ' ', ''), 20) ELSE p_name END AS label",
        "CASE p_size % 4 WHEN 0 THEN 'Study in New  Zealand' WHEN 1 THEN 'Performance monitoring for action' WHEN 2 THEN 'bin ukulele' ELSE '' END AS description",
    )
    return pairs.select("p_partkey", L.academic_mismatch(F.col("label"), F.col("description")).alias("mismatch"))


@query
def google_kg(spark, sf):
    kb = fx.knowledge_base(spark, sf)
    return L.graph_best(fx.names(spark, sf), kb.graph, kb.index["graph"])


@query
def product_ontology(spark, sf):
    return L.product_ontology(fx.names(spark, sf), fx.knowledge_base(spark, sf).urls)


def _fit_pairs(spark, sf):
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE initcap(p_name) END AS name",
        "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'the services' WHEN 2 THEN concat('The ', p_type, '!') WHEN 3 THEN concat('Ring & ', lower(p_type), ' widget-world') ELSE concat(p_name, ' ', p_name, ' solutions') END AS topic",
        "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('a poet of ', lower(p_type), ' things') WHEN 2 THEN concat('about ', p_name, ' ', p_name) ELSE concat(lower(p_type), ' widget world') END AS text",
    )


@query
def person_context(spark, sf):
    name, topic, text = F.col("name"), F.col("topic"), F.col("text")
    return _fit_pairs(spark, sf).select(
        "p_partkey", L.person_fits_extract(name, topic, text).alias("by_extract"), L.person_fits_description(name, topic, text).alias("by_description")
    )


@query
def entity_type(spark, sf):
    rows = fx.table(spark, sf, "part").selectExpr(
        "CASE p_partkey % 3 WHEN 0 THEN initcap(p_name) WHEN 1 THEN concat(p_name, ' School') ELSE p_name END AS name",
        "CASE WHEN p_size % 7 = 0 THEN 'Product' END AS known", "CASE p_size % 4 WHEN 0 THEN 'Q571' WHEN 1 THEN 'Q1' END AS p31", "p_partkey",
    )
    return rows.select("p_partkey", L.entity_type(F.col("name"), F.col("known"), F.col("p31")).alias("type"))


@query
def confidence(spark, sf):
    rows = fx.scored_mentions(spark, sf).withColumn("base", F.expr("(40 - pos) / 40 * 70"))
    columns = ("base", "wikipedia_url", "wikidata_url", "google_kg_url", "product_ontology_url", "type")
    return rows.select("page_id", "pos", L.confidence(*[F.col(c) for c in columns]).alias("score"))


def _topic_mentions(spark, sf):
    """Mentions of the cleaned text with the topic from the page's title."""
    pages = fx.pages(spark, sf)
    title = X.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return pages.select("page_id", X.name_from_title(title).alias("main_topic"), F.posexplode(M.leading_names(P.clean_text(F.col("html")))).alias("pos", "name"))


@query
def linked_entities(spark, sf):
    """Linking end to end: candidates, scores, topic fit, types and confidence of every mention."""
    return L.link_mentions(settle(_topic_mentions(spark, sf)), fx.knowledge_base(spark, sf)).drop("batch")


@query
def rank_entities(spark, sf):
    return L.rank_entities(fx.scored_mentions(spark, sf)).select("page_id", "pos", "rank")


@query
def merge_cached(spark, sf):
    asked = fx.text_mentions(spark, sf)
    rows = fx.scored_mentions(spark, sf)
    cached = rows.filter("length(name) <= 5").groupBy(F.lower("name").alias("lower_name")).agg(
        F.max_by(F.struct(*L.ENTITY_FIELDS), F.struct("page_id", "pos")).alias("entity")
    )
    fresh = rows.filter("length(name) BETWEEN 6 AND 9").withColumn("batch", F.expr("CAST(floor(pos / 5) AS INT)"))
    return L.merge_cached(asked, cached, fresh).select("page_id", "pos", "name", "type", "confidence", "google_kg_url")


@query
def linkedin_person(spark, sf):
    parsed = fx.annotated_parsed(spark, sf)
    text, nodes = F.col("text"), F.col("nodes")
    return parsed.select("page_id", *[L.linkedin_person(text, nodes, F.lit(n)).alias(a) for n, a in (("Ada Byron", "ada"), ("Alan Turing", "alan"), ("ada byron", "lower_case"))])


@query
def linkedin_company(spark, sf):
    html = F.concat(F.lit('<div><a href="https://www.linkedin.com/company/part-'), "p_partkey", F.lit('?x=1"><b>'), F.initcap("p_name"), F.lit('</b></a> <a href="http://linkedin.com/company/other">Other</a></div>'))
    return fx.part_pages(spark, sf, html, "p_name").select("page_id", L.linkedin_company(F.col("text"), F.col("nodes"), F.col("p_name")).alias("company"), L.linkedin_company(F.col("text"), F.col("nodes"), F.lit("Nobody")).alias("nobody"))


# ── salience and recommendations ──────────────────────────────────────────────


def _page_rows(spark, sf):
    """One row per page: text, entities and a topic."""
    rows = E.page_entities(fx.page_texts(spark, sf), fx.scored_mentions(spark, sf))
    topic = "CASE page_id % 4 WHEN 0 THEN 'SEO Search' WHEN 1 THEN 'Limo Hire' WHEN 2 THEN 'Higher Education' END"
    first = F.get("entities", F.lit(0))["name"]
    return rows.withColumn("main_topic", F.coalesce(F.expr(topic), first, F.col("title")))


_TEXT = ("title", "headings", "body")


@query
def salience_score(spark, sf):
    return E.salience_by_row(fx.scored_mentions(spark, sf))


@query
def salience_score_page(spark, sf):
    return _page_rows(spark, sf).select("page_id", E.salience_score(F.col("entities")).alias("salience"))


@query
def topic_patterns(spark, sf):
    topics = "CASE p_partkey % 6 WHEN 0 THEN 'Limo and SEO' WHEN 1 THEN 'Research' WHEN 2 THEN 'Higher Ed' WHEN 3 THEN 'Education search' WHEN 4 THEN '' ELSE p_name END"
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{topics} AS topic").select("p_partkey", E.topic_patterns(F.col("topic")).alias("pattern"))


def _irrelevant():
    return E.irrelevant_entities(F.col("entities"), *[F.col(c) for c in _TEXT], F.col("main_topic"))


@query
def irrelevant_entities(spark, sf):
    return _page_rows(spark, sf).select("page_id", F.array_join(_irrelevant(), "|").alias("irrelevant"))


@query
def irrelevant_by_topic(spark, sf):
    names = """array(named_struct('name', concat('University ', p_name), 'confidence', 50), named_struct('name', p_name, 'confidence', 39), named_struct('name', p_name, 'confidence', 40),
      named_struct('name', 'Search College', 'confidence', 79), named_struct('name', 'Absent', 'confidence', 80), named_struct('name', 'Absent', 'confidence', 79))"""
    rows = fx.table(spark, sf, "part").selectExpr(
        "p_partkey", f"{names} AS entities", "concat('University ', p_name) AS title", "array(named_struct('level', 2, 'text', 'Search college')) AS headings", "'' AS body",
        "CASE p_partkey % 4 WHEN 0 THEN 'seo' WHEN 1 THEN 'limo' WHEN 2 THEN 'education' ELSE 'rings' END AS topic",
    )
    found = E.irrelevant_entities(F.col("entities"), *[F.col(c) for c in _TEXT], F.col("topic"))
    return rows.select("p_partkey", F.array_join(found, "|").alias("irrelevant"))


def _with_tips(rows):
    rows = rows.withColumn("irrelevant_names", _irrelevant())
    return rows.withColumn("tips", E.salience_tips(F.col("entities"), F.col("main_topic"), F.col("irrelevant_names")))


@query
def salience_tips(spark, sf):
    return _with_tips(_page_rows(spark, sf)).select("page_id", F.array_join("tips", "\n").alias("tips"))


def _basic():
    return E.recommend_basic(*[F.col(c) for c in ("entities", "title", "description", "headings", "body")])


@query
def recommend_basic(spark, sf):
    return E.recommendation_rows(_page_rows(spark, sf).select("page_id", _basic().alias("recommendations")))


@query
def main_topic(spark, sf):
    rows = fx.page_texts(spark, sf)
    rows = rows.withColumn("names", M.leading_names(F.col("body")))
    return rows.select("page_id", *[M.main_topic(F.col("title"), F.col("body"), F.col("names"), strategy=s).alias(s) for s in ("strict", "title", "frequent")])


@query
def schema_context(spark, sf):
    docs = """CASE p_partkey % 5 WHEN 0 THEN '{"@graph":[]}' WHEN 1 THEN concat('{"@type":"WebPage","mainEntity":{"@type":"', p_type, '"},"speakable":{}}')
      WHEN 2 THEN '{"@type":"X","mainEntity":[{"@type":"X"},{"@type":"Y"},{}],"hasPart":[],"sameAs":["u"]}' WHEN 3 THEN '{"knowsAbout":[1],"provider":{"a":1}}' END"""
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{docs} AS j").select("p_partkey", E.schema_context(F.col("j")).alias("context"))


@query
def recommendation_requests(spark, sf):
    rows = _page_rows(spark, sf).withColumn("jsonld", F.lit('{"@type":"Article"}'))
    asked = E.recommendation_requests(rows, prompt="Read:\n", task="\nAdvise.")
    return asked.select("page_id", F.md5("prompt").alias("prompt_md5"), "model", "max_tokens")


@query
def parse_recommendations(spark, sf):
    fallback = F.array(F.struct(F.lit("General").alias("category"), F.lit("none").alias("advice")))
    rows = fx.recommendation_responses(spark, sf).select("page_id", E.parse_recommendations(F.col("body"), fallback).alias("recommendations"))
    return E.recommendation_rows(rows)


@query
def score_bands(spark, sf):
    rows = fx.scored_mentions(spark, sf)
    return E.score_bands(rows, E.salience_by_row(rows))


# ── classification ────────────────────────────────────────────────────────────


def _classified_documents(spark, sf):
    """Documents as page text, with ordinary words replaced by the words the patterns look for."""
    text = """CASE doc_id % 6 WHEN 0 THEN replace(text, ' the ', ' services ') WHEN 1 THEN replace(text, ' the ', ' guide ') WHEN 2 THEN replace(replace(text, ' of ', ' tuition '), ' the ', ' shop ')
      WHEN 3 THEN replace(replace(text, ' of ', ' limo agency '), ' the ', ' partner ') WHEN 4 THEN replace(text, ' of ', ' phd ') ELSE text END"""
    return fx.spread(fx.table(spark, sf, "documents")).selectExpr(
        "doc_id", "concat('Doc ', lang) AS title", "source AS description",
        "array(named_struct('level', 1, 'text', concat('About ', lang)), named_struct('level', 2, 'text', 'More')) AS headings", f"{text} AS body",
    )


@query
def schema_type(spark, sf):
    counts = C.pattern_counts(*[F.col(c) for c in ("title", "description", "headings", "body")])
    rows = _classified_documents(spark, sf).select("doc_id", counts.alias("c"))
    return rows.select("doc_id", "c.*", C.schema_type(F.col("c")).alias("schema_type"))


_SERVICE_WORDS = "CASE p_partkey % 8 WHEN 0 THEN 'Organic Search' WHEN 1 THEN 'pay-per-click ads' WHEN 2 THEN 'content marketing and SEO' WHEN 3 THEN 'Link building' WHEN 4 THEN 'limousine service' WHEN 5 THEN 'limousines' WHEN 6 THEN 'website development' ELSE '' END"
_AUDIENCE_WORDS = "CASE p_size % 6 WHEN 0 THEN 'for universities' WHEN 1 THEN 'k-12 schools' WHEN 2 THEN 'clinic' WHEN 3 THEN 'shopify retailers' WHEN 4 THEN 'legalese' ELSE 'enterprise law firm' END"


def _titled_parts(spark, sf):
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name AS title", f"{_AUDIENCE_WORDS} AS description", f"array(named_struct('level', 1, 'text', {_SERVICE_WORDS})) AS headings"
    )


@query
def service_type(spark, sf):
    found = _titled_parts(spark, sf).select("p_partkey", C.service_type(*[F.col(c) for c in ("title", "description", "headings")]).alias("s"))
    return found.select("p_partkey", "s.service_type", F.array_join("s.same_as", "|").alias("same_as"))


@query
def main_topic_pattern(spark, sf):
    """Topics by the ``pattern`` strategy: the service that title, description and headings name, else the title."""
    parts = _titled_parts(spark, sf)
    kind = C.service_type(*[F.col(c) for c in ("title", "description", "headings")])["service_type"]
    return parts.select("p_partkey", M.main_topic(F.col("title"), F.col("description"), F.array().cast("array<string>"), kind, "pattern").alias("topic"))


@query
def audience(spark, sf):
    found = _titled_parts(spark, sf).select("p_partkey", C.audience(*[F.col(c) for c in ("title", "description", "headings")]).alias("a"))
    return found.select("p_partkey", "a.name", "a.type", "a.industry", "a.educational_role", "a.audience_type")


# ── structured data and JSON-LD ───────────────────────────────────────────────


def _structured(spark, sf):
    return J.structured_columns(fx.annotated_parsed(spark, sf))


@query
def contact_info(spark, sf):
    parsed = fx.annotated_parsed(spark, sf)
    text, nodes = F.col("text"), F.col("nodes")
    found = parsed.select("page_id", S.telephone(text).alias("telephone"), S.address(text, nodes).alias("a"))
    return found.select("page_id", "telephone", "a.postalCode", "a.addressRegion", "a.addressCountry", "a.streetAddress", "a.addressLocality")


@query
def parse_address(spark, sf):
    texts = """CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' ', p_name, ' road, Paris, TX 75460-', lpad(p_size, 4, '0'), ' United States') WHEN 1 THEN concat(p_name, ' lane 12345') WHEN 2 THEN p_name
      WHEN 3 THEN concat('NY ', p_name) WHEN 4 THEN concat(p_name, ', ', p_brand, ' usa') ELSE '' END"""
    rows = fx.table(spark, sf, "part").selectExpr("p_partkey", f"{texts} AS t").select("p_partkey", S.parse_address(F.col("t")).alias("a"))
    return rows.select("p_partkey", "a.postalCode", "a.addressRegion", "a.addressCountry", "a.streetAddress", "a.addressLocality")


@query
def social_links(spark, sf):
    found = fx.annotated_parsed(spark, sf).select("page_id", F.posexplode(S.social_links(F.col("nodes"))).alias("pos", "link"))
    return found


@query
def author_and_organization(spark, sf):
    parsed = fx.annotated_parsed(spark, sf)
    text, nodes = F.col("text"), F.col("nodes")
    return parsed.select("page_id", S.author(text, nodes).alias("author"), S.organization(text, nodes).alias("organization"))


@query
def faq(spark, sf):
    found = fx.annotated_parsed(spark, sf).select("page_id", S.faq(F.col("text"), F.col("nodes")).alias("faq"))
    rows = found.select("page_id", F.posexplode_outer("faq.mainEntity").alias("pos", "q")).filter("pos IS NOT NULL")
    return rows.select("page_id", "pos", "q.name", F.col("q.acceptedAnswer.text").alias("answer"))


@query
def clean_qa(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat(CASE doc_id % 3 WHEN 0 THEN 'Q: ' WHEN 1 THEN 'question:' ELSE '#12. ' END, 'how ', lang, CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '' END) AS q", "concat('Answer:  ', text) AS a"
    )
    return rows.select("doc_id", S.clean_question(F.col("q")).alias("question"), S.clean_answer(F.col("a")).alias("answer"))


@query
def howto(spark, sf):
    found = fx.annotated_parsed(spark, sf).select("page_id", S.howto(F.col("text"), F.col("nodes")).alias("h"))
    steps = F.array_join(F.transform("h.step", lambda s: F.concat_ws("/", s["position"], s["text"], s["name"])), "|")
    return found.select("page_id", "h.name", "h.description", "h.totalTime", steps.alias("steps"), F.array_join(F.transform("h.supply", lambda s: s["name"]), "|").alias("supply"))


@query
def howto_from_headings(spark, sf):
    html = "concat('<h1>How to use ', p_name, '</h1><h2>Step 1: Take ', p_name, '</h2><p>First  take it.</p><p>Then look.</p><h3>2. Turn</h3><p>Turn it ', p_size, ' times.</p><h2>End</h2><p>x</p>')"
    parsed = fx.part_pages(spark, sf, html)
    found = parsed.select("page_id", S.howto(F.col("text"), F.col("nodes")).alias("h"))
    steps = F.array_join(F.transform("h.step", lambda s: F.concat_ws("/", s["position"], s["name"], s["text"])), "|")
    return found.select("page_id", "h.name", steps.alias("steps"))


@query
def howto_numbered(spark, sf):
    """Steps from numbered lines of a container without step elements."""
    html = """concat('<h1>Keeping ', p_name, '</h1><div class="howto"><h2>How to keep ', p_name, '</h2>\n<p>Everything here takes a little care and thought.</p>\n1. Take the ', p_name,
      ' out of its box\n2) Step 2: Turn it ', p_size, ' times  to the left\n3. short\n</div>')"""
    parsed = fx.part_pages(spark, sf, html)
    found = parsed.select("page_id", S.howto(F.col("text"), F.col("nodes")).alias("h"))
    steps = F.array_join(F.transform("h.step", lambda s: F.concat_ws("/", s["position"], s["name"], s["text"])), "|")
    return found.select("page_id", "h.name", "h.description", steps.alias("steps"))


@query
def faq_accordion(spark, sf):
    """Answers of accordions: the sibling with an answer's class, else the next one that is long enough."""
    html = """concat('<div class="accordion"><div class="accordion-title">How is ', p_name, ' made?</div><p>A note that is long enough to be an answer of its own.</p>',
      '<div class="accordion-content">It is made of ', p_type, ' in boxes of ', p_size, ' pieces.</div></div>',
      '<div class="accordion"><button aria-expanded="false">Where is ', p_name, ' sold?</button><div>x</div><p>Shops of the brand ', p_brand, ' sell it for a price.</p></div>')"""
    parsed = fx.part_pages(spark, sf, html)
    found = parsed.select("page_id", S.faq(F.col("text"), F.col("nodes")).alias("faq"))
    rows = found.select("page_id", F.posexplode_outer("faq.mainEntity").alias("pos", "q")).filter("pos IS NOT NULL")
    return rows.select("page_id", "pos", "q.name", F.col("q.acceptedAnswer.text").alias("answer"))


@query
def howto_time(spark, sf):
    texts = "concat('About ', p_size, CASE p_partkey % 5 WHEN 0 THEN ' hrs and 5mins' WHEN 1 THEN ' Hours, 2 days' WHEN 2 THEN 'days' WHEN 3 THEN ' minute' ELSE ' moons' END)"
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{texts} AS t").select("p_partkey", S.howto_time(F.col("t")).alias("total_time"))


@query
def clean_step(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr("doc_id", "concat(CASE WHEN doc_id % 2 = 0 THEN 'Step 3:  ' ELSE '#4. ' END, text) AS t")
    return rows.select("doc_id", S.clean_step(F.col("t")).alias("step"))


@query
def program_details(spark, sf):
    texts = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' takes 2 years or 18 Months' WHEN 1 THEN ' 4 year HYBRID degree' WHEN 2 THEN ', 12weeks online certificate, 30 Credits' ELSE '' END)"
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{texts} AS t").select("p_partkey", S.program_details(F.col("t")).alias("d")).select("p_partkey", "d.*")


def _full_rows(spark, sf):
    """Annotated pages with text, entities and structured data, one row each."""
    parsed = fx.annotated_parsed(spark, sf)
    rows = P.page_text(parsed, also=J.structured_values())
    return E.page_entities(rows, fx.scored_mentions(spark, sf))


def _entity_rows(spark, sf):
    return E.page_entities(fx.pages(spark, sf).select("page_id"), fx.scored_mentions(spark, sf))


@query
def about_things(spark, sf):
    found = _entity_rows(spark, sf).select("page_id", F.posexplode(J.about_things(F.col("entities"))).alias("pos", "t"))
    return found.select("page_id", "pos", F.to_json("t").alias("thing"))


@query
def knows_about(spark, sf):
    found = _entity_rows(spark, sf).select("page_id", F.posexplode(J.knows_about(F.col("entities"))).alias("pos", "t"))
    return found.select("page_id", "pos", F.to_json("t").alias("thing"))


@query
def education_provider(spark, sf):
    rows = E.page_entities(fx.pages(spark, sf).selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN '' ELSE concat('T', page_id, ' - x') END AS title"), fx.scored_mentions(spark, sf))
    named = F.transform("entities", lambda e: F.when((e["pos"] == 3) & (F.col("page_id") % 3 == 0), e.withField("name", F.concat(e["name"], F.lit(" Academy")))).otherwise(e))
    return rows.withColumn("entities", named).select("page_id", J.education_provider().alias("provider"))


@query
def site_nodes(spark, sf):
    return _structured(spark, sf).select("page_id", F.to_json("org_node").alias("organization"), F.to_json("site_node").alias("website"))


@query
def speakable(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return pages.select("page_id", *[F.to_json(J.speakable(n)).alias(f"speakable_{n}") for n in (4, 5, 6)])


def _written(spark, sf, kind):
    return _full_rows(spark, sf).select("page_id", J.WRITERS[kind]().alias("jsonld"))


@query
def jsonld_webpage(spark, sf):
    return _written(spark, sf, "WebPage")


@query
def jsonld_article(spark, sf):
    return _written(spark, sf, "Article")


@query
def jsonld_service(spark, sf):
    return _written(spark, sf, "Service")


@query
def jsonld_local_business(spark, sf):
    return _written(spark, sf, "LocalBusiness")


@query
def jsonld_educational(spark, sf):
    return _written(spark, sf, "EducationalOccupationalProgram")


@query
def generate_jsonld(spark, sf):
    made = J.generate_jsonld(_full_rows(spark, sf))
    return made.groupBy("schema_type").agg(F.count("*").alias("pages"), F.count(F.when(F.length("jsonld") > 2, 1)).alias("documents"))


@query
def generate_jsonld_types(spark, sf):
    """The document of every page, on pages of all five types, with audience, service type and programme details."""
    rows = P.page_text(dom.parse_pages(fx.typed(spark, sf)), also=J.structured_values())
    return J.generate_jsonld(E.page_entities(rows, fx.scored_mentions(spark, sf)))


# ── fan-out ───────────────────────────────────────────────────────────────────


@query
def semantic_chunks(spark, sf):
    return G.chunk_rows(G.semantic_chunks(fx.annotated_parsed(spark, sf)))


@query
def semantic_chunks_fallback(spark, sf):
    return G.chunk_rows(G.semantic_chunks(fx.parsed(spark, sf)))


@query
def fanout_requests(spark, sf):
    docs = fx.table(spark, sf, "documents").selectExpr(
        "doc_id AS page_id", "CASE WHEN doc_id % 2 = 0 THEN concat('https://example.org/', doc_id) ELSE '' END AS url", "md5(text) AS content_hash",
        "concat(transform(split(text, '\\n', -1), line -> named_struct('type', 'section', 'heading', lang, 'content', line)), array(named_struct('type', 'list', 'heading', CAST(NULL AS STRING), 'content', source))) AS chunks",
    )
    asked = G.fanout_requests(docs, prompt="Read.\n", task="\nAnswer.")
    return asked.select("page_id", "content_hash", "chunks_extracted", F.md5("prompt").alias("prompt_md5"), "temperature", "maxOutputTokens")


@query
def parse_fanout(spark, sf):
    parsed = G.parse_fanout(fx.fanout_responses(spark, sf))
    return parsed.select("content_hash", "primary_entity", F.size("queries").alias("n_queries"), F.array_join("follow_ups", "|").alias("follow_ups"), "coverage_score", "recommendations")


@query
def fanout_queries(spark, sf):
    return G.query_rows(G.parse_fanout(fx.fanout_responses(spark, sf)))


@query
def coverage_pct(spark, sf):
    return G.parse_fanout(fx.fanout_responses(spark, sf)).select("content_hash", G.coverage_pct(F.col("coverage_score")).alias("pct"))


@query
def coverage_rollup(spark, sf):
    return G.coverage_rollup(G.query_rows(G.parse_fanout(fx.fanout_responses(spark, sf))), "content_hash")


@query
def coverage_corpus(spark, sf):
    return G.coverage_rollup(G.query_rows(G.parse_fanout(fx.fanout_responses(spark, sf))))


# ── results, streams, DOM ─────────────────────────────────────────────────────


def _results(spark, sf):
    rows = _with_tips(_page_rows(spark, sf))
    # Pages whose response is broken have no recommendations, pages that were not labelled no fan-out result.
    answered = fx.recommendation_responses(spark, sf).filter(F.from_json("body", "recommendations array<string>").isNotNull() & ~F.startswith("body", F.lit("broken")))
    made = rows.join(answered.select("page_id"), "page_id", "left_semi").select(
        "page_id", F.concat(F.lit('{"n":'), "page_id", F.lit("}")).alias("jsonld"), _basic().alias("recommendations"),
        E.salience_score(F.col("entities")).alias("salience"), "tips", F.col("irrelevant_names").alias("irrelevant"),
    )
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    fan = fx.table(spark, sf, "pages").join(labelled, "page_id", "left_semi").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN concat('analysis ', page_id) END AS analysis", "CAST(page_id % 9 AS INT) AS chunks_extracted", "CASE WHEN page_id % 3 = 1 THEN 'no key' END AS error"
    )
    return R.assemble_results(rows.select("page_id", "url", "main_topic"), rows.select("page_id", "entities"), made, fan)


@query
def assemble_results(spark, sf):
    out = _results(spark, sf)
    sizes = [F.size(c).alias(f"n_{c}") for c in ("entities", "recommendations", "tips")]
    return out.select("page_id", "url", "main_topic", "jsonld", "salience", F.array_join("irrelevant", "|").alias("irrelevant"), *sizes, "analysis", "chunks_extracted", "error", "processing_time_ms", "cached")


@query
def reports(spark, sf):
    """Reports written as files and read back."""
    path = ST.run_folder(spark, "reports")
    R.write_reports(_results(spark, sf), path)
    return spark.read.schema("page_id long, report string").json(path).select("page_id", "report")


@query
def dom_nodes(spark, sf):
    return dom.dom_nodes(fx.parsed(spark, sf)).groupBy("page_id").agg(
        F.count(F.when(F.col("tag") == "p", 1)).alias("p"), F.count(F.when(F.col("tag") == "li", 1)).alias("li"), F.count(F.when(F.col("tag") == "a", 1)).alias("a"),
        F.count(F.when(F.col("tag").isin("html", "head", "body"), 1)).alias("frame"), F.md5(F.max(F.when(F.col("tag") == "nav", F.col("text")))).alias("nav_md5"),
    )


@query
def dom_nodes_documents(spark, sf):
    parsed = dom.parse_pages(paste_to_pages(fx.spread(fx.table(spark, sf, "documents"))))
    return parsed.select("page_id", F.md5(F.array_join("text", "")).alias("text_md5"), (F.element_at("nodes", -1)["pre_end"] + 1 == F.size("nodes")).alias("closed"))


@query
def analyse_corpus(spark, sf):
    """Every stage in turn over the annotated pages, with stored stage tables."""
    results = corpus.analyse(spark, fx.annotated(spark, sf), fx.knowledge_base(spark, sf), ST.run_folder(spark, "corpus"))
    return results.select("page_id", "url", F.size("entities").alias("n_entities"), F.size("recommendations").alias("n_recommendations"), "chunks_extracted", F.get_json_object("jsonld", "$['@context']").alias("context"))


@query
def analyse_again(spark, sf):
    """A second run over the same pages, and a third after a tenth of them have changed: what was found before is used."""
    pages, folder, kb = settle(fx.annotated(spark, sf)), ST.run_folder(spark, "again"), fx.knowledge_base(spark, sf)
    news = F.concat(F.lit("<body><div><h2>news of page "), "page_id", F.lit("</h2><p>page "), "page_id", F.lit(" has changed.</p></div>"))
    changed = pages.withColumn("html", F.when(F.col("page_id") % 10 == 3, F.replace("html", F.lit("<body>"), news)).otherwise(F.col("html")))
    out = None
    for number, (name, given) in enumerate((("first", pages), ("same", pages), ("changed", changed))):
        at = fx.AS_OF_TIME + timedelta(minutes=10 * number)
        results = corpus.analyse(spark, given, kb, f"{folder}/{name}", state=f"{folder}/state", as_of=at)
        counts = corpus.stage_rows(spark, f"{folder}/{name}")
        rows = results.select(F.lit(name).alias("run"), "page_id", "url", "cached", "chunks_extracted", F.lit(counts["parsed"]).cast("long").alias("n_parsed"), F.lit(counts["links"] > 0).alias("linked"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _stream_events(spark, sf):
    return ST.read_stream(spark, sf, "events.parquet", fx.table(spark, sf, "events").schema)


@query
def stream_new_content(spark, sf):
    keyed = _stream_events(spark, sf).selectExpr("event_id", "ts", "md5(concat('content ', user_id % 97)) AS content_hash")
    keyed = keyed.withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.write_new_content(keyed, ST.run_folder(spark, "content")).groupBy("content_hash").agg(F.count("*").alias("extractions"))


@query
def stream_usage(spark, sf):
    return ST.write_usage(ST.usage_counts(_stream_events(spark, sf)), ST.run_folder(spark, "usage")).select("user_id", "month", "runs")


@query
def stream_hit_rate(spark, sf):
    cache = fx.cache_of(spark, sf, "view", "url_hash", "24 HOURS").select("url_hash", "written_at", "expires_at")
    keyed = _stream_events(spark, sf).selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS at", "ts", "md5(concat('https://example.org/u/', user_id)) AS url_hash")
    hit = F.coalesce((F.col("at") > F.col("written_at")) & (F.col("at") < F.col("expires_at")), F.lit(False))
    rated = ST.hit_rate(keyed.join(cache, "url_hash", "left").withColumn("hit", hit))
    return ST.write_hit_rate(rated, ST.run_folder(spark, "hits")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query
def stream_pages(spark, sf):
    arriving = ST.read_stream(spark, sf, "pages.parquet", fx.table(spark, sf, "pages").schema)
    path = ST.write_page_texts(arriving, ST.run_folder(spark, "pages"))
    return spark.read.parquet(path).select("page_id", "title", F.md5("body").alias("body_md5"))

"""The whole analysis of a corpus, stage by stage, and again after some of its pages have changed.

Each stage writes a table under the run's folder and a manifest beside it: what went in, the settings, the schema. A stage
whose manifest matches is read instead of run, so a job that was killed carries on after its last finished stage, and what
earlier stages found is kept.

Work that was done before is found in stored caches (:class:`State`): results by address, links by name, answers of models
by content. Only pages that are new, changed or expired, or whose answers have come in since, go through the stages. Of
pages with the same markup one is parsed, linked and scored; its rows go back to the others at the end, in a join of plain
exchanges, so a markup that a third of the corpus shares is split like any hot key.

What models should answer leaves as request tables under ``requests/``, only for content without an answer. Answers come
back with a later run, as ``responses``.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X
from pagequarry.operators import classify as C
from pagequarry.operators import dom
from pagequarry.operators import fanout as G
from pagequarry.operators import jsonld as J
from pagequarry.operators import linking as L
from pagequarry.operators import mentions as M
from pagequarry.operators import page_text as P
from pagequarry.operators import report as R
from pagequarry.operators import scoring as E
from pagequarry.operators.stores import CacheStore, folder_exists
from pagequarry.session import settle

#: A list of page ids up to this many is broadcast, so that pages are picked in their scan; a longer one is joined.
PICKED = 2_000_000

_RESULT = (
    "main_topic string, entities {entities}, jsonld string, recommendations {advice}, salience int, tips array<string>, "
    "irrelevant array<string>, analysis string, chunks_extracted int, error string"
)
RESULT_COLUMNS = ("main_topic", "entities", "jsonld", "recommendations", "salience", "tips", "irrelevant", "analysis", "chunks_extracted", "error")


@dataclass
class State:
    """The stored caches of a corpus, shared by its runs."""

    results: CacheStore
    links: CacheStore
    extraction: CacheStore
    fanout: CacheStore
    recommendation: CacheStore

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> State:
        result = _RESULT.format(entities=f"array<{E.ENTITY.simpleString()}>", advice=E.RECOMMENDATION)
        links = "name string, topic_key string, " + ", ".join(f"{c} string" for c in L.LINK_COLUMNS)
        names = "main_topic string, confidence double, names array<string>, tokens bigint, cost_usd double"
        store = lambda name, key, ttl, payload: CacheStore(spark, f"{folder.rstrip('/')}/{name}", key, ttl, payload)
        return cls(
            store("results", "url_hash", rules.ANALYSIS_TTL, f"markup_hash string, answers string, {result}"),
            store("links", "link_hash", rules.ENTITY_TTL, links),
            store("extraction", "content_hash", rules.EXTRACTION_TTL, names),
            store("fanout", "content_hash", rules.FANOUT_TTL, "analysis string, error string"),
            store("recommendation", "page_key", rules.ANALYSIS_TTL, f"advice {E.RECOMMENDATION}"),
        )


class Run:
    """Stage tables and manifests under ``root``."""

    def __init__(self, spark: SparkSession, root: str, settings: Mapping[str, object]) -> None:
        self.spark, self.root, self.settings = spark, root.rstrip("/"), json.dumps(settings, sort_keys=True, default=str)
        self.input = ""

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read where its manifest matches, else made, written, and its manifest after it."""
        manifest = self.path(f"manifest/{name}")
        wanted = hashlib.sha256(f"{name}\n{self.input}\n{self.settings}".encode()).hexdigest()
        if folder_exists(self.spark, manifest):
            found = self.spark.read.schema("fingerprint string, fields string").json(manifest).first()
            if found and found["fingerprint"] == wanted:
                return self.spark.read.schema(T.StructType.fromJson(json.loads(found["fields"]))).parquet(self.path(name))
        df = make()
        df.write.mode("overwrite").parquet(self.path(name))
        fields = self.spark.read.parquet(self.path(name)).schema
        self.spark.createDataFrame([(wanted, fields.json())], "fingerprint string, fields string").coalesce(1).write.mode("overwrite").json(manifest)
        return self.spark.read.schema(fields).parquet(self.path(name))

    def once(self, name: str, act: Callable[[], None]) -> None:
        """An act on stored state, not repeated once its manifest is there."""

        def make() -> DataFrame:
            act()
            return self.spark.createDataFrame([(name,)], "done string")

        self.stage(name, make)


def stage_rows(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows of what the costly stages took in: pages parsed, names linked, pages whose stored result was used, and requests."""
    names = ("cached", "parsed", "links", "requests/extraction", "requests/fanout", "requests/recommendation")
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}").count() for n in names}


def link_hash(name: Column, topic: Column) -> Column:
    return F.md5(F.concat_ws("\n", name, topic))


def page_key(url_hash: Column, markup_hash: Column) -> Column:
    return F.md5(F.concat(url_hash, markup_hash))


def _picked(pages: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``pages`` whose id is in ``chosen(page_id, …)``, with its ``columns``; pages are shuffled only for a long list."""
    right = chosen.select("page_id", *columns)
    return pages.join(F.broadcast(right) if right.count() <= PICKED else right, "page_id")


def _store_answers(run: Run, state: State, keys: DataFrame, responses: Mapping[str, DataFrame], now: Column) -> None:
    """Usable answers go to the caches."""
    if "extraction" in responses:
        usable = M.parse_extraction(responses["extraction"]).filter(F.col("names").isNotNull())
        run.once("stored_extraction", lambda: state.extraction.upsert(usable.withColumn("written_at", now)))
    if "fanout" in responses:
        given = responses["fanout"].select("content_hash", F.col("body").alias("analysis"), F.lit(None).cast("string").alias("error"), now.alias("written_at"))
        run.once("stored_fanout", lambda: state.fanout.upsert(given.filter(F.coalesce("analysis", F.lit("")) != "")))
    if "recommendation" in responses:
        advice = E.parse_recommendations(F.col("body"), F.lit(None))
        keyed = responses["recommendation"].join(keys.select("page_id", "page_key"), "page_id")
        usable = keyed.select("page_key", advice.alias("advice"), now.alias("written_at")).filter(F.col("advice").isNotNull())
        run.once("stored_recommendation", lambda: state.recommendation.upsert(usable))


def _answered(state: State, keys: DataFrame, now: Column) -> DataFrame:
    """``keys`` with ``answers``, which tells a result made with one set of answers from another."""
    out, stamps = keys, []
    for name, store in (("extraction", state.extraction), ("fanout", state.fanout), ("recommendation", state.recommendation)):
        out = store.lookup(out, now).withColumn(f"_{name}", F.col("_entry.written_at").cast("string")).drop("_entry")
        stamps.append(F.coalesce(f"_{name}", F.lit("")))
    return out.select(*keys.columns, F.concat_ws("|", *stamps).alias("answers"))


def analyse(
    spark: SparkSession,
    pages: DataFrame,
    kb: L.KnowledgeBase,
    root: str,
    extracted: DataFrame | None = None,
    topic_strategy: str = "strict",
    batch_size: int | None = rules.BATCH_SIZE,
    state: str | None = None,
    as_of: datetime | None = None,
    responses: Mapping[str, DataFrame] | None = None,
    version: str = "",
) -> DataFrame:
    """``pages(page_id, url, html)`` to one result row per page; stage tables and manifests are written under ``root``.

    With a folder for ``state``, results and links stored there by earlier runs are used while they live, and this run's
    are stored; a result is used only for the same address with the same markup and the same answers. ``responses`` are
    answers to request tables: ``extraction`` and ``fanout`` as ``(content_hash, body)``, ``recommendation`` as
    ``(page_id, body)``. ``extracted`` holds parsed extraction answers; pages without one fall back to patterns, and pages
    without a topic take one by ``topic_strategy``. ``version`` names the snapshot tables: a finished stage is not
    repeated under the same ``root`` unless the pages, these settings or ``version`` have changed.
    """
    shared = State.at(spark, state or f"{root.rstrip('/')}/state")
    now = F.lit((as_of or datetime.now(timezone.utc).replace(tzinfo=None)).isoformat(sep=" ")).cast("timestamp_ntz")
    run = Run(spark, root, {"topics": topic_strategy, "batch": batch_size, "version": version, "answers": sorted(responses or ()), "extracted": extracted is not None})

    hashed = pages.select("page_id", "url", X.md5_key(F.col("url")).alias("url_hash"), P.content_hash(F.col("html")).alias("content_hash"), F.md5("html").alias("markup_hash"))
    hashed = settle(hashed)  # pages are read and hashed once, for the manifests and for the first stage
    seen = hashed.agg(F.count("*"), F.sum(F.xxhash64(*hashed.columns).cast("decimal(38,0)"))).first()
    run.input = f"{seen[0]} {seen[1]}"
    keys = run.stage("keys", lambda: hashed.withColumn("page_key", page_key(F.col("url_hash"), F.col("markup_hash"))))
    _store_answers(run, shared, keys, responses or {}, now)
    keys = run.stage("answered", lambda: _answered(shared, keys, now))

    def cached() -> DataFrame:
        found = shared.results.lookup(keys, now)
        same = (F.col("_entry.markup_hash") == F.col("markup_hash")) & (F.col("_entry.answers") == F.col("answers"))
        return found.filter(same).select("page_id", "url", *[f"_entry.{c}" for c in RESULT_COLUMNS])

    before = run.stage("cached", cached)
    fresh = run.stage("fresh", lambda: keys.join(before.select("page_id"), "page_id", "left_anti"))
    one = run.stage("representatives", lambda: fresh.groupBy("markup_hash").agg(F.min("page_id").alias("page_id"), F.min("content_hash").alias("content_hash")))
    parsed = run.stage("parsed", lambda: dom.parse_pages(_picked(pages.select("page_id", "url", "html"), one, ["markup_hash", "content_hash"])))

    full = P.full_text(*[F.col(c) for c in ("title", "description", "headings", "body")])
    nodes = F.col("nodes")
    also = [*J.content_values(), N.select(nodes, "meta").alias("metas"), L.person_anchors(F.col("text"), nodes).alias("anchors")]
    text = run.stage("page_text", lambda: P.page_text(parsed, keep=("content_hash", "markup_hash"), also=also).withColumn("full_text", full))
    chunks = run.stage("chunks", lambda: G.semantic_chunks(parsed))

    def mentioned() -> DataFrame:
        stored = shared.extraction.lookup(text.select("content_hash").distinct(), now).filter(F.col("_entry").isNotNull())
        known = stored.select("content_hash", "_entry.main_topic", "_entry.confidence", "_entry.names")
        if extracted is not None:
            given = extracted.select("content_hash", "main_topic", "confidence", "names")
            known = given.unionByName(known.join(given.select("content_hash"), "content_hash", "left_anti"))
        found = M.extract_entities(text, known if known.head(1) else None)  # without answers no page travels to meet one
        kind = C.service_type(F.col("title"), F.col("description"), F.col("headings"))["service_type"]
        derived = M.main_topic(F.col("title"), F.col("full_text"), F.col("names"), kind, topic_strategy)
        return M.explode_names(found.withColumn("main_topic", F.coalesce(X.not_blank(F.col("main_topic")), derived)))

    mentions = run.stage("mentions", mentioned)
    scored = L.scored_keys(mentions, batch_size)
    asked = run.stage("link_keys", lambda: shared.links.lookup(scored.select("name", "topic_key").distinct().withColumn("link_hash", link_hash(F.col("name"), F.col("topic_key"))), now))
    missing = asked.filter(F.col("_entry").isNull()).select("name", "topic_key")
    # The snapshot is searched only when there is something to search for.
    made = run.stage("links", lambda: L.link_names(missing, kb) if missing.head(1) else missing.select("*", *[F.lit(None).cast("string").alias(c) for c in L.LINK_COLUMNS]))
    links = made.unionByName(asked.filter(F.col("_entry").isNotNull()).select("name", "topic_key", *[f"_entry.{c}" for c in L.LINK_COLUMNS]))
    run.once("stored_links", lambda: shared.links.upsert(made.select(link_hash(F.col("name"), F.col("topic_key")).alias("link_hash"), "*", now.alias("written_at"))))

    def joined() -> DataFrame:
        linked = L.with_links(scored, links)
        none = linked.filter("false").select(F.lower("name").alias("lower_name"), F.struct(*L.ENTITY_FIELDS).alias("entity"))
        return L.merge_cached(mentions, none, linked)

    linked = run.stage("linked", joined)

    def page_rows() -> DataFrame:
        entities = E.entities_by_page(linked)
        topics = mentions.groupBy("page_id").agg(F.first("main_topic").alias("main_topic"))
        empty = F.array().cast(entities.schema["entities"].dataType)
        # Dealt out by number: what follows is dear, and partitions put together by their size leave cores idle.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = text.drop("full_text").repartition(parts, "page_id").join(entities, "page_id", "left").join(topics, "page_id", "left")
        anchors = F.when(F.size("anchors") > 0, F.col("anchors"))
        rows = rows.withColumn("entities", J.with_profiles(F.coalesce("entities", empty), anchors)).drop("anchors")
        rows = rows.withColumn("main_topic", F.coalesce("main_topic", X.name_from_title(F.col("title"))))
        rows = rows.withColumn("irrelevant", E.irrelevant_entities(F.col("entities"), *[F.col(c) for c in ("title", "headings", "body", "main_topic")]))
        rows = rows.withColumns(
            {
                "salience": E.salience_score(F.col("entities")),
                "tips": E.salience_tips(F.col("entities"), F.col("main_topic"), F.col("irrelevant")),
                "basic": E.recommend_basic(*[F.col(c) for c in ("entities", "title", "description", "headings", "body")]),
            }
        )
        rows = rows.join(chunks.select("page_id", F.size("chunks").alias("chunks_extracted")), "page_id", "left")
        return J.with_schema_type(rows).drop("page_id", "url", "content_hash")

    rows = run.stage("rows", page_rows)

    def finished() -> DataFrame:
        home = fresh.select("page_id", "url", "page_key", "content_hash", "markup_hash").join(rows, "markup_hash")
        home = home.select("*", *J.site_values(F.col("metas"), F.col("url"), F.col("socials"))).drop("metas")
        home = shared.fanout.lookup(home, now).withColumns({"analysis": F.col("_entry.analysis"), "error": F.col("_entry.error")}).drop("_entry")
        home = shared.recommendation.lookup(home, now).withColumn("recommendations", F.coalesce("_entry.advice", F.col("basic").cast(E.RECOMMENDATION))).drop("_entry")
        return home.withColumn("jsonld", J.document()).select("page_id", "url", *RESULT_COLUMNS, "body")

    done = run.stage("finished", finished)
    _write_requests(run, shared, text, chunks, done, fresh, now)
    keyed = fresh.select("page_id", "url_hash", "markup_hash", "answers")
    run.once("stored_results", lambda: shared.results.upsert(done.drop("url", "body").join(keyed, "page_id").withColumn("written_at", now)))

    def results() -> DataFrame:
        every = done.select("page_id", "url", *RESULT_COLUMNS, F.lit(False).alias("cached")).unionByName(before.withColumn("cached", F.lit(True)))
        generated = every.select("page_id", *R.GENERATED)
        return R.assemble_results(every.select("page_id", "url", "main_topic", "cached"), every, generated, every.select("page_id", *R.FANOUT))

    return run.stage("results", results)


def _write_requests(run: Run, state: State, text: DataFrame, chunks: DataFrame, done: DataFrame, fresh: DataFrame, now: Column) -> None:
    """Request tables of this run: one request per content (or page, for recommendations) that has no answer yet."""

    def unanswered(store: CacheStore, rows: DataFrame) -> DataFrame:
        return store.lookup(rows, now).filter(F.col("_entry").isNull()).drop("_entry")

    run.stage("requests/extraction", lambda: M.extraction_requests(unanswered(state.extraction, text.select("content_hash", "full_text"))))

    def fanout() -> DataFrame:
        one = unanswered(state.fanout, text.select("page_id", "url", "content_hash")).groupBy("content_hash").agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))
        return G.fanout_requests(one.join(chunks, "page_id"))

    run.stage("requests/fanout", fanout)

    def recommendation() -> DataFrame:
        open_ = unanswered(state.recommendation, fresh.select("page_id", "page_key"))
        return E.recommendation_requests(done.select("page_id", "body", "entities", "jsonld").join(open_.select("page_id"), "page_id"))

    run.stage("requests/recommendation", recommendation)

"""Fan-out: semantic chunks of a page, request and response tables, query coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X

CHUNKS = "array<struct<type:string,heading:string,content:string>>"


def _level(tag: Column) -> Column:
    """Heading level of a tag, 0 for other tags."""
    return F.find_in_set(tag, F.lit("h1,h2,h3,h4,h5,h6"))


def until(items: Column, stop) -> Column:
    """Leading items before the first that satisfies ``stop``."""
    def leading(all_: Column) -> Column:
        at = F.array_position(F.transform(all_, lambda s: F.coalesce(stop(s), F.lit(False))), True)
        return X.let(at.cast("int"), lambda i: F.when(i > 0, F.slice(all_, F.lit(1), i - 1)).otherwise(all_))

    return X.let(items, leading)


def _chunk(kind: str, content: Column, limit: int | None, heading: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None).cast("string") if heading is None else heading).alias("heading"),
        X.cut(content, limit).alias("content"),
    )


def _some(kind: str, parts: Column, limit: int | None) -> Column:
    """A list of one chunk from joined parts, empty when there are none."""
    return F.when(F.size(parts) > 0, F.array(_chunk(kind, F.array_join(parts, " | "), limit)).cast(CHUNKS)).otherwise(F.array().cast(CHUNKS))


def semantic_chunks(parsed: DataFrame, read_ldjson: bool = False, limits: rules.Limits = rules.LIMITS) -> DataFrame:
    """``(page_id, chunks)``: the page's content blocks in order, after its noise elements are cut out.

    With ``read_ldjson`` structured data is read before scripts are removed; by default it never appears. What is removed is
    worked out once a page, as a flag for each node and as text runs with gaps; a chunk is then a slice of those arrays.
    """
    out = parsed
    for columns in _chunk_steps(read_ldjson, limits):
        out = out.select(*columns)
    return out


@X.built_once
def _chunk_steps(read_ldjson: bool, limits: rules.Limits) -> list[list[Column | str]]:
    """The columns of each step from a parsed page to its chunks."""
    nodes, text, gone, live = F.col("nodes"), F.col("kept"), F.col("gone"), F.col("live")
    ranges = ["page_id", "text", "nodes", N.outermost(nodes, *rules.FANOUT_NOISE).alias("removed")]
    base = [
        "page_id", "text", "nodes",
        N.kept_runs(F.col("text"), F.col("removed")).alias("kept"),
        N.removed_flags(nodes, F.col("removed")).alias("gone"),
        N.without(nodes, F.col("removed")).alias("live"),
    ]
    shown = lambda n: X.trim(N.run_text(text, n))
    visible = lambda n: ~F.get(gone, n["pre"])

    # Elements that several expressions look at are columns of their own, found once.
    wanted = [
        "*",
        X.trim(F.array_join(F.transform(N.select(live, "title"), lambda n: N.run_text(text, n)), "")).alias("title"),
        N.first(live, "h1").alias("h1"),
        N.select(live, "meta").alias("metas"),
        N.select(live, "h2", "h3").alias("heads"),
        N.select(live, "ul", "ol").alias("groups"),
        F.coalesce(N.first(live, *rules.FANOUT_ROOT), N.first(live, "body")).alias("scope"),
    ]
    meta = lambda *sel: X.trim(N.meta(F.col("metas"), *sel))
    topic = F.filter(F.array(F.col("title"), shown(F.col("h1")), meta('meta[name="description"]', 'meta[property="og:description"]')), lambda t: F.coalesce(t, F.lit("")) != "")

    def section(h: Column) -> Column:
        level = lambda s: _level(s["tag"])
        later = F.filter(N.later_siblings(nodes, h), visible)
        within = until(later, lambda s: level(s).between(1, level(h)))
        texts = F.filter(F.transform(within, shown), lambda t: t != "")
        return _chunk("section", F.array_join(texts, " "), limits.section_chars, shown(h))

    def items(u: Column) -> Column:
        inner = F.filter(F.slice(nodes, u["pre"] + 2, u["pre_end"] - u["pre"]), lambda n: (n["tag"] == "li") & visible(n))
        return F.transform(inner, shown)

    data = F.array().cast(CHUNKS)
    if read_ldjson:
        raw = F.transform(N.select(nodes, 'script[type="application/ld+json"]'), lambda n: X.trim(X.collapse(N.run_text(F.col("text"), n))))
        kind = lambda t: F.get_json_object(t, "$['@type']")
        data = F.transform(
            F.filter(raw, lambda t: F.coalesce(kind(t), F.lit("")) != ""),
            lambda t: _chunk("structured_data", F.concat(F.lit("Type: "), kind(t), F.lit(", "), X.cut(t, limits.ldjson_chars)), None),
        )

    long_lists = X.head(F.filter(F.transform("groups", items), lambda i: F.size(i) > 2), limits.lists)
    first = [
        "page_id", "kept", "live", "metas", "scope",
        topic.alias("topic"),
        F.filter(F.transform("heads", section), lambda c: c["content"] != "").cast(CHUNKS).alias("sections"),
        F.transform(long_lists, lambda i: _chunk("list", F.array_join(i, " | "), limits.list_chars)).cast(CHUNKS).alias("lists"),
        data.cast(CHUNKS).alias("data"),
    ]

    few, scope = F.size("sections") < 3, F.col("scope")
    inner = F.filter(live, lambda n: (n["pre"] > scope["pre"]) & (n["pre"] <= scope["pre_end"]))
    none = lambda column: F.when(few, column).otherwise(F.array().cast("array<string>"))
    squeezed = lambda n: X.trim(X.collapse(N.run_text(text, n)))
    long = F.filter(F.transform(F.filter(inner, lambda n: n["tag"] == "p"), squeezed), lambda t: F.length(t) >= 80)
    paragraphs = F.transform(X.head(long, limits.paragraphs), lambda t: X.cut(t, limits.paragraph_chars))
    sentences = F.split(squeezed(scope), rf"(?<=[.!?]){X.SPACE}+", -1)
    asked = F.filter(sentences, lambda s: F.contains(s, F.lit("?")) & F.length(s).between(11, 249))
    terms = F.filter(F.transform(F.filter(inner, N.selector(*rules.FANOUT_TERMS)), shown), lambda t: F.length(t).between(2, 80))
    signal = lambda label, *sel: F.concat(F.lit(label), X.not_blank(N.meta(F.col("metas"), *sel)))
    signals = F.array_compact(
        F.array(
            signal("og:type=", 'meta[property="og:type"]'),
            signal("og:site=", 'meta[property="og:site_name"]'),
            signal("twitter:title=", 'meta[name="twitter:title"]'),
        )
    )
    second = [
        "page_id", "topic", "sections", "lists", "data",
        none(paragraphs).alias("paragraphs"), none(X.head(asked, limits.questions)).alias("asked"),
        none(X.head(F.array_distinct(terms), limits.terms)).alias("terms"), none(signals).alias("signals"),
    ]
    primary = F.when(F.size("topic") > 0, F.array(_chunk("primary_topic", F.array_join("topic", " — "), limits.topic_chars)).cast(CHUNKS)).otherwise(F.array().cast(CHUNKS))
    chunks = F.concat(
        primary, "sections", "lists", "data",
        _some("paragraphs", F.col("paragraphs"), limits.paragraphs_chars),
        _some("questions_on_page", F.col("asked"), limits.questions_chars),
        _some("key_terms", F.col("terms"), limits.terms_chars),
        _some("page_metadata", F.col("signals"), limits.metadata_chars),
    )
    return [ranges, base, wanted, first, second, ["page_id", chunks.alias("chunks")]]


def chunk_rows(chunked: DataFrame) -> DataFrame:
    """``(page_id, pos, type, heading, content)``.

    The outer form keeps the optimiser from asking for the array's size before, which would work the chunks out twice.
    """
    return chunked.select("page_id", F.posexplode_outer("chunks").alias("pos", "c")).filter("pos IS NOT NULL").select("page_id", "pos", "c.*")


DEFAULT_FANOUT_PROMPT = (
    "Analyse how a search assistant would split a question about this page into sub-queries, and how well the page "
    "answers them.\n\n"
)
DEFAULT_FANOUT_TASK = """

Name the primary entity. Predict 12-15 distinct sub-queries of different intent (definition, related topics, implicit
needs, comparison, procedure, evaluation, audience and context, trust). For each say whether the page answers it fully
(Yes), in part (Partial) or not at all (No), and why in one sentence. List 5-8 follow-up questions.

Answer in plain text, one item per line, in this format:

PRIMARY ENTITY: [entity name]

FAN-OUT QUERIES:
• [Query] - Coverage: [Yes/Partial/No] - Why: [one-sentence rationale]

FOLLOW-UP POTENTIAL:
• [Follow-up question]

COVERAGE SCORE: [X/Y queries fully covered]
RECOMMENDATIONS: [2-4 sentences on the most valuable content gaps]"""


def fanout_requests(pages: DataFrame, prompt: str = DEFAULT_FANOUT_PROMPT, task: str = DEFAULT_FANOUT_TASK) -> DataFrame:
    """One request per page with its chunks as JSON: ``pages`` is ``(page_id, url, content_hash, chunks)``."""
    where = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("URL: "), "url", F.lit("\n\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit(prompt), where, F.lit("SEMANTIC CHUNKS FROM PAGE:\n"), F.to_json("chunks"), F.lit(task))
    settings = [F.lit(v).alias(k) for k, v in rules.FANOUT_MODEL.items()]
    return pages.select("page_id", "content_hash", F.size("chunks").alias("chunks_extracted"), body.alias("prompt"), *settings)


# ── responses ─────────────────────────────────────────────────────────────────

_DASH = "[-–—]"
_COVERAGE = "(Yes|Partial|No)"
_BULLET = r"^\s*(?:[•‣◦\-*]|\d+\.)\s+(.*)$"
_STATE = (
    "struct<section:string,primary_entity:string,queries:array<struct<query:string,coverage:string,rationale:string>>,"
    "follow_ups:array<string>,coverage_score:string,recommendations:string>"
)


def _plain(line: Column) -> Column:
    return X.trim(X.sub(X.sub(line, r"^\*+|\*+$", ""), r"^#+\s*", ""))


def parse_query(item: Column) -> Column:
    """``(query, coverage, rationale)`` of one list item; the forms are tried in order."""
    forms = [
        rf"^(.+?)\s*{_DASH}\s*Coverage:\s*{_COVERAGE}\b\s*{_DASH}\s*Why:\s*(.+)$",
        rf"^(.+?)\s*{_DASH}\s*Coverage:\s*{_COVERAGE}\b.*$",
        rf"^(.+?)\s*\[{_COVERAGE}\].*$",
        rf"^(.+?)\s*{_DASH}\s*{_COVERAGE}\b.*$",
    ]
    why = X.trim(X.first_match(item, r"Why:\s*(.+)$", 1))
    out = F.struct(item.alias("query"), F.lit("Unknown").alias("coverage"), F.lit(None).cast("string").alias("rationale"))
    for i in reversed(range(len(forms))):
        regex = X.rx(forms[i], "i")
        reason = X.trim(F.regexp_extract(item, regex, 3)) if i == 0 else why
        found = F.struct(
            X.sub(X.trim(F.regexp_extract(item, regex, 1)), r"[?:.]+$", "?").alias("query"),
            F.regexp_extract(item, regex, 2).alias("coverage"),
            reason.alias("rationale"),
        )
        out = F.when(item.rlike(regex), found).otherwise(out)
    return out


def _step(acc: Column, line: Column) -> Column:
    """One non-blank line of a response: a section header, a list item of the current section, or running text."""
    head = X.sub(_plain(line), r"^\d+\.\s*", "")
    item = _plain(X.trim(X.first_match(line, _BULLET, 1)))
    return X.let(head, lambda h: X.let(item, lambda i: _advance(acc, line, h, i)))


def _advance(acc: Column, line: Column, head: Column, item: Column) -> Column:
    primary = X.first_match(head, r"^PRIMARY\s+ENTITY:\s*(.*)$", 1)
    score = X.first_match(head, r"^COVERAGE\s+SCORE:\s*(.*)$", 1)
    advice = X.first_match(head, r"^(?:RECOMMENDATIONS?|OPTIMIZATION[S]?):\s*(.*)$", 1)
    header = (
        F.when(primary.isNotNull(), F.lit("primary"))
        .when(X.hits(head, r"^FAN-?OUT\s+QUERIES:?"), F.lit("fanout"))
        .when(X.hits(head, r"^FOLLOW[-\s]?UP(\s+POTENTIAL|\s+QUESTIONS)?:?"), F.lit("followup"))
        .when(score.isNotNull(), F.lit("coverage"))
        .when(advice.isNotNull(), F.lit("recommendations"))
    )
    return X.let(header, lambda h: _apply(acc, line, item, h, primary, score, advice))


def _apply(
    acc: Column, line: Column, item: Column, header: Column, primary: Column, score: Column, advice: Column
) -> Column:
    section = acc["section"]
    is_item = header.isNull() & item.isNotNull()
    is_text = header.isNull() & item.isNull()
    more = F.when(is_item, item).otherwise(line)
    longer = F.concat(acc["recommendations"], F.when(acc["recommendations"] == "", F.lit("")).otherwise(F.lit(" ")), more)
    return F.struct(
        F.coalesce(header, section).alias("section"),
        F.when(header == "primary", F.coalesce(X.not_blank(X.trim(primary)), acc["primary_entity"]))
        .when(is_text & (section == "primary") & acc["primary_entity"].isNull(), line)
        .otherwise(acc["primary_entity"])
        .alias("primary_entity"),
        F.when(is_item & (section == "fanout"), F.array_append(acc["queries"], parse_query(item))).otherwise(acc["queries"]).alias("queries"),
        F.when(is_item & (section == "followup"), F.array_append(acc["follow_ups"], item)).otherwise(acc["follow_ups"]).alias("follow_ups"),
        F.when(header == "coverage", X.trim(score)).otherwise(acc["coverage_score"]).alias("coverage_score"),
        F.when(header == "recommendations", F.coalesce(X.not_blank(X.trim(advice)), acc["recommendations"]))
        .when(header.isNull() & (section == "recommendations"), longer)
        .otherwise(acc["recommendations"])
        .alias("recommendations"),
    ).cast(_STATE)


def parse_fanout(responses: DataFrame) -> DataFrame:
    """Response text to ``(content_hash, primary_entity, queries, follow_ups, coverage_score, recommendations)``.

    A fold over the lines inside the row: responses are a few dozen lines.
    """
    lines = F.filter(F.transform(F.split("body", "\n", -1), X.trim), lambda line: line != "")
    start = F.struct(
        F.lit("").alias("section"), F.lit(None).cast("string").alias("primary_entity"), F.array().alias("queries"),
        F.array().alias("follow_ups"), F.lit("").alias("coverage_score"), F.lit("").alias("recommendations"),
    ).cast(_STATE)
    return responses.select("content_hash", F.aggregate(lines, start, _step).alias("r")).select("content_hash", "r.*").drop("section")


def query_rows(parsed: DataFrame) -> DataFrame:
    """``(content_hash, pos, query, coverage, rationale)``."""
    return parsed.select("content_hash", F.posexplode("queries").alias("pos", "q")).select("content_hash", "pos", "q.*")


def coverage_pct(score: Column) -> Column:
    """``X/Y`` as a rounded percentage, NULL without a fraction or with Y = 0."""
    regex = r"(\d+)\s*/\s*(\d+)"
    covered, total = X.first_match(score, regex, 1).cast("double"), X.first_match(score, regex, 2).cast("double")
    return F.when(total != 0, X.js_round(covered / total * 100))


def coverage_rollup(queries: DataFrame, *keys: str) -> DataFrame:
    """Queries per coverage value, one column each, per ``keys``."""
    values = ["Yes", "Partial", "No", "Unknown"]
    counts = [F.count(F.when(F.lower("coverage") == v.lower(), F.lit(1))).alias(v.lower()) for v in values]
    return queries.groupBy(*keys).agg(*counts)

"""Keys, content hashes and page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.session import settle

HEADING_KIND = "array<struct<pos:int,level:int,text:string>>"


def clean_text(html: Column) -> Column:
    """Text for hashing: script and style blocks and tags become blanks, white space collapses. Not a DOM parse."""
    out = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " ")
    out = F.regexp_replace(out, r"(?i)<style[\s\S]*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return X.trim(X.collapse(out))


def content_hash(html: Column) -> Column:
    return F.md5(clean_text(html))


def with_keys(pages: DataFrame) -> DataFrame:
    """Adds ``url_hash`` and ``content_hash``."""
    return pages.withColumns({"url_hash": X.md5_key(F.col("url")), "content_hash": content_hash(F.col("html"))})


def content_groups(pages: DataFrame) -> DataFrame:
    """Pages with their content hash, and the page that stands for it (the lowest id) with the group size.

    Only ``(page_id, hash)`` travels, settled once so that the pages are read and hashed once; a ``content_hash``
    column is used where the table has it. Counts and minima are combined before the shuffle, so a hash shared by a third
    of the corpus costs one row per task. The groups are written before the way back, so that the join on the hash is
    one of plain exchanges, whose hot keys the adaptive skew join splits.
    """
    given = "content_hash" in pages.columns
    hashed = pages.select("page_id", "content_hash" if given else content_hash(F.col("html")).alias("content_hash"))
    hashed = hashed if given else settle(hashed)
    groups = hashed.groupBy("content_hash").agg(F.min("page_id").alias("representative"), F.count("*").alias("copies"))
    return hashed.join(settle(groups), "content_hash").select("page_id", "content_hash", "representative", "copies")


def page_title(text: Column, nodes: Column) -> Column:
    """First ``title`` element, else ``og:title``."""
    title = X.trim(N.node_text(text, N.first(nodes, "title")))
    fallback = X.trim(N.first(nodes, 'meta[property="og:title"]')["attrs"]["content"])
    return F.coalesce(X.not_blank(title), fallback, F.lit(""))


def page_description(nodes: Column) -> Column:
    return F.coalesce(X.trim(N.first(nodes, 'meta[name="description"]')["attrs"]["content"]), F.lit(""))


def page_headings(text: Column, nodes: Column) -> Column:
    """h1 to h4 in document order, blank ones left out, as ``(pos, level, text)``."""
    found = F.transform(
        N.select(nodes, "h1", "h2", "h3", "h4"),
        lambda n: F.struct(F.substring(n["tag"], 2, 1).cast("int").alias("level"), X.trim(N.node_text(text, n)).alias("text")),
    )
    kept = F.filter(found, lambda h: h["text"] != "")
    return F.transform(kept, lambda h, i: F.struct(i.cast("int").alias("pos"), h["level"], h["text"])).cast(HEADING_KIND)


def boilerplate(nodes: Column) -> Column:
    """Outermost boilerplate subtrees as ranges."""
    return N.outermost(nodes, *rules.BOILERPLATE)


def strip_boilerplate(parsed: DataFrame) -> DataFrame:
    """Adds ``removed``: the boilerplate ranges of each page."""
    return parsed.withColumn("removed", boilerplate(F.col("nodes")))


def main_content(text: Column, nodes: Column, removed: Column) -> Column:
    """Longest trimmed text among the content containers, else the body; the earliest wins a tie.

    Ties go by selector order, then document order. ``array_max`` over (length, order) picks it without sorting, and
    the text is only cut out for the candidates.
    """
    kept = F.struct(N.kept_runs(text, removed).alias("runs"), N.removed_flags(nodes, removed).alias("gone"))
    return X.let(kept, lambda k: _main_content(k["runs"], k["gone"], nodes))


def _main_content(runs: Column, gone: Column, nodes: Column) -> Column:
    outside = F.filter(N.select(nodes, *rules.MAIN_CONTENT), lambda n: ~F.get(gone, n["pre"]))
    shown = lambda n: X.trim(N.run_text(runs, n))

    def rank(n: Column) -> Column:
        order = F.lit(len(rules.MAIN_CONTENT))
        for i in reversed(range(len(rules.MAIN_CONTENT))):
            order = F.when(N.selector(rules.MAIN_CONTENT[i])(n), F.lit(i)).otherwise(order)
        return order

    scored = F.transform(
        outside,
        lambda n: F.struct(
            F.length(shown(n)).alias("size"),
            (-rank(n)).alias("first_selector"),
            (-n["pre"]).alias("first_node"),
        ),
    )
    picked = X.let(
        F.array_max(scored),
        lambda best: F.when(best["size"] > 0, X.let(F.get(nodes, -best["first_node"]), shown)),
    )
    return F.coalesce(picked, X.let(N.first(nodes, "body"), shown), F.lit(""))


def page_text(parsed: DataFrame, keep: tuple[str, ...] = (), also: Sequence[Column] = ()) -> DataFrame:
    """``(page_id, url, title, description, headings, body)`` per page, plus the columns named in ``keep`` and given in ``also``.

    A map over the parsed pages: no shuffle.
    """
    return strip_boilerplate(parsed).select("page_id", "url", *keep, *_text_columns(), *also)


@X.built_once
def _text_columns() -> list[Column]:
    text, nodes = F.col("text"), F.col("nodes")
    return [
        page_title(text, nodes).alias("title"),
        page_description(nodes).alias("description"),
        page_headings(text, nodes).alias("headings"),
        X.trim(X.collapse(main_content(text, nodes, F.col("removed")))).alias("body"),
    ]


def full_text(title: Column, description: Column, headings: Column, body: Column) -> Column:
    """Title, description, each heading and body joined with ``". "``, blanks left out."""
    parts = F.concat(F.array(title, description), F.transform(headings, lambda h: h["text"]), F.array(body))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), ". ")


def site_ids(url: Column) -> Column:
    """``origin``, ``organization_id``, ``webpage_id`` and ``website_id`` of a page URL."""
    return F.struct(
        U.origin(url).alias("origin"),
        U.organization_id(url).alias("organization_id"),
        U.webpage_id(url).alias("webpage_id"),
        U.website_id(url).alias("website_id"),
    )

"""The whole analysis: runs again over the same and changed pages, shared markup, answers, and runs that were killed."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import dom
from pagequarry.operators import fanout as G
from pagequarry.operators import linking as L
from pagequarry.plans import corpus

NOW = datetime.datetime(2024, 5, 1, 12)
PARAGRAPH = "Stone masons of Rochester cut granite and marble for the Acme Stone company near the Erie Canal every day. "
PAGES = 12


def html(k, word="granite"):
    who = f"Ada Byron {word.title()}"
    return (
        f"<html><head><title>Acme Stone {k % 4} | Rochester</title><meta name='description' content='All about {word} {k % 4}'></head><body><h1>Acme {word}</h1>"
        f"<h2>Granite Works</h2><p>{PARAGRAPH * 2}{who}</p><ul><li>One</li><li>Two</li><li>Three {word}</li></ul></body></html>"
    )


def given(spark, changed=()):
    """Twelve pages of four markups at different addresses; ``changed`` ones have another word."""
    rows = [(k, f"https://www.site{k % 3}.example/p/{k}", html(k, "marble" if k in changed else "granite")) for k in range(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def kb(spark):
    rank = [("Acme Stone", "1"), ("Rochester", "2"), ("Erie Canal", "3"), ("Stone", "4")]
    pages = spark.createDataFrame([(t, f"https://en.wikipedia.org/wiki/{t.replace(' ', '_')}", t.lower(), f"Q{r}", r) for t, r in rank], "title string, url string, extract string, wikibase_item string, rank string")
    items = spark.createDataFrame([(f"Q{r}", t, "", None, r, t) for t, r in rank], "id string, label string, description string, p31 string, rank string, lookup string")
    graph = spark.createDataFrame([(f"kg:/m/{r}", t, "", r, t) for t, r in rank], "mid string, name string, description string, rank string, lookup string")
    return L.KnowledgeBase(pages, items, graph, spark.createDataFrame([], "url string"))


def rows_of(results, *leave_out):
    columns = [c for c in results.columns if c not in ("cached", *leave_out)]
    return sorted(map(str, results.select(*columns).collect()))


@pytest.fixture(scope="module")
def first(spark, kb, tmp_path_factory):
    """A first run: its folder, the folder of its state, and its rows."""
    folder = tmp_path_factory.mktemp("first")
    results = corpus.analyse(spark, given(spark), kb, f"{folder}/run", state=f"{folder}/state", as_of=NOW)
    assert results.count() == PAGES and results.filter("NOT cached AND size(entities) > 2 AND jsonld <> '{}' AND chunks_extracted > 1 AND analysis IS NULL").count() == PAGES
    return folder, rows_of(results)


def again(spark, kb, first, folder, name, pages, hours, **kw):
    """A later run with a copy of the first run's state."""
    if not (folder / "state").exists():
        shutil.copytree(first[0] / "state", folder / "state")
    return corpus.analyse(spark, pages, kb, f"{folder}/{name}", state=f"{folder}/state", as_of=NOW + datetime.timedelta(hours=hours), **kw)


def test_changed_pages_alone_are_analysed(spark, kb, first, tmp_path, monkeypatch):
    """Rows are those of a full run; one page of each markup is parsed; a long list of pages is joined, not broadcast."""
    counts = corpus.stage_rows(spark, f"{first[0]}/run")
    assert counts["cached"] == 0 and counts["parsed"] == 4 < PAGES and counts["links"] > 4
    pages = given(spark, changed={5})
    full = corpus.analyse(spark, pages, kb, f"{tmp_path}/full", as_of=NOW)
    monkeypatch.setattr(corpus, "PICKED", 0)
    changed = again(spark, kb, first, tmp_path, "changed", pages, 0.6)
    assert rows_of(changed) == rows_of(full) != first[1]
    assert {r["page_id"] for r in changed.filter("NOT cached").collect()} == {5}
    counts = corpus.stage_rows(spark, f"{tmp_path}/changed")
    assert (counts["cached"], counts["parsed"]) == (PAGES - 1, 1) and 0 < counts["links"] < corpus.stage_rows(spark, f"{tmp_path}/full")["links"]


def test_page_rows_are_dealt_out_by_number(spark, first):
    """The dear stage is not put together by its size: four small rows lie in more than one part."""
    assert spark.read.parquet(f"{first[0]}/run/rows").count() == 4
    assert len(spark.read.parquet(f"{first[0]}/run/rows").inputFiles()) > 1


def test_pages_without_answers_do_not_travel(spark, kb, tmp_path, monkeypatch):
    """A first run has no answers to look up, so its pages are not shuffled to meet any; pages are hashed once."""
    joined, settled = [], []
    once, spread = corpus.settle, corpus.M.spread_join
    monkeypatch.setattr(corpus, "settle", lambda df: settled.append(df.columns) or once(df))
    monkeypatch.setattr(corpus.M, "spread_join", lambda *a: joined.append(a) or spread(*a))
    corpus.analyse(spark, given(spark), kb, f"{tmp_path}/run", as_of=NOW)
    assert joined == [] and settled == [["page_id", "url", "url_hash", "content_hash", "markup_hash"]]


def test_results_expire_before_links(spark, kb, first, tmp_path):
    """Results live an hour, links a week."""
    late = again(spark, kb, first, tmp_path, "late", given(spark), 30)
    counts = corpus.stage_rows(spark, f"{tmp_path}/late")
    assert (counts["cached"], counts["parsed"], counts["links"]) == (0, 4, 0) and rows_of(late) == first[1]


def test_a_killed_run_carries_on_after_its_last_stage(spark, kb, first, tmp_path, monkeypatch):
    def never(*args, **kw):
        raise AssertionError("this stage was finished")

    with monkeypatch.context() as m:
        m.setattr(L, "link_names", never)
        with pytest.raises(AssertionError):
            corpus.analyse(spark, given(spark), kb, f"{tmp_path}/run", as_of=NOW)
    assert spark.read.parquet(f"{tmp_path}/run/mentions").count() > 0  # what was found is kept
    with monkeypatch.context() as m:
        for owner, name in ((dom, "parse_pages"), (G, "semantic_chunks"), (corpus.P, "page_text"), (corpus.M, "extract_entities")):
            m.setattr(owner, name, never)
        assert rows_of(corpus.analyse(spark, given(spark), kb, f"{tmp_path}/run", as_of=NOW)) == first[1]
    with monkeypatch.context() as m:  # other pages are another input
        m.setattr(dom, "parse_pages", never)
        with pytest.raises(AssertionError):
            corpus.analyse(spark, given(spark, changed={1}), kb, f"{tmp_path}/run", as_of=NOW)


def test_answers_come_back_with_the_next_run(spark, kb, first, tmp_path):
    asked = {n: spark.read.parquet(f"{first[0]}/run/requests/{n}") for n in ("extraction", "fanout", "recommendation")}
    assert [asked[n].count() for n in ("extraction", "fanout", "recommendation")] == [4, 4, PAGES]

    quoted = F.lit('{"choices":[{"message":{"content":"{\\"main_topic\\":\\"Quarries\\",\\"entities\\":[\\"Erie Canal\\",\\"Rochester\\"]}"}}]}')
    chosen = asked["fanout"].orderBy("content_hash").limit(2)
    answers = {
        "extraction": chosen.select("content_hash", quoted.alias("body")),
        "fanout": asked["fanout"].select("content_hash", F.concat(F.lit("COVERAGE SCORE: 1/2 of "), "content_hash").alias("body")),
        "recommendation": asked["recommendation"].filter("page_id = 3").select("page_id", F.lit('{"recommendations":[{"category":"C","advice":"Add a map"}]}').alias("body")),
    }
    second = again(spark, kb, first, tmp_path, "two", given(spark), 0.2, responses=answers)
    hashes = {r["page_id"]: r["content_hash"] for r in spark.read.parquet(f"{tmp_path}/two/keys").collect()}
    taken = {r["content_hash"] for r in chosen.collect()}
    for r in second.collect():
        assert r["analysis"] == f"COVERAGE SCORE: 1/2 of {hashes[r['page_id']]}" and not r["cached"]
        assert (r["main_topic"] == "Quarries") == (hashes[r["page_id"]] in taken)
        assert not (hashes[r["page_id"]] in taken) or [e["name"] for e in r["entities"]] == ["Erie Canal", "Rochester"]
        assert ([a["advice"] for a in r["recommendations"]] == ["Add a map"]) == (r["page_id"] == 3)
    counts = corpus.stage_rows(spark, f"{tmp_path}/two")
    assert (counts["requests/extraction"], counts["requests/fanout"], counts["requests/recommendation"]) == (2, 0, PAGES - 1)
    third = again(spark, kb, first, tmp_path, "three", given(spark), 0.3)
    assert rows_of(third) == rows_of(second) and third.filter("cached").count() == PAGES

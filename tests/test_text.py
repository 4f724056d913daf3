import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators import mentions as M
from pagequarry.operators import page_text as P


def test_word_boundary_is_ascii(evaluate):
    # In "éat" the boundary lies between the accented letter and "a".
    assert evaluate(lambda a: X.hits(a, r"\bat\b"), "éat") is True
    assert evaluate(lambda a: X.hits(a, r"\bat\b"), "eat") is False


def test_white_space_covers_unicode(evaluate):
    nbsp = chr(0xA0)
    assert evaluate(X.trim, f"{nbsp}\t a b {nbsp}\n") == "a b"
    assert evaluate(X.collapse, f"a{nbsp} {chr(0x2003)}b") == "a b"
    assert evaluate(lambda a: F.size(X.words(a)), f"a{nbsp}b") == 2


def test_end_anchor_is_the_very_end(evaluate):
    assert evaluate(lambda a: X.hits(a, "texas$"), "in texas\n") is False


@pytest.mark.parametrize("value, rounded", [(0.5, 1), (1.5, 2), (2.4999, 2), (84.5, 85)])
def test_rounding_is_half_up(spark, value, rounded):
    assert spark.range(1).select(X.js_round(F.lit(value)).alias("v")).first()["v"] == rounded


def test_empty_needle(evaluate):
    assert evaluate(X.contains, "abc", "") is True
    assert evaluate(X.contains, "abc", None) is True
    assert evaluate(X.count_occurrences, "abc", "") == 0
    assert evaluate(X.count_occurrences, "aaaa", "aa") == 2


def test_names(evaluate):
    assert evaluate(X.name_in, "Will Scott", "about willscott-1") is True
    assert evaluate(X.name_in, "Will Scott", "") is False
    assert evaluate(X.name_from_title, "E-commerce tips") == "E"
    assert evaluate(X.name_from_title, "- only") == "- only"
    assert evaluate(X.name_from_title, "Name | Site") == "Name"


def test_person_shapes(evaluate):
    assert evaluate(X.person_shaped, "Ada B. Byron") is True
    assert evaluate(X.person_shaped, "Ada Byron Group") is False
    assert evaluate(X.starts_like_person, "Ada Byron Group") is True


def test_clip_at_period(evaluate):
    long = "x" * 1100 + ". " + "y" * 600
    assert evaluate(lambda a: X.clip_at_period(a, 1500, 1000), long) == "x" * 1100 + "."
    early = "x" * 100 + ". " + "y" * 1600
    assert evaluate(lambda a: X.clip_at_period(a, 1500, 1000), early) == early[:1500] + "..."
    assert evaluate(lambda a: X.clip_at_period(a, 1500, 1000), "short") == "short"


def test_uri_encoding(evaluate):
    assert evaluate(X.encode_uri_component, "O'Hare (A) é&~!*") == "O'Hare%20(A)%20%C3%A9%26~!*"


def test_urls(evaluate):
    assert evaluate(U.origin, "HTTPS://Ex.org:443/a") == "https://ex.org"
    assert evaluate(U.origin, "http://ex.org:8080?q") == "http://ex.org:8080"
    assert evaluate(U.origin, "nothing") == ""
    assert evaluate(U.webpage_id, "nothing") == "nothing#webpage"
    assert evaluate(U.website_id, "nothing") == ""
    assert evaluate(U.resolve, "/i.png", "https://ex.org/a/b?c") == "https://ex.org/i.png"
    assert evaluate(U.resolve, "i.png", "https://ex.org/a/b?c") == "https://ex.org/a/i.png"
    assert evaluate(U.resolve, "//cdn.org/i.png", "https://ex.org/") == "https://cdn.org/i.png"


def test_keys_ignore_case_and_space(evaluate):
    assert evaluate(X.md5_key, " HTTPS://Example.com/page ") == evaluate(X.md5_key, "https://example.com/page")


def test_clean_text(evaluate):
    html = "<SCRIPT>var a='<p>'</SCRIPT ><script>x</script><style>p{}</style><p>a<b>b</b>\n c</p>"
    assert evaluate(P.clean_text, html).endswith("a b c")


PHRASE = re.compile(r"\b[A-Z][a-zA-Z&]+(?:\s+[A-Z][a-zA-Z&]+)*\b", re.A)
PRODUCT = re.compile(
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Pro|Max|Plus|Ultra|Elite|Premium|Standard|Basic|Lite|Mini|Air|Studio|Enterprise|Professional)\b",
    re.A | re.I,
)
_word = st.sampled_from(["Ab", "A", "abc", "Pro", "air", "Mini1", "x_y", "AT&T", "R&", "é", "The", "plus", "9", "-", "Max.", "\n"])


@settings(max_examples=25, deadline=None)
@given(st.lists(_word, max_size=25).map(" ".join))
def test_patterns_match_backtracking_regexes(evaluate, text):
    """The possessive forms find what plain backtracking finds."""
    wanted = [m.strip() for m in PHRASE.findall(text)]
    assert evaluate(M.capitalised_phrases, text) == [m for m in wanted if 3 <= len(m) <= 49]
    assert evaluate(M.product_names, text) == [m.strip() for m in PRODUCT.findall(text)]


def test_patterns_survive_long_runs(evaluate):
    """A page-long run of words neither overflows the stack nor takes quadratic time."""
    run = "Word " * 60_000
    assert evaluate(lambda a: F.size(M.capitalised_phrases(a)), run) == 0
    assert evaluate(lambda a: F.size(M.product_names(a)), run + "pro") == 1


def test_mentions_order_and_filter(evaluate):
    names = evaluate(M.candidate_names, "The Stone Works. red stone pro. Stone Works again. A B. First")
    assert names == ["The Stone Works", "Stone Works", "red stone pro"]


# ── the same results with less work (analyse_corpus at size) ──────────────────


def test_white_space_patterns_hold_the_same_characters(spark):
    """Every character of the basic plane: in a run of white space or not, as the plain list says."""
    spaces = set(X.SPACE_CHARS)
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    found = chars.filter(F.col("c").rlike(X.SPACE)).collect()
    assert {r["c"] for r in found} == spaces
    runs = [chars.select("c", X.collapse(F.concat(F.lit("a"), *parts, F.lit("b"))).alias("v")) for parts in (("c",), ("c", F.lit(" ")), (F.lit(" "), "c"), ("c", "c"))]
    for rows, before, after, n in zip(runs, ("", "", " ", ""), ("", " ", "", ""), (1, 1, 1, 2), strict=True):
        for r in rows.collect():
            assert r["v"] == ("a b" if r["c"] in spaces else f"a{before}{r['c'] * n}{after}b")


def test_a_single_blank_is_no_match_of_collapse(spark):
    """Plain text is left as it is instead of being put together anew at each blank."""
    plan = spark.range(1).select(X.collapse(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    pattern = plan[plan.index("regexp_replace(") :].split(", ", 1)[1]
    pattern = pattern[: pattern.index("*+,") + 2]
    assert spark.sql("SELECT 'a b c' AS v").select(F.col("v").rlike(pattern)).first()[0] is False
    assert spark.sql("SELECT 'a  b' AS v").select(F.col("v").rlike(pattern)).first()[0] is True


def test_patterns_by_first_letter_match_the_same(spark):
    """Every word list, with and without a boundary around each of its words, side by side and inside one another."""
    words = [w for patterns in rules.PAGE_TYPE_PATTERNS.values() for p in patterns for w in re.sub(r"\['’\]", "'", p.lower()[3:-3]).replace(r"\(\d{3}\)", "(312)").replace("?", "").split("|")]
    texts = [a.format(w, v) for w, v in zip(words, words[1:] + words[:1], strict=True) for a in ("{0}", "{0} {1}", "x{0} {1}s", "{0}{1}", "the _{0}. {0}-{1} x(312) 5", "{1}\x01{0}")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in rules.PAGE_TYPE_PATTERNS.values():
        for p in (p.lower() for p in patterns):
            quick = X.by_first_letter(p)
            assert quick != p and quick.startswith("[")
            ours = [r["n"] for r in rows.select(F.regexp_count("t", F.lit(X.rx(quick, "", r"\b"))).alias("n")).collect()]
            plain = [r["n"] for r in rows.select(F.regexp_count("t", F.lit(X.rx(p, "i", r"\b"))).alias("n")).collect()]
            assert ours == plain and sum(ours) > 0
    assert X.by_first_letter(r"\bk.?12\b|school") == r"\bk.?12\b|school" and X.by_first_letter(r"\b(s?a|b)\b") == r"\b(s?a|b)\b"


def test_occurrences_of_other_alphabets(evaluate):
    assert evaluate(X.count_occurrences, "zürich, zürich und 東京東京", "東京") == 2
    assert evaluate(X.count_occurrences, "zürich, zürich und 東京東京", "zürich") == 2
    assert evaluate(X.count_occurrences, None, "a") == 0


def test_names_of_a_page_are_found_once(spark):
    """An explode has its list worked out a second time, to leave out pages without one, unless it keeps them for a moment."""
    pages = spark.createDataFrame([(1, "h", "Acme Stone of New York"), (2, "h", "nothing here"), (3, "h", None)], "page_id long, content_hash string, full_text string")
    for found in (M.explode_names(M.extract_entities(pages)), M.mentions(pages)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 2  # phrases and product names
        assert [(r["page_id"], r["pos"], r["name"]) for r in found.collect()] == [(1, 0, "Acme Stone"), (1, 1, "New York")]


def test_only_names_of_the_title_are_counted(spark):
    """By ``strict``; the most frequent wins, the earliest of equals."""
    row = spark.createDataFrame([("Acme Stone in York | x", "York acme stone York, Rome Rome Rome", ["Rome", "Acme Stone", "York"])], "title string, t string, names array<string>")
    topic = M.main_topic(F.col("title"), F.col("t"), F.col("names")).alias("v")
    assert row.select(topic).first()["v"] == "York"
    assert row.select(M.main_topic(F.col("title"), F.col("t"), F.col("names"), strategy="frequent").alias("v")).first()["v"] == "Rome"

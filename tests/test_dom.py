from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.operators import page_text as P
from pagequarry.operators.dom import dom_nodes, parse_html


def shape(html):
    tree = parse_html(html)
    text = "".join(tree.text)
    return [(tree.tag[i], text[tree.t0[i] : tree.t1[i]]) for i in range(3, len(tree.tag))]


def test_implied_end_tags():
    assert shape("<body><p>a<p>b<ul><li>c<li>d</ul><h2>e<h3>f") == [
        ("p", "a"), ("p", "b"), ("ul", "cd"), ("li", "c"), ("li", "d"), ("h2", "e"), ("h3", "f"),
    ]


def test_formatting_is_reopened():
    assert shape("<body><p><b>x<br><p>y</b>z") == [("p", "x"), ("b", "x"), ("br", ""), ("p", "yz"), ("b", "y")]


def test_void_raw_and_references():
    html = "<title>A &amp; B</title><body>x<img src=a.png>y<script>if (a<b) '</p>'</script>&lt;p&gt;<!-- <p> -->"
    tree = parse_html(html)
    assert tree.tag == ["html", "head", "title", "body", "img", "script"]
    assert "".join(tree.text) == "A & Bxyif (a<b) '</p>'<p>"


def test_attributes():
    tree = parse_html("<a HREF='x?a=1&copy=2' href=second data-x=\"1>2\" checked class=\"q\">t</a>")
    assert tree.attrs[3] == {"href": "x?a=1&copy=2", "data-x": "1>2", "checked": "", "class": "q"}


def test_tables_and_definition_lists():
    assert [t for t, _ in shape("<body><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>")] == [
        "table", "tr", "td", "td", "tr", "td", "dl", "dt", "dd",
    ]


def test_empty_and_broken_pages():
    for html in ("", "plain", "<", "</p>", "<p", "<div><span></div></span>x", "<b><p>1</b>2</p>3"):
        tree = parse_html(html)
        assert tree.tag[:3] == ["html", "head", "body"] and not tree.stack


def test_deep_and_wide_pages_stay_linear():
    deep = parse_html("<body>" + "<div>" * 50_000 + "x" + "</section>" * 1000)
    assert len(deep.tag) == 50_003
    wide = parse_html("<body>" + "<p><b>x<br>" * 3_000)
    assert wide.tag.count("p") == 3_000


_piece = st.sampled_from(
    ["<p>", "</p>", "<b>", "</b>", "<div class='a'>", "</div>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "text ", "<br>", "<td>", "<table>", "</table>", "<i>", "</i>", "<h2>", "</h3>", "&amp;", "<script>x</script>"]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(_piece, max_size=40).map("".join))
def test_tree_invariants(html):
    tree = parse_html(html)
    count, size = len(tree.tag), len(tree.text)
    for i in range(count):
        assert i <= tree.end[i] < count
        assert 0 <= tree.t0[i] <= tree.t1[i] <= size
        assert tree.chars[i] == len("".join(tree.text[tree.t0[i] : tree.t1[i]]))
        assert tree.depth[i] == (tree.depth[tree.parent[i]] + 1 if i else 0)
        assert tree.parent[i] < i
    assert tree.end[0] == count - 1 and tree.t1[0] == size


def test_node_rows(parse):
    rows = dom_nodes(parse("<h1 id=t>Hi <b>you</b></h1>")).orderBy("pre").collect()
    assert [(r["tag"], r["text"], r["elem_id"]) for r in rows][-2:] == [("h1", "Hi you", "t"), ("b", "you", None)]


def test_page_text(parse):
    page = """<title> T </title><meta name=description content=" D "><body><div class="loading"><h2>Kept as heading</h2>gone</div>
      <main>short</main><article>The  main\ntext <span id="cookie-box">gone</span>goes on</article><h4></h4><h5>no</h5>"""
    row = P.page_text(parse(page)).first()
    assert (row["title"], row["description"], row["body"]) == ("T", "D", "The main text goes on")
    assert [(h["pos"], h["level"], h["text"]) for h in row["headings"]] == [(0, 2, "Kept as heading")]


def test_page_text_fallbacks(parse):
    page = '<meta property="og:title" content="OG"><body>only body<footer>f</footer></body>'
    first, empty = P.page_text(parse(page, "")).orderBy("page_id").collect()
    assert (first["title"], first["description"], first["body"]) == ("OG", "", "only body")
    assert (empty["title"], empty["body"], empty["headings"]) == ("", "", [])


def test_main_content_ties_go_to_selector_order(parse):
    row = P.page_text(parse("<body><div class=content>abc</div><main>xyz</main>")).first()
    assert row["body"] == "xyz"


def test_boilerplate_is_a_substring_test(parse):
    found = parse("<body><div class=shadow>a</div><div class=Sidebar>b</div><p id=footer>c</p><nav>d<p class=ad>e</p></nav>")
    removed = found.select(P.boilerplate(F.col("nodes")).alias("r"), "nodes").first()
    assert [removed["nodes"][r["pre"]]["tag"] for r in removed["r"]] == ["div", "nav"]


def test_selectors(parse):
    doc = parse('<body><p class="a main b" id=x role=main>1</p><div class=domain>2</div><a rel=author>3</a>')
    for selector, wanted in ((".main", ["p"]), ("#x", ["p"]), ('[class*="main"]', ["p", "div"]), ('p[role="main"]', ["p"]), ('[rel="author"]', ["a"])):
        tags = doc.select(F.transform(N.select(F.col("nodes"), selector), lambda n: n["tag"])).first()[0]
        assert tags == wanted, selector


def test_full_text_drops_blanks(spark):
    row = spark.sql("SELECT 'T' AS t, '' AS d, array(named_struct('text', 'H')) AS h, 'B' AS b")
    assert row.select(P.full_text(row.t, row.d, row.h, row.b)).first()[0] == "T. H. B"


def test_rule_lists_have_no_duplicates():
    for values in (rules.BOILERPLATE, rules.COMMON_WORDS, rules.NON_ENTITIES, rules.FAQ_QUESTIONS):
        assert len(set(values)) == len(values)
    assert (len(rules.BOILERPLATE), len(rules.COMMON_WORDS), len(rules.KNOWN_ENTITIES), len(rules.NON_ENTITIES)) == (33, 53, 26, 39)


def test_references_without_semicolon_are_decoded_in_text(parse):
    """As HTML5 has it: a title cut inside a reference still gives its character."""
    row = parse("<title>A &amp;&amp</title><body><h1>B &amp</h1><p>c &quot</p><p>d &am</p>").first()
    assert row["text"] == ["A &&", "B &", 'c "', "d &am"]

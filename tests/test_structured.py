import json

from pyspark.sql import functions as F

from pagequarry.operators import fanout as G
from pagequarry.operators import jsonld as J
from pagequarry.operators import linking as L
from pagequarry.operators import page_text as P
from pagequarry.operators import scoring as E
from pagequarry.operators import structured as S



def value(doc, make):
    row = doc.select(make(F.col("text"), F.col("nodes")).alias("v")).first()["v"]
    return row.asDict(True) if hasattr(row, "asDict") else row


def answers(doc):
    found = value(doc, lambda t, d: S.faq(t, d))
    return [(q["name"], q["acceptedAnswer"]["text"]) for q in found["mainEntity"]] if found else []


def test_contact(parse):
    doc = parse('<body>Tel 312-555-0101 or (999) 555-0000<p class=address>tiny</p><p id=address-1>5 Elm St, Paris, TX 75460 USA</p>')
    assert value(doc, lambda t, d: S.telephone(t)) == "312-555-0101"
    assert value(doc, lambda t, d: S.address(t, d)) == {
        "@type": "PostalAddress", "postalCode": "75460", "addressRegion": "TX", "addressCountry": "US",
        "streetAddress": "5 Elm St", "addressLocality": "Paris",
    }


def test_social_links(parse):
    doc = parse('<a href="https://twitter.com/a">1</a><a href="/facebook.com">2</a><a href="https://facebook.com/b">3</a><a href="https://twitter.com/a">4</a>')
    assert value(doc, lambda t, d: S.social_links(d)) == ["https://facebook.com/b", "https://twitter.com/a"]


def test_author_and_organization(parse):
    doc = parse('<meta name=author content="  "><body><p class=byline>x</p><i id=author>Written by: Ann Bo Cy Di</i><div class=logo></div><div class=company>Stone Ltd</div>')
    assert value(doc, lambda t, d: S.author(t, d)) == "Ann Bo Cy"
    assert value(doc, lambda t, d: S.organization(t, d)) == "Stone Ltd"


def test_faq_accordion(parse):
    doc = parse(
        """<body><div class="accordion"><div><button aria-expanded=false>Question: can it rain here</button><div>skip me</div>
        <div class="collapse">It can rain here on every second day.</div></div></div>"""
    )
    assert answers(doc) == [("can it rain here?", "It can rain here on every second day.")]


def test_faq_headings_need_longer_answers(parse):
    short, long = "Twenty-five characters ok.", "This answer has rather more than fifty characters in it."
    doc = parse(f"<body><h2>What is short?</h2><p>{short}</p><h2>What is long?</h2><h3>No</h3><p>{long}</p><h4>Statement here</h4><p>{long}</p>")
    # The first later sibling with enough text answers, also beyond a heading.
    assert answers(doc) == [("What is long?", long)]


def test_faq_first_usable_answer_counts(parse):
    answer = "This answer has rather more than fifty characters in it."
    doc = parse(f"<body><div class=faq><h3>Why is it so?</h3><p>{answer}</p></div><h2>why is it so?</h2><p>Another {answer}</p>")
    assert answers(doc) == [("Why is it so?", answer)]


def test_faq_stops_at_fifteen(parse):
    items = "".join(f"<dt>What is item {i}?</dt><dd>Item {i} is described at some length here.</dd>" for i in range(20))
    assert len(answers(parse(f"<body><dl class=faq>{items}</dl>"))) == 15


def test_howto_container(parse):
    doc = parse(
        """<title>How to carve</title><body><div class=guide>no steps</div><div class="steps"><p>Plain words that go beyond thirty chars.</p>
        <div class="step"><h4 class=step-title>Step 1: Cut</h4>Cut along the drawn line.</div><div class="step">short</div>
        <ul class=materials><li>Saw</li></ul><ol><li>Not used, as the step class came first</li></ol>Takes 02 hours</div>"""
    )
    assert value(doc, lambda t, d: S.howto(t, d)) == {
        "@type": "HowTo", "mainEntity": None, "name": "Step 1: Cut", "description": "Plain words that go beyond thirty chars.",
        "step": [{"@type": "HowToStep", "position": 1, "text": "Cut along the drawn line.", "name": "Cut"}],
        "totalTime": "PT2H", "supply": [{"@type": "HowToSupply", "name": "Saw"}],
    }


def test_howto_numbered_text(parse):
    doc = parse("<body><pre class=instructions>Intro\n1. Mix the sand and the water\n2) Wait\n 3. Pour it into the open form</pre>")
    steps = value(doc, lambda t, d: S.howto(t, d))["step"]
    assert [(s["position"], s["text"]) for s in steps] == [(1, "Mix the sand and the water"), (3, "Pour it into the open form")]


def test_howto_from_headings_needs_two_steps(parse):
    two = parse("<body><h1>A tutorial</h1><h2>Step 1 Go</h2><p>go there</p><h2>2. Stay</h2><p>stay there</p>")
    one = parse("<body><h1>A tutorial</h1><h2>Step 1 Go</h2><p>go there</p><h2>2. Stay</h2>")
    assert [s["name"] for s in value(two, lambda t, d: S.howto(t, d))["step"]] == ["Go", "2. Stay"]
    assert value(one, lambda t, d: S.howto(t, d)) is None


def test_linkedin_needs_a_strong_signal(parse):
    doc = parse(
        """<body><div>Ada Byron wrote this<p><a href="https://linkedin.com/in/x1">profile</a></p></div>
        <section><div><a href="http://www.linkedin.com/in/grace-hopper/?t=1" aria-label="Grace Hopper">in</a></div></section>"""
    )
    assert value(doc, lambda t, d: L.linkedin_person(t, d, F.lit("Ada Byron"))) is None
    assert value(doc, lambda t, d: L.linkedin_person(t, d, F.lit("Grace Hopper"))) == "https://linkedin.com/in/grace-hopper"


PAGE = """<html><head><title>Acme Works | Home</title><meta name="description" content="Stone &amp; more">
<meta property="og:image" content="/i.png"><meta name="author" content="Jane Roe"><meta property="og:site_name" content="Acme"></head>
<body><p class="contact">1 Elm St, Paris, TX 75460 USA</p><a href="https://facebook.com/acme">f</a>
<div class="faq"><h3>What is a quarry</h3><p>A place where stone is cut out of the ground.</p></div></body></html>"""
ENTITIES = [
    (1, 0, "Stone College", "Organization", "https://w/1", "https://d/1", "https://g?kgmid=/m/1", None, 90),
    (1, 1, "Care Services", "Thing", None, None, "https://g?q=x", "http://p/1", 60),
    *[(1, i, f"Thing {i}", "Thing", None, None, "https://g?q=y", None, 0) for i in range(2, 12)],
]
FIELDS = "page_id long, pos int, name string, type string, wikipedia_url string, wikidata_url string, google_kg_url string, product_ontology_url string, confidence int"


def documents(spark, parse):
    parsed = parse(PAGE, url="https://acme.org/x")
    rows = E.page_entities(P.page_text(parsed).join(J.structured_columns(parsed), "page_id"), spark.createDataFrame(ENTITIES, FIELDS))
    made = rows.select(*[w().alias(k) for k, w in J.WRITERS.items()]).first()
    return {k: json.loads(made[k]) for k in J.WRITERS}


def test_jsonld_documents(spark, parse):
    made = documents(spark, parse)
    org, site, page = made["WebPage"]["@graph"]
    assert org == {
        "@type": "Organization", "@id": "https://acme.org/#organization", "name": "Acme", "url": "https://acme.org/",
        "logo": {"@type": "ImageObject", "url": "https://acme.org/i.png"}, "sameAs": ["https://facebook.com/acme"],
    }
    assert site["publisher"] == {"@id": "https://acme.org/#organization"} and site["name"] == "Acme"
    assert page["name"] == "Acme Works | Home" and page["description"] == "Stone & more" and page["author"]["name"] == "Jane Roe"
    assert page["mainEntity"]["@type"] == "FAQPage" and len(page["about"]) == 4 and len(page["mentions"]) == 6
    assert page["about"][0]["sameAs"] == ["https://w/1", "https://d/1", "https://g?kgmid=/m/1"]
    assert page["primaryImageOfPage"] == "https://acme.org/i.png" and len(page["speakable"]["xpath"]) == 4

    service = made["Service"]["@graph"][2]
    assert service["primaryImageOfPage"] == "/i.png" and service["hasPart"][0]["@type"] == "FAQPage"
    assert service["mainEntity"]["name"] == "Acme Works" and len(service["mainEntity"]["mentions"]) == 5
    assert "sameAs" not in service["mainEntity"] and "audience" not in service["mainEntity"]

    article = made["Article"]
    assert article["@type"] == "WebPage" and article["mainEntity"]["headline"] == "Acme Works | Home"
    assert article["about"]["name"] == "Stone College" and len(article["mentions"]) == 11 and len(article["speakable"]["xpath"]) == 6
    assert article["publisher"] == {"@type": "Organization", "name": "Acme"}

    local = made["LocalBusiness"]
    assert local["hasOfferCatalog"]["itemListElement"] == [{"@type": "Offer", "itemOffered": {"@type": "Service", "name": "Care Services"}}]
    assert local["knowsAbout"] == [{"@type": "Thing", "name": "stone college", "sameAs": ["https://w/1", "https://g?kgmid=/m/1"]}]
    assert "speakable" not in local and local["address"]["addressLocality"] == "Paris"

    education = made["EducationalOccupationalProgram"]
    assert education["provider"] == education["mainEntity"]["provider"] and education["provider"]["name"] == "Stone College"
    assert education["hasPart"]["@type"] == "FAQPage" and len(education["speakable"]["xpath"]) == 5


def test_page_without_url_has_no_site_nodes(spark, parse):
    parsed = parse("<title>T</title><body>x", url="")
    rows = E.page_entities(P.page_text(parsed).join(J.structured_columns(parsed), "page_id"), spark.createDataFrame([], FIELDS))
    made = J.generate_jsonld(rows).first()
    assert made["schema_type"] == "WebPage"
    assert [n["@type"] for n in json.loads(made["jsonld"])["@graph"]] == ["WebPage"]


def chunks(doc, **flags):
    return [(c["type"], c["heading"], c["content"]) for c in G.chunk_rows(G.semantic_chunks(doc, **flags)).orderBy("pos").collect()]


def test_chunks_with_sections(parse):
    doc = parse(
        """<title>T</title><body><nav><h2>gone</h2><p>x</p></nav><h1>H</h1><h2>A</h2><p>a1</p><h3>B</h3><p>b1</p><div class=menu>no</div><h2>C</h2>
        <ul><li>1<li>2<li>3</ul><h3>Empty</h3>"""
    )
    assert chunks(doc) == [
        ("primary_topic", None, "T — H"), ("section", "A", "a1 B b1"), ("section", "B", "b1"), ("section", "C", "123 Empty"),
        ("list", None, "1 | 2 | 3"),
    ]


def test_chunks_fallback(parse):
    long = "This paragraph has to be at least eighty characters long to be counted as a substantial one. Is it?"
    doc = parse(f'<meta property="og:type" content="article"><body><main><p>{long}</p><p>short? no</p><b>Key</b><strong>Key</strong><h4>Other</h4></main><b>Out</b>')
    assert chunks(doc) == [
        ("paragraphs", None, long), ("questions_on_page", None, "Is it?short?"), ("key_terms", None, "Key | Other"),
        ("page_metadata", None, "og:type=article"),
    ]


def test_structured_data_chunk_is_off_by_default(parse):
    doc = parse('<script type="application/ld+json">{"@type":"Thing","a":1}</script><body><p>x</p>')
    assert not [c for c in chunks(doc) if c[0] == "structured_data"]
    assert [c[2] for c in chunks(doc, read_ldjson=True) if c[0] == "structured_data"] == ['Type: Thing, {"@type":"Thing","a":1}']

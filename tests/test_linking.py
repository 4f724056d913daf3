from pyspark.sql import functions as F

from pagequarry.functions.skew import spread_join
from pagequarry.operators import linking as L
from pagequarry.operators import mentions as M
from pagequarry.operators import scoring as E


def mentions(spark, *names, page=1, topic=""):
    rows = [(page, i, n, topic) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "page_id int, pos int, name string, main_topic string")


def knowledge_base(spark, pages=(), items=(), graph=(), urls=()):
    return L.KnowledgeBase(
        spark.createDataFrame(list(pages), "title string, url string, extract string, wikibase_item string, rank int"),
        spark.createDataFrame(list(items), "id string, label string, description string, p31 string, rank int, lookup string"),
        spark.createDataFrame(list(graph), "mid string, name string, description string, rank int, lookup string"),
        spark.createDataFrame([(u,) for u in urls], "url string"),
    )


def wiki(title, extract="", item=None, rank=1):
    return (title, "https://en.wikipedia.org/wiki/" + title.replace(" ", "_"), extract, item, rank)


def link(spark, found, kb, **options):
    rows = L.link_mentions(found, kb, **options).collect()
    return {r["name"]: r for r in rows}


def test_base_score_is_relative_to_the_batch(spark):
    names = ["A One", "Newsletter", "B Two", "C Three", "D Four", "E Five", "F Six"]
    rows = {r["name"]: (r["batch"], round(r["base"], 3)) for r in L.base_score(mentions(spark, *names)).collect()}
    assert rows == {"A One": (0, 70.0), "B Two": (0, 52.5), "C Three": (0, 35.0), "D Four": (0, 17.5), "E Five": (1, 70.0), "F Six": (1, 35.0)}


def test_cap_comes_before_the_skip_filter(spark):
    names = ["Newsletter"] * 19 + ["Kept Name", "Late Name"]
    rows = L.base_score(mentions(spark, *names), batch_size=None).collect()
    assert [(r["name"], r["base"]) for r in rows] == [("Kept Name", 70.0)]


def test_cache_hits_leave_the_batch_before_scoring(spark):
    found = mentions(spark, "A One", "B Two").withColumn("cached", F.col("pos") == 0)
    assert [(r["name"], r["base"]) for r in L.base_score(found).collect()] == [("B Two", 70.0)]


def test_multi_word_page_titles_fail_item_verification(spark):
    kb = knowledge_base(
        spark,
        pages=[wiki("Stone cutting", "stone cutting is old", "Q1"), wiki("Quarry", "a quarry", "Q2"), wiki("Big airport", "a big airport", "Q3")],
        items=[("Q1", "stone cutting", "", "Q571", 1, "zzz"), ("Q2", "quarry", "", "Q571", 1, "zzz"), ("Q3", "other", "", None, 1, "zzz")],
    )
    got = link(spark, mentions(spark, "stone cutting", "quarry", "big airport"), kb)
    assert got["stone cutting"]["wikipedia_url"].endswith("Stone_cutting") and got["stone cutting"]["wikidata_url"] is None
    assert got["quarry"]["wikidata_url"].endswith("Q2") and got["quarry"]["type"] == "CreativeWork"
    assert got["big airport"]["wikipedia_url"] is None  # searched as "big International Airport"


def test_empty_label_scores_seventy(spark):
    kb = knowledge_base(spark, items=[("Q9", "", "all about quarry", None, 1, "quarry")])
    assert link(spark, mentions(spark, "quarry"), kb)["quarry"]["wikidata_url"].endswith("Q9")


def test_ties_go_to_the_first_hit(spark):
    kb = knowledge_base(spark, items=[("Q2", "quarry a", "", None, 2, "quarry a"), ("Q1", "quarry b", "", None, 1, "quarry b")])
    assert link(spark, mentions(spark, "quarry"), kb)["quarry"]["wikidata_url"].endswith("Q1")


def test_person_needs_topic(spark):
    kb = knowledge_base(
        spark,
        pages=[wiki("Will Scott", "will scott was a blues musician", "Q5")],
        graph=[("kg:/m/1", "Will Scott", "American musician", 1, "will scott")],
    )
    plain = link(spark, mentions(spark, "Will Scott"), kb)["Will Scott"]
    assert plain["wikipedia_url"] and "kgmid=/m/1" in plain["google_kg_url"]
    off = link(spark, mentions(spark, "Will Scott", topic="Content Marketing"), kb)["Will Scott"]
    assert off["wikipedia_url"] is None and off["google_kg_url"] == "https://www.google.com/search?q=Will%20Scott"
    assert link(spark, mentions(spark, "Will Scott", topic="Blues Musician"), kb)["Will Scott"]["wikipedia_url"]
    single = link(spark, mentions(spark, "Will Scott", topic="American"), kb)["Will Scott"]
    assert "kgmid" not in single["google_kg_url"]  # a profession rules it out when the topic is one word


def test_known_entities_skip_search_but_not_the_graph(spark):
    kb = knowledge_base(spark, graph=[("kg:/m/9", "Instagram", "", 1, "instagram")], urls=["http://www.productontology.org/doc/INSTAGRAM"])
    row = link(spark, mentions(spark, "Instagram"), kb)["Instagram"]
    assert row["wikidata_url"].endswith("Q209330") and row["google_kg_url"].endswith("kgmid=/m/9") and row["type"] == "Organization"
    assert row["product_ontology_url"].endswith("/doc/INSTAGRAM") and row["confidence"] == 100


def test_seo_tries_its_terms_in_order(spark):
    terms = L.wiki_search_terms(spark.createDataFrame([("SEO", False)], "name string, academic boolean")).orderBy("term_pos").collect()
    assert [t["term"] for t in terms] == ["Search Engine Optimization", "SEO Search Engine Optimization", "Search engine optimization", "SEO"]


def test_search_returns_five_per_key(spark):
    pages = [wiki(f"Stone {i}", rank=i) for i in range(20)]
    index = L.search_index(knowledge_base(spark, pages=pages).pages, "title")
    kept = index.filter("key = 'stone'").orderBy("hit").collect()
    assert [r["title"] for r in kept] == [f"Stone {i}" for i in range(5)]


def test_merge_fills_and_keeps_order(spark):
    found = mentions(spark, "Seo", "SEO", "Skipped", "Cached")
    fields = "page_id int, pos int, batch int, name string, type string, wikipedia_url string, wikidata_url string, google_kg_url string, product_ontology_url string, confidence int"
    fresh = spark.createDataFrame([(1, 0, 0, "Seo", "Thing", None, None, "g", None, 50), (1, 1, 0, "SEO", "Thing", None, None, "g", None, 60)], fields)
    cached = fresh.limit(1).select(F.lit("cached").alias("lower_name"), F.struct(*L.ENTITY_FIELDS).alias("entity"))
    rows = L.merge_cached(found, cached, fresh).orderBy("pos").collect()
    assert [(r["name"], r["confidence"]) for r in rows] == [("SEO", 60), ("SEO", 60), ("Skipped", 0), ("Seo", 50)]


def test_spread_join_splits_hot_and_null_keys(spark):
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id % 50) END AS k")
    right = left.select("k").distinct().filter("k <> 'k1'").selectExpr("k", "upper(k) AS v")
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.advisoryPartitionSizeInBytes": "1k", "adaptive.coalescePartitions.enabled": "false", "adaptive.skewJoin.skewedPartitionFactor": "2", "shuffle.partitions": "16"}
    for key, value in settings.items():
        spark.conf.set(f"spark.sql.{key}", value)
    joined = spread_join(left, right, ["k"], "id")
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    for key in settings:
        spark.conf.unset(f"spark.sql.{key}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert joined.count() == 3000
    assert joined.filter("k = 'k1' OR k IS NULL").filter("v IS NOT NULL").count() == 0
    assert joined.filter("k IS NOT NULL AND k <> 'k1'").filter("v = upper(k)").count() == left.filter("k IS NOT NULL AND k <> 'k1'").count()


def test_confidence_stays_in_range(spark):
    rows = spark.range(101).selectExpr("id * 0.7 AS base", "'w' AS w", "CAST(NULL AS STRING) AS n", "'x?kgmid=1' AS g")
    score = L.confidence(F.col("base"), F.col("w"), F.col("w"), F.col("g"), F.col("n"), F.lit("Person"))
    low, high = rows.select(F.min(score), F.max(score)).first()
    assert (low, high) == (70, 100)


def test_aliases(spark):
    names = spark.createDataFrame([("SEO",), (" College",), ("ppc",), ("none",)], "name string")
    got = {r["name"]: (r["canonical"], r["variants"]) for r in M.canonical_entities(names).collect()}
    assert got["SEO"] == ("seo", ["search engine optimization", "seo"])
    assert got[" College"][0] == "higher education" and got["ppc"][0] == "ppc" and got["none"] == ("none", ["none"])


def test_salience_of_no_entities_is_zero(spark):
    rows = spark.range(1).select(F.lit(1).alias("page_id"))
    fields = "page_id int, pos int, name string, type string, wikipedia_url string, wikidata_url string, google_kg_url string, product_ontology_url string, confidence int"
    assert E.page_entities(rows, spark.createDataFrame([], fields)).select(E.salience_score(F.col("entities"))).first()[0] == 0


def test_recommendation_fallbacks(spark):
    bodies = [('{"recommendations":[{"category":"A","advice":"b"}]}',), ("{}",), ("broken",), (None,)]
    fallback = F.array(F.struct(F.lit("G").alias("category"), F.lit("n").alias("advice")))
    rows = spark.createDataFrame(bodies, "body string").select(E.parse_recommendations(F.col("body"), fallback).alias("r")).collect()
    assert [r["r"][0]["category"] for r in rows] == ["A", "G", "G", "G"]

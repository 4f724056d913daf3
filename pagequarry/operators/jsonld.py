"""JSON-LD per page: one typed struct per schema type, written with ``to_json``, which omits NULL fields.

Input is one row per page: ``url, title, description, headings, body, entities`` and the structured-data columns of
:func:`structured_columns`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators import classify as C
from pagequarry.operators import linking as L
from pagequarry.operators import structured as S

CONTEXT = "https://schema.org"


def obj(**fields: Column) -> Column:
    """A JSON object; ``type_`` and ``id_`` become ``@type`` and ``@id``, other keys keep their names."""
    names = {"type_": "@type", "id_": "@id", "context_": "@context", "graph_": "@graph"}
    return F.struct(*[v.alias(names.get(k, k)) for k, v in fields.items()])


def some(array: Column) -> Column:
    """NULL for an empty array, so that its key is omitted."""
    return X.let(array, S.some)


def about_things(entities: Column) -> Column:
    """Entities as schema.org things with their links in fixed order."""

    def thing(e: Column) -> Column:
        links = F.array_compact(F.array(*[X.not_blank(e[c]) for c in ("wikipedia_url", "wikidata_url", "google_kg_url", "linkedin_url")]))
        kind = F.coalesce(X.not_blank(e["type"]), F.lit("Thing"))
        return obj(type_=kind, name=e["name"], additionalType=X.not_blank(e["product_ontology_url"]), sameAs=some(links))

    return F.transform(entities, thing)


def knows_about(entities: Column, limit: int = 12) -> Column:
    """Entities above 60 with an encyclopedia page, lower-case names, the first ``limit``."""
    kept = F.slice(F.filter(entities, lambda e: (e["confidence"] > 60) & e["wikipedia_url"].isNotNull()), 1, limit)
    links = lambda e: F.array_compact(F.array(e["wikipedia_url"], X.not_blank(e["google_kg_url"])))
    return F.transform(kept, lambda e: obj(type_=F.lit("Thing"), name=F.lower(e["name"]), sameAs=some(links(e))))


def speakable(count: int) -> Column:
    """The first ``count`` speakable paths."""
    return obj(type_=F.lit("SpeakableSpecification"), xpath=F.array(*[F.lit(p) for p in rules.SPEAKABLE[:count]]))


def site_name(nodes: Column, url: Column) -> Column:
    """Site name from meta tags, else from the host: its first label in words."""
    metas = [
        X.trim(N.first(nodes, s)["attrs"]["content"])
        for s in ('meta[property="og:site_name"]', 'meta[name="application-name"]', 'meta[name="apple-mobile-web-app-title"]')
    ]
    host = F.regexp_replace(F.coalesce(U.host(url), F.lit("")), r"^www\.", "")
    parts = F.split(F.substring_index(host, ".", 1), "[-_]", -1)
    pretty = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.coalesce(*[X.longer(m, 2) for m in metas], pretty)


def organization_node(nodes: Column, url: Column, socials: Column) -> Column:
    """The site's Organization node, NULL without a valid URL or a name."""
    return X.let(U.origin(url), lambda o: X.let(site_name(nodes, url), lambda n: _organization(nodes, url, socials, o, n)))


def _organization(nodes: Column, url: Column, socials: Column, origin: Column, name: Column) -> Column:
    image = X.not_blank(N.first(nodes, 'meta[property="og:image"]')["attrs"]["content"])
    logo = F.coalesce(X.not_blank(N.first(nodes, 'meta[property="og:logo"]')["attrs"]["content"]), image)
    image_object = lambda a: F.when(a.isNotNull(), obj(type_=F.lit("ImageObject"), url=a))
    foreign = F.filter(socials, lambda h: F.coalesce(U.host(h), F.lit("")) != F.coalesce(U.host(url), F.lit("")))
    node = obj(
        type_=F.lit("Organization"), id_=U.organization_id(url), name=name, url=F.concat(origin, F.lit("/")),
        logo=X.let(U.resolve(logo, origin), image_object), sameAs=some(F.array_distinct(foreign)),
    )
    return F.when((origin != "") & (name != ""), node)


def website_node(nodes: Column, url: Column) -> Column:
    """The site's WebSite node, NULL without a valid URL."""
    return X.let(U.origin(url), lambda o: _website(nodes, url, o))


def _website(nodes: Column, url: Column, origin: Column) -> Column:
    given = X.not_blank(X.trim(N.first(nodes, 'meta[property="og:site_name"]')["attrs"]["content"]))
    node = obj(
        type_=F.lit("WebSite"), id_=U.website_id(url), url=F.concat(origin, F.lit("/")),
        publisher=obj(id_=U.organization_id(url)), name=F.coalesce(given, X.not_blank(site_name(nodes, url))),
    )
    return F.when(origin != "", node)


@X.built_once
def content_values() -> list[Column]:
    """What follows from the markup alone, whatever the page's address: telephone, address, social links, author, organisation, FAQ, how-to, image."""
    text, nodes = F.col("text"), F.col("nodes")
    return [
        S.telephone(text).alias("telephone"),
        S.address(text, nodes).alias("address"),
        S.social_links(nodes).alias("socials"),
        S.author(text, nodes).alias("author"),
        S.organization(text, nodes).alias("organization"),
        S.faq(text, nodes).alias("faq"),
        S.howto(text, nodes).alias("howto"),
        X.not_blank(N.first(nodes, 'meta[property="og:image"]')["attrs"]["content"]).alias("og_image"),
    ]


def site_values(nodes: Column, url: Column, socials: Column) -> list[Column]:
    """The site nodes of a page at ``url``; of ``nodes`` only the ``meta`` elements count."""
    return [organization_node(nodes, url, socials).alias("org_node"), website_node(nodes, url).alias("site_node")]


def structured_values() -> list[Column]:
    """:func:`content_values` and :func:`site_values` of a parsed page."""
    nodes = F.col("nodes")
    return [*content_values(), *site_values(nodes, F.col("url"), S.social_links(nodes))]


def structured_columns(parsed: DataFrame) -> DataFrame:
    """``(page_id, telephone, address, socials, author, organization, faq, howto, org_node, site_node, og_image)``.

    A map over the parsed pages; :func:`pagequarry.operators.page_text.page_text` takes the same values beside its own.
    """
    return parsed.select("page_id", *structured_values())


def _first_name(default: str) -> Column:
    return F.coalesce(X.not_blank(F.get("entities", F.lit(0))["name"]), F.lit(default))


def _named(kind: str, name: Column) -> Column:
    return F.when(name.isNotNull(), obj(type_=F.lit(kind), name=name))


def _things(start: int, count: int) -> Column:
    """A slice of the about things, NULL when empty."""
    return some(F.slice(about_things(F.col("entities")), start, count))


_DESCRIPTION = lambda: X.not_blank(F.col("description"))
_TITLE = lambda: X.not_blank(F.col("title"))


def _parts() -> Column:
    """FAQ and how-to as a list, NULL when the page has neither."""
    return some(F.array_compact(F.array("faq", "howto")))


def _page_node(**rest: Column) -> Column:
    url = F.col("url")
    head = dict(type_=F.lit("WebPage"), id_=U.webpage_id(url), url=F.coalesce(url, F.lit("")))
    links = dict(
        publisher=F.when(F.col("org_node").isNotNull(), obj(id_=U.organization_id(url))),
        isPartOf=F.when(F.col("site_node").isNotNull(), obj(id_=U.website_id(url))),
    )
    name = rest.pop("name")
    return obj(**head, name=name, description=_DESCRIPTION(), **links, **rest)


def _graph(page: Column) -> Column:
    """``@graph`` of organisation, site and page; the missing ones are left out."""
    nodes = F.array_compact(F.array(F.to_json("org_node"), F.to_json("site_node"), F.to_json(page)))
    return F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(nodes, ","), F.lit("]}"))


@X.built_once
def jsonld_webpage() -> Column:
    return _graph(
        _page_node(
            name=_TITLE(),
            primaryImageOfPage=U.resolve(F.col("og_image"), F.col("url")),
            author=_named("Person", F.col("author")),
            mainEntity=F.coalesce("howto", "faq"),
            about=_things(1, 4),
            mentions=_things(5, 6),
            speakable=speakable(4),
        )
    )


@X.built_once
def jsonld_service() -> Column:
    name = F.coalesce(X.not_blank(X.name_from_title(F.col("title"))), _first_name("Professional Service"))
    kind = C.service_type(F.col("title"), F.col("description"), F.col("headings"))
    target = C.audience(F.col("title"), F.col("description"), F.col("headings"))
    service = obj(
        type_=F.lit("Service"), name=name, serviceType=kind["service_type"], description=_DESCRIPTION(),
        sameAs=kind["same_as"],
        additionalType=F.when(
            kind["same_as"].isNotNull(), F.concat(F.lit(rules.PRODUCT_URL + "/id/"), F.replace(kind["service_type"], F.lit(" "), F.lit("_")))
        ),
        provider=F.when(F.col("org_node").isNotNull(), obj(id_=U.organization_id(F.col("url")))),
        audience=F.when(
            target.isNotNull(),
            obj(type_=target["type"], name=target["name"], educationalRole=target["educational_role"], audienceType=target["audience_type"]),
        ),
        areaServed=F.when(target.isNotNull(), obj(type_=F.lit("AdministrativeArea"), name=F.lit("United States"))),
        category=target["industry"],
        about=_things(1, 3),
        mentions=_things(4, 5),
    )
    return _graph(
        _page_node(
            name=F.coalesce(_TITLE(), name), primaryImageOfPage=F.col("og_image"), mainEntity=service, speakable=speakable(4), hasPart=_parts()
        )
    )


@X.built_once
def jsonld_article() -> Column:
    article = obj(type_=F.lit("Article"), headline=F.coalesce("title", F.lit("")), description=_DESCRIPTION(), author=_named("Person", F.col("author")))
    things = about_things(F.col("entities"))
    return F.to_json(
        obj(
            context_=F.lit(CONTEXT), type_=F.lit("WebPage"), url=F.coalesce("url", F.lit("")), name=F.coalesce("title", F.lit("")),
            description=_DESCRIPTION(), mainEntity=article, hasPart=_parts(), about=F.get(things, F.lit(0)),
            mentions=some(F.slice(things, F.lit(2), F.size(things))), publisher=_named("Organization", F.col("organization")),
            speakable=speakable(6),
        )
    )


@X.built_once
def jsonld_local_business(limits: rules.Limits = rules.LIMITS) -> Column:
    name = F.coalesce(X.not_blank(X.name_from_title(F.col("title"))), _first_name("Local Business"))
    wanted = lambda e: (e["confidence"] > 50) & F.lower(e["name"]).rlike("|".join(rules.OFFER_WORDS))
    offered = X.head(F.filter("entities", wanted), limits.offers)
    offers = F.transform(offered, lambda e: obj(type_=F.lit("Offer"), itemOffered=obj(type_=F.lit("Service"), name=e["name"])))
    return F.to_json(
        obj(
            context_=F.lit(CONTEXT), type_=F.lit("LocalBusiness"), name=name, url=F.coalesce("url", F.lit("")), description=_DESCRIPTION(),
            telephone=F.col("telephone"), address=F.col("address"),
            hasOfferCatalog=F.when(F.size(offers) > 0, obj(type_=F.lit("OfferCatalog"), name=F.lit("Services"), itemListElement=offers)),
            knowsAbout=some(knows_about(F.col("entities"), limits.knows_about)), sameAs=some(F.col("socials")),
        )
    )


def education_provider() -> Column:
    """Name of the first school among the entities, else from the title, else the first entity."""
    school = F.get(F.filter("entities", lambda e: X.hits(e["name"], rules.SCHOOL_NAME)), F.lit(0))["name"]
    return F.coalesce(school, X.not_blank(X.name_from_title(F.col("title"))), _first_name("Educational Institution"))


@X.built_once
def jsonld_educational() -> Column:
    name = F.coalesce(_TITLE(), _first_name("Educational Program"))
    details = S.program_details(F.col("body"))
    provider = obj(
        type_=F.lit("CollegeOrUniversity"), name=education_provider(), description=_DESCRIPTION(), telephone=F.col("telephone"), address=F.col("address")
    )
    credential = obj(type_=F.lit("EducationalOccupationalCredential"), credentialCategory=details["credential"])
    program = obj(
        type_=F.lit("EducationalOccupationalProgram"), name=name, url=F.coalesce("url", F.lit("")), description=_DESCRIPTION(),
        timeToComplete=details["timeToComplete"], numberOfCredits=details["numberOfCredits"],
        educationalCredentialAwarded=F.when(details["credential"].isNotNull(), credential),
        educationalProgramMode=details["mode"], provider=provider,
    )
    return F.to_json(
        obj(
            context_=F.lit(CONTEXT), type_=F.lit("WebPage"), name=name, url=F.coalesce("url", F.lit("")), description=_DESCRIPTION(),
            provider=provider, mainEntity=program, hasPart=F.col("faq"), about=_things(1, 4), mentions=_things(5, 4),
            publisher=_named("Organization", F.col("organization")), speakable=speakable(5),
        )
    )


WRITERS = {
    "Service": jsonld_service,
    "LocalBusiness": jsonld_local_business,
    "EducationalOccupationalProgram": jsonld_educational,
    "Article": jsonld_article,
    "WebPage": jsonld_webpage,
}


def with_schema_type(pages: DataFrame) -> DataFrame:
    """Adds ``schema_type`` to page rows with text columns."""
    counts = C.pattern_counts(*[F.col(c) for c in ("title", "description", "headings", "body")])
    return pages.withColumn("_counts", counts).withColumn("schema_type", C.schema_type(F.col("_counts"))).drop("_counts")


@X.built_once
def document() -> Column:
    """The JSON-LD document of a page row with ``schema_type``: the type picks the writer, ``CASE`` evaluates one branch."""
    out = None
    for kind, writer in WRITERS.items():
        out = (F.when if out is None else out.when)(F.col("schema_type") == kind, writer())
    return out


def generate_jsonld(pages: DataFrame) -> DataFrame:
    """``(page_id, schema_type, jsonld)``, one row per page; the pages are read once rather than once per type."""
    typed = pages if "schema_type" in pages.columns else with_schema_type(pages)
    return typed.select("page_id", "schema_type", document().alias("jsonld"))


def with_profiles(entities: Column, anchors: Column) -> Column:
    """``entities`` with ``linkedin_url`` filled for persons from the page's :func:`pagequarry.operators.linking.person_anchors`."""
    url = lambda e: F.when((e["type"] == "Person") & anchors.isNotNull(), L.person_link(anchors, e["name"]))
    return F.transform(entities, lambda e: e.withField("linkedin_url", url(e)))


def person_links(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities(page_id, entities)`` with ``linkedin_url`` filled for persons from links on their page.

    Each page that has such links is mapped to one small row of them (address, label and nearby text that is short
    enough to count), and only those rows meet the entities.
    """
    anchors = parsed.select("page_id", L.person_anchors(F.col("text"), F.col("nodes")).alias("_anchors")).filter(F.size("_anchors") > 0)
    joined = entities.join(anchors, "page_id", "left")
    return joined.select(*[c for c in entities.columns if c != "entities"], with_profiles(F.col("entities"), F.col("_anchors")).alias("entities"))

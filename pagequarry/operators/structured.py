"""Structured data found on a page: contact, social links, author, organisation, FAQ, how-to, programme details.

Column expressions over ``text`` and ``nodes`` of a parsed page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import nodes as N
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators.fanout import until

ADDRESS = (
    "struct<`@type`:string,postalCode:string,addressRegion:string,addressCountry:string,streetAddress:string,"
    "addressLocality:string>"
)
QUESTION = "struct<`@type`:string,name:string,acceptedAnswer:struct<`@type`:string,text:string>>"
STEP = "struct<`@type`:string,position:int,text:string,name:string>"
SUPPLY = "struct<`@type`:string,name:string>"
#: An FAQ page or a how-to: the fields of both, so that they fit the same slots.
PART = (
    f"struct<`@type`:string,mainEntity:array<{QUESTION}>,name:string,step:array<{STEP}>,description:string,"
    f"totalTime:string,supply:array<{SUPPLY}>>"
)


def some(array: Column) -> Column:
    """NULL for an empty array, so that its key is omitted."""
    return F.when(F.size(array) > 0, array)


def parse_address(text: Column) -> Column:
    """ZIP, two-letter state, country, street and locality; NULL when nothing is found."""
    return X.let(text, lambda t: _address_parts(t, X.trim(X.sub(X.sub(t, rules.ZIP + ".*$", ""), rules.STATE + ".*$", ""))))


def _address_parts(text: Column, rest: Column) -> Column:
    return X.let(rest, lambda r: _address(text, r))


def _address(text: Column, rest: Column) -> Column:
    postal, state = X.first_match(text, rules.ZIP, 0, ""), X.first_match(text, rules.STATE, 0, "")
    country = F.when(X.hits(text, rules.COUNTRY_US), F.lit("US"))
    parts = F.split(rest, ",", -1)
    street = F.when(rest != "", F.when(F.size(parts) >= 2, X.trim(F.get(parts, F.lit(0)))).otherwise(rest))
    locality = F.when((rest != "") & (F.size(parts) >= 2), X.trim(F.get(parts, F.lit(1))))
    found = postal.isNotNull() | state.isNotNull() | country.isNotNull() | (rest != "")
    return F.when(found, F.struct(F.lit("PostalAddress"), postal, state, country, street, locality).cast(ADDRESS))


def telephone(text: Column) -> Column:
    """First phone number in the document text; the patterns are tried in order."""
    return X.let(F.array_join(text, ""), lambda t: X.trim(F.coalesce(*[X.first_match(t, p, 0, "") for p in rules.PHONES])))


def address(text: Column, nodes: Column) -> Column:
    """Address of the first element of each selector, if its text has 11 to 199 characters."""
    return N.first_of_each(nodes, rules.ADDRESS_ELEMENTS, lambda n: parse_address(X.longer(X.trim(N.node_text(text, n)), 11, 199)))


def social_links(nodes: Column) -> Column:
    """Absolute links to social networks, by network, then in document order."""
    links = F.transform(N.select(nodes, "a[href]"), lambda a: a["attrs"]["href"])
    absolute = F.filter(links, U.is_absolute)

    def by_network(hrefs: Column) -> Column:
        of = lambda domain: F.filter(hrefs, lambda h: F.contains(h, F.lit(domain)))
        return F.array_distinct(F.concat(*[of(d) for d in rules.SOCIAL_DOMAINS]))

    return X.let(absolute, by_network)


def clean_author(text: Column) -> Column:
    """Name from a byline: prefix stripped, three words at most, 3 to 99 characters."""
    bare = X.trim(X.sub(X.trim(text), rules.AUTHOR_PREFIX, "", "i"))
    return X.longer(F.array_join(F.slice(X.words(bare), 1, 3), " "), 3, 99)


def _meta_name(nodes: Column, selectors: tuple[str, ...]) -> Column:
    return N.first_of_each(nodes, selectors, lambda n: X.longer(X.trim(n["attrs"]["content"]), 3))


def author(text: Column, nodes: Column) -> Column:
    """Author name from meta tags, else from the first element of each selector."""
    element = N.first_of_each(nodes, rules.AUTHOR_ELEMENTS, lambda n: clean_author(N.node_text(text, n)))
    return F.coalesce(_meta_name(nodes, rules.AUTHOR_META), element)


def organization(text: Column, nodes: Column) -> Column:
    """Organisation name, in the same way."""
    element = N.first_of_each(nodes, rules.ORGANIZATION_ELEMENTS, lambda n: X.longer(X.trim(N.node_text(text, n)), 3, 199))
    return F.coalesce(_meta_name(nodes, rules.ORGANIZATION_META), element)


# ── FAQ ───────────────────────────────────────────────────────────────────────


def is_question(text: Column) -> Column:
    return X.let(text, lambda t: F.length(t).between(10, 300) & X.hits_any(t, rules.QUESTION_FORMS))


def clean_question(text: Column) -> Column:
    """Prefix stripped; a question mark added where a question word lacks one."""
    open_end = lambda t: ~X.hits(t, "[?!.]$", "") & X.hits(t, rules.QUESTION_WORDS)
    bare = X.trim(X.sub(text, rules.QUESTION_PREFIX, "", "i"))
    return X.let(bare, lambda t: F.when(open_end(t), F.concat(t, F.lit("?"))).otherwise(t))


def clean_answer(text: Column) -> Column:
    """Prefix stripped, white space collapsed, cut at 1,500 characters."""
    return X.clip_at_period(X.collapse(X.trim(X.sub(text, rules.ANSWER_PREFIX, "", "i"))), 1500, 1000)


def find_answer(text: Column, nodes: Column, question: Column) -> Column:
    """Answer to a question element: a later sibling with an accordion class, else the first later sibling.

    Either needs more than 20 characters. (The search over the next three siblings and the search over the parent's
    children both come down to the first later sibling with enough text.)
    """
    return X.let(N.later_siblings(nodes, question), lambda later: _answer_among(text, later))


def _answer_among(text: Column, later: Column) -> Column:
    long_enough = lambda n: X.longer(X.trim(N.node_text(text, n)), 21)
    by_class = N.first_of_each(later, rules.FAQ_ANSWERS, long_enough)

    def first_long(candidates: Column) -> Column:
        # The first three are tried one by one; all are cut out only when those fail.
        quick = [long_enough(F.get(candidates, F.lit(i))) for i in range(3)]
        return F.coalesce(*quick, N.first_value(F.transform(candidates, long_enough)))

    return F.coalesce(by_class, X.let(F.filter(later, lambda n: n["chars"] > 20), first_long))


def faq(text: Column, nodes: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """Up to ``limits.faq`` questions with answers as an FAQ page, NULL if there are none.

    Questions inside FAQ containers come first (container selector, container, question selector, position), then
    headings anywhere. The first usable answer per question counts.
    """
    kind = "array<struct<pre:int,enough:int>>"

    def marks(found: Column, enough: int) -> Column:
        return F.transform(found, lambda n: F.struct(n["pre"].alias("pre"), F.lit(enough).alias("enough"))).cast(kind)

    def in_container(c: Column) -> Column:
        return marks(F.flatten(N.turns(N.inside(nodes, c), *rules.FAQ_QUESTIONS)), 20)

    containers = F.flatten(N.turns(nodes, *rules.FAQ_CONTAINERS))
    contained = F.flatten(F.transform(containers, in_container))
    asked = F.array_distinct(F.concat(contained, marks(N.select(nodes, *rules.HEADINGS), 50)))

    def qa(m: Column) -> Column:
        return X.let(F.get(nodes, m["pre"]), lambda node: qa_of(node, m["enough"]))

    def qa_of(node: Column, enough: Column) -> Column:
        return F.struct(
            clean_question(X.trim(N.node_text(text, node))).alias("name"),
            find_answer(text, nodes, node).alias("answer"),
            enough.alias("enough"),
        )

    valid = F.filter(asked, lambda m: is_question(X.trim(N.node_text(text, F.get(nodes, m["pre"])))))
    answered = F.filter(F.transform(valid, qa), lambda i: F.length(i["answer"]) > i["enough"])
    cleaned = F.transform(
        answered,
        lambda i: F.struct(F.lit("Question"), i["name"], F.struct(F.lit("Answer"), clean_answer(i["answer"]))).cast(QUESTION),
    )
    reply = lambda q: X.trim(q["acceptedAnswer"]["text"])
    good = lambda t: (F.length(t) >= 20) & ~X.hits(t, rules.EMPTY_ANSWER)
    usable = F.filter(cleaned, lambda q: X.let(reply(q), good))
    key = lambda q: X.trim(F.lower(q["name"]))

    def first_per_question(items: Column) -> Column:
        pick = lambda keys: F.transform(
            F.array_distinct(keys), lambda k: F.get(items, (F.array_position(keys, k) - 1).cast("int"))
        )
        return X.let(F.transform(items, key), pick)

    page = lambda q: F.when(F.size(q) > 0, _part("FAQPage", questions=q))
    return X.let(X.head(X.let(usable, first_per_question), limits.faq), page)


def _part(kind: str, questions=None, name=None, steps=None, description=None, time=None, supply=None) -> Column:
    none = F.lit(None)
    fields = [questions, name, steps, description, time, supply]
    return F.struct(F.lit(kind), *[none if f is None else f for f in fields]).cast(PART)


# ── how-to ────────────────────────────────────────────────────────────────────


def clean_step_name(text: Column) -> Column:
    return X.trim(X.sub(text, rules.STEP_PREFIX, "", "i"))


def clean_step(text: Column, most: int | None = rules.LIMITS.step_chars) -> Column:
    """Step prefix stripped, white space collapsed, cut at ``most`` characters, after a period in their last fifth if there is one."""
    bare = X.collapse(clean_step_name(text))
    return bare if most is None else X.clip_at_period(bare, most, most * 4 // 5)


def howto_time(text: Column) -> Column:
    """First duration in minutes, else hours, else days, as an ISO 8601 duration."""
    found = []
    for pattern, prefix, unit in rules.DURATIONS:
        number = F.regexp_replace(X.first_match(text, pattern, 1), r"^0+(?=\d)", "")
        found.append(F.concat(F.lit(prefix), number, F.lit(unit)))
    return F.coalesce(*found)


def howto_supplies(text: Column, nodes: Column, container: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """Up to ``limits.supplies`` list items under the first supply selector that has any; NULL if none."""
    return X.let(N.inside(nodes, container), lambda inner: _supplies(text, nodes, inner, limits))


def _supplies(text: Column, nodes: Column, inner: Column, limits: rules.Limits) -> Column:
    def under(groups: Column) -> Column:
        items = F.filter(
            inner, lambda n: (n["tag"] == "li") & F.exists(groups, lambda g: (n["pre"] > g["pre"]) & (n["pre"] <= g["pre_end"]))
        )
        names = F.filter(F.transform(items, lambda n: X.trim(N.node_text(text, n))), lambda t: F.length(t).between(1, 99))
        rows = F.transform(X.head(names, limits.supplies), lambda t: F.struct(F.lit("HowToSupply"), t).cast(SUPPLY))
        return X.let(rows, some)

    return N.first_value(F.transform(N.turns(nodes, *rules.HOWTO_SUPPLIES), under))


def _remove_first(text: Column, part: Column) -> Column:
    def at(i: Column) -> Column:
        cut = F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + F.length(part), F.length(text)))
        return F.when((i > 0) & (part != ""), cut).otherwise(text)

    return X.let(F.position(part, text), at)


def _numbered(container_text: Column, pattern: str, flags: str, limits: rules.Limits) -> Column:
    """Steps from numbered lines."""
    regex = X.rx(pattern, flags)
    numbers = F.regexp_extract_all(container_text, F.lit(regex), F.lit(1))
    bodies = F.regexp_extract_all(container_text, F.lit(regex), F.lit(2))
    both = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("n"), X.trim(b).alias("b")))
    kept = F.filter(both, lambda s: F.length(s["b"]) > 15)
    return F.transform(kept, lambda s: F.struct(F.lit("HowToStep"), s["n"], clean_step(s["b"], limits.step_chars), F.lit(None)).cast(STEP))


def howto_steps(text: Column, nodes: Column, container: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """Up to ``limits.steps`` steps: elements of the first step selector that yields any, else numbered lines."""
    return X.let(container, lambda c: X.let(N.inside(nodes, c), lambda inner: _steps(text, nodes, c, inner, limits)))


def _steps(text: Column, nodes: Column, container: Column, inner: Column, limits: rules.Limits) -> Column:
    none = F.array().cast(f"array<{STEP}>")

    def from_elements(found: Column) -> Column:
        def one(n: Column) -> Column:
            whole = X.trim(N.node_text(text, n))
            name = F.coalesce(X.trim(N.node_text(text, N.first(N.inside(nodes, n), *rules.HOWTO_STEP_HEADINGS))), F.lit(""))
            both = lambda w, h: F.struct(X.trim(_remove_first(w, h)).alias("body"), h.alias("name"))
            return X.let(whole, lambda w: X.let(name, lambda h: both(w, h)))

        kept = F.filter(F.transform(found, one), lambda s: F.length(s["body"]) > 15)
        return F.transform(
            kept,
            lambda s, i: F.struct(
                F.lit("HowToStep"), (i + 1).cast("int"), clean_step(s["body"], limits.step_chars), F.when(s["name"] != "", clean_step_name(s["name"]))
            ).cast(STEP),
        )

    ordered = F.filter(inner, lambda n: (n["tag"] == "li") & (N.parent(nodes, n)["tag"] == "ol"))
    found = F.transform(F.array_append(N.turns(inner, *rules.HOWTO_STEPS), ordered), from_elements)
    structured = F.get(F.filter(found, lambda steps: F.size(steps) > 0), F.lit(0))
    body = N.node_text(text, container)
    numbered = [
        _numbered(body, r"(?:^|\n)\s*(\d+)[.)]\s*([^\n]+)", "m", limits),
        _numbered(body, r"(?:^|\n)\s*Step\s+(\d+):?\s*([^\n]+)", "im", limits),
    ]
    return X.head(F.coalesce(structured, *[X.let(s, some) for s in numbered], none), limits.steps)


def howto(text: Column, nodes: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """How-to of the first container that has steps, else from step headings, else NULL."""
    page_title = X.trim(F.array_join(F.transform(N.select(nodes, "title"), lambda n: N.node_text(text, n)), ""))
    named = F.coalesce(F.concat(F.lit("How to "), X.first_match(page_title, r"how\s+to\s+(.+)", 1)), F.lit("How-to Guide"))

    def from_container(c: Column) -> Column:
        return X.let(N.inside(nodes, c), lambda inner: described(c, inner))

    def described(c: Column, inner: Column) -> Column:
        heading = F.get(F.flatten(N.turns(inner, *rules.HOWTO_TITLES)), F.lit(0))
        title = F.coalesce(N.text_or_null(text, heading), named)
        long = lambda n: X.longer(X.trim(N.node_text(text, n)), 31)
        description = N.first_of_each(inner, (*rules.HOWTO_DESCRIPTIONS, "p"), long)
        whole = lambda steps: _part(
            "HowTo", name=title, steps=steps, description=description, time=X.let(N.node_text(text, c), howto_time),
            supply=howto_supplies(text, nodes, c, limits),
        )
        return X.let(howto_steps(text, nodes, c, limits), lambda steps: F.when(F.size(steps) > 0, whole(steps)))

    firsts = F.transform(N.turns(nodes, *rules.HOWTO_CONTAINERS), lambda found: F.get(found, F.lit(0))["pre"])
    containers = F.array_distinct(F.array_compact(firsts))
    built = F.transform(containers, lambda p: X.let(F.get(nodes, p), from_container))
    return F.coalesce(N.first_value(built), howto_from_headings(text, nodes, limits))


def howto_from_headings(text: Column, nodes: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """How-to of a page whose first h1 announces one and that has at least two step headings."""
    title = X.trim(N.node_text(text, N.first(nodes, "h1")))
    return X.let(title, lambda t: F.when(X.hits(t, rules.HOWTO_PAGE_TITLE), _headed_steps(text, nodes, t, limits)))


def _headed_steps(text: Column, nodes: Column, title: Column, limits: rules.Limits) -> Column:
    heading_text = lambda n: X.trim(N.node_text(text, n))
    heads = F.filter(N.select(nodes, "h2", "h3"), lambda n: X.hits(heading_text(n), rules.HOWTO_STEP_TITLE, ""))

    def one(n: Column, i: Column) -> Column:
        between = until(N.later_siblings(nodes, n), lambda s: s["tag"].rlike(r"^h[1-6]\z"))
        body = X.trim(F.array_join(F.transform(between, heading_text), " "))
        step = lambda b: F.struct(F.lit("HowToStep"), (i + 1).cast("int"), clean_step(b, limits.step_chars), clean_step_name(heading_text(n)))
        return X.let(body, lambda b: F.when(b != "", step(b).cast(STEP)))

    whole = lambda steps: F.when(F.size(steps) >= 2, _part("HowTo", name=title, steps=X.head(steps, limits.heading_steps)))
    return X.let(F.array_compact(F.transform(heads, one)), whole)


# ── programmes ────────────────────────────────────────────────────────────────


def program_details(body: Column) -> Column:
    """Duration, credits, credential and mode named in the text."""
    length = F.coalesce(*[F.concat(F.lit("P"), X.first_match(body, p, 1), F.lit(u)) for p, u in rules.PROGRAM_LENGTHS])
    proper = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
    return F.struct(
        length.alias("timeToComplete"),
        X.first_match(body, rules.PROGRAM_CREDITS, 1).cast("bigint").alias("numberOfCredits"),
        X.let(X.first_match(body, rules.PROGRAM_CREDENTIAL, 1), proper).alias("credential"),
        F.lower(X.first_match(body, rules.PROGRAM_MODE, 1)).alias("mode"),
    )

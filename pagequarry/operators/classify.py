"""Page classification: schema type, service type, audience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import text as X


def _heading_text(headings: Column) -> Column:
    return F.array_join(F.transform(headings, lambda h: h["text"]), " ")


def _topline(title: Column, description: Column, headings: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), _heading_text(headings)))


def pattern_counts(title: Column, description: Column, headings: Column, body: Column, chars: int | None = None) -> Column:
    """Matches per pattern group in the lower-cased head and the body, or its first ``chars`` characters."""
    sample = F.concat_ws(
        " ",
        F.coalesce(title, F.lit("")),
        F.coalesce(description, F.lit("")),
        _heading_text(headings),
        F.coalesce(F.substring(body, 1, chars) if chars else body, F.lit("")),
    )
    # The text is in lower case, and so are the patterns.
    low = {kind: [p.lower() for p in patterns] for kind, patterns in rules.PAGE_TYPE_PATTERNS.items()}
    count = lambda text: F.struct(*[X.count_matches(text, p, "").alias(k) for k, p in low.items()])
    return X.let(X.ascii_words(F.lower(sample)), count)


def schema_type(counts: Column, has_html: Column | bool = True) -> Column:
    """Best schema type for :func:`pattern_counts`; ties go Service, LocalBusiness, education, Article."""
    service, agency, article = counts["service"], counts["agency"], counts["article"]
    education = "EducationalOccupationalProgram"
    top = F.greatest(service, counts["business"], counts["education"], article)
    best = (
        F.when(service == top, F.lit("Service"))
        .when(counts["business"] == top, F.lit("LocalBusiness"))
        .when(counts["education"] == top, F.lit(education))
        .otherwise(F.lit("Article"))
    )
    return (
        F.when(~F.lit(has_html) if isinstance(has_html, bool) else ~has_html, F.lit("WebPage"))
        .when((service >= 2) & (agency >= 1), F.lit("Service"))
        .when((article >= 3) & (article > service), F.lit("Article"))
        .when(top >= 2, best)
        .otherwise(F.lit("WebPage"))
    )


def service_type(title: Column, description: Column, headings: Column) -> Column:
    """``(service_type, same_as)`` of the first matching pattern, else the default with no links."""
    text = _topline(title, description, headings)
    kind = "struct<service_type:string,same_as:array<string>>"
    out = F.lit(None).cast(kind)
    for pattern, name, page, item in reversed(rules.SERVICE_TYPES):
        links = [F.lit(rules.WIKIPEDIA + page)] + ([F.lit(rules.WIKIDATA + item)] if item else [])
        out = F.when(X.hits(text, pattern), F.struct(F.lit(name).alias("service_type"), F.array(*links).alias("same_as"))).otherwise(out)
    default = F.struct(F.lit(rules.DEFAULT_SERVICE_TYPE).alias("service_type"), F.lit(None).cast("array<string>").alias("same_as"))
    return F.coalesce(out, default.cast(kind))


def audience(title: Column, description: Column, headings: Column, limits: rules.Limits = rules.LIMITS) -> Column:
    """The audience object of the first matching pattern with its industry label, NULL if none matches."""
    text = _topline(title, description, X.head(headings, limits.audience_headings))
    kind = "struct<type:string,name:string,educational_role:string,audience_type:string,industry:string>"
    out = F.lit(None).cast(kind)
    for pattern, type_, name, field, value, label in reversed(rules.AUDIENCES):
        role = F.lit(value if field == "educationalRole" else None).cast("string")
        audience_type = F.lit(value if field == "audienceType" else None).cast("string")
        one = F.struct(
            F.lit(type_).alias("type"), F.lit(name).alias("name"), role.alias("educational_role"),
            audience_type.alias("audience_type"), F.lit(label).alias("industry"),
        )
        out = F.when(X.hits(text, pattern), one).otherwise(out)
    return out

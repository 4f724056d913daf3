"""Column expressions for page URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions import text as X

_ABSOLUTE = r"[a-zA-Z][a-zA-Z0-9+.-]*:"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-case host with a non-default port, NULL when the URL has none."""
    def of(u: Column) -> Column:
        raw = F.lower(F.regexp_extract(u, _HOST, 1))
        default_port = F.when(u.rlike("(?i)^https:"), F.lit(r":443\z")).otherwise(F.lit(r":80\z"))
        return F.regexp_replace(raw, default_port, "")

    return X.not_blank(X.let(F.trim(url), of))


def is_absolute(url: Column) -> Column:
    """Would the URL parse without a base? ``http(s)`` needs a host, other schemes only their name."""
    return F.coalesce(F.trim(url).rlike(rf"(?i)^https?:/*[^/?#\s]+|(?!https?:){_ABSOLUTE}"), F.lit(False))


def origin(url: Column) -> Column:
    """``scheme://host``, the empty string when the URL is not valid."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.coalesce(F.concat(scheme, F.lit("://"), host(url)), F.lit(""))


def organization_id(url: Column) -> Column:
    return X.let(origin(url), lambda o: F.when(o == "", o).otherwise(F.concat(o, F.lit("/#organization"))))


def website_id(url: Column) -> Column:
    return X.let(origin(url), lambda o: F.when(o == "", o).otherwise(F.concat(o, F.lit("/#website"))))


def webpage_id(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(u == "", F.lit("")).otherwise(F.concat(u, F.lit("#webpage")))


def resolve(ref: Column, base: Column) -> Column:
    """``ref`` against ``base``: absolute, protocol-relative, rooted and plain relative references."""
    return X.let(F.trim(ref), lambda r: X.let(F.trim(base), lambda b: X.let(origin(b), lambda o: _resolve(r, b, o))))


def _resolve(r: Column, base: Column, o: Column) -> Column:
    folder = F.regexp_extract(F.regexp_extract(base, r"^[^?#]*", 0), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/(?:[^/]*/)*)?", 1)
    scheme = F.concat(F.substring_index(o, ":", 1), F.lit(":"))
    return (
        F.when(is_absolute(r), F.when(r.rlike(r"(?i)^https?://[^/?#]+$"), F.concat(r, F.lit("/"))).otherwise(r))
        .when(o == "", F.lit(None))
        .when(r.startswith("//"), F.concat(scheme, r))
        .when(r.startswith("/"), F.concat(o, r))
        .otherwise(F.concat(o, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), r))
    )

"""Column expressions for text with ECMAScript string semantics.

Java's regular expressions differ from ECMAScript's in ``\\b`` (Unicode-aware), ``\\s`` (ASCII only), ``.`` and ``$``;
:func:`rx` rewrites a pattern so that both agree. Nothing in this package writes a bare ``\\b``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it, as regex class content and as plain characters.
_WIDE = (
    (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
_NOT_BLANK = r"\t-\r" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in _WIDE)
SPACE_CLASS = _NOT_BLANK + " "
SPACE_CHARS = "\t\n\x0b\f\r " + "".join(chr(c) for a, b in _WIDE for c in range(a, b + 1))
#: One such character. Two ranges come before the list: a letter is turned away there.
SPACE = rf"[\t- \u00A0-\uFEFF&&[{SPACE_CLASS}]]"
#: ASCII word boundary.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a transform over a one-element array binds it to a variable.

    Columns are trees, so using a Python variable twice repeats the whole expression; nested helpers would multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BUILT: dict[tuple, object] = {}


def built_once(make: Callable) -> Callable:
    """A builder of columns that depends on its (hashable) arguments alone: the columns are kept for the session.

    A large expression takes seconds of driver time to put together, and columns that name their inputs can be used again.
    """

    @functools.wraps(make)
    def kept(*args, **settings):
        key = (SparkContext._active_spark_context.applicationId, make.__module__, make.__qualname__, args, tuple(sorted(settings.items())))
        if key not in _BUILT:
            _BUILT[key] = make(*args, **settings)
        return _BUILT[key]

    return kept


def rx(pattern: str, flags: str = "", boundary: str = BOUNDARY) -> str:
    """``pattern`` (ECMAScript syntax) as an equivalent Java pattern."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == r"\s":
                out.append(SPACE_CLASS if in_class else SPACE)
            elif two == r"\b" and not in_class:
                out.append(boundary)
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "." and not in_class:
            c = r"[^\n\r\u2028\u2029]"
        elif c == "$" and not in_class:
            c = r"\z"
        out.append(c)
        i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def hits(col: Column, pattern: str, flags: str = "i") -> Column:
    """Does ``pattern`` match somewhere in ``col``?"""
    return col.rlike(rx(pattern, flags))


def hits_any(col: Column, patterns: Sequence[str], flags: str = "i") -> Column:
    """Does any of ``patterns`` match? One alternation, so one pass per distinct start."""
    return col.rlike(rx("|".join(f"(?:{p})" for p in patterns), flags))


def first_match(col: Column, pattern: str, group: int = 0, flags: str = "i") -> Column:
    """First match (or its group), NULL if there is none."""
    regex = rx(pattern, flags)
    if group == 0:
        return F.regexp_substr(col, F.lit(regex))
    return let(col, lambda c: F.when(c.rlike(regex), F.regexp_extract(c, regex, group)))


def ascii_words(col: Column) -> Column:
    """Non-ASCII characters (but for the typographic apostrophe) replaced by a control character.

    On such text Java's own ``\\b`` is the ASCII boundary, at a third of the cost of :data:`BOUNDARY`.
    """
    return F.regexp_replace(col, "[^\\x00-\\x7F\u2019]", "\x01")


def count_matches(plain: Column, patterns: Sequence[str], flags: str = "i") -> Column:
    """Matches of each pattern, added up; ``plain`` comes from :func:`ascii_words`."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(plain, F.lit(rx(by_first_letter(p), flags, r"\b")))
    return total


_WORD_LIST = re.compile(r"\\b\(((?:[^()\\]|\\.)+)\)\\b")


def by_first_letter(pattern: str) -> str:
    r"""``\b(a|b|c)\b`` with the first character read before the boundary: most positions of a text fail at one look-up.

    Alternatives with the same first character keep their order, so the matches are the same. Other patterns are returned as they are.
    """
    found = _WORD_LIST.fullmatch(pattern)
    parts = [re.match(r"(\\[^\w]|\w)(?![?*+{])(.*)", a) for a in found[1].split("|")] if found else [None]
    if not all(parts):
        return pattern
    rests: dict[str, list[str]] = {}
    for part in parts:
        rests.setdefault(part[1], []).append(part[2])
    return f"[{''.join(rests)}](?:" + "|".join(rf"(?<=\b{c})(?:{'|'.join(r)})" for c, r in rests.items()) + r")\b"


def sub(col: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replace every match."""
    return F.regexp_replace(col, rx(pattern, flags), replacement)


def sub_first(col: Column, pattern: str, flags: str = "") -> Column:
    """Remove the first match only; ``pattern`` must be anchored at the start or at the end."""
    return F.regexp_replace(col, rx(pattern, flags), "")


def head(items: Column, most: int | None) -> Column:
    """The first ``most`` items, all of them for ``None``."""
    return items if most is None else F.slice(items, 1, most)


def cut(text: Column, most: int | None) -> Column:
    """The first ``most`` characters, all of them for ``None``."""
    return text if most is None else F.substring(text, 1, most)


def trim(col: Column) -> Column:
    """Strip ECMAScript white space at both ends, in linear time."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank. A single blank is one already and no match, so plain text is not put together anew."""
    return F.regexp_replace(col, rf" {SPACE}++|[\t-\r\u00A0-\uFEFF&&[{_NOT_BLANK}]]{SPACE}*+", " ")


def words(col: Column) -> Column:
    """Split at white space, empty words kept (as a plain split does)."""
    return F.split(col, SPACE + "+", -1)


def real_words(col: Column) -> Column:
    """Split at white space, empty words dropped."""
    return F.filter(words(col), lambda w: w != "")


def js_round(col: Column) -> Column:
    """Half-up rounding of a non-negative number."""
    return F.floor(col + F.lit(0.5)).cast("int")


def not_blank(col: Column) -> Column:
    """NULL for the empty string. The value is evaluated once, without a lambda, which is dear to build."""
    return F.get(F.array_except(F.array(col), F.array(F.lit(""))), F.lit(0))


def longer(col: Column, low: int, high: int | None = None) -> Column:
    """The text if its length is at least ``low`` (and at most ``high``), else NULL."""
    return let(col, lambda c: F.when(F.length(c).between(low, high) if high else F.length(c) >= low, c))


def contains(haystack: Column, needle: Column | str) -> Column:
    """Literal containment, never NULL; the empty needle is contained in everything."""
    needle = F.lit(needle) if isinstance(needle, str) else F.coalesce(needle, F.lit(""))
    return F.contains(F.coalesce(haystack, F.lit("")), needle)


def count_occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping literal count; an empty needle counts 0. Lengths are in bytes, which a text knows; characters would be counted each time."""
    def count(n: Column) -> Column:
        gone = F.octet_length(haystack) - F.octet_length(F.replace(haystack, n, F.lit("")))
        return F.when(n == "", F.lit(0)).otherwise(F.coalesce((gone / F.octet_length(n)).cast("int"), F.lit(0)))

    return let(F.coalesce(needle, F.lit("")), count)


def name_in(name: Column, haystack: Column) -> Column:
    """``name`` occurs in ``haystack`` after case and space folding, or with all spaces removed."""
    fold = lambda c: trim(collapse(F.lower(c)))
    squeeze = lambda c: F.regexp_replace(c, SPACE + "+", "")
    hit = lambda n, h: (n != "") & (h != "") & (F.contains(h, n) | F.contains(squeeze(h), squeeze(n)))
    return F.coalesce(let(fold(name), lambda n: let(fold(haystack), lambda h: hit(n, h))), F.lit(False))


def name_from_title(title: Column) -> Column:
    """Everything before the first ``-`` or ``|``; the whole title if nothing is left."""
    # A dot does not cross a line break, so only a rest that runs to the end of the text is cut.
    cut = lambda t: not_blank(trim(F.regexp_replace(t, rx(r"\s*+[-|]\s*.+$"), "")))
    return let(F.coalesce(title, F.lit("")), lambda t: F.coalesce(cut(t), t))


def clip_at_period(col: Column, limit: int, floor: int) -> Column:
    """Cut at ``limit``: after the last period beyond ``floor``, else at the limit with an ellipsis."""
    def cut(head: Column) -> Column:
        # ``back`` is the distance of the last period from the end, 0 without one.
        clip = lambda back: F.when(
            (back > 0) & (limit - back > floor), F.substring(head, F.lit(1), limit - back + 1)
        ).otherwise(F.concat(head, F.lit("...")))
        return let(F.position(F.lit("."), F.reverse(head)), clip)

    return let(col, lambda c: F.when(F.length(c) > limit, let(F.substring(c, 1, limit), cut)).otherwise(c))


def encode_uri_component(col: Column) -> Column:
    """Percent-encoding as in ECMAScript: ``url_encode`` with its five extra escapes undone."""
    out = F.url_encode(col)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def md5_key(col: Column) -> Column:
    """Cache key of a URL or a name: md5 of the trimmed lower-case text."""
    return F.md5(F.lower(trim(col)))


LIKE_PERSON = r"^[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+"


def person_shaped(name: Column) -> Column:
    """Two capitalised words, optionally with an initial between them."""
    return hits(trim(name), LIKE_PERSON + "$", "")


def starts_like_person(name: Column) -> Column:
    """As :func:`person_shaped`, with anything after it."""
    return hits(trim(name), LIKE_PERSON, "")

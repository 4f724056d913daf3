"""Column expressions over a page's element array: selectors, subtree text, neighbours."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.text import SPACE, let, not_blank, trim

Predicate = Callable[[Column], Column]

_PART = re.compile(r'^([a-z][a-z0-9]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*]?=)"([^"]*)")?\]')
_FIELD = {"class": "cls", "id": "elem_id", "role": "role"}


def attr(node: Column, name: str) -> Column:
    """Attribute value, NULL when absent."""
    return node[_FIELD[name]] if name in _FIELD else node["attrs"][name]


def _tests(selector: str) -> list[tuple[str, str, str]]:
    """A compound selector as (kind, name, value) tests."""
    found = []
    for tag, cls, elem_id, name, op, value in _PART.findall(selector):
        if tag:
            found.append(("tag", "", tag))
        elif cls:
            found.append(("word", "class", cls))
        elif elem_id:
            found.append(("=", "id", elem_id))
        else:
            found.append((op or "has", name, value))
    return found


def _check(node: Column, kind: str, name: str, values: Sequence[str]) -> Column:
    if kind == "tag":
        return node["tag"] == values[0] if len(values) == 1 else node["tag"].isin(*values)
    value = attr(node, name)
    if kind == "has":
        return value.isNotNull()
    if kind == "=":
        return value == values[0] if len(values) == 1 else value.isin(*values)
    either = "|".join(re.escape(v) for v in values)
    return value.rlike(either if kind == "*=" else rf"(?:^|{SPACE})(?:{either})(?:{SPACE}|\z)")


def selector(*selectors: str) -> Predicate:
    """A node predicate for a list of simple CSS selectors (tag, ``.class``, ``#id``, ``[attr]``, ``=``, ``*=``).

    Selectors that test the same attribute in the same way become one alternation, so a list of thirty costs a
    handful of tests per node.
    """
    single: dict[tuple[str, str], list[str]] = {}
    compound: list[list[tuple[str, str, str]]] = []
    for part in selectors:
        tests = _tests(part)
        if len(tests) == 1:
            kind, name, value = tests[0]
            single.setdefault((kind, name), []).append(value)
        else:
            compound.append(tests)

    def matches(node: Column) -> Column:
        # NULL (the attribute is absent) counts as no match wherever predicates are used.
        hits = [_check(node, kind, name, values) for (kind, name), values in single.items()]
        for tests in compound:
            hits.append(reduce(and_, [_check(node, kind, name, [value]) for kind, name, value in tests]))
        return reduce(or_, hits)

    return matches


def select(nodes: Column, *selectors: str) -> Column:
    """Matching nodes in document order."""
    return F.filter(nodes, selector(*selectors))


def first(nodes: Column, *selectors: str) -> Column:
    """First matching node, NULL if none."""
    return F.get(select(nodes, *selectors), F.lit(0))


def turns(nodes: Column, *selectors: str) -> Column:
    """For each selector in turn, its matching nodes in document order. Every selector is tested once per node."""

    def flagged(n: Column) -> Column:
        return F.struct(n.alias("node"), F.array(*[selector(s)(n) for s in selectors]).alias("is"))

    def by_turn(matched: Column) -> Column:
        chosen = lambda i: F.filter(matched, lambda x: F.get(x["is"], i))
        numbers = F.sequence(F.lit(0), F.lit(len(selectors) - 1))
        return F.transform(numbers, lambda i: F.transform(chosen(i), lambda x: x["node"]))

    return let(F.filter(F.transform(nodes, flagged), lambda x: F.array_contains(x["is"], True)), by_turn)


def first_value(values: Column) -> Column:
    """First element that is not NULL; NULL if there is none."""
    return F.get(F.array_compact(values), F.lit(0))


def first_of_each(nodes: Column, selectors: Sequence[str], value: Callable[[Column], Column]) -> Column:
    """``value`` of the first match of each selector in turn; the first that is not NULL."""
    return first_value(F.transform(turns(nodes, *selectors), lambda found: value(F.get(found, F.lit(0)))))


def inside(nodes: Column, node: Column) -> Column:
    """Descendants of ``node``: a slice, because the array is in document order."""
    return let(node, lambda n: F.slice(nodes, n["pre"] + 2, n["pre_end"] - n["pre"]))


def node_text(text: Column, node: Column) -> Column:
    """Text of the subtree."""
    return let(node, lambda n: F.array_join(F.slice(text, n["t0"] + 1, n["t1"] - n["t0"]), ""))


def parent(nodes: Column, node: Column) -> Column:
    """Parent node, NULL for the root."""
    return F.get(nodes, node["parent"])


def later_siblings(nodes: Column, node: Column) -> Column:
    """Siblings after ``node``, in order."""
    def of(node: Column) -> Column:
        count = F.greatest(parent(nodes, node)["pre_end"] - node["pre_end"], F.lit(0))
        return F.filter(F.slice(nodes, node["pre_end"] + 2, count), lambda n: n["parent"] == node["parent"])

    return let(node, of)


def meta(nodes: Column, *selectors: str) -> Column:
    """``content`` of the first element matching ONE selector, for the first selector in the list that has one."""
    return F.coalesce(*[first(nodes, s)["attrs"]["content"] for s in selectors])


def text_or_null(text: Column, node: Column) -> Column:
    """Trimmed subtree text, NULL when empty or when there is no node."""
    return not_blank(trim(node_text(text, node)))


# ── removed subtrees ──────────────────────────────────────────────────────────


def outermost(nodes: Column, *selectors: str) -> Column:
    """Matching nodes that lie in no other matching node, as ``(pre, pre_end, t0, t1)`` ranges in document order.

    Every node is tested once; a match then looks at its ancestors only, so the cost follows the page, not its square.
    """

    def of(flags: Column) -> Column:
        def covered(n: Column) -> Column:
            start = F.struct(n["parent"].alias("at"), F.lit(False).alias("hit"))
            up = lambda acc, _: F.struct(
                F.coalesce(F.get(nodes, acc["at"])["parent"], F.lit(-1)).alias("at"),
                (acc["hit"] | F.coalesce(F.get(flags, acc["at"]) & (F.get(nodes, acc["at"])["pre_end"] >= n["pre"]), F.lit(False))).alias("hit"),
            )
            return F.aggregate(F.sequence(F.lit(0), n["depth"]), start, up, lambda acc: acc["hit"])

        outer = F.filter(nodes, lambda n: F.get(flags, n["pre"]) & ~covered(n))
        return F.transform(outer, lambda n: F.struct(n["pre"], n["pre_end"], n["t0"], n["t1"]))

    return let(F.transform(nodes, lambda n: F.coalesce(selector(*selectors)(n), F.lit(False))), of)


def ranges_upto(ranges: Column, pre: Column) -> Column:
    """How many of the ordered ranges begin at ``pre`` or before, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ranges) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(ranges).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.get(ranges, middle)["pre"] <= pre
        low = F.when((acc["low"] < acc["high"]) & before, middle + 1).otherwise(acc["low"])
        high = F.when((acc["low"] < acc["high"]) & ~before, middle).otherwise(acc["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(steps, start, halve, lambda acc: acc["low"])


def within(ranges: Column, node: Column) -> Column:
    """Whether the node lies in one of the ordered, separate ranges."""
    return let(node, lambda n: F.coalesce(n["pre"] <= F.get(ranges, ranges_upto(ranges, n["pre"]) - 1)["pre_end"], F.lit(False)))


def without(nodes: Column, ranges: Column) -> Column:
    """Nodes outside the removed ranges: the slices between them, put together."""
    starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["pre_end"] + 1))
    ends = F.concat(F.transform(ranges, lambda r: r["pre"]), F.array(F.size(nodes)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(nodes, s + 1, e - s)))


def kept_text(text: Column, ranges: Column, node: Column) -> Column:
    """Subtree text with the removed ranges cut out; NULL when there is no node."""
    return let(node, lambda n: _kept_text(text, ranges, n))


def _kept_text(text: Column, ranges: Column, node: Column) -> Column:
    def inner(first: Column) -> Column:
        return F.slice(ranges, first + 1, F.greatest(ranges_upto(ranges, node["pre_end"]) - first, F.lit(0)))

    return let(let(ranges_upto(ranges, node["pre"]), inner), lambda w: _cut(text, node, w))


def _cut(text: Column, node: Column, inner: Column) -> Column:
    starts = F.concat(F.array(node["t0"]), F.transform(inner, lambda r: r["t1"]))
    ends = F.concat(F.transform(inner, lambda r: r["t0"]), F.array(node["t1"]))
    pieces = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(text, s + 1, F.greatest(e - s, F.lit(0)))))
    return F.when(node.isNotNull(), F.array_join(pieces, ""))


def by_position(ranges: Column, size: Column, low: Callable[[Column], Column], high: Callable[[Column], Column], keep, drop) -> Column:
    """An array over positions 0 to ``size``: ``keep(start, count)`` between the ordered ranges, ``drop(count)`` inside them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(ranges, high))
    ends = F.concat(F.transform(ranges, low), F.array(size))
    kept = F.zip_with(starts, ends, lambda s, e: keep(s, F.greatest(e - s, F.lit(0))))
    dropped = F.concat(F.transform(ranges, lambda r: drop(high(r) - low(r))), F.array(drop(F.lit(0))))
    return F.flatten(F.zip_with(kept, dropped, lambda k, d: F.concat(k, d)))


def removed_flags(nodes: Column, ranges: Column) -> Column:
    """For each node, by its ``pre``, whether it lies in a removed range: one look-up instead of a search."""
    flag = lambda value: lambda *args: F.array_repeat(F.lit(value), args[-1])
    return by_position(ranges, F.size(nodes), lambda r: r["pre"], lambda r: r["pre_end"] + 1, flag(False), flag(True))


def kept_runs(text: Column, ranges: Column) -> Column:
    """The text runs with those in removed ranges made empty, in their places, so that a slice is the kept text of a subtree."""
    return by_position(ranges, F.size(text), lambda r: r["t0"], lambda r: r["t1"], lambda s, n: F.slice(text, s + 1, n), lambda n: F.array_repeat(F.lit(""), n))


def run_text(runs: Column, node: Column) -> Column:
    """Text of the subtree of ``node``, which is a variable or a field: :func:`node_text` without binding it."""
    return F.array_join(F.slice(runs, node["t0"] + 1, node["t1"] - node["t0"]), "")

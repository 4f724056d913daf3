"""The DOM job: HTML text to one row per page with its element tree.

A page becomes ``(page_id, url, text, nodes)``. ``text`` holds the document's runs of text between tags, in order.
``nodes`` holds the elements in document order, so a node's ``pre`` is its array index, its subtree is the slice up to
``pre_end``, its text is the runs ``t0`` to ``t1`` put together, ``chars`` long: no node rescans the page. Everything downstream navigates that array with built-in array functions: there is no
join, no window and no shuffle until entity names leave their page.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("pre", "pre_end", "parent", "depth")]
    + [T.StructField(n, T.StringType()) for n in ("tag", "cls", "elem_id", "role")]
    + [T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("t0", "t1", "chars")]
)

# Fixed values of the HTML standard: element groups that decide where elements close.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
DECODED_RAW = frozenset(("title", "textarea"))
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr li dd dt main menu nav ol p pre listing search section summary table ul xmp plaintext".split()
)
SPECIAL = CLOSES_P | frozenset(
    "applet area base body br button caption col colgroup embed frame frameset head html iframe img input link "
    "marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot "
    "th thead title tr track wbr".split()
)
SCOPE_END = frozenset("applet caption html table td th marquee object template".split())
MARKERS = frozenset("applet marquee object template td th caption".split())
TABLE_PARTS = {
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ATTR_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)")


class _Tree:
    """Element columns of one page under construction."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.chars: list[int] = []
        self.text: list[str] = []
        self.size = 0
        self.stack: list[int] = []
        self.opened: Counter[str] = Counter()  # open elements by tag: a search for an absent tag need not walk the stack
        self.active: list[int | None] = []  # formatting elements to re-open; None is a marker
        self.in_body = False

    def open(self, tag: str, attrs: dict[str, str]) -> int:
        pre = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.depth.append(self.depth[self.stack[-1]] + 1 if self.stack else 0)
        self.end.append(-1)
        self.t0.append(len(self.text))
        self.t1.append(-1)
        self.chars.append(-self.size)
        self.stack.append(pre)
        self.opened[tag] += 1
        return pre

    def pop(self) -> int:
        pre = self.stack.pop()
        self.opened[self.tag[pre]] -= 1
        if self.end[pre] < 0:
            self.close(pre)
        if self.tag[pre] in MARKERS:
            while self.active and self.active.pop() is not None:
                pass
        return pre

    def close(self, pre: int) -> None:
        self.end[pre], self.t1[pre] = len(self.tag) - 1, len(self.text)
        self.chars[pre] += self.size

    def pop_to(self, tags, stop=SCOPE_END) -> bool:
        """Close up to and including the nearest of ``tags``, if it is in scope."""
        if not any(self.opened[t] for t in tags):
            return False
        for at in range(len(self.stack) - 1, 1, -1):
            name = self.tag[self.stack[at]]
            if name in tags:
                while len(self.stack) > at:
                    self.pop()
                return True
            if name in stop:
                return False
        return False

    def add_text(self, data: str) -> None:
        self.text.append(data)
        self.size += len(data)

    def enter_body(self) -> None:
        if not self.in_body:
            self.pop()  # head
            self.open("body", {})
            self.in_body = True

    def reopen(self) -> None:
        """Re-open formatting elements that were closed by a block, in order."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.end[self.active[at - 1]] >= 0:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            self.active[i] = self.open(self.tag[old], self.attrs[old])

    def close_formatting(self, tag: str) -> None:
        for at in range(len(self.active) - 1, -1, -1):
            pre = self.active[at]
            if pre is None:
                break
            if self.tag[pre] == tag:
                del self.active[at]
                if self.end[pre] >= 0:
                    return
                depth = self.stack.index(pre)
                if any(self.tag[p] in SPECIAL for p in self.stack[depth + 1 :]):
                    # A block is still open inside: end the element here and leave the block open.
                    self.close(pre)
                    self.opened[tag] -= 1
                    del self.stack[depth]
                else:
                    while len(self.stack) > depth:
                        self.pop()
                return
        self.close_other(tag)

    def close_other(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        for at in range(len(self.stack) - 1, 1, -1):
            name = self.tag[self.stack[at]]
            if name == tag:
                while len(self.stack) > at:
                    self.pop()
                return
            if name in SPECIAL:
                return

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if not self.in_body and tag not in IN_HEAD:
            self.enter_body()
        if self.in_body:
            self._make_room(tag)
        pre = self.open(tag, attrs)
        if tag in VOID:
            self.pop()
        elif tag in MARKERS:
            self.active.append(None)
        elif tag in FORMATTING and self.in_body:
            self._remember(pre)

    def _make_room(self, tag: str) -> None:
        """Close what ``tag`` implies closed, then re-open formatting where the content is inline."""
        if tag in CLOSES_P:
            self.pop_to(("p",), SCOPE_END | {"button"})
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self.pop()
        elif tag == "li":
            self.pop_to(("li",), SPECIAL - {"address", "div", "p", "li"})
        elif tag in ("dd", "dt"):
            self.pop_to(("dd", "dt"), SPECIAL - {"address", "div", "p", "dd", "dt"})
        elif tag in TABLE_PARTS:
            while self.pop_to(TABLE_PARTS[tag], {"table", "html", "template"}):
                pass
        elif tag in ("option", "optgroup") and self.tag[self.stack[-1]] == "option":
            self.pop()
        elif tag == "button":
            self.pop_to(("button",))
        elif tag == "a" and any(p is not None and self.tag[p] == "a" for p in self.active):
            self.close_formatting("a")
        if tag not in SPECIAL or tag in ("br", "img", "input", "embed", "area", "wbr", "button", "select", "object"):
            self.reopen()

    def _remember(self, pre: int) -> None:
        same = []
        for at in range(len(self.active) - 1, -1, -1):
            other = self.active[at]
            if other is None:
                break
            if self.tag[other] == self.tag[pre] and self.attrs[other] == self.attrs[pre]:
                same.append(at)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(pre)

    def stop(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if not self.in_body:
            self.pop_to((tag,))
        elif tag == "p":
            if not self.pop_to(("p",), SCOPE_END | {"button"}):
                self.open("p", {})
                self.pop()
        elif tag == "br":
            self.start("br", {})
        elif tag in HEADINGS:
            self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.close_formatting(tag)
        elif tag in TABLE_PARTS or tag == "table":
            self.pop_to((tag,), {"html", "template"} if tag == "table" else {"table", "html", "template"})
        elif tag in SPECIAL:
            self.pop_to((tag,))
        else:
            self.close_other(tag)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        if "&" in value:
            value = _ATTR_REF.sub(lambda m: _html.unescape(m.group()), value)
        found.setdefault(name.lower(), value)
    return found


def _merge(tree: _Tree, pre: int, attrs: dict[str, str]) -> None:
    for name, value in attrs.items():
        tree.attrs[pre].setdefault(name, value)


def parse_html(source: str) -> _Tree:
    """Element tree of one page: HTML rules for implied, void, raw-text and formatting elements.

    Not covered: moving stray content out of tables, and splitting a formatting element that ends inside a block.
    """
    tree = _Tree()
    tree.open("html", {})
    tree.open("head", {})
    at, size = 0, len(source)

    def text(upto: int) -> None:
        data = source[at:upto]
        if not data or (not tree.in_body and not data.strip()):
            return
        tree.enter_body()
        tree.reopen()
        tree.add_text(_html.unescape(data) if "&" in data else data)

    while at < size:
        token = _TOKEN.search(source, at)
        if token is None:
            text(size)
            break
        if token.start() > at:
            text(token.start())
        at = token.end()
        name = token.group(2)
        if name is None:
            continue
        name = name.lower()
        if token.group(1):
            tree.stop(name)
            continue
        raw_attrs = token.group(3)
        attrs = _attributes(raw_attrs) if raw_attrs and not raw_attrs.isspace() else {}
        if name == "html":
            _merge(tree, 0, attrs)
        elif name == "body":
            tree.enter_body()
            _merge(tree, tree.stack[1], attrs)
        elif name == "head":
            _merge(tree, 1, attrs)
        elif name in RAW:
            tree.start(name, attrs)
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            stop = closing.start() if closing else size
            data = source[at:stop]
            tree.add_text(_html.unescape(data) if name in DECODED_RAW and "&" in data else data)
            tree.pop()
            at = closing.end() if closing else size
        else:
            tree.start(name, attrs)
    tree.enter_body()
    while tree.stack:
        tree.pop()
    return tree


_FAST = ("class", "id", "role")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow in, Arrow out: columns are built flat, so no per-node Python object crosses the boundary."""
    ints, strings = pa.int32(), pa.string()
    for batch in batches:
        texts: list[list[str]] = []
        offsets = [0]
        cols: dict[str, list] = {name: [] for name in NODE.names}
        for source in batch.column(batch.schema.get_field_index("html")).to_pylist():
            tree = parse_html(source or "")
            count = len(tree.tag)
            texts.append(tree.text)
            offsets.append(offsets[-1] + count)
            cols["pre"].extend(range(count))
            cols["pre_end"].extend(tree.end)
            cols["parent"].extend(tree.parent)
            cols["depth"].extend(tree.depth)
            cols["tag"].extend(tree.tag)
            cols["t0"].extend(tree.t0)
            cols["t1"].extend(tree.t1)
            cols["chars"].extend(tree.chars)
            for attrs in tree.attrs:
                cols["cls"].append(attrs.get("class"))
                cols["elem_id"].append(attrs.get("id"))
                cols["role"].append(attrs.get("role"))
                cols["attrs"].append([(k, v) for k, v in attrs.items() if k not in _FAST])
        kinds = {f.name: ints if isinstance(f.dataType, T.IntegerType) else strings for f in NODE.fields}
        kinds["attrs"] = pa.map_(strings, strings)
        fields = [pa.array(cols[n], kinds[n]) for n in NODE.names]
        nodes = pa.ListArray.from_arrays(
            pa.array(offsets, ints), pa.StructArray.from_arrays(fields, fields=[pa.field(n, kinds[n]) for n in NODE.names])
        )
        keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "html"]
        names = [f.name for f in batch.schema if f.name != "html"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.list_(strings)), nodes], names=[*names, "text", "nodes"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, …)`` to ``(page_id, url, …, text, nodes)``; each page is parsed once."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType([*kept, T.StructField("text", T.ArrayType(T.StringType())), T.StructField("nodes", T.ArrayType(NODE))])
    return pages.select(*[F.col(f.name) for f in kept], "html").mapInArrow(_parse_batches, schema)


def dom_nodes(parsed: DataFrame) -> DataFrame:
    """The tree as rows: one per element, with the text of its subtree."""
    body = F.array_join(F.slice("text", F.col("n.t0") + 1, F.col("n.t1") - F.col("n.t0")), "")
    return parsed.select("page_id", "text", F.explode("nodes").alias("n")).select("page_id", "n.*", body.alias("text"))

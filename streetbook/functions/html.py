"""Page trees: one Arrow function turns markup into arrays, everything after it is column work inside the row.

``page_tree(html)`` gives ``struct<texts, nodes, menu>``; ``menu`` holds the sections of an embedded menu as JSON texts. ``nodes`` lists the elements in document order; a node's
descendants are the next ``last - id`` entries, and its text is ``texts[t0:t1]``. A page stays one row, so selecting
and nesting need no shuffle.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetbook.functions.expr import col, let, squeeze, trim_all

# The parser travels to the executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the HTML standard: elements without content, and elements that a new one closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
SAME_LEVEL = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
RAW_TEXT = frozenset(("script", "style"))
EMBEDDED_MENU = re.compile(r'"menu":\s*(\{.*?\}),\s*"', re.ASCII)
#: Markup that is parsed at once; the trees of a piece are handed on before the next one is read.
PIECE_BYTES = 1 << 19
ATTRIBUTES = {"class": "cls", "itemprop": "prop", "content": "content", "href": "href", "data-testid": "testid"}


# Markup that the pattern scanner takes: a text, then an end tag, a start tag of plain names and values, a document type or a
# comment. It is a part of what the library's parser takes, read to the same effect; possessive, so a text is looked at once.
_ATTRIBUTE = r"""[ \t\n\r\f]++([a-zA-Z_][-a-zA-Z0-9_:.]*+)(?:="([^"]*+)"|='([^']*+)'|=([^\s"'<>=`/]++)(?!/))?+"""
_TOKEN = re.compile(
    r"([^<]*+)<(?:/([a-zA-Z][-.a-zA-Z0-9:_]*+)>|([a-zA-Z][a-zA-Z0-9]*+(?:"
    + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE)
    + r")*+)[ \t\n\r\f]*+(/?+)>|![dD][oO][cC][tT][yY][pP][eE][^>]*+>|!--(?!-?>)[^-]*+(?:-(?!-)[^-]*+)*+-->)"
)
_ATTRIBUTE = re.compile(_ATTRIBUTE)
_RAW = re.compile(r"</\s*(?:script|style)", re.IGNORECASE)
#: Start tags whose attributes a worker remembers, and the characters of the longest of them.
KNOWN_TAGS, KNOWN_CHARACTERS = 4096, 256


class _Trees:
    """Nodes and text pieces of several pages, a list for each kind of value; places count from the first page."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.last: list[int] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.texts: list[str] = []
        self.ends: list[tuple[int, int]] = [(0, 0)]
        self.menus: list[list[dict] | None] = []
        self.missing: list[bool] = []
        self.open: list[int] = []
        self.opened: Counter[str] = Counter()

    def add(self, html: str | None) -> None:
        """One page more; a null page has an empty tree that is marked as missing."""
        if html is not None:
            read = self.scan(html)
            if read < len(html):
                rest = _Rest(self)
                rest.feed(html[read:])
                rest.close()
            while self.open:
                self.close_top()
        found = EMBEDDED_MENU.search(html or "")
        self.menus.append(_entries(found[1]) if found else None)
        self.missing.append(html is None)
        self.ends.append((len(self.rows), len(self.texts)))

    def scan(self, html: str) -> int:
        """Reads plain markup; the place from which on the library's parser has to read, or the end."""
        at, match, texts = 0, _TOKEN.match, self.texts
        while token := match(html, at):
            text, end, head, slash = token.groups()
            row, raw = (_known.get(head) or _start(head)) if head else None, None
            if row and row[0] in RAW_TEXT and not slash:
                raw, close = _RAW.search(html, token.end()), f"</{row[0]}>"
                if not raw or html[raw.start() : raw.start() + len(close)].lower() != close:
                    return at
            if text:
                texts.append(unescape(text) if "&" in text else text)
            at = token.end()
            if end:
                self.end(end.lower())
            elif row:
                self.start(row)
                if slash:
                    self.startend(row[0])
                elif raw:
                    self.end(row[0])
                    at = raw.start() + len(close)
        if at < len(html) and html.find("<", at) < 0:
            texts.append(unescape(html[at:]))
            at = len(html)
        return at

    def close_top(self) -> None:
        at = self.open.pop()
        self.opened[self.rows[at][0]] -= 1
        self.last[at] = len(self.rows) - 1
        self.t1[at] = len(self.texts)

    def start(self, row: tuple) -> None:
        """``row``: tag, cls, prop, content, href, src, testid."""
        tag = row[0]
        if (ends := _ENDS.get(tag)) is not None:
            while self.open and self.rows[self.open[-1]][0] in ends:
                self.close_top()
        at, begin = len(self.rows), len(self.texts)
        self.rows.append(row)
        self.last.append(at)
        self.t0.append(begin)
        self.t1.append(begin)
        if tag not in VOID:
            self.open.append(at)
            self.opened[tag] += 1

    def startend(self, tag: str) -> None:
        if tag not in VOID:
            self.close_top()

    def end(self, tag: str) -> None:
        if self.opened[tag]:
            while self.rows[self.open[-1]][0] != tag:
                self.close_top()
            self.close_top()

    def array(self) -> pa.Array:
        """The pages' trees; places count from each page's own beginning."""
        ends, pieces = np.array(self.ends, dtype=np.int32).T
        base, first = (np.repeat(x[:-1], np.diff(ends)) for x in (ends, pieces))
        numbers = {"id": np.arange(len(self.rows), dtype=np.int32) - base, "last": np.array(self.last, dtype=np.int32) - base}
        numbers |= {"t0": np.array(self.t0, dtype=np.int32) - first, "t1": np.array(self.t1, dtype=np.int32) - first}
        named = dict(zip(_ROW, zip(*self.rows))) if self.rows else dict.fromkeys(_ROW, ())
        columns = [pa.array((numbers | named)[name], _ARROW[kind]) for name, kind in _NODE]
        items = pa.StructArray.from_arrays(columns, fields=list(_TREE.field("nodes").type.value_type))
        texts, nodes = pa.array(self.texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends), items)
        parts = [pa.ListArray.from_arrays(pa.array(pieces), texts), nodes, pa.array(self.menus, _PAIRS)]
        return pa.StructArray.from_arrays(parts, fields=list(_TREE), mask=pa.array(self.missing, pa.bool_()))


class _Rest(HTMLParser):
    """The library's parser, for markup that the scanner does not take."""

    def __init__(self, trees: _Trees) -> None:
        super().__init__(convert_charrefs=True)
        self.trees = trees

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` begins a comment up to the next ``>``, as in browsers; the base class raises on unknown sections."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.trees.start(_row(tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.trees.startend(tag)

    def handle_endtag(self, tag: str) -> None:
        self.trees.end(tag)

    def handle_data(self, data: str) -> None:
        trees = self.trees
        if not trees.open or trees.rows[trees.open[-1]][0] not in RAW_TEXT:
            trees.texts.append(data)


_ROW = ("tag", "cls", "prop", "content", "href", "src", "testid")
_ENDS = {tag: SAME_LEVEL.get(tag, set()) | ({"p"} if tag in BLOCK else set()) for tag in {*SAME_LEVEL, *BLOCK}}
_NAME = re.compile(r"[a-zA-Z0-9]+")
_known: dict[str, tuple] = {}


def _row(tag: str, attrs: list) -> tuple:
    seen = dict(reversed(attrs))
    node = {name: seen.get(attr) for attr, name in ATTRIBUTES.items()}
    if node["cls"]:
        node["cls"] = " ".join(node["cls"].split())
    src = seen["src"] if seen.get("src") is not None else seen.get("data-src")
    return tag, node["cls"], node["prop"], node["content"], node["href"], src, node["testid"]


def _start(head: str) -> tuple:
    """The row of a start tag, from its name and attributes as written."""
    if (row := _known.get(head)) is None:
        attrs = [(m[1].lower(), unescape(m[m.lastindex]) if m.lastindex > 1 else None) for m in _ATTRIBUTE.finditer(head)]
        row = _row(_NAME.match(head)[0].lower(), attrs)
        if len(head) <= KNOWN_CHARACTERS:
            if len(_known) >= KNOWN_TAGS:
                _known.clear()
            _known[head] = row
    return row


def _entries(text: str) -> list[dict] | None:
    """Keys of a JSON object, each with the text of its last value; null if it is no such object."""
    decoder, out = json.JSONDecoder(), {}
    try:
        i = _skip(text, 0, "{")
        while text[i] != "}":
            key, i = decoder.raw_decode(text, i)
            start = _skip(text, _skip(text, i, ""), ":")
            _, i = decoder.raw_decode(text, start)
            out[key] = text[start:i]
            i = _skip(text, i, "")
            if text[i] != "}":
                i = _skip(text, i, ",")
    except (ValueError, IndexError):
        return None
    return [{"key": k, "value": v} for k, v in out.items()] if all(isinstance(k, str) for k in out) else None


def _skip(text: str, i: int, mark: str) -> int:
    """The place after white space, ``mark`` and more white space."""
    while text[i].isspace():
        i += 1
    if not text.startswith(mark, i):
        raise ValueError(mark)
    i += len(mark)
    while mark and text[i].isspace():
        i += 1
    return i


def _parse(html: str | None) -> dict | None:
    """The tree of one page."""
    trees = _Trees()
    trees.add(html)
    return trees.array()[0].as_py()


_NODE = [("id", "int"), ("last", "int")]
_NODE += [(name, "string") for name in ("tag", "cls", "prop", "content", "href", "src", "testid")]
_NODE += [("t0", "int"), ("t1", "int")]

_ARROW = {"int": pa.int32(), "string": pa.string()}
_SPARK = {"int": T.IntegerType(), "string": T.StringType()}
_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_TREE = pa.struct(
    [("texts", pa.list_(pa.string())), ("nodes", pa.list_(pa.struct([(n, _ARROW[k]) for n, k in _NODE]))), ("menu", _PAIRS)]
)
TREE_TYPE = T.StructType(
    [
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(n, _SPARK[k]) for n, k in _NODE]))),
        T.StructField("menu", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("key", "value")]))),
    ]
)


def _pieces(html: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of up to ``PIECE_BYTES`` of markup, or of one larger page."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(html).to_pylist()):
        if i > start and size + (n or 0) > PIECE_BYTES:
            yield html.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield html.slice(start)


def _parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Trees of one slice at a time: a tree takes many times its markup, so those of a whole batch would not fit a worker."""
    for html in batches:
        for piece in _pieces(html):
            trees = _Trees()
            for page in piece.to_pylist():
                trees.add(page)
            yield trees.array()


# Not marked as repeatable, so that the optimizer parses a page once and not once more for each filter on its tree.
_page_tree = F.arrow_udf(_parse_batches, TREE_TYPE).asNondeterministic()


def page_tree(html: Column | str) -> Column:
    return _page_tree(col(html))


def has_class(node: Column, name: str) -> Column:
    """The class attribute holds the whole word ``name``. Most nodes lack even its letters, so few are joined with blanks."""
    return class_like(node, name) & F.contains(F.concat(F.lit(" "), node["cls"], F.lit(" ")), F.lit(f" {name} "))


def class_like(node: Column, part: str) -> Column:
    """The class attribute holds ``part`` anywhere."""
    return F.coalesce(F.contains(node["cls"], F.lit(part)), F.lit(False))


def inside(tree: Column, node: Column) -> Column:
    """Descendants of a node, in document order."""
    return let(node, lambda n: F.slice(tree["nodes"], n["id"] + 2, n["last"] - n["id"]))


def find(nodes: Column, test) -> Column:
    return F.filter(nodes, test)


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def last(nodes: Column) -> Column:
    return F.try_element_at(nodes, F.lit(-1))


def raw_text(tree: Column, node: Column) -> Column:
    """Text of a node and its descendants as written; null for a missing node. The node is bound, so it is looked for once."""

    def joined(n: Column) -> Column:
        pieces = F.slice(tree["texts"], n["t0"] + 1, n["t1"] - n["t0"])
        return F.when(n.isNotNull(), F.array_join(pieces, ""))

    return let(node, joined)


def trimmed_text(tree: Column, node: Column) -> Column:
    return trim_all(raw_text(tree, node))


def text(tree: Column, node: Column) -> Column:
    """Text of a node with white space squeezed."""
    return squeeze(raw_text(tree, node))


def _by_key(items: Column, key, build) -> Column:
    """``build(keys)`` over ``struct<key, at>`` of the items that have a key, sorted: equal keys stand together."""
    keys = F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at")))
    return let(F.sort_array(F.filter(keys, lambda k: k["key"].isNotNull())), build)


def _ends(keys: Column, step: int) -> Column:
    """The first (``step`` -1) or last (1) place of each key."""
    return F.filter(keys, lambda k, i: ~k["key"].eqNullSafe(F.get(keys, i + step)["key"]))


def keep_first(items: Column, key) -> Column:
    """Items whose key has not come before."""
    places = lambda keys: F.sort_array(F.transform(_ends(keys, -1), lambda k: k["at"]))
    return let(items, lambda xs: F.transform(_by_key(xs, key, places), lambda at: F.get(xs, at)))


def keyed(items: Column, key) -> Column:
    """One item per key, at the place of the key's first item with the value of its last."""

    def places(keys: Column) -> Column:
        pair = lambda a, b: F.struct(a["at"].alias("first"), b["at"].alias("last"))
        return F.sort_array(F.zip_with(_ends(keys, -1), _ends(keys, 1), pair))

    return let(items, lambda xs: F.transform(_by_key(xs, key, places), lambda p: F.get(xs, p["last"])))

"""Pages to page trees: one row in, one row out, no shuffle.

Each page becomes ``texts`` and ``markup`` (its text and its serialised markup,
in document order, cut into pieces) and ``nodes``, one struct per element in
document order.  ``nodes[i].id == i``; node 0 is the document itself.  The
subtree of ``n`` is the id range ``(n.id, n.last]`` and its text is
``texts[n.t0:n.t1]``, so containment is an integer comparison and nested
elements repeat no text.

The tree follows the HTML standard's rules for implied and auto-closed
elements, raw text, entities, table sections and formatting elements that are
re-opened in the next block.  Not covered: foster parenting, and moving a block
out of a formatting element that is closed inside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.cols import join_span

NODE_MEMBERS = {
    **dict.fromkeys(("id", "parent", "last", "depth", "idx", "prev", "kids"), "int"),
    "tag": "string",
    "classes": "array<string>",
    "attrs": "map<string,string>",
    **dict.fromkeys(("t0", "t1", "h0", "h1"), "int"),
}
TREE_COLUMNS = ("texts", "markup", "nodes")
# characters of html from which trees are handed over; a tree takes some fifty bytes of memory for each
CHUNK_CHARS = 500_000

# ---- fixed values: element classes of the HTML standard ------------------
VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HEAD_ONLY = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext "
    "pre search section summary ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL_ELEMENTS = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption "
    "center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link "
    "listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre "
    "script search section select source style summary table tbody td template textarea tfoot th "
    "thead title tr track ul wbr xmp".split()
)
SCOPE_WALLS = frozenset("applet caption html table td th marquee object template".split())
BUTTON_WALLS = SCOPE_WALLS | {"button"}
LIST_WALLS = SCOPE_WALLS | {"ol", "ul"}
TABLE_WALLS = frozenset(("html", "table", "template"))
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
MARKER_ELEMENTS = frozenset("applet marquee object td th caption template".split())
NO_REOPEN = CLOSES_P | HEAD_ONLY | frozenset("table param source track".split())
# Where a table part may sit, and what is implied when the parent is missing.
TABLE_PARENTS = {
    "caption": ("table",),
    "colgroup": ("table",),
    "tbody": ("table",),
    "thead": ("table",),
    "tfoot": ("table",),
    "col": ("colgroup", "table"),
    "tr": ("tbody", "thead", "tfoot", "table"),
    "td": ("tr", "tbody", "thead", "tfoot", "table"),
    "th": ("tr", "tbody", "thead", "tfoot", "table"),
}
TABLE_IMPLIED = {
    ("col", "table"): ("colgroup",),
    ("tr", "table"): ("tbody",),
    ("td", "table"): ("tbody", "tr"),
    ("th", "table"): ("tbody", "tr"),
}
for _cell in ("td", "th"):
    for _section in ("tbody", "thead", "tfoot"):
        TABLE_IMPLIED[_cell, _section] = ("tr",)

SPACE = " \t\n\f\r"
TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|"|')*+)>"""
)
ATTRIBUTE = re.compile(
    r"""([^\s/=][^\s/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']\S*+)?))?"""
)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW_TEXT | RCDATA}
COMMENT_END = re.compile(r"--!?>")
ATTR_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*+;?)(=?)")


def _attr_entity(match: re.Match) -> str:
    body, equals = match.groups()
    if body[0] == "#" or (body in html5 and (body[-1] == ";" or not equals)):
        return unescape("&" + body) + equals
    return match.group(0)


def _read_attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        value = double or single or bare
        if "&" in value:
            value = ATTR_ENTITY.sub(_attr_entity, value)
        found.setdefault(name.lower(), value)
    return found


def _escape(text: str, quoted: bool = False) -> str:
    text = text.replace("&", "&amp;").replace(chr(160), "&nbsp;")
    if quoted:
        return text.replace('"', "&quot;")
    return text.replace("<", "&lt;").replace(">", "&gt;")


# Positions in a node's row of numbers; NEWEST is the latest child, used while building.
PARENT, LAST, DEPTH, IDX, PREV, KIDS, T0, T1, H0, H1, NEWEST = range(11)
NUMBERS = ("parent", "last", "depth", "idx", "prev", "kids", "t0", "t1", "h0", "h1")


class PageTree:
    """The flat tree of one page, built in a single pass without recursion.

    Per node: a row of numbers, a tag and an attribute dict, at index = node id.
    """

    def __init__(self, source: str, want_markup: bool) -> None:
        self.texts: list[str] = []
        self.markup: list[str] | None = [] if want_markup else None
        self.rows: list[list[int]] = [[-1, 0, 0, 0, -1, 0, 0, 0, 0, 0, -1]]
        self.tag: list[str] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.open = [0]
        # what is open, by id and by tag: most questions end here, however deep the page
        self.is_open = {0}
        self.n_open: dict[str, int] = {}
        self.active: list[tuple[str, dict[str, str], int] | None] = []
        self.head = self.body = -1
        self.after_head: list[str] = []
        self.head_closed = False
        self.quirks = True
        self.foreign = 0
        self._read(source.replace("\r\n", "\n").replace("\r", "\n") if "\r" in source else source)
        self._finish()

    # -- writing ------------------------------------------------------------
    def _open(self, tag: str, attrs: dict[str, str], void: bool = False) -> int:
        rows = self.rows
        node, parent = len(rows), self.open[-1]
        above = rows[parent]
        if self.markup is not None:
            shown = "".join(f' {k}="{_escape(v, quoted=True)}"' for k, v in attrs.items())
            self.markup.append(f"<{tag}{shown}>")
            h = len(self.markup)
        else:
            h = 0
        t = len(self.texts)
        rows.append([parent, node, above[DEPTH] + 1, above[KIDS], above[NEWEST], 0, t, t, h, h, -1])
        above[KIDS] += 1
        above[NEWEST] = node
        self.tag.append(tag)
        self.attrs.append(attrs)
        if not void:
            self.open.append(node)
            self.is_open.add(node)
            self.n_open[tag] = self.n_open.get(tag, 0) + 1
            if tag in ("svg", "math"):
                self.foreign += 1
        return node

    def _close(self) -> str:
        node = self.open.pop()
        row, tag = self.rows[node], self.tag[node]
        self.is_open.discard(node)
        self.n_open[tag] = self.n_open.get(tag, 0) - 1
        row[LAST] = len(self.rows) - 1
        row[T1] = len(self.texts)
        if self.markup is not None:
            row[H1] = len(self.markup)
            if node:
                self.markup.append(f"</{tag}>")
        if self.foreign and tag in ("svg", "math"):
            self.foreign -= 1
        return tag

    def _text(self, text: str, raw: bool = False) -> None:
        if text:
            self.texts.append(text)
            if self.markup is not None:
                self.markup.append(text if raw else _escape(text))

    # -- open elements --------------------------------------------------------
    def _in_scope(self, tags: Iterable[str], walls: frozenset[str]) -> bool:
        if not any(self.n_open.get(tag) for tag in tags):
            return False
        for node in reversed(self.open):
            tag = self.tag[node]
            if tag in tags:
                return True
            if tag in walls:
                return False
        return False

    def _close_through(self, tags: Iterable[str]) -> None:
        while True:
            tag = self._close()
            if tag in MARKER_ELEMENTS:
                while self.active and self.active.pop() is not None:
                    pass
            if tag in tags:
                return

    def _close_p(self) -> None:
        if self._in_scope(("p",), BUTTON_WALLS):
            self._close_through(("p",))

    def _reopen_formatting(self) -> None:
        """Open again the formatting elements whose block was closed around them."""
        if not self.active or self.active[-1] is None or self.active[-1][2] in self.is_open:
            return
        on_stack = self.is_open
        first = len(self.active)
        while first and self.active[first - 1] is not None and self.active[first - 1][2] not in on_stack:
            first -= 1
        for i in range(first, len(self.active)):
            tag, attrs, _ = self.active[i]
            self.active[i] = (tag, attrs, self._open(tag, attrs))

    def _remember_formatting(self, tag: str, attrs: dict[str, str], node: int) -> None:
        """Keep at most three equal entries since the last marker."""
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            entry = self.active[i]
            if entry is None:
                break
            if entry[0] == tag and entry[1] == attrs:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append((tag, attrs, node))

    def _drop_formatting(self, tag: str) -> None:
        """End a formatting element; blocks opened inside it stay where they are."""
        at = next(
            (
                i
                for i in range(len(self.active) - 1, -1, -1)
                if self.active[i] is None or self.active[i][0] == tag
            ),
            -1,
        )
        entry = self.active[at] if at >= 0 else None
        if entry is None:
            self._close_other(tag)
            return
        del self.active[at]
        node = entry[2]
        if node in self.is_open:
            above = self.open[self.open.index(node) + 1 :]
            if not any(self.tag[n] in SPECIAL_ELEMENTS for n in above):
                while self.open[-1] != node:
                    self._close()
                self._close()

    def _close_other(self, tag: str) -> None:
        if not self.n_open.get(tag):
            return
        for node in reversed(self.open):
            if self.tag[node] == tag:
                self._close_through((tag,))
                return
            if self.tag[node] in SPECIAL_ELEMENTS or node == 0:
                return

    # -- document frame ---------------------------------------------------------
    def _ensure_head(self, attrs: dict[str, str] | None = None) -> None:
        if len(self.tag) == 1:
            self._open("html", {})
        if self.head < 0:
            self.head = self._open("head", attrs or {})

    def _ensure_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body >= 0:
            return
        self._ensure_head()
        while len(self.open) > 2:
            self._close()
        for space in self.after_head:
            self._text(space)
        self.body = self._open("body", attrs or {})

    def _characters(self, text: str, raw: bool = False) -> None:
        if self.body < 0 and not raw:
            rest = text.lstrip(SPACE)
            space = text[: len(text) - len(rest)]
            if space and self.head >= 0:
                if self.head_closed:
                    self.after_head.append(space)
                else:
                    self._text(space)
            if not rest:
                return
            self._ensure_body()
            text = rest
        if not raw and not self.foreign:
            self._reopen_formatting()
        self._text(text, raw)

    # -- tags ---------------------------------------------------------------------
    def _start(self, tag: str, attrs: dict[str, str], self_closing: bool) -> None:
        if tag == "html":
            if len(self.tag) == 1:
                self._open("html", attrs)
            else:
                for name, value in attrs.items():
                    self.attrs[1].setdefault(name, value)
            return
        if tag == "head":
            if self.head < 0:
                self._ensure_head(attrs)
            return
        if tag == "body":
            if self.body < 0:
                self._ensure_body(attrs)
            else:
                for name, value in attrs.items():
                    self.attrs[self.body].setdefault(name, value)
            return
        if self.body < 0:
            if tag in HEAD_ONLY:
                self._ensure_head()
            else:
                self._ensure_body()
        if self.foreign:
            self._open(tag, attrs)
            if self_closing:
                self._close()
            return
        if tag == "image":
            tag = "img"
        if tag in TABLE_PARENTS:
            self._table_part(tag, attrs)
            return
        self._auto_close(tag)
        if tag not in NO_REOPEN:
            self._reopen_formatting()
        node = self._open(tag, attrs, void=tag in VOID)
        if tag in FORMATTING:
            self._remember_formatting(tag, attrs, node)
        elif tag in MARKER_ELEMENTS:
            self.active.append(None)

    def _auto_close(self, tag: str) -> None:
        if tag in ("li", "dd", "dt"):
            peers = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.open) if any(self.n_open.get(p) for p in peers) else ():
                name = self.tag[node]
                if name in peers:
                    self._close_through((name,))
                    break
                if name in SPECIAL_ELEMENTS and name not in ("address", "div", "p"):
                    break
        if tag in CLOSES_P or (tag == "table" and not self.quirks):
            self._close_p()
        top = self.tag[self.open[-1]]
        if tag in HEADINGS:
            if top in HEADINGS:
                self._close()
        elif tag == "button":
            if self._in_scope(("button",), SCOPE_WALLS):
                self._close_through(("button",))
        elif tag in ("option", "optgroup"):
            if top == "option":
                top = self._close() and self.tag[self.open[-1]]
            if tag == "optgroup" and top == "optgroup":
                self._close()
        elif tag in ("rb", "rtc", "rp", "rt"):
            if top in ("rb", "rp", "rt") or (top == "rtc" and tag in ("rb", "rtc")):
                self._close()
        elif tag == "table":
            if top in ("table", "tbody", "thead", "tfoot", "tr"):
                self._close_through(("table",))
        elif tag in ("a", "nobr"):
            if any(entry is not None and entry[0] == tag for entry in self._since_marker()):
                self._drop_formatting(tag)

    def _since_marker(self) -> Iterator[tuple[str, dict[str, str], int]]:
        for entry in reversed(self.active):
            if entry is None:
                return
            yield entry

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not self._in_scope(("table",), TABLE_WALLS):
            return
        parents = TABLE_PARENTS[tag]
        while self.tag[self.open[-1]] not in parents:
            self._close_through((self.tag[self.open[-1]],))
        for implied in TABLE_IMPLIED.get((tag, self.tag[self.open[-1]]), ()):
            self._open(implied, {})
        self._open(tag, attrs, void=tag == "col")
        if tag in MARKER_ELEMENTS:
            self.active.append(None)

    def _end(self, tag: str) -> None:
        if self.body < 0:
            if tag == "head":
                self._ensure_head()
                self.head_closed = True
                return
            if tag in ("noscript", "template") and len(self.open) > 3:
                self._close_other(tag)
                return
            if tag not in ("body", "html", "br"):
                return
            self._ensure_body()
        if tag in ("body", "html", "head"):
            return
        if tag == "br":
            self._start("br", {}, False)
        elif tag == "p":
            if not self._in_scope(("p",), BUTTON_WALLS):
                self._open("p", {})
            self._close_through(("p",))
        elif tag in FORMATTING:
            self._drop_formatting(tag)
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS, SCOPE_WALLS):
                self._close_through(HEADINGS)
        elif tag == "table" or tag in TABLE_PARENTS:
            if self._in_scope((tag,), TABLE_WALLS):
                self._close_through((tag,))
        elif tag == "li":
            if self._in_scope((tag,), LIST_WALLS):
                self._close_through((tag,))
        elif tag in CLOSES_P or tag in MARKER_ELEMENTS or tag in ("button", "select"):
            if self._in_scope((tag,), SCOPE_WALLS):
                self._close_through((tag,))
        elif tag not in VOID:
            self._close_other(tag)

    # -- reading --------------------------------------------------------------------
    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            mark = source.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                text = source[at:mark]
                self._characters(unescape(text) if "&" in text else text)
            if mark == size:
                return
            at = self._markup(source, mark)

    def _markup(self, source: str, at: int) -> int:
        """Handle the ``<`` at ``at``; returns where reading goes on."""
        match = TAG.match(source, at)
        if match:
            closing, tag, rest = match.groups()
            tag = tag.lower()
            if closing:
                self._end(tag)
                return match.end()
            self_closing = rest.endswith("/")
            self._start(tag, _read_attributes(rest) if rest else {}, self_closing)
            if self.foreign == 0 and (tag in RAW_TEXT or tag in RCDATA):
                return self._raw_text(tag, source, match.end())
            if tag in ("pre", "listing") and source.startswith("\n", match.end()):
                return match.end() + 1
            return match.end()
        follower = source[at + 1 : at + 2]
        if source.startswith("<!--", at):
            if source.startswith(("<!-->", "<!--->"), at):
                stop, body_end = source.index(">", at) + 1, at + 4
            else:
                found = COMMENT_END.search(source, at + 4)
                body_end, stop = (found.start(), found.end()) if found else (len(source),) * 2
            self._comment(source[at + 4 : body_end])
            return stop
        if follower in ("!", "?") or source.startswith("</", at):
            if source.startswith("</", at) and source[at + 2 : at + 3].isalpha():
                return len(source)
            stop = source.find(">", at)
            stop = len(source) if stop < 0 else stop
            if source[at + 2 : at + 9].lower() == "doctype":
                if source[at + 9 : stop].strip().lower().startswith("html"):
                    self.quirks = len(self.tag) > 1 and self.quirks
            elif source.startswith("<![CDATA[", at) and self.foreign:
                end = source.find("]]>", at)
                end = len(source) if end < 0 else end
                self._characters(source[at + 9 : end])
                return end + 3
            elif stop > at + 2:
                self._comment(source[at + (1 if follower == "?" else 2) : stop])
            return stop + 1
        if follower.isascii() and follower.isalpha():
            return len(source)
        self._characters("<")
        return at + 1

    def _comment(self, body: str) -> None:
        if self.markup is not None:
            self.markup.append(f"<!--{body}-->")

    def _raw_text(self, tag: str, source: str, at: int) -> int:
        end = RAW_END[tag].search(source, at)
        stop = end.start() if end else len(source)
        text = source[at:stop]
        if tag == "textarea" and text.startswith("\n"):
            text = text[1:]
        if tag in RCDATA:
            text = unescape(text) if "&" in text else text
        self._text(text, raw=tag in RAW_TEXT)
        if self.tag[self.open[-1]] == tag:
            self._close()
        if not end:
            return stop
        close = source.find(">", stop)
        return len(source) if close < 0 else close + 1

    def _finish(self) -> None:
        self._ensure_body()
        while self.open:
            self._close()


def _list_array(lengths: list[int], values: pa.Array) -> pa.Array:
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _pieces(lists: list[list[str]]) -> pa.Array:
    return _list_array([len(x) for x in lists], pa.array([p for x in lists for p in x], pa.string()))


def _class_array(trees: list[PageTree]) -> pa.Array:
    counts: list[int] = []
    classes: list[str] = []
    for tree in trees:
        for attrs in tree.attrs:
            names = attrs["class"].split() if "class" in attrs else ()
            counts.append(len(names))
            classes.extend(names)
    return _list_array(counts, pa.array(classes, pa.string()))


def _attr_array(trees: list[PageTree], keep: frozenset[str] | None) -> pa.Array:
    offsets = [0]
    names: list[str] = []
    values: list[str] = []
    for tree in trees:
        for attrs in tree.attrs:
            for name, value in attrs.items():
                if keep is None or name in keep:
                    names.append(name)
                    values.append(value)
            offsets.append(len(names))
    return pa.MapArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())
    )


def _trees_to_arrow(
    trees: list[PageTree], keep_attrs: frozenset[str] | None, members: list[str]
) -> list[pa.Array]:
    numbers = np.array([row for tree in trees for row in tree.rows], dtype=np.int32)
    arrays: list[pa.Array] = []
    for name in members:
        if name == "id":
            ids = [np.arange(len(tree.tag), dtype=np.int32) for tree in trees]
            arrays.append(pa.array(np.concatenate(ids)))
        elif name == "tag":
            arrays.append(pa.array([tag for tree in trees for tag in tree.tag], pa.string()))
        elif name == "classes":
            arrays.append(_class_array(trees))
        elif name == "attrs":
            arrays.append(_attr_array(trees, keep_attrs))
        else:
            column = numbers[:, NUMBERS.index(name)]
            arrays.append(pa.array(np.ascontiguousarray(column)))
    nodes = pa.StructArray.from_arrays(arrays, names=members)
    empty: list[str] = []
    texts = [tree.texts if "t0" in members else empty for tree in trees]
    markup = [tree.markup or empty for tree in trees]
    return [_pieces(texts), _pieces(markup), _list_array([len(t.tag) for t in trees], nodes)]


def _shredder(
    keep: list[str],
    want_markup: bool,
    keep_attrs: frozenset[str] | None,
    members: list[str],
    chunk_chars: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index("html"))
            carried = batch.select(keep)
            start, chars, trees = 0, 0, []
            for row in range(batch.num_rows):
                source = sources[row].as_py() or ""
                trees.append(PageTree(source, want_markup))
                chars += len(source)
                # hand over early so that a run of huge pages never piles up
                if chars >= chunk_chars or row == batch.num_rows - 1:
                    part = carried.slice(start, len(trees))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *_trees_to_arrow(trees, keep_attrs, members)],
                        names=[*keep, *TREE_COLUMNS],
                    )
                    start, chars, trees = row + 1, 0, []

    return run


def shred(
    pages: DataFrame,
    keep: Iterable[str] | None = None,
    markup: bool = True,
    attrs: Iterable[str] | None = None,
    members: Iterable[str] | None = None,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Page trees for a table with an ``html`` column.

    Catalyst cannot look into a Python operator, so what later steps need is said
    here: ``keep`` names the columns to carry along, ``markup=False`` drops the
    serialised form, ``attrs`` limits the attributes and ``members`` the parts of a
    node shipped to the JVM (without ``t0`` no texts are).  Filters on URLs belong
    before this call, where they reach the scan.
    """
    keep = [c for c in (keep or pages.columns) if c != "html"]
    kept = pages.select(*keep, "html")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)])
    shipped = [m for m in NODE_MEMBERS if members is None or m == "id" or m in set(members)]
    node = ",".join(f"{m}:{NODE_MEMBERS[m]}" for m in shipped)
    ddl = f"{fields}, texts array<string>, markup array<string>, nodes array<struct<{node}>>"
    wanted = None if attrs is None else frozenset(attrs)
    return kept.mapInArrow(_shredder(keep, markup, wanted, shipped, chunk_chars), ddl)


NODE_COLUMNS = ("id", "parent", "last", "depth", "idx", "tag", "classes", "attrs", "text")


def node_table(
    trees: DataFrame, keep: Iterable[str], columns: Iterable[str] = NODE_COLUMNS
) -> DataFrame:
    """The exploded form: one row per element.  Name the columns needed; text is costly."""
    texts = F.col("texts")

    def member(n: Column, name: str) -> Column:
        return join_span(texts, n.t0, n.t1) if name == "text" else n[name]

    wanted = list(columns)
    rows = F.transform(
        F.filter("nodes", lambda n: n.id > 0),
        lambda n: F.struct(*[member(n, name).alias(name) for name in wanted]),
    )
    return trees.select(*keep, F.inline(rows))

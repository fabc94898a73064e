"""XT0: shred HTML pages into an element relation (the one Python-side job).

``pages.mapInPandas(shred_batches, ELEMENT_SCHEMA)`` turns each page into one row
per element.  Everything downstream (header fields, tables, paragraphs, links,
main text) is a relational filter / join / window over this relation, so no
per-row selector engine is needed.

The parser is the standard library ``html.parser`` plus the usual implied-end
rules so malformed pages give the same tree a browser-style parser would:
void elements never open, ``p`` closes when a block element starts (within its
button scope), ``li`` closes ``li``, ``td``/``th`` close cells, ``tr`` closes
rows, ``</table>`` closes everything inside, and an end tag without an open
element is ignored.

Per element: pre-order ``seq``, ``parent``, ``depth``, ``last`` (seq of its last
descendant), ``path`` (``tag#id.class`` steps from the root), ``href``, the
the enclosing tables of a ``tr`` and rows of a ``td`` (``table_seqs``/``tr_seqs``), character offsets
``start``/``end`` of its outer HTML, and -- for text-bearing tags and elements
with an id -- its text content as a serialising parser would print it
(entities resolved, then ``& < >`` escaped).
"""
from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


# The shred runs in Python workers; ship this module's code with each task so
# workers need only pandas and the standard library, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT_SCHEMA = StructType([
    StructField("page_id", LongType()),
    StructField("seq", IntegerType()),
    StructField("parent", IntegerType()),
    StructField("depth", IntegerType()),
    StructField("last", IntegerType()),
    StructField("tag", StringType()),
    StructField("id", StringType()),
    StructField("cls", StringType()),
    StructField("path", StringType()),
    StructField("href", StringType()),
    StructField("table_seqs", ArrayType(IntegerType())),
    StructField("tr_seqs", ArrayType(IntegerType())),
    StructField("start", IntegerType()),
    StructField("end", IntegerType()),
    StructField("text", StringType()),
])

# Fixed HTML rules.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "dd",
            "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
            "section", "table", "ul"}
BUTTON_SCOPE = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template",
                "button"}
TABLE_SCOPE = {"html", "table", "template"}
LIST_SCOPE = {"ul", "ol"} | BUTTON_SCOPE
# Plain tags, which need no other rule of the parser; tags whose content it treats in its own way.
PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z]+="[^"<>&]*")*)>')
PLAIN_ATTR = re.compile(r'([a-z]+)="([^"]*)"')
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
OWN_CONTENT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp",
               "plaintext"}
TEXT_TAGS = {"p", "td", "th", "a", "li", "title", "h1", "h2", "h3", "h4", "h5", "h6", "span", "b"}


def _escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _escape_step(name: str) -> str:
    """An id or class with the characters that separate path steps written as %xx."""
    return re.sub(r"[%/.#]", lambda m: f"%{ord(m.group()):02X}", name)


def _step(tag: str, el_id: str | None, cls: str | None) -> str:
    """An element's step of a path."""
    return tag + (f"#{_escape_step(el_id)}" if el_id else "") + (
        "." + ".".join(map(_escape_step, cls.split())) if cls else "")


class _Shredder(HTMLParser):
    def __init__(self, src: str, tags: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.src = src
        self.tags = tags                    # tags whose text is wanted; all by default
        self.at = 0                         # characters read
        self.rows: list[list] = []
        self.stack: list[int] = []          # indexes into rows
        self.collect: dict[int, list[str]] = {}

    def updatepos(self, i: int, j: int) -> int:
        """Count characters instead of lines and columns."""
        if i < j:
            self.at += j - i
        return j

    def parse_starttag(self, i: int) -> int:
        """A plain tag at once; any other as the parser does."""
        m = PLAIN_START.match(self.rawdata, i)
        if m is None or m.group(1) in OWN_CONTENT:
            return super().parse_starttag(i)
        attrs = m.group(2)
        self._open(m.group(1), PLAIN_ATTR.findall(attrs) if attrs else (), m.end() - i)
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m.group(1))
        return m.end()

    def _close_top(self, at: int) -> None:
        i = self.stack.pop()
        row = self.rows[i]
        row[13] = at
        row[4] = len(self.rows) - 1
        if i in self.collect:
            row[14] = "".join(self.collect.pop(i))

    def _close_until(self, tag: str, at: int) -> None:
        while self.stack:
            top_tag = self.rows[self.stack[-1]][5]
            self._close_top(at)
            if top_tag == tag:
                return

    def _in_scope(self, tags: set[str], boundary: set[str]) -> str | None:
        for i in reversed(self.stack):
            t = self.rows[i][5]
            if t in tags:
                return t
            if t in boundary:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, len(self.get_starttag_text() or ""))

    def _open(self, tag, attrs, length: int) -> None:
        at = self.at
        if tag in CLOSES_P and self._in_scope({"p"}, BUTTON_SCOPE):
            self._close_until("p", at)
        if tag == "li" and self._in_scope({"li"}, LIST_SCOPE):
            self._close_until("li", at)
        if tag in ("td", "th", "tr") and self._in_scope({"td", "th"}, TABLE_SCOPE):
            self._close_until(self._in_scope({"td", "th"}, TABLE_SCOPE), at)
        if tag == "tr" and self._in_scope({"tr"}, TABLE_SCOPE):
            self._close_until("tr", at)
        a = dict(attrs)
        el_id, cls = a.get("id"), a.get("class")
        step = _step(tag, el_id, cls)
        parent = self.stack[-1] if self.stack else None
        ppath = self.rows[parent][8] if parent is not None else ""
        # a table's rows and a row's cells are all those inside it, nested ones too
        tables = [i for i in self.stack if self.rows[i][5] == "table"] if tag == "tr" else None
        trs = [i for i in self.stack if self.rows[i][5] == "tr"] if tag == "td" else None
        seq = len(self.rows)
        row = [None, seq, parent, len(self.stack), seq, tag, el_id, cls,
               f"{ppath}/{step}" if ppath else step, a.get("href") if tag == "a" else None,
               tables, trs, at, at + length, None]
        self.rows.append(row)
        if tag in VOID:
            return
        self.stack.append(seq)
        if (tag in TEXT_TAGS or el_id) and (self.tags is None or tag in self.tags):
            self.collect[seq] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.rows[self.stack[-1]][5] == tag:
            self._close_top(self.rows[self.stack[-1]][13])

    def handle_endtag(self, tag):
        at = self.at
        if not any(self.rows[i][5] == tag for i in self.stack):
            return
        gt = self.src.find(">", at)
        end = gt + 1 if gt >= 0 else len(self.src)
        while self.stack:
            i = self.stack[-1]
            if self.rows[i][5] == tag:
                self._close_top(end)
                return
            self._close_top(at)

    def handle_data(self, data):
        if self.collect:
            esc = _escape_text(data)
            for buf in self.collect.values():
                buf.append(esc)

    def finish(self) -> list[list]:
        self.close()
        n = len(self.src)
        while self.stack:
            self._close_top(n)
        return self.rows


#: A plain tag anywhere in a page: no references, no quotes but double ones, lower case.
PLAIN_TAG = re.compile(r'<(?:/([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?:[ \n]+[a-z]+="[^"<>&]*")*))>')
#: The same as one group, to split a page at.
PLAIN_CUT = re.compile(r'(<(?:/[a-z][a-z0-9]*|[a-z][a-z0-9]*(?:[ \n]+[a-z]+="[^"<>&]*")*)>)')
#: Tags remembered in their contexts; beyond it they are worked out anew.
CONTEXTS = 20_000


class _Context:
    """The open elements at a place of a page.  What a tag closes and opens there, and the path of
    what it opens, depend on nothing else, so they are worked out once (``moves``)."""

    __slots__ = ("up", "tag", "id", "cls", "href", "path", "depth", "tables", "trs", "kept", "text", "moves")

    def __init__(self, up: "_Context | None" = None, tag: str = "", attrs: dict | None = None):
        self.up, self.tag, self.moves = up, tag, {}
        self.depth = 0 if up is None else up.depth + 1
        self.tables = self.trs = ()         # places of the open tables and rows
        self.path = ""
        if up is None:
            return
        self.id, self.cls, self.href = attrs.get("id"), attrs.get("class"), attrs.get("href") if tag == "a" else None
        step = _step(tag, self.id, self.cls)
        self.path = f"{up.path}/{step}" if up.up is not None else step
        self.tables, self.trs = (
            (*places, up.depth - 1) if up.tag == name else places
            for name, places in (("table", up.tables), ("tr", up.trs)))

    def scoped(self, among: tuple, boundary: set[str]) -> str | None:
        """The innermost open one of some tags within a scope."""
        at = self
        while at.up is not None:
            if at.tag in among:
                return at.tag
            if at.tag in boundary:
                return None
            at = at.up
        return None

    def closed(self, tag: str) -> tuple["_Context", int]:
        """The context when an open tag is closed, and the elements that are."""
        at, n = self, 1
        while at.tag != tag:
            at, n = at.up, n + 1
        return at.up, n


class _Plain:
    """Reads pages of plain tags and plain text, as ``_Shredder`` does, in one pass over the tags.

    ``text``: tags whose text is wanted, all by default.  ``only``: tags whose rows are, with the
    number of rows inside an element as one more entry."""

    def __init__(self, text: frozenset[str] | None = None, only: frozenset[str] | None = None):
        self.text, self.only = text, only
        self.root, self.known = _Context(), 0

    def _move(self, here: _Context, token: str) -> tuple | None:
        """What a tag does: elements closed before it, whether it closes one more, the context
        after it, and that of an element it opens."""
        tag, name, attrs = PLAIN_TAG.match(token).groups()
        if tag is not None:
            at = here
            while at.up is not None and at.tag != tag:
                at = at.up
            if at.up is None:
                return 0, False, here, None
            after, n = here.closed(tag)
            return n - 1, True, after, None
        if name in OWN_CONTENT:
            return None
        n = 0
        for when, among, boundary in ((name in CLOSES_P, ("p",), BUTTON_SCOPE), (name == "li", ("li",), LIST_SCOPE),
                                      (name in ("td", "th", "tr"), ("td", "th"), TABLE_SCOPE),
                                      (name == "tr", ("tr",), TABLE_SCOPE)):
            found = here.scoped(among, boundary) if when else None
            if found is not None:
                here, more = here.closed(found)
                n += more
        new = _Context(here, name, dict(PLAIN_ATTR.findall(attrs)) if attrs else {})
        new.kept = self.only is None or name in self.only
        new.text = new.kept and bool(name in TEXT_TAGS or new.id) and (self.text is None or name in self.text)
        return n, False, here if name in VOID else new, new

    def rows(self, src: str) -> list[list] | None:
        """The elements of a page; None if it has other than plain tags and text."""
        if "&" in src:
            return None
        parts = PLAIN_CUT.split(src)
        n_tags = len(parts) // 2
        if n_tags != src.count("<"):
            return None
        escaped = src.count(">") != n_tags
        if self.known > CONTEXTS:
            self.root, self.known = _Context(), 0
        every = self.only is None
        rows: list[list] = []
        stack: list[tuple] = []             # open elements: row, where its text starts in ``texts``, seq
        texts: list[str] = []
        wanted = at = seq = 0
        here = self.root

        def close(end: int) -> None:
            nonlocal wanted
            row, mark, _ = stack.pop()
            if row is not None:
                row[13], row[4] = end, seq - 1
                if not every:
                    row[15] = len(rows) - row[15]
                if mark >= 0:
                    text = "".join(texts[mark:])
                    row[14] = text.replace(">", "&gt;") if escaped else text
                    wanted -= 1

        for i in range(1, len(parts), 2):
            before, token = parts[i - 1], parts[i]
            if before:
                at += len(before)
                if wanted:
                    texts.append(before)
            start = at
            at += len(token)
            move = here.moves.get(token)
            if move is None:
                move = self._move(here, token)
                if move is None:
                    return None
                here.moves[token] = move
                self.known += 1
            n, ends, here, new = move
            while n:
                close(start)
                n -= 1
            if ends:
                close(at)
            if new is None:
                continue
            row = None
            if new.kept:
                tag = new.tag
                row = [None, seq, stack[-1][2] if stack else None, len(stack), seq, tag, new.id, new.cls, new.path, new.href,
                       [stack[d][2] for d in new.tables] if every and tag == "tr" else None,
                       [stack[d][2] for d in new.trs] if every and tag == "td" else None, start, at, None]
                rows.append(row)
                if not every:
                    row.append(0 if here is not new else len(rows))
            if here is new:
                stack.append((row, len(texts) if new.text else -1, seq))
                wanted += new.text
            seq += 1
        if wanted and parts[-1]:
            texts.append(parts[-1])
        while stack:
            close(len(src))
        return rows


def _plain_rows(src: str, tags: frozenset[str] | None) -> list[list] | None:
    """The elements of a page of plain tags and plain text; None for any other page."""
    return _Plain(tags).rows(src)


def shred_html(page_id: int, src: str | None, tags: frozenset[str] | None = None,
               plain: _Plain | None = None) -> list[list]:
    """All elements; with ``tags`` only those have their text."""
    if src is None:
        return []
    rows = (plain or _Plain(tags)).rows(src)
    if rows is None:
        p = _Shredder(src, tags)
        p.feed(src)
        rows = p.finish()
    for r in rows:
        r[0] = page_id
    return rows


#: Pages whose elements are held at a time.
PAGES_PER_FRAME = 200


def shred_batches(batches: Iterator[pd.DataFrame], tags: frozenset[str] | None = None) -> Iterator[pd.DataFrame]:
    cols = [f.name for f in ELEMENT_SCHEMA.fields]
    plain = _Plain(tags)
    for pdf in batches:
        for at in range(0, len(pdf), PAGES_PER_FRAME):
            some = pdf.iloc[at:at + PAGES_PER_FRAME]
            out: list[list] = []
            for pid, src in zip(some["page_id"].tolist(), some["html"].tolist()):
                rows = shred_html(int(pid), src, tags, plain)
                out.extend(rows if tags is None else [r for r in rows if r[5] in tags])
            frame = pd.DataFrame(out, columns=cols)
            for c in ("seq", "parent", "depth", "last", "start", "end"):
                frame[c] = frame[c].astype("Int32")
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame


def shred(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
          tags: frozenset[str] | None = None) -> DataFrame:
    """pages(page_id, html) -> element relation (ELEMENT_SCHEMA); with ``tags`` those elements alone."""
    src = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[html_col].alias("html"))
    return src.mapInPandas(lambda batches: shred_batches(batches, tags), ELEMENT_SCHEMA)


# An element in its page's array: its place from 0, and how many of the next ones are inside it.
PLACE = [StructField("at", IntegerType()), StructField("inside", IntegerType())]
ARROW = {"int": pa.int32(), "string": pa.string()}


def _tag_rows(src: str | None, plain: _Plain) -> list[list]:
    """The rows that ``plain`` keeps of any page, with the number of rows inside an element as one
    more entry."""
    rows = [] if src is None else plain.rows(src)
    if rows is None:
        p = _Shredder(src, plain.text)
        p.feed(src)
        rows = p.finish()
        before = [0]                        # kept elements that stand before each element
        for r in rows:
            before.append(before[-1] + (r[5] in plain.only))
        rows = [[*r, before[r[4] + 1] - before[r[1] + 1]] for r in rows if r[5] in plain.only]
    return rows


def _page_elements(sources: list, plain: _Plain, fields: list[tuple[int, pa.DataType]], names: list[str]) -> pa.ListArray:
    """The elements with one of the tags of each page, in page order."""
    offsets, kept, places = [0], [], []
    for src in sources:
        rows = _tag_rows(src, plain)
        kept.extend(rows)
        places.extend(range(len(rows)))
        offsets.append(len(kept))
    arrays = [pa.array([r[i] for r in kept], kind) for i, kind in fields]
    arrays += [pa.array(places, pa.int32()), pa.array([r[15] for r in kept], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names))


def shred_pages(pages: DataFrame, tags: frozenset[str], columns: list[str], text: frozenset[str] | None = None,
                html: bool = True) -> DataFrame:
    """pages(page_id, html, ...) -> the same rows with ``els``: the elements of the page with one of
    the tags as an array of (columns..., at, inside).  A page's elements stay in its row, so what is
    taken from them needs no shuffle.  ``text``: tags whose text is wanted, by default all of ``tags``;
    without ``html`` the pages' own text is left out."""
    wanted = [ELEMENT_SCHEMA[c] for c in columns]
    order = ELEMENT_SCHEMA.names
    fields = [(order.index(f.name), ARROW[f.dataType.simpleString()]) for f in wanted]
    names = [f.name for f in (*wanted, *PLACE)]
    given = [f for f in pages.schema.fields if html or f.name != "html"]
    schema = StructType([*given, StructField("els", ArrayType(StructType([*wanted, *PLACE])))])
    others = [f.name for f in given]

    def shred_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _Plain(tags if text is None else text, tags)
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_PER_FRAME):
                some = batch.slice(at, PAGES_PER_FRAME)
                els = _page_elements(some.column("html").to_pylist(), plain, fields, names)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), els], [*others, "els"])

    return pages.mapInArrow(shred_rows, schema)

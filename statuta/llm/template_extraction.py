"""Operator 13: main text of web pages by equivalence-class template deduction.

A page is read as a sequence of tokens, each told apart by its role: the start and the end
of a block element on its path (tag, class and id names), the words of a short text run on
that path, a longer run as a whole.  A token's occurrence vector lists how often it stands
in each page of a host.  Vectors are not collected: an aggregation by host and token sums a
hash of (page, count), so tokens with equal sums share their vector.

1.  Tokens of one vector, found on enough pages of the host, form an equivalence class.
2.  A class is valid if its tokens stand in one order, over and over, on every page, and if
    its runs always begin in the same gap of the same surrounding class.  A second pass
    over the pages sends each page's order and place of every class, and an aggregation
    compares them.  The valid classes, nested in each other's gaps, are the template.
3.  What is no template token is left in slots.  Elements that a valid class has once a page
    can hold the article; the one that holds most of the words outside links and
    page furniture does, on average over the host's pages.  Its slots are the main text;
    furniture inside it (by tag, class or id name), lists of nothing but links, and
    blocks that are template text on nearly all pages are left out.

Hosts with under ``MIN_PAGES`` pages are pooled.  Pages whose template names no container
(among them odd pages of a host) choose it from their own elements by the same rule.

Blocks are split at block elements; ``br`` and white space of any kind turn into one space.

Defined cases: null html is empty and gives an empty text; a null or odd url belongs to
the host ''; a page without text gives ''; an unclosed comment or script runs to the end
of the page, an unclosed quote to the next >; repeated rows each get a row; of equal containers the deeper counts;
other columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, ship

ship(__name__)

#: Pages a host needs for a template of its own; hosts with fewer are pooled as one.
MIN_PAGES = 8
#: Least share of the group's pages, and least pages, that hold the tokens of a class.
MIN_SHARE, MIN_SUPPORT = 0.2, 3
#: Longest run whose words are tokens of their own.
SHORT_WORDS = 16
#: Least mean share of the words that a container of the main text holds.
MAIN_SHARE = 0.6
#: Share of the pages with a template text from which a block of it is left out.
FIXED_SHARE = 0.9
#: Groups and tokens a task holds before it hands its sums on.
HELD = 100_000

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img br".split())
FURNITURE_TAGS = frozenset("head nav header footer aside form menu dialog button fieldset".split()) | RAW
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promoted promotion related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
MAIN_TAGS = frozenset(("article", "main"))
#: A start tag closes open elements of the first set, up to one of the second.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
MARKED = re.compile(r"class|id|role", re.I)
#: A class or id that only says that the page has such a thing (has-sidebar, no-banner).
STATES = frozenset("has have with without no not is show hide".split())
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
MASK = (1 << 63) - 1
#: What tells an element's start and end from each other.
START, END = 0x5A, 0xA5


def hashed(*parts) -> int:
    """A 63-bit hash that is the same in every process."""
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8)
                          .digest(), "little") & MASK


_WORDS: dict[str, int] = {}
_PATHS: dict[tuple, int] = {}


def word_hash(word: str) -> int:
    """``hashed`` of a word; a bounded number of them is remembered."""
    h = _WORDS.get(word)
    if h is None:
        if len(_WORDS) >= HELD:
            _WORDS.clear()
        h = _WORDS[word] = hashed(word)
    return h


def path_hash(up: int, tag: str, names: str) -> int:
    """The path of an element by its tag and its class and id names without digits."""
    key = up, tag, names
    h = _PATHS.get(key)
    if h is None:
        if len(_PATHS) >= HELD:
            _PATHS.clear()
        h = _PATHS[key] = hashed(up, tag, *sorted(set(DIGITS.sub("", names).split())))
    return h


def is_furniture(tag: str, names: str, role: str, in_main: bool) -> bool:
    """Whether an element's tag, class and id names or role say that it is not the article."""
    if tag in ("html", "body", *MAIN_TAGS) and role not in FURNITURE_ROLES and tag not in MAIN_TAGS:
        return False
    if tag in FURNITURE_TAGS and not (tag == "header" and in_main) or role in FURNITURE_ROLES:
        return True
    for name in names.split():
        parts = NAME.findall(name)
        if not STATES.isdisjoint(parts[:1]) or in_main and parts and parts[-1] == "header":
            continue
        if not FURNITURE_NAMES.isdisjoint(parts):
            return True
    return False


class Element:
    """An open element: what its path is, whether it is furniture, and the words inside."""

    __slots__ = ("tag", "path", "depth", "furniture", "block", "listed", "words")

    def __init__(self, tag: str, path: int, depth: int, furniture: bool, block: bool, listed: int):
        self.tag, self.path, self.depth, self.furniture = tag, path, depth, furniture
        self.block, self.listed, self.words = block, listed, 0


class Page:
    """A page as a sequence of tokens and blocks.

    ``elements`` list tag, path, depth, and the words outside furniture and links; ``parents``
    the number of the block element around each; ``blocks`` list text, element number, words,
    words in links, furniture, number of the list around, first and end place in ``tokens``.
    """

    def __init__(self, html: str | None):
        self.tokens: list[int] = []
        self.elements: list[Element] = []
        self.parents: list[int] = []
        self.blocks: list[tuple] = []
        # open elements: the number of a block element, ~number of an inline one
        self._open: list[int] = []
        self._open_blocks: list[int] = []
        self._count: dict[str, int] = {}
        self._run: list[str] = []
        self._linked = 0
        self._inline_furniture: list[str] = []
        self._start("", "", "")
        self._read(html or "")
        self._flush()
        while self._open:
            self._close()

    # reading

    def _read(self, html: str) -> None:
        at, end, ends = 0, len(html), True
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            nxt = html[lt + 1:lt + 2]
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif nxt in ("!", "?"):
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
            elif nxt.isascii() and nxt.isalpha() or nxt == "/" and html[lt + 2:lt + 3].isalpha():
                m = TAG.match(html, lt) if ends else None
                if m is None:
                    stop = html.find(">", lt)
                    ends = stop >= 0
                    at = end if not ends else stop + 1
                    continue
                at = m.end()
                tag = m.group(2).lower()
                if m.group(1):
                    self._end(tag)
                    continue
                if tag == "br":
                    self._run.append(" ")
                elif tag not in VOID:
                    if tag in ("svg", "math") and m.group(3).endswith("/"):
                        continue
                    self._open_tag(tag, m.group(3))
                    if tag in RAW:
                        close = re.compile("</" + re.escape(tag) + r"(?=[\s/>]|\Z)", re.I).search(html, at)
                        if close:
                            at = close.start()
                        else:
                            return
            else:
                self._text("<")
                at = lt + 1

    def _text(self, raw: str) -> None:
        if self._inline_furniture:
            return
        text = unescape(raw) if "&" in raw else raw
        self._run.append(text)
        if self._count.get("a"):
            self._linked += len(text.split())

    def _open_tag(self, tag: str, attributes: str) -> None:
        names = role = ""
        if "=" in attributes and MARKED.search(attributes):
            for key, value in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'").lower()
                if key.lower() == "role":
                    role = value
                else:
                    names += " " + value
        if tag in INLINE:
            if self._inline_furniture or is_furniture(tag, names, role, True):
                self._inline_furniture.append(tag)
            self._count[tag] = self._count.get(tag, 0) + 1
            self._open.append(~len(self.elements))
            self.elements.append(Element(tag, 0, 0, False, False, 0))
            self.parents.append(0)
            return
        self._flush()
        if self._count.get("p"):
            self._close_to({"p"}, {"table", "td", "th", "button", "object", "article", "section", "div", "blockquote",
                                   "li", "body"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        self._start(tag, names, role)

    def _start(self, tag: str, names: str, role: str) -> None:
        up = self._open_blocks[-1] if self._open_blocks else -1
        parent = self.elements[up] if up >= 0 else None
        number = len(self.elements)
        path = path_hash(parent.path if parent else 0, tag, names)
        in_main = bool(self._count.get("article") or self._count.get("main"))
        furniture = bool(parent and parent.furniture) or is_furniture(tag, names, role, in_main)
        listed = number if tag in ("ul", "ol") else parent.listed if parent else 0
        self._open.append(number)
        self._open_blocks.append(number)
        self._count[tag] = self._count.get(tag, 0) + 1
        self.elements.append(Element(tag, path, parent.depth + 1 if parent else 0, furniture, True, listed))
        self.parents.append(up)
        self.tokens.append(path ^ START)

    def _close(self) -> None:
        number = self._open.pop()
        e = self.elements[number if number >= 0 else ~number]
        self._count[e.tag] -= 1
        if number < 0:
            if self._inline_furniture and self._inline_furniture[-1] == e.tag:
                self._inline_furniture.pop()
            return
        self._open_blocks.pop()
        self.tokens.append(e.path ^ END)
        if self.parents[number] >= 0:
            self.elements[self.parents[number]].words += e.words

    def _close_to(self, wanted: set[str], stops: set[str]) -> None:
        """Close up to the innermost open element of ``wanted``, unless one of ``stops`` is nearer."""
        if not any(self._count.get(t) for t in wanted):
            return
        for k in range(len(self._open) - 1, -1, -1):
            number = self._open[k]
            tag = self.elements[number].tag if number >= 0 else ""
            if tag in wanted:
                while len(self._open) > k:
                    self._close()
                return
            if tag in stops:
                return

    def _end(self, tag: str) -> None:
        if not self._count.get(tag):
            return
        if tag in INLINE:
            for k in range(len(self._open) - 1, -1, -1):
                number = self._open[k]
                if number < 0 and self.elements[~number].tag == tag:
                    self._open.append(self._open.pop(k))
                    self._close()
                    return
            return
        self._flush()
        while True:
            number = self._open[-1]
            last = number >= 0 and self.elements[number].tag == tag
            self._close()
            if last:
                return

    def _flush(self) -> None:
        """Make a block of the text since the last block boundary."""
        words = "".join(self._run).split()
        linked, self._run, self._linked = self._linked, [], 0
        if not words:
            return
        number = self._open_blocks[-1]
        e = self.elements[number]
        first = len(self.tokens)
        if not e.furniture:
            e.words += max(0, len(words) - linked)
            if len(words) <= SHORT_WORDS:
                self.tokens.extend(e.path ^ word_hash(w) for w in words)
            else:
                self.tokens.append(hashed(e.path, " ".join(words)))
        self.blocks.append((" ".join(words), number, len(words), linked, e.furniture, e.listed, first,
                            len(self.tokens)))

    # what the operator reads off

    def inside(self, container: int) -> list[bool]:
        """For every element whether it is ``container`` or inside it."""
        out: list[bool] = []
        for k, up in enumerate(self.parents):
            out.append(k == container or up >= 0 and self.elements[k].block and out[up])
        return out

    def containers(self) -> dict[int, tuple[int, float]]:
        """Path -> (element, share of the page's words) of block elements that stand once."""
        seen: dict[int, int] = {}
        for k, e in enumerate(self.elements):
            if e.block and not e.furniture:
                seen[e.path] = -1 if e.path in seen else k
        total = self.elements[0].words
        return {path: (k, self.elements[k].words / total if total else 0.0) for path, k in seen.items() if k >= 0}


# --- 1: occurrence vectors and classes ----------------------------------------------------------

def _vectors(batches):
    """Per host and token: sums over pages that tell occurrence vectors apart."""
    held: dict[tuple[int, int], list] = {}
    columns = ["host", "token", "sum_a", "sum_b", "pages", "once", "share", "depth", "main"]

    def frame():
        keys = np.array(list(held), dtype=np.int64).reshape(-1, 2)
        values = list(zip(*held.values()))
        data = [keys[:, 0], keys[:, 1], *[np.array(v, np.int64) for v in values[:4]], np.array(values[4], float),
                np.array(values[5], np.int32), np.array(values[6], bool)]
        return pd.DataFrame(dict(zip(columns, data)))

    for batch in batches:
        for page_id, host, html in zip(batch["page_id"], batch["host"], batch["html"]):
            page = Page(html)
            key = hashed("page", page_id, html)
            counts: dict[int, int] = {}
            for t in page.tokens:
                counts[t] = counts.get(t, 0) + 1
            starts = {path ^ START: (share, page.elements[k].depth, page.elements[k].tag in MAIN_TAGS)
                      for path, (k, share) in page.containers().items()}
            signs: dict[int, int] = {}
            for t, n in counts.items():
                h = signs.get(n)
                if h is None:
                    h = signs[n] = hashed(key, n)
                share, depth, main = starts.get(t, (0.0, 0, False))
                entry = held.get((host, t))
                if entry is None:
                    held[host, t] = [h & 0xFFFFFFF, h >> 28 & 0xFFFFFFF, 1, int(n == 1), share, depth, main]
                else:
                    entry[0] += h & 0xFFFFFFF
                    entry[1] += h >> 28 & 0xFFFFFFF
                    entry[2] += 1
                    entry[3] += n == 1
                    entry[4] += share
                    entry[5] = max(entry[5], depth)
                    entry[6] = entry[6] or main
            if len(held) >= HELD:
                yield frame()
                held.clear()
    if held:
        yield frame()


def token_classes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, group, group_pages), and per group the tokens of its classes with their sums."""
    vectors = shared(pages.mapInPandas(
        _vectors, "host long, token long, sum_a long, sum_b long, pages long, once long, share double, depth int,"
                  " main boolean").groupBy("host", "token").agg(
        *[F.sum(c).alias(c) for c in ("sum_a", "sum_b", "pages", "once", "share")],
        F.max("depth").alias("depth"), F.max("main").alias("main")), "vectors")
    # every page has the token of its root element once
    root = Page("").tokens[0]
    sizes = vectors.where(F.col("token") == root).select("host", F.col("pages").alias("host_pages"))
    groups = sizes.select("host", F.when(F.col("host_pages") >= MIN_PAGES, F.col("host")).alias("own"), "host_pages")
    groups = groups.select("host", F.coalesce("own", F.lit(-1).cast("long")).alias("group"), "host_pages")
    totals = groups.groupBy("group").agg(F.sum("host_pages").alias("group_pages"))
    groups = shared(groups.join(totals, "group").select("host", "group", "group_pages"), "groups")
    sums = vectors.join(groups, "host").groupBy("group", "group_pages", "token").agg(
        *[F.sum(c).alias(c) for c in ("sum_a", "sum_b", "pages", "once", "share")],
        F.max("depth").alias("depth"), F.max("main").alias("main"))
    enough = (F.col("pages") >= MIN_SUPPORT) & (F.col("pages") >= MIN_SHARE * F.col("group_pages"))
    classes = sums.where(enough).withColumn("class", F.xxhash64("sum_a", "sum_b", "pages"))
    return groups, shared(classes, "classes")


# --- 2: valid classes ---------------------------------------------------------------------------

def class_places(tokens: list[int], class_of: dict[int, int]) -> dict[int, tuple[int, int, bool]]:
    """Class -> (order, place, valid) on one page.

    The order is that of its tokens in a run, the place the gap of the surrounding run in which its
    runs begin; a class is not valid here if runs differ, begin in several gaps, or cross others.
    """
    members: dict[int, list[int]] = {}
    for t in tokens:
        if t in class_of:
            members.setdefault(class_of[t], []).append(t)
    size: dict[int, int] = {}
    order: dict[int, int] = {}
    valid: dict[int, bool] = {}
    for c, some in members.items():
        k = size[c] = len(set(some))
        valid[c] = len(some) % k == 0 and all(some[i] == some[i % k] for i in range(len(some)))
        order[c] = hashed("order", *some[:k])
    place: dict[int, int] = {}
    stack: list[list[int]] = []
    inside: dict[int, int] = {}
    for t in tokens:
        c = class_of.get(t)
        if c is None or not valid[c]:
            continue
        if inside.get(c, 0) == 0:
            here = hashed("gap", *(stack[-1] if stack else (0, 0)))
            if place.setdefault(c, here) != here:
                valid[c] = False
            if size[c] > 1:
                stack.append([c, 1])
                inside[c] = 1
        else:
            while stack[-1][0] != c:
                crossed = stack.pop()[0]
                valid[crossed] = False
                inside[crossed] = 0
            stack[-1][1] += 1
            inside[c] += 1
            if inside[c] == size[c]:
                stack.pop()
                inside[c] = 0
    return {c: (order[c], place.get(c, 0), valid[c]) for c in members}


def _places(batches):
    held: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        class_of: dict[int, dict[int, int]] = {}
        for group, html, tokens, classes in zip(batch["group"], batch["html"], batch["tokens"], batch["classes"]):
            if tokens is None:
                continue
            if group not in class_of:
                class_of[group] = dict(zip((int(t) for t in tokens), (int(c) for c in classes)))
            for c, (order, place, valid) in class_places(Page(html).tokens, class_of[group]).items():
                e = held.setdefault((group, c), [order, order, place, place, 1])
                e[0], e[1], e[2], e[3] = min(e[0], order), max(e[1], order), min(e[2], place), max(e[3], place)
                e[4] &= valid
    if held:
        rows = [(g, c, *e) for (g, c), e in held.items()]
        yield pd.DataFrame(rows, columns=["group", "class", "order_a", "order_b", "place_a", "place_b", "valid"])


def valid_classes(pages: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(group, class) of the classes that keep one order and one place on all pages."""
    listed = shared(classes.groupBy("group").agg(
        F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes")), "listed")
    placed = pages.join(groups, "host").join(listed, "group").select("group", "html", "tokens", "classes")
    found = placed.mapInPandas(_places, "group long, class long, order_a long, order_b long, place_a long,"
                                        " place_b long, valid int")
    same = found.groupBy("group", "class").agg(
        F.min("order_a").alias("oa"), F.max("order_b").alias("ob"), F.min("place_a").alias("pa"),
        F.max("place_b").alias("pb"), F.min("valid").alias("valid"))
    return same.where("valid = 1 AND oa = ob AND pa = pb").select("group", "class")


# --- 3: slots of the main text ------------------------------------------------------------------

def choose(page: Page, containers: dict[int, tuple[int, bool]]) -> int:
    """The element of the main text, by the template's containers, else by the page's own."""
    own = page.containers()
    some = [(main, depth, own[path][0]) for path, (depth, main) in containers.items() if path in own]
    if not some:
        some = [(page.elements[k].tag in MAIN_TAGS, page.elements[k].depth, k)
                for k, share in own.values() if share >= MAIN_SHARE]
    return max(some, default=(False, 0, 0))[2]


def main_text(page: Page, containers: dict[int, tuple[int, bool]], fixed: frozenset[int]) -> str:
    """The slots of the page's main element, one line a block."""
    container = choose(page, containers)
    inside = page.inside(container)
    blocks, lists, begun = [], {}, False
    for block in page.blocks:
        text, k, n, linked, furniture, listed, low, high = block
        begun = begun or inside[k] and not furniture
        # a headline may stand before its article
        if not furniture and (inside[k] or not begun and page.elements[k].tag == "h1"):
            blocks.append(block)
            if listed:
                items, all_linked = lists.get(listed, (0, True))
                lists[listed] = items + 1, all_linked and linked >= n
    menus = {listed for listed, (items, all_linked) in lists.items() if items > 1 and all_linked}
    blocks = [b for b in blocks if b[5] not in menus]
    template = [all(t in fixed for t in page.tokens[b[6]:b[7]]) for b in blocks]
    if 2 * sum(b[2] for b, t in zip(blocks, template) if t) > sum(b[2] for b in blocks):
        # template text is the lesser part of an article; a copy of one page is no template
        template = [False] * len(blocks)
    return "\n".join(b[0] for b, t in zip(blocks, template) if not t)


def _extract(batches):
    for batch in batches:
        templates: dict[int | None, tuple[dict, frozenset]] = {}
        texts = []
        for group, html, paths, depths, mains, fixed in zip(*(batch[c] for c in (
                "group", "html", "paths", "depths", "mains", "fixed"))):
            if group not in templates:
                some = {} if paths is None else {int(p) ^ START: (int(d), bool(m))
                                                 for p, d, m in zip(paths, depths, mains)}
                templates[group] = some, frozenset() if fixed is None else frozenset(int(t) for t in fixed)
            texts.append(main_text(Page(html), *templates[group]))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": pd.Series(texts, dtype=object),
                            "n_chars": np.array([len(t) for t in texts], np.int64)})


def templates(classes: DataFrame, valid: DataFrame) -> DataFrame:
    """Per group the containers of its main text, and its fixed tokens."""
    rows = classes.join(valid, ["group", "class"])
    holds = (F.col("once") == F.col("pages")) & (F.col("share") >= MAIN_SHARE * F.col("pages"))
    fixed = (F.col("pages") >= FIXED_SHARE * F.col("group_pages")) & (F.col("group_pages") >= MIN_PAGES)
    return rows.groupBy("group").agg(
        *[F.collect_list(F.when(holds, F.col(c))).alias(name)
          for c, name in (("token", "paths"), ("depth", "depths"), ("main", "mains"))],
        F.collect_list(F.when(fixed, F.col("token"))).alias("fixed"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"),
                        F.xxhash64(F.lower(F.regexp_extract(url, HOST, 1))).alias("host"))
    groups, classes = token_classes(rows)
    template = shared(templates(classes, valid_classes(rows, groups, classes)), "templates")
    placed = rows.join(groups.select("host", "group"), "host", "left").join(template, "group", "left")
    return placed.select("page_id", "url", "html", "group", "paths", "depths", "mains", "fixed").mapInPandas(
        _extract, "page_id long, url string, text string, n_chars long")

"""Field, table, paragraph, link and main-text extraction over shredded pages
(XT1-XT11, TX16).  Every selector is a filter on the element relation of
``shred.py``; grouping is per page, so work spreads over pages.

Pages that do not have the expected layout are not dropped silently: each
extraction returns a ``status`` column ('ok' or the reason), the quarantine of
ST5, instead of raising as the original does.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators.shred import shred, shred_pages
from statuta.session import broadcast_if_small

# ---------------------------------------------------------------------------
# Fixed selectors of the original page layouts (path steps are tag#id.class).
# ---------------------------------------------------------------------------
DOC_CONTAINER = r"(^|/)div#divContentDoc(\.[^/]*)?/div(#[^/.]*)?\.content1/div[^/]*/div[^/]*"
RESULT_BLOCK_DIV = r"(^|/)div#block-info-advan(\.[^/]*)?/div[^/]*$"
DOC_LINK_BLOCK = (r"(^|/)div(#[^/.]*)?\.{block}/div(#[^/.]*)?\.left-col/div(#[^/.]*)?\.nq"
                  r"/p(#[^/.]*)?\.nqTitle/a[^/]*$")
PAGER_LINK = r"(^|/)div(#[^/.]*)?\.cmPager/a[^/]*$"
MAIN_TEXT_ID = "toanvancontent"
# ---------------------------------------------------------------------------


def _sorted_join(items: Column, sep: str) -> Column:
    """items: array<struct<o, v>> -> v joined in o order."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["v"]), sep)


def containers(el: DataFrame) -> DataFrame:
    """First element matching the document container per page."""
    c = el.where(F.col("path").rlike(DOC_CONTAINER + "$"))
    return c.groupBy("page_id").agg(F.min_by(F.struct("seq", "last", "start", "end"), "seq").alias("c")) \
        .select("page_id", F.col("c.seq").alias("c_seq"), F.col("c.last").alias("c_last"),
                F.col("c.start").alias("c_start"), F.col("c.end").alias("c_end"))


def container_tables(el: DataFrame, cont: DataFrame) -> DataFrame:
    """Tables inside the container in document order: (page_id, t_seq, table_no, t_end)."""
    t = el.where(F.col("tag") == "table").select("page_id", F.col("seq").alias("t_seq"),
                                                 F.col("end").alias("t_end"))
    t = t.join(cont, "page_id").where((F.col("t_seq") > F.col("c_seq")) & (F.col("t_seq") <= F.col("c_last")))
    w = Window.partitionBy("page_id").orderBy("t_seq")
    return t.select("page_id", "t_seq", "t_end", (F.row_number().over(w) - 1).alias("table_no"))


def table_cells(el: DataFrame, tables: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cell_no, text) for td cells of the given tables.
    A table has all rows inside it and a row all cells inside it, so those of a nested
    table also belong to the outer one."""
    tr = el.where(F.col("tag") == "tr").select("page_id", F.explode("table_seqs").alias("t_seq"),
                                               F.col("seq").alias("r_seq"))
    tr = tr.join(tables.select("page_id", "t_seq", "table_no"), ["page_id", "t_seq"])
    tr = tr.withColumn("row_no", F.row_number().over(
        Window.partitionBy("page_id", "t_seq").orderBy("r_seq")) - 1)
    td = el.where(F.col("tag") == "td").select("page_id", F.explode("tr_seqs").alias("r_seq"),
                                               F.col("seq").alias("d_seq"), "text")
    td = td.join(tr, ["page_id", "r_seq"])
    td = td.withColumn("cell_no", F.row_number().over(
        Window.partitionBy("page_id", "t_seq", "r_seq").orderBy("d_seq")) - 1)
    return td.select("page_id", "table_no", "row_no", "cell_no", "text")


def nested_tables(cells: DataFrame, clean) -> DataFrame:
    """(page_id, table_no, rows: array<array<string>>) -- XT3."""
    rows = cells.groupBy("page_id", "table_no", "row_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("cell_no").alias("o"),
                                                         clean(F.col("text")).alias("v")))),
                    lambda s: s["v"]).alias("cells"))
    return rows.groupBy("page_id", "table_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("row_no").alias("o"),
                                                         F.col("cells").alias("v")))),
                    lambda s: s["v"]).alias("rows"))


def header_fields(el: DataFrame, pages: DataFrame) -> DataFrame:
    """XT1 + XT2 (fields cleaned with TX2).  status: ok / no_container / few_tables / missing_cell."""
    cont = containers(el)
    tables = container_tables(el, cont)
    cells = table_cells(el, tables.where(F.col("table_no") < 2))
    val = T.strip_tags_flat(F.col("text"))

    def pick(t, r, c):
        return F.max(F.when((F.col("table_no") == t) & (F.col("row_no") == r) & (F.col("cell_no") == c), val))

    f = cells.groupBy("page_id").agg(
        pick(0, 0, 0).alias("org"), pick(0, 0, 1).alias("cou"), pick(0, 1, 0).alias("doc_id"),
        pick(0, 1, 1).alias("date"), pick(1, 0, 0).alias("receiver"), pick(1, 0, 1).alias("signer"))
    nt = tables.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tables"))
    out = (pages.select("page_id").join(cont.select("page_id", "c_seq"), "page_id", "left")
           .join(nt, "page_id", "left").join(f, "page_id", "left"))
    fields = ["org", "cou", "doc_id", "date", "receiver", "signer"]
    status = (F.when(F.col("c_seq").isNull(), "no_container")
              .when(F.coalesce(F.col("n_tables"), F.lit(0)) < 2, "few_tables")
              .when(F.greatest(*[F.col(x).isNull().cast("int") for x in fields]) == 1, "missing_cell")
              .otherwise("ok"))
    return out.select("page_id", *fields, F.coalesce(F.col("n_tables"), F.lit(0)).cast("bigint").alias("n_tables"),
                      status.alias("status"))


def paragraphs(el: DataFrame, clean=T.strip_tags_flat, fallback: bool = True,
               pages: DataFrame | None = None) -> DataFrame:
    """XT4 + XT5: <p> children of the container, or (fallback) one level deeper when
    a page has none; cleaned and joined by one space.  (page_id, level, content);
    with ``pages`` every page gets a row (empty content, NULL level, when it has
    no such paragraph)."""
    p = el.where(F.col("tag") == "p")
    lvl = (F.when(F.col("path").rlike(DOC_CONTAINER + r"/p[^/]*$"), 1)
           .when(F.col("path").rlike(DOC_CONTAINER + r"/div[^/]*/p[^/]*$"), 2))
    p = p.withColumn("level", lvl).where(F.col("level").isNotNull())
    if not fallback:
        p = p.where(F.col("level") == 1)
    p = p.withColumn("n1", F.count_if(F.col("level") == 1).over(Window.partitionBy("page_id")))
    p = p.where((F.col("level") == 1) | (F.col("n1") == 0))
    out = p.groupBy("page_id").agg(
        F.min("level").alias("level"),
        _sorted_join(F.collect_list(F.struct(F.col("seq").alias("o"), clean(F.col("text")).alias("v"))),
                     " ").alias("content"))
    if pages is None:
        return out
    return pages.select("page_id").join(out, "page_id", "left").select(
        "page_id", "level", F.coalesce(F.col("content"), F.lit("")).alias("content"))


def appendix_tables(el: DataFrame, pages: DataFrame, first: int = 2) -> DataFrame:
    """XT7 + TX16: tables from the third on as JSON rows x cells (cells cleaned with
    TX1); ``[]`` for a document with two tables.  (page_id, appendix,
    n_appendix_tables, status) for every page; fewer than two tables is
    quarantined, as the original fails on it."""
    cont = containers(el)
    tables = container_tables(el, cont)
    nested = nested_tables(table_cells(el, tables.where(F.col("table_no") >= first)), T.strip_tags)
    full = tables.where(F.col("table_no") >= first).join(nested, ["page_id", "table_no"], "left")
    app = full.groupBy("page_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("table_no").alias("o"), F.coalesce(F.col("rows"), F.array().cast("array<array<string>>"))
            .alias("v")))), lambda s: s["v"])).alias("appendix"))
    nt = tables.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tables"))
    out = (pages.select("page_id").join(cont.select("page_id", "c_seq"), "page_id", "left")
           .join(nt, "page_id", "left").join(app, "page_id", "left"))
    n = F.coalesce(F.col("n_tables"), F.lit(0))
    status = (F.when(F.col("c_seq").isNull(), "no_container")
              .when(n < 2, "few_tables").otherwise("ok"))
    return out.select(
        "page_id",
        F.when(status == "ok", F.coalesce(F.col("appendix"), F.lit("[]"))).alias("appendix"),
        F.greatest(n - first, F.lit(0)).cast("bigint").alias("n_appendix_tables"),
        status.alias("status"))


def content_and_appendix(el: DataFrame, pages: DataFrame, compat: bool = False) -> DataFrame:
    """XT6: split the container HTML on ``</table>``.  Pieces 0-1 hold the content;
    each later piece becomes {text, table}: its text without table blocks (TX6 then
    TX4) and the rows of the table inside it (cells TX4); the piece after the last
    table has an empty table.  With two tables or fewer the content is the
    paragraphs and the appendix is empty.  ``compat`` empties the content when
    there are more than two tables (Q11) and uses the one-line block rule (Q16)."""
    cont = containers(el)
    tables = container_tables(el, cont)
    nt = tables.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tables"),
                                       F.max(F.when(F.col("table_no") == 1, F.col("t_end"))).alias("t1_end"))
    chtml = pages.select("page_id", "html").join(cont, "page_id").select(
        "page_id", F.substring(F.col("html"), F.col("c_start") + 1, F.col("c_end") - F.col("c_start")).alias("chtml"))
    pieces = chtml.select("page_id", F.posexplode(F.split("chtml", "</table>")).alias("i", "piece")) \
        .where(F.col("i") >= 2)
    nested = nested_tables(table_cells(el, tables.where(F.col("table_no") >= 2)), T.strip_tags_multiline)
    ent = pieces.join(nested.withColumnRenamed("table_no", "i"), ["page_id", "i"], "left").select(
        "page_id", "i",
        T.strip_tags_multiline(T.delete_tag_block(F.concat(F.col("piece"), F.lit("</table>")), "table",
                                                  compat=compat)).alias("text"),
        F.coalesce(F.col("rows"), F.array().cast("array<array<string>>")).alias("table"))
    app = ent.groupBy("page_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("i").alias("o"),
                                                                   F.struct("text", "table").alias("v")))),
                              lambda s: s["v"])).alias("appendix"),
        F.count(F.lit(1)).cast("bigint").alias("n_entries"))
    # content: paragraphs in the container; with > 2 tables only those before the end of table 2
    p = el.where(F.col("tag") == "p").join(cont, "page_id").join(nt, "page_id", "left")
    many = F.coalesce(F.col("n_tables"), F.lit(0)) > 2
    p = p.where(F.when(many, (F.col("seq") > F.col("c_seq")) & (F.col("seq") <= F.col("c_last"))
                       & (F.col("end") <= F.col("t1_end")))
                .otherwise(F.col("path").rlike(DOC_CONTAINER + r"/p[^/]*$")))
    content = p.groupBy("page_id").agg(_sorted_join(F.collect_list(F.struct(
        F.col("seq").alias("o"), T.strip_tags_multiline(F.col("text")).alias("v"))), " ").alias("content"))
    out = (pages.select("page_id").join(cont.select("page_id", "c_seq"), "page_id", "left")
           .join(nt, "page_id", "left").join(content, "page_id", "left").join(app, "page_id", "left"))
    many = F.coalesce(F.col("n_tables"), F.lit(0)) > 2
    content_col = F.coalesce(F.col("content"), F.lit(""))
    if compat:
        content_col = F.when(many, F.lit("")).otherwise(content_col)
    return out.select(
        "page_id", content_col.alias("content"),
        F.when(many, F.col("appendix")).otherwise(F.lit("[]")).alias("appendix"),
        F.when(many, F.col("n_entries")).otherwise(F.lit(0)).cast("bigint").alias("n_entries"),
        F.when(F.col("c_seq").isNull(), "no_container")
        .when(F.coalesce(F.col("n_tables"), F.lit(0)) < 2, "few_tables").otherwise("ok").alias("status"))


def document_links(el: DataFrame, compat: bool = False) -> DataFrame:
    """XT9 + SET1: document links of result pages: block content-0 then content-1
    (``compat``: content-0 twice, Q10), duplicates kept.  The second-step search
    covers the whole page (Q18) but needs at least two result-block divs.
    (page_id, block, seq, href)."""
    blocks = el.where(F.col("path").rlike(RESULT_BLOCK_DIV)).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_blocks"))
    ok_pages = blocks.where(F.col("n_blocks") >= 2).select("page_id")
    a = el.where((F.col("tag") == "a") & F.col("href").isNotNull()).join(ok_pages, "page_id", "left_semi")
    second = "content-0" if compat else "content-1"
    b0 = a.where(F.col("path").rlike(DOC_LINK_BLOCK.format(block="content-0"))).select(
        "page_id", F.lit(0).alias("block"), "seq", "href")
    b1 = a.where(F.col("path").rlike(DOC_LINK_BLOCK.format(block=second))).select(
        "page_id", F.lit(1).alias("block"), "seq", "href")
    return b0.unionAll(b1)


def pager_links(el: DataFrame, base: str) -> DataFrame:
    """XT10: pager hrefs made absolute by plain prefixing.  (page_id, seq, url)."""
    a = el.where((F.col("tag") == "a") & F.col("href").isNotNull() & F.col("path").rlike(PAGER_LINK))
    return a.select("page_id", "seq", F.concat(F.lit(base), F.col("href")).alias("url"))


def main_text(el: DataFrame, pages: DataFrame, compat: bool = False) -> DataFrame:
    """XT11 + TX3 + TX7: text of the first ``div#toanvancontent`` with CR, tab,
    backslash and quotes as spaces, whitespace normalised.  (page_id, text, status)."""
    m = el.where((F.col("tag") == "div") & (F.col("id") == MAIN_TEXT_ID)).groupBy("page_id").agg(
        F.min_by("text", "seq").alias("raw"))
    cleaned = T.normalize_whitespace(F.translate(F.col("raw"), "\r\t\\'\"", "     "), compat=compat)
    return pages.select("page_id").join(m, "page_id", "left").select(
        "page_id", cleaned.alias("text"),
        F.when(F.col("raw").isNull(), "no_main_text").otherwise("ok").alias("status"))


# ---------------------------------------------------------------------------
# The same extractions on pages that carry their elements (``shred_pages``): a page's
# fields are expressions over its own row, so the pages are not shuffled at all.
# ---------------------------------------------------------------------------
DOC_TAGS = frozenset({"div", "table", "tr", "td", "p"})
DOC_COLUMNS = ["seq", "tag", "path", "start", "end", "text"]
#: Tags whose text the fields of a document are made of; the least that tables or paragraphs are read from.
DOC_TEXT = frozenset({"td", "p"})
TABLE_TAGS, PARAGRAPH_TAGS = frozenset({"div", "table", "tr", "td"}), frozenset({"p"})
LEAST_COLUMNS = ["tag", "path", "text"]
FIELDS = {"org": (0, 0, 0), "cou": (0, 0, 1), "doc_id": (0, 1, 0), "date": (0, 1, 1),
          "receiver": (1, 0, 0), "signer": (1, 0, 1)}
REPEATED_ROWS = 1_000_000


def by_page(pages: DataFrame, own, shared) -> DataFrame:
    """``own(pages)`` for pages with an id of their own.  Elements of pages that share an id are
    read together: those take ``shared(elements, pages)``."""
    repeated = pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id")
    repeated, few = broadcast_if_small(repeated, REPEATED_ROWS, persist=True)
    if few and repeated.isEmpty():
        return own(pages)
    again = pages.join(repeated, "page_id", "left_semi").select(*pages.columns)
    once = pages.join(repeated, "page_id", "left_anti").select(*pages.columns)
    out = own(once)
    return out.unionByName(shared(shred(again).persist(), again).select(*out.columns))


def _inside(e: Column, *tags: str) -> Column:
    """The elements with one of the tags inside an element, in page order."""
    return F.filter(F.slice("els", e["at"] + 2, e["inside"]), lambda x: x["tag"].isin(*tags))


def document_elements(pages: DataFrame, tags: frozenset[str] = DOC_TAGS, columns: list[str] = DOC_COLUMNS,
                      html: bool = True) -> DataFrame:
    """Pages with ``els``, their document container ``cont`` and the tables in it.  An extraction that
    reads fewer ``tags`` or ``columns``, or no ``html``, moves no others out of the shred."""
    x = shred_pages(pages, tags, columns, DOC_TEXT & tags, html)
    x = x.withColumn("cont", F.get(F.filter("els", lambda e: (e["tag"] == "div") & e["path"].rlike(
        DOC_CONTAINER + "$")), 0))
    tables = _inside(F.col("cont"), "table")
    return x.withColumn("tables", F.coalesce(tables, F.slice("els", 1, 0)))


def _n_tables() -> Column:
    return F.size("tables")


def _status() -> Column:
    return F.when(F.col("cont").isNull(), "no_container").when(_n_tables() < 2, "few_tables")


def with_fields(x: DataFrame) -> DataFrame:
    """XT1 + XT2: ``header_fields`` of each page."""
    firsts = {(t, r): F.get(_inside(F.get("tables", t), "tr"), r) for t, r in ((0, 0), (0, 1), (1, 0))}
    x = x.withColumns({f"row{t}{r}": c for (t, r), c in firsts.items()})
    x = x.withColumns({f"cells{t}{r}": _inside(F.col(f"row{t}{r}"), "td") for t, r in firsts})
    x = x.withColumns({name: T.strip_tags_flat(F.get(f"cells{t}{r}", c)["text"]) for name, (t, r, c) in FIELDS.items()})
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in FIELDS]) == 1
    return x.withColumns({"n_tables": _n_tables().cast("bigint"),
                          "status": F.coalesce(_status(), F.when(missing, "missing_cell").otherwise("ok"))})


def _joined(elements: Column, clean) -> Column:
    return F.array_join(F.transform(elements, lambda e: clean(e["text"])), " ")


def with_paragraphs(x: DataFrame, clean=T.strip_tags_flat) -> DataFrame:
    """XT4 + XT5: ``paragraphs`` of each page (empty content, NULL level, where it has none)."""
    p = F.filter("els", lambda e: e["tag"] == "p")
    x = x.withColumn("p1", F.filter(p, lambda e: e["path"].rlike(DOC_CONTAINER + r"/p[^/]*$")))
    x = x.withColumn("p2", F.when(F.size("p1") == 0, F.filter(p, lambda e: e["path"].rlike(
        DOC_CONTAINER + r"/div[^/]*/p[^/]*$"))))
    return x.withColumns({
        "level": F.when(F.size("p1") > 0, 1).when(F.size("p2") > 0, 2),
        "content": _joined(F.when(F.size("p1") > 0, F.col("p1")).otherwise(F.col("p2")), clean)})


def _table_rows(t: Column, clean) -> Column:
    """A table's rows of cells; rows without a cell are none."""
    rows = F.transform(_inside(t, "tr"), lambda r: F.transform(_inside(r, "td"), lambda d: clean(d["text"])))
    return F.filter(rows, lambda r: F.size(r) > 0)


def with_tables(x: DataFrame, first: int = 2) -> DataFrame:
    """XT7 + TX16: ``appendix_tables`` of each page."""
    later = F.slice("tables", first + 1, F.greatest(_n_tables() - first, F.lit(0)))
    x = x.withColumn("status", F.coalesce(_status(), F.lit("ok")))
    return x.withColumns({
        "appendix": F.when(F.col("status") == "ok", F.to_json(F.transform(
            later, lambda t: _table_rows(t, T.strip_tags)))),
        "n_appendix_tables": F.greatest(_n_tables() - first, F.lit(0)).cast("bigint")})


def with_split(x: DataFrame, compat: bool = False) -> DataFrame:
    """XT6: ``content_and_appendix`` of each page."""
    many = _n_tables() > 2
    cont = F.col("cont")
    pieces = F.split(F.substring(F.col("html"), cont["start"] + 1, cont["end"] - cont["start"]), "</table>")
    x = x.withColumn("pieces", F.when(many, F.slice(pieces, 3, F.size(pieces))))
    x = x.withColumn("later", F.when(many, F.transform(
        F.slice("tables", 3, _n_tables()), lambda t: _table_rows(t, T.strip_tags_multiline))))
    none = F.array().cast("array<array<string>>")
    entries = F.transform("pieces", lambda piece, i: F.struct(
        T.strip_tags_multiline(T.delete_tag_block(F.concat(piece, F.lit("</table>")), "table", compat=compat))
        .alias("text"), F.coalesce(F.get("later", i), none).alias("table")))
    p = F.filter("els", lambda e: e["tag"] == "p")
    before = F.filter(_inside(cont, "p"), lambda e: e["end"] <= F.get("tables", 1)["end"])
    alone = F.filter(p, lambda e: e["path"].rlike(DOC_CONTAINER + r"/p[^/]*$"))
    content = F.coalesce(_joined(F.when(many, before).when(cont.isNotNull(), alone), T.strip_tags_multiline), F.lit(""))
    if compat:
        content = F.when(many, F.lit("")).otherwise(content)
    # without a later piece there is no list of entries
    return x.withColumns({
        "content": content,
        "appendix": F.when(many, F.when(F.size("pieces") > 0, F.to_json(entries))).otherwise(F.lit("[]")),
        "n_entries": F.when(many, F.when(F.size("pieces") > 0, F.size("pieces"))).otherwise(0).cast("bigint"),
        "status": F.coalesce(_status(), F.lit("ok"))})


LINK_TAGS = frozenset({"div", "a"})


def page_document_links(pages: DataFrame, compat: bool = False) -> DataFrame:
    """``document_links`` of each page: (page_id, block, seq, href)."""
    x = shred_pages(pages.select("page_id", "html"), LINK_TAGS, ["seq", "tag", "path", "href"], frozenset(),
                    html=False)
    blocks = F.filter("els", lambda e: (e["tag"] == "div") & e["path"].rlike(RESULT_BLOCK_DIV))
    second = "content-0" if compat else "content-1"

    def found(block: int, name: str) -> Column:
        own = F.filter("els", lambda e: e["href"].isNotNull() & e["path"].rlike(DOC_LINK_BLOCK.format(block=name)))
        return F.transform(own, lambda e: F.struct(F.lit(block).alias("block"), e["seq"].alias("seq"), e["href"].alias("href")))

    x = x.where(F.size(blocks) >= 2).select("page_id", F.concat(found(0, "content-0"), found(1, second)).alias("found"))
    return x.select("page_id", F.inline("found"))


def page_pager_links(pages: DataFrame, base: str) -> DataFrame:
    """``pager_links`` of each page: (page_id, seq, url).  Only the links leave the shred."""
    x = shred_pages(pages.select("page_id", "html"), frozenset({"a"}), ["seq", "path", "href"], frozenset(), html=False)
    found = F.filter("els", lambda e: e["href"].isNotNull() & e["path"].rlike(PAGER_LINK))
    return x.select("page_id", F.inline(F.transform(found, lambda e: F.struct(
        e["seq"].alias("seq"), F.concat(F.lit(base), e["href"]).alias("url")))))


MAIN_TAGS = frozenset({"div"})


def page_main_text(pages: DataFrame, compat: bool = False) -> DataFrame:
    """``main_text`` of each page, with the pages' other columns."""
    x = shred_pages(pages, MAIN_TAGS, ["id", "text"])
    x = x.withColumn("raw", F.get(F.filter("els", lambda e: e["id"] == MAIN_TEXT_ID), 0)["text"])
    cleaned = T.normalize_whitespace(F.translate(F.col("raw"), "\r\t\\'\"", "     "), compat=compat)
    return x.select(*[c for c in pages.columns if c != "html"], cleaned.alias("text"),
                    F.when(F.col("raw").isNull(), "no_main_text").otherwise("ok").alias("status"))

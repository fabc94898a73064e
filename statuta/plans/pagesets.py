"""Web pages composed from the driver tables, in every layout the extraction rules meet.

One document page per order (its lines are the paragraphs and appendix rows), one result
page per ten orders, and one statute page per supplier.  The oracles compute the expected
fields from the same source rows, not from the HTML.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.articles import statute_texts_from_lineitem
from statuta.session import even_parts
from statuta.sources.tables import table

DOC_PAGES, RESULT_PAGES, STATUTE_PAGES = 1_000_000_000, 2_000_000_000, 3_000_000_000
#: Layout of a document page: order key modulo 8.
PLAIN, ATTRIBUTES, DEEP, APPENDIX, MISSING_CELL, NO_CONTAINER, NESTED, FEW_TABLES = range(8)
ORDERS_PER_RESULT_PAGE = 10

# Values of a document page as expressions over an order (also read by the oracles).
VALUES = {
    "org": "'Cơ quan ' || o_custkey", "cou": "o_orderpriority", "doc_id": "'Số: ' || o_orderkey",
    "date": "'ngày ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))", "receiver": "'Nơi nhận ' || o_orderstatus",
    "signer": "'Ông ' || (o_custkey % 97)",
}


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines (number, quantity, flag), sorted, and the page's layout.  Rows are spread
    before the pages are composed from them, so that the pages themselves are not shuffled."""
    lineitem = table(spark, sf_dir, "lineitem")
    n = even_parts(lineitem)
    lines = lineitem.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("ln"), F.col("l_quantity").cast("int").alias("q"),
        F.col("l_returnflag").alias("f")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").repartition(n, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = F.array().cast("array<struct<ln:int,q:int,f:string>>")
    return orders.select("o_orderkey", *[F.expr(e).alias(c) for c, e in VALUES.items()], "o_custkey",
                         F.coalesce("lines", empty).alias("lines"), F.expr("o_orderkey % 8").alias("layout"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = order_lines(spark, sf_dir)
    p = f"CASE WHEN layout = {ATTRIBUTES} THEN '<p class=\"x y\"\\n id=\"a/b.c#d\">' ELSE '<p>' END"
    td = f"CASE WHEN layout = {ATTRIBUTES} THEN '<td width=\"1\"\\n align=\"left\">' ELSE '<td>' END"
    paras = f"array_join(transform(lines, l -> {p} || 'Điều ' || l.ln || '. <b>' || l.f || '</b> ' || l.q || '</p>'), '\\n')"
    rows = "array_join(transform(lines, l -> '<tr><td>' || l.ln || '</td><td><i>' || l.q || '</i></td></tr>'), '')"
    cell = lambda c: f"{td} || '<b>' || {c} || '</b></td>'"
    header = (f"'<table><tr>' || {cell('org')} || {cell('cou')} || '</tr><tr>' || {cell('doc_id')} || "
              f"CASE WHEN layout = {MISSING_CELL} THEN '' ELSE {cell('date')} END || '</tr></table>'")
    body = f"CASE WHEN layout = {DEEP} THEN '<div class=\"w-1/2\">' || {paras} || '</div>' ELSE {paras} END"
    footer = (f"CASE WHEN layout = {FEW_TABLES} THEN '' ELSE '<table class=\"sign\"><tr>' || {cell('receiver')} || "
              f"{cell('signer')} || '</tr></table>' END")
    appendix = (f"CASE WHEN layout = {APPENDIX} THEN array_join(transform(sequence(1, 1 + size(lines) % 3), "
                f"k -> 'Phụ lục ' || k || '<table class=\"t\">' || {rows} || '</table>'), '') || 'hết' "
                f"WHEN layout = {NESTED} THEN '<table><tr><td>ngoài<table><tr><td>' || o_custkey || "
                "'</td></tr></table></td><td>x</td></tr></table>hết' ELSE '' END")
    name = f"CASE WHEN layout = {NO_CONTAINER} THEN 'other' ELSE 'divContentDoc' END"
    html = (f"'<html><body><div id=\"' || {name} || '\"><div class=\"content1\"><div class=\"w-1/2\"><div>' || {header} || "
            f"{body} || {footer} || {appendix} || '</div></div></div></div></body></html>'")
    return x.select((F.col("o_orderkey") + DOC_PAGES).alias("page_id"),
                    F.expr("'vb/' || o_orderkey").alias("url"), F.expr(html).alias("html"))


def result_pages(spark: SparkSession, sf_dir: str, base: str = "") -> DataFrame:
    """Ten orders per page, halves in two blocks; every ninth page has one block div only.
    The pager of page n leads to pages 10n + 1 to 10n + 10, some of which do not exist."""
    no = F.floor(F.col("o_orderkey") / ORDERS_PER_RESULT_PAGE).cast("bigint")
    link = "'<div class=\"nq\"><p class=\"nqTitle\"><a class=\"l\" href=\"vb/' || k || '\">' || k || '</a></p></div>'"
    orders = table(spark, sf_dir, "orders")
    groups = orders.select("o_orderkey", no.alias("no")).repartition(even_parts(orders), "no").groupBy("no").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))

    def block(n: int, test: str) -> str:
        return (f"'<div class=\"content-{n}\"><div class=\"left-col\">' || array_join(transform("
                f"filter(k, x -> {test}), k -> {link}), '') || '</div></div>'")

    html = ("'<div id=\"block-info-advan\">' || CASE WHEN no % 9 = 0 THEN '' ELSE '<div>head</div>' END || '<div>' || "
            f"{block(0, 'x % 10 < 5')} || {block(1, 'x % 10 >= 5')} || '</div></div>"
            "<div class=\"cmPager\">' || array_join(transform(sequence(1, 10), i -> '<a href=\"tim.aspx?page=' || "
            "(10 * no + i) || '\">' || i || '</a>'), ' ') || '</div>'")
    return groups.select((F.col("no") + RESULT_PAGES).alias("page_id"), F.concat(F.lit(f"{base}tim.aspx?page="), F.col("no").cast("string")).alias("url"),
                         F.expr(html).alias("html"))


def supplier_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes with their lines as an array, one statute per supplier."""
    li = table(spark, sf_dir, "lineitem")
    return statute_texts_from_lineitem(li.withColumn("l_orderkey", F.col("l_suppkey"))
                                       .repartition(even_parts(li), "l_orderkey"))


def statute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("raws", lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>\n"))), "")
    html = F.concat(F.lit('<html><body><div class="a.b" id="toanvancontent">'), text, F.lit("</div></body></html>"))
    return supplier_statutes(spark, sf_dir).select(
        (F.col("law_id") + STATUTE_PAGES).alias("page_id"), F.concat(F.lit("luat/"), F.col("law_id")).alias("url"), html.alias("html"))


# ---------------------------------------------------------------------------
# Expected results as DuckDB SQL over the source rows
# ---------------------------------------------------------------------------

def oracles(link_base: str, domain: str, segments_sql: str, statute_lines_sql: str) -> dict[str, str]:
    values = ", ".join(f"{e} AS {c}" for c, e in VALUES.items())
    source = f"""l AS (SELECT l_orderkey, l_linenumber AS ln, CAST(l_quantity AS INT) AS q, l_returnflag AS f FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS n, string_agg('Điều ' || ln || '. ' || f || ' ' || q, ' ' ORDER BY ln, q, f) AS paras,
        '[' || string_agg('["' || ln || '","' || q || '"]', ',' ORDER BY ln, q, f) || ']' AS rows FROM l GROUP BY l_orderkey),
d AS (SELECT o_orderkey + {DOC_PAGES} AS page_id, o_orderkey, o_custkey, {values}, o_orderkey % 8 AS layout,
        coalesce(n, 0) AS n, coalesce(paras, '') AS paras, coalesce(rows, '[]') AS rows
      FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)"""
    n_app = "(1 + n % 3)"
    many = f"layout IN ({APPENDIX}, {NESTED})"
    status = (f"CASE layout WHEN {NO_CONTAINER} THEN 'no_container' WHEN {FEW_TABLES} THEN 'few_tables' ELSE 'ok' END")
    nested = "'[[\"ngoài' || o_custkey || '\",\"' || o_custkey || '\",\"x\"],[\"' || o_custkey || '\"]]'"
    inner = "'[[\"' || o_custkey || '\"]]'"
    found = f"layout <> {NO_CONTAINER}"
    sql = {}
    sql["doc_header_fields"] = f"""WITH {source} SELECT page_id, CASE WHEN {found} THEN org END AS org,
  CASE WHEN {found} THEN cou END AS cou, CASE WHEN {found} THEN doc_id END AS doc_id,
  CASE WHEN {found} AND layout <> {MISSING_CELL} THEN date END AS date,
  CASE WHEN {found} AND layout <> {FEW_TABLES} THEN receiver END AS receiver,
  CASE WHEN {found} AND layout <> {FEW_TABLES} THEN signer END AS signer,
  CAST(CASE layout WHEN {NO_CONTAINER} THEN 0 WHEN {FEW_TABLES} THEN 1 WHEN {NESTED} THEN 4
       WHEN {APPENDIX} THEN 2 + {n_app} ELSE 2 END AS BIGINT) AS n_tables,
  CASE WHEN layout = {MISSING_CELL} THEN 'missing_cell' ELSE {status} END AS status FROM d
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'no_container' FROM pages"""
    sql["doc_tables"] = f"""WITH {source} SELECT page_id,
  CASE WHEN layout IN ({NO_CONTAINER}, {FEW_TABLES}) THEN NULL
       WHEN layout = {APPENDIX} THEN '[' || array_to_string(list_transform(range({n_app}), lambda k: rows), ',') || ']'
       WHEN layout = {NESTED} THEN '[' || {nested} || ',' || {inner} || ']' ELSE '[]' END AS appendix,
  CAST(CASE layout WHEN {APPENDIX} THEN {n_app} WHEN {NESTED} THEN 2 ELSE 0 END AS BIGINT) AS n_appendix_tables,
  {status} AS status FROM d UNION ALL SELECT page_id, NULL, 0, 'no_container' FROM pages"""
    sql["doc_content_appendix"] = f"""WITH {source} SELECT page_id,
  CASE WHEN layout IN ({NO_CONTAINER}, {DEEP}) THEN '' ELSE paras END AS content,
  CASE WHEN layout = {APPENDIX} THEN '[' || array_to_string(list_transform(range({n_app}),
         lambda k: '{{"text":"Phụ lục ' || (k + 1) || '","table":' || rows || '}}'), ',') || ',{{"text":"hết","table":[]}}]'
       WHEN layout = {NESTED} THEN '[{{"text":"","table":' || {nested} || '}},{{"text":"x","table":' || {inner}
         || '}},{{"text":"hết","table":[]}}]' ELSE '[]' END AS appendix,
  CAST(CASE WHEN layout = {APPENDIX} THEN {n_app} + 1 WHEN {many} THEN 3 ELSE 0 END AS BIGINT) AS n_entries,
  {status} AS status FROM d UNION ALL SELECT page_id, '', '[]', 0, 'no_container' FROM pages"""
    sql["doc_paragraph_fallback"] = f"""WITH {source} SELECT page_id,
  CAST(CASE WHEN layout = {NO_CONTAINER} OR n = 0 THEN NULL WHEN layout = {DEEP} THEN 2 ELSE 1 END AS BIGINT) AS level,
  CASE WHEN {found} THEN paras ELSE '' END AS content FROM d UNION ALL SELECT page_id, NULL, '' FROM pages"""
    linked = "(o_orderkey // 10) % 9 <> 0"
    sql["document_links"] = f"""SELECT o_orderkey // 10 + {RESULT_PAGES} AS page_id,
  CAST(CASE WHEN o_orderkey % 10 < 5 THEN 0 ELSE 1 END AS BIGINT) AS block, 'vb/' || o_orderkey AS href
FROM orders WHERE {linked}"""
    sql["pager_links"] = f"""SELECT no + {RESULT_PAGES} AS page_id, '{link_base}tim.aspx?page=' || (10 * no + i) AS url
FROM (SELECT DISTINCT o_orderkey // 10 AS no FROM orders), range(1, 11) t(i)"""
    # pages 0, 1 to 10, 11 to 110, ...: the round is the number of digits of 9 no + 9, less one
    sql["crawl_rounds"] = f"""SELECT '{link_base}tim.aspx?page=' || no AS link,
  CAST(length(CAST(9 * no + 9 AS VARCHAR)) - 1 AS BIGINT) AS round, CASE WHEN no % 9 = 0 THEN 0 ELSE n END AS n_links
FROM (SELECT o_orderkey // 10 AS no, count(*) AS n FROM orders GROUP BY ALL)"""
    sql["documents_with_appendix"] = f"""SELECT h.doc_id, h.org, h.date, h.receiver, h.signer, c.content, c.appendix,
  '{domain}' AS domain FROM ({sql["doc_header_fields"]}) h JOIN ({sql["doc_content_appendix"]}) c USING (page_id)
WHERE h.status = 'ok'"""
    sql["main_text"] = f"""WITH {statute_lines_sql} SELECT law_id + {STATUTE_PAGES} AS page_id,
  string_agg(trim(regexp_replace(raw, ' +', ' ', 'g')), chr(10) ORDER BY line_no) FILTER (raw <> '') || chr(10) AS text,
  'ok' AS status FROM lines GROUP BY law_id UNION ALL SELECT page_id, NULL, 'no_main_text' FROM pages"""
    sql["statute_text"] = f"""SELECT law_id + {STATUTE_PAGES} AS law_id, art_no,
  (law_id + {STATUTE_PAGES}) || '-' || art_no AS key, pos, replace(content, 'LUẬT  ', 'LUẬT ') AS content
FROM ({segments_sql})"""
    sql["pages_to_documents"] = f"""WITH {source} SELECT doc_id, org, date, receiver, signer, paras AS content,
  'vb/' || o_orderkey AS link, '{domain}' AS domain FROM d
WHERE layout NOT IN ({MISSING_CELL}, {NO_CONTAINER}, {FEW_TABLES}) AND {linked}"""
    sql["documents_quarantined"] = f"SELECT page_id, status FROM ({sql['doc_header_fields']}) WHERE status <> 'ok'"
    sql["linked_documents_quarantined"] = f"""SELECT h.page_id, h.status FROM ({sql['doc_header_fields']}) h
JOIN orders ON page_id = o_orderkey + {DOC_PAGES} WHERE status <> 'ok' AND {linked}"""
    return sql

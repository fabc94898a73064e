"""Literal probe rows appended to driver tables by some catalogue queries.

The driver text is too clean for the cleaning rules (no tabs, CR, multi-line tags,
double spaces ...).  These rows are unioned onto the table input in both Spark and
the DuckDB oracle so the rules are exercised; the table rows keep the work growing
with the data.
"""
from __future__ import annotations

# Fixed probe rows (id, text).  Ids are negative so they never meet table ids.
TEXT_PROBES = [
    (-1, '<p\n class="x">A\t"b"</p>\r\n<i>c\\d</i> <> it\'s <table><tr><td>1</td></tr>'
         '</table> <table w="1"><tr><td>2</td></tr></table>'),
    (-2, '<ul><li value="4">Mục <u>bốn</u>: xem <a href="/b">bảng<br/>hai</a></li>\n<li>hết</li></ul>'),
    (-3, "a  b \n \n  c\n\n\nd "),
    (-4, " a b\t c　d \x0be\x1cf "),
    (-5, '<div class="x">one\ntwo</div> keep <div>plain</div> <div id="y">z</div> '),
    (-6, "  Điều 7.   x\u0085y z "),
]


def probe_frame(spark: SparkSession, id_col: str, text_col: str) -> DataFrame:
    return spark.createDataFrame(TEXT_PROBES, f"{id_col} bigint, {text_col} string")


def sql_str(s: str) -> str:
    """A DuckDB string expression equal to ``s`` (control characters via chr())."""
    parts: list[str] = []
    buf = ""
    for ch in s:
        o = ord(ch)
        if o < 32 or o in (0x85, 0x2028, 0x2029) or o == 0x7F:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({o})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def probe_sql(id_col: str, text_col: str) -> str:
    rows = ", ".join(f"({i}, {sql_str(t)})" for i, t in TEXT_PROBES)
    return f"SELECT * FROM (VALUES {rows}) AS probe({id_col}, {text_col})"


# Fixed probe pages (page_id, url, html) in the layouts the extraction rules target.
DOC_PAGE = ('<div id="divContentDoc"><div class="content1"><div><div><table><tr><td>ỦY BAN</td>'
            '<td>CỘNG HÒA</td></tr><tr><td>Số: 1/QĐ</td><td>Hà Nội, ngày 1</td></tr></table>'
            '<p>Điều 1. <b>A</b></p><p>Điều 2. B</p><table><tr><td>Nơi nhận: X</td><td>Ông Y</td>'
            '</tr></table>phụ lục <table class="t"><tr><td>1</td><td>2</td></tr></table>hết'
            '</div></div></div></div>')
DEEP_PAGE = ('<html><body><div id="divContentDoc"><div class="content1"><div><div><table><tr><td>SỞ'
             '<td>CỘNG HÒA<tr><td>Số: 2/QĐ<td>ngày "2"</table><div><p>Điều 1. Sâu</p>'
             '<p>Điều 2. it\'s</div><table><tr><td>Nơi nhận:\nZ<td>Bà W</table></div></div></div>'
             '</div></body></html>')
ONE_TABLE_PAGE = ('<div id="divContentDoc"><div class="content1"><div><div><table><tr><td>A</td>'
                  '<td>B</td></tr></table><p>x</p></div></div></div></div>')
RESULT_PAGE = ('<div id="block-info-advan"><div>head</div><div><div class="content-0"><div class="left-col">'
               '<div class="nq"><p class="nqTitle"><a href="u1">1</a></p></div><div class="nq">'
               '<p class="nqTitle"><a href="u2">2</a></p></div></div></div><div class="content-1">'
               '<div class="left-col"><div class="nq"><p class="nqTitle"><a href="u2">2</a></p></div>'
               '<div class="nq"><p class="nqTitle"><a href="u3">3</a></p></div></div></div></div></div>'
               '<div class="cmPager"><a href="tim.aspx?page=2">2</a></div>')
STATUTE_PAGE = ('<html><body><div id="toanvancontent"><p>LUẬT  MẪU</p>\n<p>Chương I</p>\n\n'
                '<p>Điều 1. Phạm   vi</p>\n \n<p>\t"a" it\'s &amp; &copy;</p>\n<p>Điều 2. Hai</p>'
                '\n<p>b</p></div></body></html>')
PAGE_PROBES = [
    (-101, "u1", DOC_PAGE),
    (-102, "u2", DEEP_PAGE),
    (-103, "u3", ONE_TABLE_PAGE),
    (-104, "https://legal.example/search?page=1", RESULT_PAGE),
    (-105, "https://laws.example/statute/1", STATUTE_PAGE),
]

"""Shred + extraction against the FIXTURES §3 pages."""
import json

from statuta.operators import html as H
from statuta.operators.shred import shred, shred_html
from statuta.plans import probes


def pages(spark):
    return spark.createDataFrame(probes.PAGE_PROBES, "page_id bigint, url string, html string")


def by_page(df):
    return {r["page_id"]: r for r in df.collect()}


def test_header_fields(spark):
    p = pages(spark)
    got = by_page(H.header_fields(shred(p), p))
    r = got[-101]
    assert (r.org, r.cou, r.doc_id, r.date) == ("ỦY BAN", "CỘNG HÒA", "Số: 1/QĐ", "Hà Nội, ngày 1")
    assert (r.receiver, r.signer, r.status) == ("Nơi nhận: X", "Ông Y", "ok")
    assert got[-102].signer == "Bà W" and got[-102].org == "SỞ"   # unclosed td
    assert got[-103].status == "few_tables"
    assert got[-104].status == "no_container"


def test_paragraphs_and_fallback(spark):
    p = pages(spark)
    got = by_page(H.paragraphs(shred(p), pages=p))
    assert got[-101].content == "Điều 1. A Điều 2. B" and got[-101].level == 1
    assert got[-102].level == 2 and got[-102].content.startswith("Điều 1. Sâu")
    assert got[-104].content == "" and got[-104].level is None


def test_tables_and_appendix(spark):
    p = pages(spark)
    el = shred(p)
    app = by_page(H.appendix_tables(el, p))
    assert json.loads(app[-101].appendix) == [[["1", "2"]]] and app[-101].n_appendix_tables == 1
    assert app[-102].appendix == "[]" and app[-103].status == "few_tables"
    ca = by_page(H.content_and_appendix(el, p))[-101]
    assert json.loads(ca.appendix) == [{"text": "phụ lục", "table": [["1", "2"]]}, {"text": "hết", "table": []}]
    assert ca.content == "Điều 1. A Điều 2. B"
    assert by_page(H.content_and_appendix(el, p, compat=True))[-101].content == ""


def test_links(spark):
    el = shred(pages(spark))
    got = [r.href for r in H.document_links(el).orderBy("block", "seq").collect()]
    assert got == ["u1", "u2", "u2", "u3"]
    compat = [r.href for r in H.document_links(el, compat=True).orderBy("block", "seq").collect()]
    assert compat == ["u1", "u2", "u1", "u2"]
    assert [r.url for r in H.pager_links(el, "B/").collect()] == ["B/tim.aspx?page=2"]


def test_main_text(spark):
    p = pages(spark)
    got = by_page(H.main_text(shred(p), p))
    assert got[-105].text.startswith("LUẬT MẪU\nChương I\nĐiều 1. Phạm vi\na it s &amp; ©")
    assert got[-101].status == "no_main_text"


def test_parser_repairs_tree():
    rows = shred_html(1, '<p>a<p>b<div>c</div><script>var t="</p>";</script><ul><li>x<li>y</ul>')
    tags = [(r[5], r[2]) for r in rows]
    assert tags[:3] == [("p", None), ("p", None), ("div", None)]
    assert [r[14] for r in rows if r[5] == "li"] == ["x", "y"]


def test_links_of_all_navigation_blocks_and_between(spark):
    from statuta.plans.catalog import page_hrefs

    html = ('<a href="a">1</a><nav class="x"><a title="t" href="b">2</a></nav><p><a href="c">3</a></p>'
            '<nav><ul><li><a\nhref="d">4</a></li></ul></nav><a href="e">5</a>')
    pages = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    got = [(r["pos"], r["href"], r["in_nav"]) for r in page_hrefs(pages).orderBy("pos").collect()]
    assert got == [(0, "a", False), (1, "b", True), (2, "c", False), (3, "d", True), (4, "e", False)]


def test_paragraphs_with_attributes_and_line_breaks(spark):
    from statuta.plans.catalog import merged_paragraphs

    rows = [(1, '<p class="a">x <b>y</b></p>\n<p\n id="q">one\ntwo</p><p>open<div>z</div>'), (2, "<div>none</div>")]
    got = {r["page_id"]: (r["content"], r["n_paragraphs"])
           for r in merged_paragraphs(spark.createDataFrame(rows, "page_id bigint, html string")).collect()}
    assert got == {1: ("x y one\ntwo open", 3), 2: ("", 0)}

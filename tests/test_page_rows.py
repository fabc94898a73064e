"""Extraction on pages that carry their elements, against the element relation."""
from statuta.operators import html as H
from statuta.operators.shred import shred, shred_html
from statuta.plans import jobs, probes

NESTED = ('<div id="divContentDoc"><div class="content1"><div><div><table><tr><td>a</td><td>b<br/></td></tr><tr></tr>'
          '<tr><td>c<td>d</table><p class="x">q&amp;r</p><table><tr><td>e</td><td>f</td></tr></table><p>later</p>'
          '<table><tr><td>g<table><tr><td>h</td></tr></table></td><td>i</td></tr></table>t<table></table>'
          '<p>end</p></div></div></div></div>')
PAGES = [*((i, html) for i, _, html in probes.PAGE_PROBES), (1, NESTED), (2, None), (3, "")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, html string")


def same(a, b):
    key = lambda r: [repr(r[c]) for c in sorted(a.columns)]
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def cases(p):
    x = H.document_elements(p)
    yield H.with_fields(x).select("page_id", *H.FIELDS, "n_tables", "status"), H.header_fields
    yield H.with_tables(x).select("page_id", "appendix", "n_appendix_tables", "status"), H.appendix_tables
    for compat in (False, True):
        yield (H.with_split(x, compat).select("page_id", "content", "appendix", "n_entries", "status"),
               lambda el, pages, compat=compat: H.content_and_appendix(el, pages, compat))
        yield H.page_document_links(p, compat), lambda el, _, compat=compat: H.document_links(el, compat)
    yield H.page_main_text(p), H.main_text


def test_pages_give_what_their_elements_give(spark):
    p = frame(spark)
    el = shred(p).persist()
    for own, shared in cases(p):
        same(own, shared(el, p))
    paragraphs = H.with_paragraphs(H.document_elements(p)).where("level IS NOT NULL").select("page_id", "level", "content")
    same(paragraphs, H.paragraphs(el))


def test_extraction_shuffles_no_page(spark):
    p = frame(spark)
    for own, _ in cases(p):
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_pages_that_share_an_id_are_read_together(spark):
    p = frame(spark, [*PAGES, (-104, probes.RESULT_PAGE)])
    found = H.by_page(p, H.page_document_links, lambda el, _: H.document_links(el))
    same(found, H.document_links(shred(p)))


def test_listed_statutes(spark):
    pages = spark.createDataFrame(probes.PAGE_PROBES, "page_id bigint, url string, html string")
    urls = spark.createDataFrame([(7, "https://laws.example/statute/1"), (8, "nowhere")], "law_id bigint, url string")
    [row] = jobs.statute_text(pages, url_dim=urls).collect()
    assert row.law_id == 7 and row.status == "ok" and row.text.startswith("LUẬT MẪU\nChương I")


def test_plain_tags_are_read_as_the_parser_reads_them():
    from statuta.operators import shred as module

    odd = (NESTED + '<A HREF="x">1</A><a href="y" href="z">2</a><script>if (a<b) {"</p>"}</script><title>a<b></title>'
           '<p\n id="u">x</p ><br/><div/>é<!-- c --><a title="&lt;" href=\'q\'>3</a></nothing><textarea><p></textarea><p')
    plain = [shred_html(1, odd), module.PLAIN_START, module.PLAIN_END]
    never = module.re.compile("(?!)")
    module.PLAIN_START = module.PLAIN_END = never
    try:
        assert shred_html(1, odd) == plain[0]
    finally:
        module.PLAIN_START, module.PLAIN_END = plain[1:]
    for r in plain[0]:
        assert odd[r[12]] == "<"

"""Pages are composed where their rows lie, and parsed once for all that is asked of them."""
from statuta.operators import html as H
from statuta.operators.shred import shred
from statuta.plans import jobs
from statuta.plans import pagesets as PS
from statuta.plans.probes import PAGE_PROBES
from tests.conftest import SF_SMALL


def test_composed_pages_are_not_shuffled(spark):
    for pages in (PS.document_pages, PS.result_pages, PS.statute_pages):
        plan = pages(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan, pages


def test_pager_links_of_a_page_are_those_of_its_elements(spark):
    html = ('<div class="cmPager"><a href="1">a</a> <A HREF="2&amp;3">b</A><a>no</a><p><a href="4">in</a></p></div>'
            '<div class="cmPager"><span><a href="5"></a></span><a href="6"></div><a href="7">')
    pages = spark.createDataFrame([(1, html), (1, html), (2, None), (3, ""), *[(p[0], p[2]) for p in PAGE_PROBES]],
                                  "page_id bigint, html string")
    want = sorted(H.pager_links(shred(pages, tags=frozenset({"a"})), "b/").collect())
    assert sorted(H.page_pager_links(pages, "b/").collect()) == want
    assert [r.url for r in want if r.page_id == 1][:4] == ["b/1", "b/1", "b/2&3", "b/2&3"]


def test_links_of_a_store_are_worked_out_once(spark, scratch):
    pages = spark.createDataFrame(PAGE_PROBES, "page_id bigint, url string, html string")
    seen = spark.sparkContext.accumulator(0)

    def parse(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    links = spark.createDataFrame([("u1",), ("u2",), ("none",)], "link string").mapInPandas(parse, "link string")
    added = jobs._store_linked(spark, links, lambda urls: pages.join(urls, "url", "left_semi"), f"{scratch}/store", "d", None)
    assert sorted(r.link for r in added.collect()) == ["u1", "u2"]
    assert seen.value == 3

"""Plain tags are read by their context, and an extraction takes only what it reads out of the shred."""
import random

import pytest

from statuta.operators import html as H
from statuta.operators import shred as S
from test_page_rows import PAGES, frame, same

TAGS = ["p", "div", "table", "tr", "td", "th", "li", "ul", "b", "br"]
ATTRS = ["", "", ' id="a/b.c#d"', ' class="x y"\n id="q"', ' class=""', ' id="r" id="s"']


def parsed(src, text, only):
    """The kept rows of the parser, with the rows inside each."""
    p = S._Shredder(src, text)
    p.feed(src)
    rows = [r for r in p.finish() if r[5] in only]
    return [[*r[:10], None, None, *r[12:], sum(r[1] < x[1] <= r[4] for x in rows)] for r in rows]


@pytest.mark.parametrize("contexts", [S.CONTEXTS, 3])
def test_kept_rows_equal_the_parser(contexts, monkeypatch):
    monkeypatch.setattr(S, "CONTEXTS", contexts)
    rng = random.Random(5)
    only, text = frozenset({"div", "table", "tr", "td", "p", "br"}), frozenset({"td", "p"})
    one = S._Plain(text, only)
    for i in range(1500):
        some = [*ATTRS, f' id="n{i}"']
        src = "".join(rng.choice([f"<{rng.choice(TAGS)}{rng.choice(some)}>", f"</{rng.choice(TAGS)}>", " x > y\n", "z"])
                      for _ in range(rng.randint(0, 30)))
        assert one.rows(src) == parsed(src, text, only), src
    assert one.known <= contexts + 30


def test_other_pages_keep_the_same_rows():
    only = frozenset({"p", "a"})
    plain = S._Plain(only, only)
    for src in ["a &amp; <p>b<a>c</a><p>d", "<p>a < b</p>", "<P>x<b>y</b></P>", "<script>a</script><p>b", None]:
        got = S._tag_rows(src, plain)
        assert [[*r[:10], None, None, *r[12:]] for r in got] == ([] if src is None else parsed(src, only, only))


def test_header_fields_move_tables_alone(spark):
    p = frame(spark)
    x = H.document_elements(p, H.TABLE_TAGS, H.LEAST_COLUMNS, html=False)
    assert "html" not in x.columns
    assert set(x.schema["els"].dataType.elementType.names) == {"tag", "path", "text", "at", "inside"}
    [tags] = x.selectExpr("explode(els) AS e").selectExpr("collect_set(e.tag) AS t", "1 AS n").select("t").collect()
    assert set(tags.t) <= H.TABLE_TAGS
    columns = ["page_id", *H.FIELDS, "n_tables", "status"]
    same(H.with_fields(x).select(*columns), H.with_fields(H.document_elements(p)).select(*columns))
    columns = ["page_id", "appendix", "n_appendix_tables", "status"]
    same(H.with_tables(x).select(*columns), H.with_tables(H.document_elements(p)).select(*columns))
    assert len(PAGES) == p.count()


def test_paragraphs_move_paragraphs_alone(spark):
    p = frame(spark)
    x = H.document_elements(p, H.PARAGRAPH_TAGS, H.LEAST_COLUMNS, html=False)
    assert "html" not in x.columns
    assert x.selectExpr("explode(els) AS e").where("e.tag <> 'p'").isEmpty()
    columns = ["page_id", "level", "content"]
    same(H.with_paragraphs(x).select(*columns), H.with_paragraphs(H.document_elements(p)).select(*columns))

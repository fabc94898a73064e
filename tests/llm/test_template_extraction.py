"""Operator 13: template deduction on composed sites, and the given pages against a plain reading."""
import html as entities
import random
import re
import time

from tests.llm.helpers import SF

from statuta.llm import template_extraction as te
from statuta.llm.queries import REGISTRY

SCHEMA = "page_id long, url string, html string"
WORDS = "the river of small towns was long and over many years its people built a bridge from stone to cross it".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.randrange(10**6)}."


def site(rng, k, host, article, before="", after=""):
    """A page: ``article`` places the paragraphs, the rest is the host's template."""
    paragraphs = [prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(3, 7))]
    title = prose(rng, 6)
    body = article(title, paragraphs)
    page = (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{before}{body}{after}"
            f"<footer>&copy; {host}</footer></body></html>")
    return (f"http://{host}/{k}.html", page, "\n".join([title, *paragraphs]))


def layouts():
    marked = lambda t, ps: f"<article><h1>{t}</h1>" + "".join(f"<p>{p}" for p in ps) + "</article>"
    divs = lambda t, ps: (f"<div id='page'><div class='lead c12'><h1>{t}</h1></div><div class='text'>"
                          + "".join(f"<div>{p}</div>" for p in ps) + "</div></div>")
    noisy = lambda t, ps: (f"<main><header><h1>{t}</h1></header>" + "".join(f"<p>{p}</p>" for p in ps)
                           + "<p class=x>Please read our rules before you write to us.</p>"
                           "<ul><li><a href=/a>Next one</a><li><a href=/b>Last one</a></ul>"
                           "<div class='comments'><p>I liked this very much, thank you all.</p></div>"
                           "<aside>See also</aside><form>Name <input></form></main>")
    return [("plain.example", marked, "<nav><ul><li><a href=/>Home</a></ul></nav>", ""),
            ("divs.example", divs, "<div class='menu'>Home About</div>", "<div class='side-bar sidebar'>Popular now</div>"),
            ("noisy.example", noisy, "<div id=cookie-notice>We use cookies</div>", "<div class=ad>Buy now &amp; save</div>")]


def composed(n=12, seed=1):
    rng, rows = random.Random(seed), []
    for host, article, before, after in layouts():
        for k in range(n):
            rows.append((len(rows), *site(rng, k, host, article, before, after)))
    return rows


def extract(spark, rows):
    df = spark.createDataFrame([tuple(r[:3]) for r in rows], SCHEMA).selectExpr(
        "*", "'x' AS host", "'x' AS token", "'x' AS `group`", "'x' AS paths", "'x' AS text", "1 AS n_chars", "1 AS `a.b`")
    out = te.extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return got


def test_composed_sites(spark):
    rows = composed()
    got = {r["page_id"]: r["text"] for r in extract(spark, rows)}
    assert got == {i: text for i, _, _, text in rows}


def test_sites_under_the_minimum_are_pooled(spark):
    rng, rows = random.Random(2), []
    host, article, before, after = layouts()[0]
    for k in range(15):
        rows.append((k, *site(rng, k, f"h{k}.example", article, before, after)))
    assert {r["page_id"]: r["text"] for r in extract(spark, rows)} == {i: t for i, _, _, t in rows}


def test_two_layouts_on_one_host(spark):
    rng, rows = random.Random(3), []
    for host, article, before, after in layouts()[:2]:
        for k in range(10):
            rows.append((len(rows), *site(rng, len(rows), "one.example", article, before, after)))
    assert {r["page_id"]: r["text"] for r in extract(spark, rows)} == {i: t for i, _, _, t in rows}


def test_copies_keep_their_text(spark):
    rng = random.Random(4)
    host, article, before, after = layouts()[0]
    url, page, text = site(rng, 1, host, article, before, after)
    rows = [(1, url, page, text)] * 20
    assert [r["text"] for r in extract(spark, rows)] == [text] * 20


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://h/", "plain  text\n here"), (None, "http://h/", "<p>a<p>b"),
            (5, "http://h/", "<!-- open <p>lost</p>"), (6, "http://h/", "<p>x<script>var a='<p>no</p>'"),
            (7, "http://h/", "1 < 2 &amp; 3 &lt; 4 &am &nbsp;end"), (8, "http://h/", "<p>a<a href='x>b"),
            (9, "http://h/", "<p>one<br>two <b>th</b>ree</p></div></b><p>four"), (10, "//H:80/x", "<ul><li>a<li>b</ul>")]
    got = {r["page_id"]: r["text"] for r in extract(spark, rows)}
    assert got == {1: "", 2: "", 3: "plain text here", None: "a\nb", 5: "", 6: "x", 7: "1 < 2 & 3 < 4 &am end", 8: "ab",
                   9: "one two three\nfour", 10: "a\nb"}
    assert extract(spark, rows * 2).__len__() == 2 * len(rows)


def test_empty_table(spark):
    assert extract(spark, []) == []


def article_text(page):
    """The article of the given pages, read plainly."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner)
    lines = [" ".join(entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in REGISTRY["op13_template_extraction"](spark, SF).collect()}
    assert got == {i: article_text(h) for i, h in pages.items()}


def test_vectors_tell_classes_apart(spark):
    """Classes by hashed sums are those by whole occurrence vectors."""
    rows = composed(n=9)
    df = spark.createDataFrame([r[:3] for r in rows], SCHEMA).selectExpr("*", "xxhash64(split(url, '/')[2]) AS host")
    _, classes = te.token_classes(df)
    got = {}
    for r in classes.collect():
        got.setdefault((r["group"], r["class"]), set()).add(r["token"])
    vectors = {}
    for r in df.collect():
        tokens = te.Page(r["html"]).tokens
        for t in set(tokens):
            vectors.setdefault((r["host"], t), {})[r["page_id"]] = tokens.count(t)
    brute = {}
    for (host, t), v in vectors.items():
        if len(v) >= max(te.MIN_SUPPORT, te.MIN_SHARE * 9):
            brute.setdefault((host, tuple(sorted(v.items()))), set()).add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute.values()))


def test_validity():
    ab, cd = {1: 7, 2: 7}, {3: 8, 4: 8}
    places = lambda tokens: {c: v[2] for c, v in te.class_places(tokens, {**ab, **cd}).items()}
    assert places([1, 3, 4, 3, 4, 2]) == {7: True, 8: True}
    assert places([1, 2, 2, 1])[7] is False                      # another order
    assert places([1, 3, 2, 4]) == {7: True, 8: False}           # crossing
    assert places([3, 4, 1, 3, 4, 2])[8] is False                # two gaps
    first, second = (te.class_places([1, *x, 2], {1: 7, 5: 7, 2: 7, **cd})[8][1] for x in ((3, 4, 5), (5, 3, 4)))
    assert first != second


def test_long_pages_take_time_in_proportion():
    def seconds(n):
        page = "<div><b><p>word</a> <i>x" * n + "<ul><li>a" * n + "<td" * n + "</div>" * n + "'\"<x " * n
        start = time.process_time()
        te.main_text(te.Page(page), {}, frozenset())
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 8 * max(seconds(4_000), 0.05)

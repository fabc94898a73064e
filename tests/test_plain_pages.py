"""Pages of plain tags are read in one pass and give what the parser gives."""
import random

from statuta.operators import shred as S


def parsed(src, tags=None):
    p = S._Shredder(src, tags)
    p.feed(src)
    return p.finish()


def test_plain_pages_equal_the_parser():
    rng = random.Random(11)
    tags = ["p", "div", "table", "tr", "td", "th", "li", "ul", "b", "a", "br", "h1", "button", "span"]
    attrs = ["", "", ' id="a/b.c#d"', ' class="x y"\n id="q"', ' href="u v"', ' class=""', ' id="r" id="s"']
    plain = 0
    for _ in range(3000):
        src = "".join(rng.choice([f"<{rng.choice(tags)}{rng.choice(attrs)}>", f"</{rng.choice(tags)}>", " x > y\n", "z"])
                      for _ in range(rng.randint(0, 30)))
        for wanted in (None, frozenset({"p", "td", "div"})):
            got = S._plain_rows(src, wanted)
            plain += got is not None
            assert got == parsed(src, wanted), src
    assert plain == 6000


def test_other_pages_go_to_the_parser():
    for src in ["a &amp; b", "<p>a < b</p>", "<!-- x --><p>", "<P>x</P>", "<br/>", "<p id=x>y", "<script>a</script>",
                "<p id='x'>", "<p", "<p hidden>"]:
        assert S._plain_rows(src, None) is None
        assert S.shred_html(0, src) == [[0, *r[1:]] for r in parsed(src)]

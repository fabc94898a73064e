"""Column functions for cleaning and keying legal text.

Every function maps ``Column -> Column`` with built-in Spark expressions only, so the
work stays inside whole-stage code generation.  ``compat=True`` reproduces the
literal behaviour of the original cleaning rules where it differs from the
intended one (see README, "Quirks").
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the original rules)
# ---------------------------------------------------------------------------
# Whitespace class equal to Python's str.split()/str.strip() whitespace:
# ASCII \t \n \v \f \r, the separators U+001C..U+001F, NEL U+0085 and all of
# Unicode category Z.  Written so that Java regex and RE2 read it the same way.
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
CHAPTER_PREFIX = "Chương"
ARTICLE_PREFIX = "Điều"
ARTICLE_WORD_LOWER = "điều"
MULTIPLE_CHOICE_TYPE = "Trắc nghiệm"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), rf"^{PY_SPACE}+|{PY_SPACE}+\z", "")


def strip_tags(c) -> Column:
    """TX1: remove ``<...>`` non-greedily; ``.`` stops at a newline only."""
    return F.regexp_replace(_c(c), r"(?d)<.*?>", "")


def strip_tags_flat(c) -> Column:
    """TX2: newline, CR, backslash and both quotes become spaces, then TX1."""
    return strip_tags(F.translate(_c(c), "\n\r\\'\"", "     "))


def strip_tags_keep_newlines(c) -> Column:
    """TX3: CR, tab, backslash and both quotes become spaces, then TX1."""
    return strip_tags(F.translate(_c(c), "\r\t\\'\"", "     "))


def normalize_quotes(c) -> Column:
    """TX5: newline/CR become spaces, double quote becomes an apostrophe."""
    return F.translate(_c(c), "\n\r\"", "  '")


def strip_tags_multiline(c) -> Column:
    """TX4: remove ``<[^>]+>`` (tags may span lines), strip, then TX5."""
    return normalize_quotes(py_strip(F.regexp_replace(_c(c), r"<[^>]+>", "")))


def delete_tag_block(c, tag: str, compat: bool = False) -> Column:
    """TX6: delete ``<tag ...>...</tag>`` blocks, then strip.

    Default matches tags with or without attributes and blocks over several lines.
    ``compat`` needs a space after the tag name and stays on one line.
    """
    if compat:
        pattern = rf"(?d)<{tag} (.*?)</{tag}>"
    else:
        pattern = rf"(?s)<{tag}\b.*?</{tag}>"
    return py_strip(F.regexp_replace(_c(c), pattern, ""))


def normalize_whitespace(c, compat: bool = False) -> Column:
    """TX7: collapse spaces and blank lines.

    Default is the closed form (all runs collapse).  ``compat`` repeats each of
    the five replacements ten times, as the original does, so runs longer than
    1024 are only shortened.
    """
    c = _c(c)
    if not compat:
        return F.regexp_replace(F.regexp_replace(c, " +", " "), " ?\n[ \n]*", "\n")
    for pattern, repl in (("  ", " "), (" \n", "\n"), ("\n ", "\n"),
                          ("\n \n", "\n"), ("\n\n", "\n")):
        for _ in range(10):
            c = F.replace(c, F.lit(pattern), F.lit(repl))
    return c


def collapse_whitespace(c) -> Column:
    """TX8: ``" ".join(s.split())`` -- one space between words, trimmed."""
    return F.trim(F.regexp_replace(_c(c), f"{PY_SPACE}+", " "))


def article_number(line) -> Column:
    """TX9: number of an article heading, -1 when it does not parse."""
    head = F.split_part(F.lower(_c(line)), F.lit("."), F.lit(1))
    num = py_strip(F.replace(head, F.lit(ARTICLE_WORD_LOWER), F.lit("")))
    return F.coalesce(num.try_cast("bigint"), F.lit(-1).cast("bigint"))


def heading_kind(line) -> Column:
    """TX10: 'chapter', 'article' or 'body' (prefix test is case-sensitive)."""
    line = _c(line)
    return (F.when(line.startswith(CHAPTER_PREFIX), F.lit("chapter"))
            .when(line.startswith(ARTICLE_PREFIX) & (article_number(line) > 0), F.lit("article"))
            .otherwise(F.lit("body")))


def law_key(law, article) -> Column:
    """TX11: composite key ``"{law}-{article}"``."""
    return F.concat_ws("-", _c(law).cast("string"), _c(article).cast("string"))


def whole_float_to_int(c) -> Column:
    """FLT2 helper: ``'5.0'`` -> ``'5'``; other text unchanged."""
    return F.regexp_replace(_c(c), r"^(\d+)\.0+$", "$1")


def gold_keys(law, art, compat: bool = False) -> Column:
    """TX12: gold article keys from a law name and an article field.

    The law id is the text before the first ``.``.  ``compat``: when the field
    contains the article word, take word 2 (split on one space) and build one key
    per ``,`` part, empty parts included.  Default: drop the article word and
    ignore empty parts.
    """
    law_id = F.split_part(_c(law), F.lit("."), F.lit(1))
    art = whole_float_to_int(_c(art).cast("string"))
    if compat:
        art = F.when(art.contains(ARTICLE_PREFIX),
                     F.get(F.split(art, " "), 1)).otherwise(art)
        parts = F.transform(F.split(art, ","), lambda p: py_strip(p))
    else:
        art = F.replace(art, F.lit(ARTICLE_PREFIX), F.lit(""))
        parts = F.filter(F.transform(F.split(art, ","), lambda p: py_strip(p)),
                         lambda p: p != "")
    return F.transform(parts, lambda p: F.concat(law_id, F.lit("-"), p))


def tokens(c) -> Column:
    """TX13: split on one space; empty tokens are kept, newline is not a separator."""
    return F.split(_c(c), " ")


def lines(c) -> Column:
    """TX14 helper: split text into lines on ``\\n``."""
    return F.split(_c(c), "\n")


def with_choice(question, choice) -> Column:
    """TX15: question and choice joined by a newline."""
    return F.concat(_c(question), F.lit("\n"), _c(choice))


def escape_apostrophes(c) -> Column:
    """TX17: apostrophes become spaces before storing."""
    return F.translate(_c(c), "'", " ")


def fold_case(c) -> Column:
    """TX18: lower-case names for lookups."""
    return F.lower(_c(c))

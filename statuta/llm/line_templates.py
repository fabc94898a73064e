"""Operator 3: line dedup with a log-template tree of fixed depth.

A line's tokens that hold a digit become the field mark ``<*>``.  The tree sorts lines by
token count, then by their first ``LEADING`` tokens.  Inside a leaf a template leaves one
variable field open: the tokens after the leading ones form ``FIELDS`` even segments, and
lines that agree in all but one segment share the template with that segment open (at
most a fifth of a line's tokens).  Masked tokens are variable like open ones: a template
needs two thirds of its tokens constant, and a line without such a template, as a row of
numbers or one of fewer than ``FIELD_TOKENS`` tokens, only shares one with lines of the very
same tokens.  A template is recurring if it occurs in two or more documents.  A line that is
not the first (by doc_id, then line number) of one of its recurring templates is a
candidate; it is dropped if the first line of one of these templates is no candidate
itself.  So every line that goes repeats a template whose first line stays.

DataFrame functions only.  Lines travel as hashes: leaf statistics collapse map-side, so a
line that a third of all rows hold is one row per task; segments are only exploded in
leaves that hold different lines and occur in several documents.  The text itself moves
once, to meet its list of dropped line numbers.

Defined cases: blank lines are never dropped; a null text stays null
and an empty one empty; rows with a null doc_id are left as they are; a repeated row is the
same document, and is treated like its first; a line repeated inside one document only is
kept; other columns pass through.  Keys are 64-bit hashes of whole lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, whole_row

#: Fewest tokens of a line whose template may leave a field open.
FIELD_TOKENS = 5
LEADING = 3
FIELDS = 6
MASK = "<*>"
#: Least share of a template's tokens that are neither masked nor in the open segment.
CONSTANT = (2, 3)


def spaced(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def masked(line: Column) -> Column:
    """The line with single spaces, and tokens that hold a digit masked."""
    fields = F.regexp_replace(spaced(line), r"[^ 0-9]*+[0-9][^ ]*+", MASK)
    # the linear test spares most lines the rewriting
    return F.when(line.rlike(r"[0-9\x09-\x0D]|  |^ | $"), fields).otherwise(line)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a token: document, line number, leaf and segment hashes,
    the templates with enough constant tokens (``wordy``), and the whole line's hash."""
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.split(text_col, "\n").alias("lines"))
    # the hash is taken before the generator, so that it is not taken again for every line
    lines = lines.select("doc_id", "version", F.posexplode("lines").alias("line_no", "line"))
    tokens = lines.select("doc_id", "version", "line_no", "line", F.split(masked(F.col("line")), " ").alias("w")).where(
        F.col("w")[0] != "")
    rest = f"greatest(size(w) - {LEADING}, 0)"
    slices = [f"slice(w, {LEADING + 1} + {rest} * {j} div {FIELDS},"
              f" {rest} * {j + 1} div {FIELDS} - {rest} * {j} div {FIELDS})" for j in range(FIELDS)]
    least, of = CONSTANT
    # tokens of ``w`` outside an open segment that are not masked, and the templates where they suffice, as bits
    words = "filter({}, t -> t <> '" + MASK + "')"
    constant = [f"(size({words.format('w')}) - size({words.format(x)}))" for x in slices]
    wordy = " + ".join(f"IF({c} * {of} >= size(w) * {least}, {1 << j}, 0)" for j, c in enumerate(constant))
    keys = tokens.select(
        "doc_id", "version", "line_no", "line", F.expr(f"xxhash64(size(w), slice(w, 1, {LEADING}))").alias("leaf"),
        F.expr(f"array({', '.join(f'xxhash64({x})' for x in slices)})").alias("segments"),
        F.expr(f"CASE WHEN size(w) < {FIELD_TOKENS} THEN 0 WHEN array_contains(w, '{MASK}') THEN {wordy}"
               f" ELSE {(1 << FIELDS) - 1} END").alias("wordy"))
    return keys.select("doc_id", "version", "line_no", "leaf", "segments", F.col("wordy").cast("byte").alias("wordy"),
                       F.when(F.col("wordy") > 0, F.xxhash64("segments")).otherwise(
                           F.xxhash64(F.split(spaced(F.col("line")), " "))).alias("line"))


def _recurrence(*more: Column) -> list[Column]:
    return [F.min(F.struct("doc_id", "line_no")).alias("first"), F.min("doc_id").alias("low"),
            F.max("doc_id").alias("high"), *more]


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, line_no of every line that repeats a template of an earlier document."""
    keys = shared(line_keys(docs, id_col, text_col), "lines")
    leaves = shared(
        keys.groupBy("leaf").agg(*_recurrence(F.min("line").alias("a"), F.max("line").alias("b")))
        .where("low <> high").select("leaf", "first", (F.col("a") == F.col("b")).alias("alike")), "leaves")
    found = keys.join(leaves, "leaf")
    later = F.struct("doc_id", "line_no") != F.col("first")
    same = found.where(F.col("alike") & later).select("doc_id", "version", "line_no")
    mixed = shared(found.where(~F.col("alike")).select(
        "doc_id", "version", "line_no",
        F.explode(F.when(F.col("wordy") > 0, F.array_compact(F.array(*[
            F.when(F.col("wordy").bitwiseAND(F.lit(1 << j).cast("byte")) > 0, F.xxhash64(
                F.col("leaf"), F.lit(j), *[F.col("segments")[i] for i in range(FIELDS) if i != j]))
            for j in range(FIELDS)]))).otherwise(F.array(F.xxhash64(F.col("leaf"), F.lit(-1), "line")))
        ).alias("template")), "templates")
    recurring = shared(mixed.groupBy("template").agg(*_recurrence()).where("low <> high")
                       .select("template", "first"), "recurring")
    varied = shared(mixed.join(recurring, "template").where(later).select(
        "doc_id", "version", "line_no", F.col("first.doc_id").alias("first_doc"),
        F.col("first.line_no").alias("first_line")), "varied")
    # first lines that are candidates themselves; made distinct first, as one may anchor many lines
    anchor = ["first_doc", "first_line"]
    candidates = varied.select(F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line")).distinct()
    gone = shared(varied.select(*anchor).distinct().join(candidates, anchor, "left_semi"), "lost-anchors")
    anchored = varied.join(gone, anchor, "left_anti")
    return same.union(anchored.select("doc_id", "version", "line_no"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with recurring lines cut from the text, and ``n_lines_dropped``."""
    drops = dropped_lines(docs, id_col, text_col).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set("line_no")).alias("drop"))
    # the row travels as one struct, so that no column of ``docs`` meets one of ours
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(text_col).alias("version"))
    joined = rows.join(drops, ["doc_id", "version"], "left")
    # whether each line goes, up to the last one that does; zip_with splits the text once
    drop = F.col("drop")
    gaps = F.transform(drop, lambda d, k: d - F.when(k > 0, F.get(drop, k - 1) + 1).otherwise(0))
    goes = F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
    lines = F.zip_with(F.split(F.col("row")[text_col], "\n"), goes, lambda line, g: F.when(g, None).otherwise(line))
    cut = F.array_join(lines, "\n")
    return joined.select(
        *[F.when(F.col("drop").isNull(), F.col("row")[c]).otherwise(cut).alias(c) if c == text_col
          else F.col("row")[c].alias(c) for c in docs.columns],
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_lines_dropped"))

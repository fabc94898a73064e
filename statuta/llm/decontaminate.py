"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items and documents are sets of five-word shingles.  Items are partitioned by
the size of their set; a partition's sketch keeps, per item, the ``k`` shingles of smallest
hash, with ``k`` one more than the shingles that an item of that size may lack at the
asked containment.  A document that holds that share of an item must then hold one of its
sketch shingles, however long the document is, so the search loses no pair.  Candidates
are verified by counting shared shingles as strings.

DataFrame functions only.  Documents stream past the sketches; Spark broadcasts a sketch
table only if its written size allows, and else joins by hash with AQE splitting a hot
shingle.  Only candidate documents are read again.

Defined cases: words are the letter and digit runs of the lower-cased text; an item of one
to four words is a single shingle, its whole sequence, and documents are also searched for
word sequences of the lengths that such items have; a null or empty text has none and
is in no pair; rows with a null id have no pair, but ``drop_contaminated`` searches them by
their text; rows that share a doc_id are one
document and rows that share an item_id one item; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import row_columns, shared, whole_row

SHINGLE = 5
#: Least share, in percent, of an item's shingles that a leaking document holds.
CONTAINMENT = 80


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _short_runs(words: str, short: tuple[int, ...], run: str) -> list[str]:
    """One array per length: ``run`` of each slice of so many words."""
    kind = "bigint" if "hash" in run else "string"
    return [f"CASE WHEN size({words}) < {n} THEN cast(array() AS array<{kind}>) ELSE transform("
            f"sequence(1, size({words}) - {n} + 1), i -> {run.format(f'slice({words}, i, {n})')}) END" for n in short]


def _hashes(words: str, short: tuple[int, ...] = ()) -> Column:
    """One hash per shingle position; short texts give one hash of the whole sequence.  With
    ``short``, also one for every run of so many words."""
    if short:
        more = ", ".join(_short_runs(words, short, "xxhash64({})"))
        return F.concat(_hashes(words), F.expr(f"concat({more})"))
    parts = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"CASE WHEN size({words}) = 0 THEN cast(array() AS array<bigint>)"
                  f" WHEN size({words}) < {SHINGLE} THEN array(xxhash64({words}))"
                  f" ELSE transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({parts})) END")


def _shingles(words: str, short: tuple[int, ...] = ()) -> Column:
    if short:
        more = ", ".join(_short_runs(words, short, "array_join({}, ' ')"))
        return F.array_distinct(F.concat(_shingles(words), F.expr(f"concat({more})")))
    return F.expr(f"CASE WHEN size({words}) = 0 THEN cast(array() AS array<string>)"
                  f" WHEN size({words}) < {SHINGLE} THEN array(array_join({words}, ' '))"
                  f" ELSE array_distinct(transform(sequence(1, size({words}) - {SHINGLE} + 1),"
                  f" i -> array_join(slice({words}, i, {SHINGLE}), ' '))) END")


def item_shingles(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, shingle, n_item: the distinct shingles of every item."""
    one = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"),
                                                            _words(F.col(text_col)).alias("w"))
    rows = one.select("item_id", F.explode(_shingles("w")).alias("shingle")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    return rows.join(sizes, "item_id")


def item_sketches(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  percent: int = CONTAINMENT) -> DataFrame:
    """item_id, n_item and one sketch hash per row, partitioned by size class."""
    one = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"),
                                                            _words(F.col(text_col)).alias("w"))
    sets = one.select("item_id", F.explode(_hashes("w")).alias("hash")).groupBy("item_id").agg(
        F.sort_array(F.collect_set("hash")).alias("hashes"))
    sized = sets.select("item_id", "hashes", F.size("hashes").alias("n_item"),
                        F.floor(F.log2(F.size("hashes"))).cast("int").alias("size_class"))
    # the largest set of a class may lack this many shingles; one more makes a hit certain
    k = F.expr(f"cast(floor((pow(2, size_class + 1) - 1) * {100 - percent} / 100) AS int) + 1")
    return sized.select("item_id", "n_item", "size_class", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 percent: int = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or above ``percent``."""
    sketches = shared(item_sketches(benchmark, percent=percent), "sketches")
    lengths = benchmark.where("item_id IS NOT NULL").select(F.size(_words(F.col("text"))).alias("n"))
    # at most SHINGLE - 1 numbers
    short = tuple(sorted(r["n"] for r in lengths.where(F.col("n").between(1, SHINGLE - 1)).distinct().collect()))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("w"))
    hits = texts.select("doc_id", F.explode(_hashes("w", short)).alias("hash")).join(sketches, "hash")
    candidates = shared(hits.select("doc_id", "item_id").distinct(), "leak-candidates")
    suspects = shared(candidates.select("doc_id").distinct(), "leak-suspects")
    items = shared(item_shingles(benchmark), "item-shingles")
    found = texts.join(suspects, "doc_id").select("doc_id", F.explode(_shingles("w", short)).alias("shingle"))
    counts = found.join(items, "shingle").groupBy("doc_id", "item_id", "n_item").agg(
        F.count_distinct("shingle").alias("n_shared"))
    return (counts.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
            .join(candidates, ["doc_id", "item_id"], "left_semi")
            .select("doc_id", "item_id", "n_shared", "n_item",
                    (F.col("n_shared") / F.col("n_item")).alias("containment")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item; a row without doc_id is one by its text."""
    key = F.coalesce(F.col("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    keyed = docs.select(key.alias("doc_id"), "text")
    leaks = shared(contaminated(keyed, benchmark, **options).select(F.col("doc_id").alias("key")).distinct(), "leaks")
    rows = docs.select(whole_row(docs).alias("row"), key.alias("key"))
    return rows.join(leaks, "key", "left_anti").select(*row_columns(docs))

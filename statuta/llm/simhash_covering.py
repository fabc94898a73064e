"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles.
For a radius ``r`` bit ``i`` gets a nonzero vector of ``r + 1`` bits, and each of the
``2^(r+1) - 1`` nonzero vectors ``v`` is a table whose mask holds the bits with an odd
inner product.  Any ``r`` differing bits leave a ``v`` orthogonal to all of them, so the
pair agrees under that mask: every pair within the radius meets in some bucket.

Copies collapse first: the tables hold each distinct fingerprint once, which is also its
node among the links.  Buckets of up to ``BUCKET_ROWS`` fingerprints are compared in one task and give
the spanning stars of their links, not their pairs.  Fingerprints of larger buckets are
linked through midpoints: two of them are within four bits exactly if some value is
within two bits of both, so each meets its 2081 two-bit neighbours as hubs.  No bucket is
cut.  Components come from distributed stars (``components``).

Defined cases: null or blank text has fingerprint zero and links like any other; texts
under ``shingle`` words are one shingle; repeated rows each get a row; rows with a null
doc_id link like others, and a component is named by its smallest doc_id, or null if it has
none.  ``one_of_each`` keeps one row of every component, named or not; ``keep_one`` keeps
those with a doc_id.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, ship, whole_row
from statuta.llm.components import connected_components

ship(__name__)

BITS = 64
SHINGLE = 4
RADIUS = 4
BUCKET_ROWS = 256
#: Shingle hashes counted at a time, which bounds the memory of a very long text.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42)
                           for i in range(start, min(n, start + CHUNK))], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed 64-bit integers, one per table."""
    top = 2 ** (radius + 1) - 1
    vectors = [i % top + 1 for i in range(BITS)]
    words = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, top + 1)]
    return [w - (1 << BITS) if w >> (BITS - 1) else w for w in words]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _ball(radius: int) -> list[int]:
    """All 64-bit values with at most ``radius`` bits set."""
    out, layer = [0], [(0, -1)]
    for _ in range(radius):
        layer = [(x | 1 << i, i) for x, last in layer for i in range(last + 1, BITS)]
        out += [_signed(x) for x, _ in layer]
    return out


def bucket_links(radius: int):
    """Rows (fps, reps) of one bucket each -> star links (u, v) of its parts within the radius."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for fps, reps in zip(batch["fps"], batch["reps"]):
                fps, reps = np.asarray(fps, dtype=np.int64), np.asarray(reps, dtype=np.int64)
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
                left = near.sum(axis=1) > 1
                for i in np.flatnonzero(left):
                    if not left[i]:
                        continue
                    part = near[i]
                    while (grown := near[part].any(axis=0)).sum() > part.sum():
                        part = grown
                    left &= ~part
                    ids = reps[part]
                    us.append(ids[ids != ids.min()])
                    vs.append(np.full(len(us[-1]), ids.min()))
            yield pd.DataFrame({"u": np.concatenate(us) if us else np.empty(0, np.int64),
                                "v": np.concatenate(vs) if vs else np.empty(0, np.int64)})

    return run


def links_within(reps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``reps`` (fp distinct, rep) -> links (u, v) that connect exactly the fingerprints
    which are connected through steps of at most ``radius`` bits."""
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for t, m in enumerate(masks(radius))])
    buckets = reps.where("rep IS NOT NULL").select("fp", "rep", F.explode(tables).alias("b")).select(
        "fp", "rep", "b.t", "b.key")
    shared_keys = shared(buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = buckets.join(shared_keys, ["t", "key"])
    small = (met.where(F.col("n") <= bucket_rows).groupBy("t", "key")
             .agg(F.collect_list(F.struct("fp", "rep")).alias("m")).select("m.fp", "m.rep").toDF("fps", "reps")
             .mapInPandas(bucket_links(radius), "u long, v long"))
    hubs = (met.where(F.col("n") > bucket_rows).select("fp", "rep").distinct()
            .select("rep", F.explode(F.transform(F.array(*[F.lit(x) for x in _ball((radius + 1) // 2)]),
                                                 lambda x: F.col("fp").bitwiseXOR(x))).alias("hub")))
    if radius % 2:  # an odd radius has no exact midpoint: hubs of a larger ball would link too much
        raise ValueError("the hubs of large buckets need an even radius")
    low = hubs.groupBy("hub").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    large = hubs.join(low, "hub").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    return small.union(large)


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int,
                bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, fp) per row, and (fp, node) per fingerprint; a component's node is its smallest fingerprint."""
    prints = shared(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"),
                                fingerprint_column(F.col(text_col), shingle).alias("fp")), "simhash")
    points = shared(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = connected_components(links_within(points.select("fp", F.col("fp").alias("rep")), radius, bucket_rows))
    named = points.join(found.withColumnRenamed("node", "_node"), F.col("fp") == F.col("_node"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("node"))
    return prints, shared(named, "simhash-nodes")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document row."""
    prints, nodes = _components(docs, id_col, text_col, shingle, radius, bucket_rows)
    names = nodes.groupBy("node").agg(F.min("low").alias("component_id"))
    named = nodes.join(names, "node").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of every near-duplicate group: the one of smallest doc_id (nulls last), then of
    smallest text hash."""
    prints, nodes = _components(docs, id_col, text_col, shingle, radius, bucket_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("first")
    per_print = prints.groupBy("fp").agg(first)
    kept = shared(per_print.join(nodes, "fp").groupBy("node").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.version").alias("_version")), "simhash-kept")
    # the row travels as one struct, so that no column of ``docs`` meets one of ours
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(text_col).alias("version"))
    met = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left_semi")
    return met.dropDuplicates(["doc_id", "version"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``one_of_each``, without the rows that have no doc_id."""
    return one_of_each(docs, **options).where(F.col(options.get("id_col", "doc_id")).isNotNull())

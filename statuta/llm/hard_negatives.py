"""Operator 12: hard-negative mining by segment summary filtering.

Every vector is cut into segments, at three levels from one segment down to segments of four
components; a segment stores its mean and its deviation (the length of what is left after
the mean is taken off).  For two vectors the inner product is the sum over segments of
``size * mean * mean`` give or take at most ``deviation * deviation``, so a level bounds every
score from both sides.  Rows against anchors go through the levels from coarse to fine; rows
and anchors without a pair inside the wanted range leave, and only what is left is scored
exactly, in integers.

Anchors are a stated query set (``vec_id`` divisible by ``EVERY``), taken in blocks of bounded
bytes that are broadcast one at a time against all rows.  A first pass keeps each anchor's
best rows of its own label.  A second pass keeps, for each anchor and positive, the best rows of
other labels inside the range of scores that the positive allows.  A task holds only the best
few so far, whose worst one narrows the range for the rows that follow; the tasks' bests
are merged by a shuffle keyed by anchor.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component,
take no part; components beyond +-4096 before scaling count as that bound, so that scores are exact
in 64 bits; a shorter vector is filled with zeros; rows of equal vec_id and equal score
count once in a list, an anchor that repeats is one anchor, and rows of its own vec_id are
never its partners; ties go by vec_id; other columns are not read; an empty table, or one
without anchors, gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, ship

ship(__name__)

#: Anchors, and rows whose label moves on by one, have a vec_id divisible by these.
EVERY, MOVED = 50, 7
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE, BOUND = 256, 1 << 20
#: Components of a segment, from the coarsest level (0: the whole vector) to the finest.
LEVELS = (0, 16, 4)
#: Most bytes of anchors in a block; anchors and rows of a tile that is scored at a time.
BLOCK_BYTES, ANCHORS, ROWS = 8 << 20, 1024, 1024


def prepare(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, labels moved, components as integers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND))))
                         .cast("int"))
    return rows.select("vec_id", label.alias("label"), scaled.alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :min(len(v), width)] = v[:width]
    return out


def summary(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled means and deviations of the segments of ``size`` components (0: one segment)."""
    n, width = x.shape
    size = size or max(1, width)
    parts = -(-width // size) if width else 0
    padded = np.zeros((n, parts * size))
    padded[:, :width] = x
    seg = padded.reshape(n, parts, size)
    mean = seg.mean(axis=2)
    return mean * np.sqrt(size), np.sqrt(((seg - mean[:, :, None]) ** 2).sum(axis=2))


class Bounded:
    """Vectors with their summaries at every level."""

    def __init__(self, x: np.ndarray, levels: list | None = None):
        self.x = x
        self.levels = [summary(x, size) for size in LEVELS if size < x.shape[1]] if levels is None else levels

    def take(self, at) -> Bounded:
        return Bounded(self.x[at], [(m[at], d[at]) for m, d in self.levels])


def scores_within(anchors: Bounded, rows: Bounded, allowed: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(anchor index, row index, score) arrays of the allowed pairs with low <= score <= high.

    ``allowed`` is a mask of pairs; ``low`` and ``high`` hold one bound per anchor.  Each level
    lets go the pairs that its bounds prove outside, and rows and anchors without pairs.
    """
    a_at, r_at = np.arange(len(anchors.x)), np.arange(len(rows.x))
    for k in range(len(anchors.levels) + 1):
        keep_a, keep_r = allowed.any(axis=1), allowed.any(axis=0)
        if not keep_a.all() or not keep_r.all():
            ka, kr = np.flatnonzero(keep_a), np.flatnonzero(keep_r)
            allowed, low, high = allowed[np.ix_(ka, kr)], low[ka], high[ka]
            anchors, rows, a_at, r_at = anchors.take(ka), rows.take(kr), a_at[ka], r_at[kr]
        if not len(a_at) or not len(r_at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if k == len(anchors.levels):
            break
        (am, ad), (rm, rd) = anchors.levels[k], rows.levels[k]
        centre, spread = am @ rm.T, ad @ rd.T
        spread *= 1 + 1e-9
        spread += 1e-9 * np.abs(centre).max() + 1e-3
        allowed = allowed & (centre + spread >= low[:, None])
        if np.isfinite(high).any():
            allowed &= centre - spread <= high[:, None]
    score = anchors.x @ rows.x.T
    a, r = np.nonzero(allowed & (score >= low[:, None]) & (score <= high[:, None]))
    return a_at[a], r_at[r], score[a, r].astype(np.int64)


class Best:
    """The ``most`` highest distinct (score, smaller vec_id) of each key so far."""

    def __init__(self, most: int):
        self.most = most
        self.key, self.score, self.vec_id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(key):
            return
        key, score, vec_id = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, key))
        key, score, vec_id = key[order], score[order], vec_id[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (vec_id[1:] != vec_id[:-1])
        key, score, vec_id = key[new], score[new], vec_id[new]
        keep = np.arange(len(key)) - np.searchsorted(key, key) < self.most
        self.key, self.score, self.vec_id = key[keep], score[keep], vec_id[keep]

    def floor(self, start: np.ndarray) -> np.ndarray:
        """Per key the score that a new entry must reach: ``start`` until ``most`` are held."""
        out = start.copy()
        last = np.arange(len(self.key)) - np.searchsorted(self.key, self.key) == self.most - 1
        out[self.key[last]] = self.score[last]
        return out


def _row_blocks(batches, width: int):
    """Blocks of at most ROWS rows: vec_id, label, bounded vectors."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at:at + ROWS]
            yield (part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64),
                   Bounded(matrix(part["v"].tolist(), width)))


def _tiles(labels: np.ndarray):
    """Slices of at most ANCHORS anchors of one label; anchors are sorted by label."""
    for low in np.unique(labels):
        first, end = np.searchsorted(labels, [low, low + 1])
        for at in range(first, end, ANCHORS):
            yield slice(at, min(at + ANCHORS, end))


def _positives(block):
    """The best rows of each anchor's label, as far as a task has seen."""
    def run(batches):
        keys, ids, labels, x = block.value
        anchors = Bounded(x)
        tiles = [(t, anchors.take(t), Best(POSITIVES)) for t in _tiles(labels)]
        for row_ids, row_labels, rows in _row_blocks(batches, x.shape[1]):
            for t, some, best in tiles:
                own = np.flatnonzero(row_labels == labels[t.start])
                if len(own):
                    n = t.stop - t.start
                    allowed = ids[t][:, None] != row_ids[own][None, :]
                    a, r, score = scores_within(some, rows.take(own), allowed, best.floor(np.full(n, -np.inf)),
                                                np.full(n, np.inf))
                    best.add(a, score, row_ids[own[r]])
        for t, _, best in tiles:
            yield pd.DataFrame({"anchor": keys[t][best.key], "anchor_id": ids[t][best.key],
                                "positive_score": best.score, "positive_id": best.vec_id})

    return run


def _negatives(block):
    """The best rows of other labels inside each positive's range, as far as a task has seen."""
    def run(batches):
        keys, ids, labels, x, p_score, p_id, p_has = block.value
        anchors = Bounded(x)
        lows = np.where(p_has, -(-LOW * p_score // 100), np.inf)
        highs = np.where(p_has, HIGH * p_score // 100, -np.inf)
        tiles = [(t, anchors.take(t), Best(NEGATIVES)) for t in _tiles(labels)]
        for row_ids, row_labels, rows in _row_blocks(batches, x.shape[1]):
            for t, some, best in tiles:
                n = t.stop - t.start
                # a key is a place in the table of positives: anchor * POSITIVES + number
                low = best.floor(lows[t].ravel()).reshape(n, POSITIVES)
                open_ = low <= highs[t]
                low, high = np.where(open_, low, np.inf), np.where(open_, highs[t], -np.inf)
                other = np.flatnonzero(row_labels != labels[t.start])
                allowed = (ids[t][:, None] != row_ids[other][None, :]) & open_.any(axis=1)[:, None]
                a, r, score = scores_within(some, rows.take(other), allowed, low.min(axis=1), high.max(axis=1))
                for j in range(POSITIVES):
                    fits = (score >= low[a, j]) & (score <= high[a, j])
                    best.add(a[fits] * POSITIVES + j, score[fits], row_ids[other[r[fits]]])
        for t, _, best in tiles:
            a, j = best.key // POSITIVES, best.key % POSITIVES
            yield pd.DataFrame({"anchor": keys[t][a], "anchor_id": ids[t][a], "positive_score": p_score[t][a, j],
                                "positive_id": p_id[t][a, j], "negative_score": best.score,
                                "negative_id": best.vec_id})

    return run


def _best(found: DataFrame, keys: list[str], score: str, vec_id: str, most: int) -> DataFrame:
    """The ``most`` best per key with their rank; a task hands on at most ``most`` per key."""
    order = F.struct((-F.col(score)).alias("by"), F.col(vec_id).alias("id"))
    some = found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set(order)), 1, most).alias("best"))
    return some.select(*keys, F.posexplode("best").alias("rank", "b")).select(
        *keys, (F.col("rank") + 1).cast("int").alias("rank"), (-F.col("b.by")).alias(score), F.col("b.id").alias(vec_id))


def _blocks(anchors: DataFrame, width: int, block_bytes: int, positives: DataFrame | None = None):
    """Blocks of anchors as arrays, fetched one at a time; a block's bytes are bounded."""
    most = max(1, block_bytes // (8 * max(1, width)))
    n_blocks = -(-anchors.count() // most)
    if positives is not None:
        pairs = positives.groupBy("anchor").agg(
            F.array_sort(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("wanted"))
        anchors = anchors.join(pairs, "anchor")
    for b in range(n_blocks):
        part = anchors.where(F.pmod(F.col("anchor"), F.lit(n_blocks)) == b).toPandas()
        part = part.sort_values(["label", "anchor"])
        if not len(part):
            continue
        data = (part["anchor"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64),
                part["label"].to_numpy(np.int64), matrix(part["v"].tolist(), width))
        if positives is not None:
            score, vec_id = (np.zeros((len(part), POSITIVES), np.int64) for _ in range(2))
            has = np.zeros((len(part), POSITIVES), bool)
            for a, wanted in enumerate(part["wanted"]):
                for j, (_, s, i) in enumerate(wanted):
                    score[a, j], vec_id[a, j], has[a, j] = s, i, True
            data = (*data, score, vec_id, has)
        yield data


def _against_rows(rows: DataFrame, blocks, step, schema: str, name: str) -> DataFrame | None:
    """Every block against all rows, one block at a time."""
    found = None
    for block in blocks:
        held = rows.sparkSession.sparkContext.broadcast(block)
        part = shared(rows.mapInPandas(step(held), schema), name)
        held.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def hard_negatives(embeddings: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = prepare(embeddings)
    # an anchor is one distinct (vec_id, label, vector); its key spreads evenly over blocks
    anchors = shared(rows.where(F.col("vec_id") % EVERY == 0).distinct().select(
        F.xxhash64("vec_id", "label", "v").alias("anchor"), "vec_id", "label", "v"), "anchors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    one = "anchor long, anchor_id long, positive_score long, positive_id long"
    own = _against_rows(rows, _blocks(anchors, width, block_bytes), _positives, one, "own")
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long,"
                                        " positive_score long, negative_score long")
    if own is None:
        return nothing
    pairs = shared(_best(own, ["anchor", "anchor_id"], "positive_score", "positive_id", POSITIVES), "positives")
    other = _against_rows(rows, _blocks(anchors, width, block_bytes, pairs), _negatives,
                          one + ", negative_score long, negative_id long", "others")
    if other is None:
        return nothing
    keys = ["anchor", "anchor_id", "positive_id", "positive_score"]
    return _best(other, keys, "negative_score", "negative_id", NEGATIVES).select(*out)

"""Operator 12 against brute force."""
import math
import random

import numpy as np
import pytest

from tests.llm.helpers import SF

from statuta.llm import hard_negatives as hn
from statuta.llm.queries import REGISTRY

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows):
    """By the contract, for rows of distinct vec_id and equal lengths."""
    live = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label,
                     np.array([math.floor(256 * float(np.float32(x))) for x in v], dtype=object)))
    out = []
    for a, la, va in live:
        if a % 50:
            continue
        scored = sorted((-int((va * v).sum()), i, lb) for i, lb, v in live if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fits = [s for s in scored if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i, _) in enumerate(fits)]
    return sorted(out)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(n, width=12, labels=4, seed=3, near=True):
    rng = random.Random(seed)
    base = [rng.gauss(0, 0.3) for _ in range(width)]
    return [(i, rng.randrange(labels), [round((b if near else 0) + rng.gauss(0, 0.4), 2) for b in base]) for i in range(n)]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS anchor", "'x' AS v", "'x' AS best", "1 AS rank")


@pytest.mark.parametrize("block_bytes", [hn.BLOCK_BYTES, 100])
def test_blocks_match_brute_force(spark, block_bytes):
    rows = vectors(260)
    assert result(hn.hard_negatives(embeddings(spark, rows), block_bytes)) == brute(rows) != []


def test_odd_rows(spark):
    rows = vectors(160, width=5)
    rows += [(1000, None, [1.0] * 5), (1001, 1, None), (1002, 1, [1.0, None, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 5),
             (1003, 1, [float("nan")] * 5), (1050, 2, [float("inf")] + [0.0] * 4), (1100, 3, [0.0] * 5)]
    assert result(hn.hard_negatives(embeddings(spark, rows))) == brute(rows)


def test_ties_and_one_common_vector(spark):
    rows = [(i, i % 3, [0.5, 0.25, 0.5] if i % 2 else [0.25, 0.25, 0.5]) for i in range(220)]
    assert result(hn.hard_negatives(embeddings(spark, rows).repartition(5))) == brute(rows) != []


def test_few_partners_and_negative_scores(spark):
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (50, 5, [1.0, 0.0]), (100, 6, [-1.0, 0.0]),
            (3, 6, [1.0, 0.0]), (4, 2, [0.9, 0.4])]
    assert result(hn.hard_negatives(embeddings(spark, rows))) == brute(rows) != []


def test_repeated_rows_count_once(spark):
    rows = vectors(120)
    assert result(hn.hard_negatives(embeddings(spark, rows * 3))) == brute(rows) != []


def test_short_and_empty_vectors(spark):
    rows = vectors(110, width=6)
    padded = [(i, la, v if i % 3 else v[:2] + [0.0] * 4) for i, la, v in rows]
    short = [(i, la, v if i % 3 else v[:2]) for i, la, v in rows]
    assert result(hn.hard_negatives(embeddings(spark, short))) == brute(padded)
    assert result(hn.hard_negatives(embeddings(spark, [(i, la, []) for i, la, _ in rows]))) == brute(
        [(i, la, [0.0]) for i, la, _ in rows])


def test_large_components_are_bounded(spark):
    rows = [(i, la, [1e30 if i == 3 else x for x in v]) for i, la, v in vectors(60)]
    held = [(i, la, [4096.0 if i == 3 else x for x in v]) for i, la, v in vectors(60)]
    assert result(hn.hard_negatives(embeddings(spark, rows))) == brute(held)


def test_empty_table_and_no_anchor(spark):
    assert result(hn.hard_negatives(embeddings(spark, []))) == []
    assert result(hn.hard_negatives(embeddings(spark, [(1, 1, [1.0]), (2, 2, [0.7])]))) == []


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert result(REGISTRY["op12_hard_negatives"](spark, SF)) == brute(rows) != []


def test_bounds_hold_and_get_tighter():
    rng = np.random.default_rng(1)
    x, y = np.floor(rng.normal(2, 40, (30, 64))), np.floor(rng.normal(2, 40, (40, 64)))
    exact, widths = x @ y.T, []
    for (xm, xd), (ym, yd) in zip(hn.Bounded(x).levels, hn.Bounded(y).levels):
        centre, spread = xm @ ym.T, xd @ yd.T
        assert (np.abs(exact - centre) <= spread + 1e-6).all()
        widths.append(spread.mean())
    assert widths == sorted(widths, reverse=True) and len(widths) == 3

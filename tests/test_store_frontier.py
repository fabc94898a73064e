"""Insert-if-absent, bookmarks (FIXTURES §8) and frontier rounds."""
from pyspark.sql import functions as F

from statuta.operators import frontier, sink, store

SCHEMA = "k string, v string, o bigint"


def test_insert_if_absent_batches(spark, scratch):
    path = f"{scratch}/sink"
    b1 = spark.createDataFrame([("k1", "v1", 1), ("k1", "v2", 2), ("k2", "v3", 3)], SCHEMA)
    b2 = spark.createDataFrame([("k2", "v4", 4), ("k3", "v5", 5)], SCHEMA)
    assert store.append_if_absent(spark, path, b1, ["k"], ["o"]).count() == 2
    assert store.append_if_absent(spark, path, b2, ["k"], ["o"]).count() == 1
    assert store.append_if_absent(spark, path, b2, ["k"], ["o"]).count() == 0  # replay
    got = sorted((r["k"], r["v"]) for r in sink.read_rows(spark, path, SCHEMA).collect())
    assert got == [("k1", "v1"), ("k2", "v3"), ("k3", "v5")]


def test_first_per_key_hot_key(spark):
    rows = [("hot", str(i), i) for i in range(500, 0, -1)] + [("cold", "c", 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = {r["k"]: r["v"] for r in store.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"hot": "1", "cold": "c"}


def test_bookmark(spark):
    ops = spark.createDataFrame([("c", "set", "u1", 1), ("c", "set", "u2", 2), ("c", "set", "u3", 3)],
                                "crawler string, op string, link string, n bigint")
    assert store.apply_bookmark_ops(ops, ["crawler"], "op", "link", ["n"]).first()["link"] == "u3"
    cleared = ops.unionByName(spark.createDataFrame([("c", "clear", None, 4)], ops.schema))
    assert store.apply_bookmark_ops(cleared, ["crawler"], "op", "link", ["n"]).first()["link"] is None


def test_frontier_rounds(spark, scratch):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "b"), ("b", "s"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("s",)], "node string")
    got = {r["node"]: r["round"] for r in frontier.bfs_rounds(spark, edges, seeds, path=f"{scratch}/f").collect()}
    assert got == {"s": 0, "a": 1, "b": 1, "c": 2}
    sym = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    got2 = {r["node"]: r["round"] for r in
            frontier.bfs_rounds(spark, sym, seeds, symmetric=True, path=f"{scratch}/g").collect()}
    assert got2 == {"s": 0, "a": 1, "b": 1, "c": 2}

"""Frontier rounds over a link graph (ST4, SET2, SET3).

Round r+1 = targets of the round-r frontier, made distinct, minus every node
already visited (the frontier is broadcast after a size check, so the edge table
streams through without a shuffle and a hub node causes no skew); the loop stops when a round is empty (the original crashes on
an empty frontier instead).  Each round is appended to a parquet table in the
shared checkpoint folder, which cuts the lineage and survives executor loss; the
next round reads its frontier back from that table.

With ``symmetric=True`` (every edge also exists reversed) the neighbours of a
round-r node are in rounds r-1, r or r+1, so the anti-join only needs the last
two rounds instead of the whole visited set.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.session import broadcast_if_small, scratch_path

FRONTIER_BROADCAST_ROWS = 5_000_000


def bfs_rounds(spark: SparkSession, edges: DataFrame, seeds: DataFrame,
               symmetric: bool = False, max_rounds: int | None = None,
               path: str | None = None) -> DataFrame:
    """edges(src, dst), seeds(node) -> (node, round)."""
    path = path or scratch_path(spark, "frontier")
    # the edge table is never partitioned by node: a hub node would sit in one
    # partition every round; instead the (usually small) frontier is broadcast
    e = edges.select("src", "dst").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    seeds.select("node").distinct().withColumn("round", F.lit(0)).write.mode("overwrite").parquet(path)
    r = 0
    while max_rounds is None or r < max_rounds:
        visited = spark.read.parquet(path)
        frontier = visited.where(F.col("round") == r).select(F.col("node").alias("src"))
        frontier, _ = broadcast_if_small(frontier, FRONTIER_BROADCAST_ROWS)
        known = visited.where(F.col("round") >= r - 1) if symmetric else visited
        nxt = (e.join(frontier, "src").select(F.col("dst").alias("node")).distinct()
               .join(known.select("node"), "node", "left_anti"))
        r += 1
        nxt.withColumn("round", F.lit(r)).write.mode("append").parquet(path)
        if spark.read.parquet(path).where(F.col("round") == r).isEmpty():
            break
    e.unpersist()
    return spark.read.parquet(path)

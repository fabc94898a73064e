"""Partitions of tables and of costly rows."""
from statuta import session


def test_spread_partitions_do_not_grow(spark, scratch):
    spark.range(5000).selectExpr("id", "sha2(string(id), 512) AS v").coalesce(1).write.parquet(f"{scratch}/t")
    slots = spark.sparkContext.defaultParallelism
    read = lambda: session.spread(spark.read.parquet(f"{scratch}/t"), ["id"]).rdd.getNumPartitions()
    assert read() == slots
    before, session.SPREAD_BYTES = session.SPREAD_BYTES, 1 << 13
    try:
        assert read() > 2 * slots
    finally:
        session.SPREAD_BYTES = before


def test_composed_pages_are_spread(spark):
    rows = session.evenly(spark.range(1000).coalesce(1), ["id"])
    assert rows.rdd.getNumPartitions() == session.EVEN_PARTS * spark.sparkContext.defaultParallelism

"""Plan shapes the scale design relies on (checked on the physical plan text)."""
from pyspark.sql import functions as F

from statuta.operators import bm25, contain
from statuta.sources.tables import table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_for_tf(spark):
    docs = table(spark, SF, "documents")
    p = plan(bm25.term_frequencies(docs.select("doc_id", "text"), ["doc_id"], "text"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_tf_needs_no_token_shuffle(spark):
    docs = table(spark, SF, "documents").repartition(8, "doc_id")
    p = plan(bm25.term_frequencies(docs, ["doc_id"], "text"))
    # the only exchange is the one we asked for; aggregation reuses hash(doc_id)
    assert p.count("Exchange hashpartitioning") == 1


def test_scoring_broadcasts_query_side(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    idx = bm25.build_index(docs, ["doc_id"])
    s = bm25.scores(idx, table(spark, SF, "benchmark"), ["item_id"])
    assert "BroadcastHashJoin" in plan(s)
    idx.unpersist()


def test_containment_streams_documents(spark):
    docs = table(spark, SF, "documents")
    pairs = contain.containment_pairs(table(spark, SF, "benchmark"), ["item_id"], docs, "doc_id")
    p = plan(pairs)
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_short_passages_need_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "a bc d"), (2, "bcd e")], "doc_id bigint, text string")
    short = spark.createDataFrame([(1, "bc"), (2, "c d"), (3, " ")], "pid bigint, text string")
    p = plan(contain.containment_pairs(short, ["pid"], docs, "doc_id"))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_spread_runs_no_job(spark):
    from statuta.session import spread

    docs = table(spark, SF, "documents")
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        assert "REPARTITION" in plan(spread(docs, ["doc_id"]))
        bm25.term_frequencies(spread(docs, ["doc_id"]), ["doc_id"], "text")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_broadcast_needs_few_rows_and_bytes(spark):
    from statuta import session

    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "a bigint, b string")
    assert session.broadcast_if_small(df, 50)[1] and not session.broadcast_if_small(df, 49)[1]
    limit, session.MAX_BROADCAST_BYTES = session.MAX_BROADCAST_BYTES, 1000
    try:
        assert not session.broadcast_if_small(df, 50)[1]
    finally:
        session.MAX_BROADCAST_BYTES = limit


def test_filter_pushed_to_scan(spark):
    ev = table(spark, SF, "events").where(F.col("event_type") == "view").select("user_id")
    p = plan(ev)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in p


def test_python_only_in_the_shred(spark):
    from statuta.plans.catalog import REGISTRY

    python_nodes = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas")
    for name in ("bm25_top1", "passage_containment", "articles_all", "retrieval_accuracy", "strip_tags_plain"):
        p = plan(REGISTRY[name](spark, SF))
        assert not any(n in p for n in python_nodes), name
    assert "MapInPandas" in plan(REGISTRY["element_counts"](spark, SF))

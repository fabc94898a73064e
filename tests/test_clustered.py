"""Postings of a document lie in one partition; pairs that cannot reach a floor are not kept."""
from pyspark.sql import functions as F

from statuta import session
from statuta.operators import bm25
from statuta.plans import catalog


def above_the_postings(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]


def many_files(spark, folder):
    slots = spark.sparkContext.defaultParallelism
    docs = spark.range(200).selectExpr("id AS doc_id", "concat_ws(' ', 'a', 'b' || id % 7, 'c' || id % 3, 'd\\n' || id) AS text",
                                       "'en' AS lang", "'s' AS source")
    docs.repartition(2 * slots).write.parquet(f"{folder}/documents.parquet")


def test_pair_sums_are_not_shuffled(spark, scratch):
    many_files(spark, scratch)
    terms = F.broadcast(spark.createDataFrame([(0, "a", 1.0), (1, "b2", 1.0)], "_q bigint, token string, w double"))
    corpora = catalog.ranked_documents(spark, scratch), catalog.sentence_corpus(spark, scratch)
    for corpus, keys in zip(corpora, (["doc_id"], ["doc_id", "line_no"])):
        idx = bm25.build_index(corpus, keys)
        sums = bm25._partial(idx, terms, ["_q"])
        p = above_the_postings(sums)
        assert "HashAggregate" in p and "Exchange hashpartitioning" not in p
        assert sums.where("_q = 0").count() == 200
        idx.unpersist()


def test_partitions_of_many_files_do_not_grow(spark, scratch):
    many_files(spark, scratch)
    slots = spark.sparkContext.defaultParallelism
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    assert session.spread(docs, ["doc_id"]).rdd.getNumPartitions() <= 2 * slots
    assert session.clustered(docs, ["doc_id"]).rdd.getNumPartitions() == slots


def test_pairs_below_the_floor_are_not_kept(spark, monkeypatch):
    rows = [(i, " ".join(["the"] * (i % 5) + [f"w{i % 40}", f"x{i % 3}", "pad"])) for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "w3 x1 the"), (2, "w7 x2 pad the")], "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    expected = bm25.scores(idx, queries, ["qid"]).toPandas().sort_values(["qid", "score", "doc_id"], ascending=[1, 0, 1])
    kept, kind = [], type(idx.tf)
    persist = kind.persist
    monkeypatch.setattr(bm25, "MOST_POSTINGS", 1.0)
    monkeypatch.setattr(kind, "persist", lambda df, *level: (kept.append(df), persist(df, *level))[1])
    best = bm25.topk(idx, queries, ["qid"], 3).toPandas().sort_values(["qid", "rank"])
    partial = [df for df in kept if {"_q", "units", "floor", "rest"} <= set(df.columns)]
    assert partial and partial[0].where("units + rest < floor").isEmpty()
    want = expected.groupby("qid").head(3)
    assert best["doc_id"].tolist() == want["doc_id"].tolist()

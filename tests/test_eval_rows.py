"""Evaluation without a shuffle by question: articles of stored texts, asks, votes and labels of a row."""
import datetime

from pyspark.sql import functions as F

from statuta.operators import articles as A
from statuta.operators import bm25, qa
from statuta.plans import jobs
from tests.test_articles import LAW, WORDS, frame

LINE = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def lineitem(spark):
    day = datetime.datetime(1996, 1, 1)
    rows = [(o, n, p, 7, 1.0, 2.0 * (p or 0), 0.0, 0.0, f, s, d) for o, n, p, f, s, d in [
        (1, 2, 5, "A", "O", day), (1, 1, 9, "N", "F", day), (1, 1, 3, "R", "O", day), (1, 1, 3, "R", "O", day),
        (2, 1, 1, "A", "F", None), (2, 2, 1, None, "O", day), (3, None, 2, "N", None, day), (None, 1, 1, "A", "O", day),
        (3, 4, None, "R", "F", day)]]
    return spark.createDataFrame(rows, LINE)


def test_statute_arrays_are_the_lines(spark):
    li = lineitem(spark)
    want = {}
    for r in A.statute_lines_from_lineitem(li).orderBy("line_no").collect():
        want.setdefault(r.law_id, []).append(r.raw)
    texts = A.statute_texts_from_lineitem(li)
    assert {r.law_id: r.raws for r in texts.collect()} == want
    plan = A.statute_texts_from_lineitem(li)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_stored_texts_are_cut_without_keeping_lines(spark):
    laws = {i: ["LUẬT %d" % i] + (LAW[1:] if i % 2 else []) + [WORDS[(i * k) % len(WORDS)] for k in range(4 * i)]
            for i in range(1, 7)}
    texts = spark.createDataFrame([(i, "\n".join(x)) for i, x in laws.items()], "law_id bigint, text string")
    lines = A.statute_lines_from_text(texts.repartition(4, "law_id"))
    for compat in (False, True):
        want = {tuple(r) for r in A.segment_articles(frame(spark, laws), compat=compat).collect()}
        got = A.segment_articles(lines, compat=compat, block_lines=7 if compat else 20, again=True)
        assert {tuple(r) for r in got.collect()} == want
    plan = A.segment_articles(lines, again=True)._jdf.queryExecution().executedPlan().toString()
    assert "InMemory" not in plan and "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def questions(spark):
    rows = [(0, "tf", "b c", None, None, None, None, "g", ["1-1"]), (1, "mc", "b", "x", "nội dung", None, "c", "g", ["1-2", "1-9"]),
            (2, "mc", "q", None, None, None, None, "h", []), (3, "tf", "zzz", None, None, None, None, "h", ["1-3"]),
            (4, "tf", None, None, None, None, None, "g", None), (5, "tf", "Điều", None, None, None, None, None, [None]),
            (6, "mc", "d", "b", "b", "c", "c", "h", ["1-2"]), (7, "tf", "c b", "x", None, None, None, "g", ["1-3", "1-3"])]
    return spark.createDataFrame(rows, "qid long, kind string, quest string, A string, B string, C string, D string,"
                                       " grp string, gold array<string>")


def test_row_evaluation_is_the_relational_one(spark):
    laws = {1: ["LUẬT  MẪU", "Điều 1. b c", "Điều 2. c", "nội dung", "Điều 3. c b b", "Điều 4"], 2: ["T", "Điều 1. b", "d d"]}
    arts = A.segment_articles(frame(spark, laws))
    q = questions(spark)
    gold = q.select("qid", F.explode("gold").alias("key"))
    want = sorted(map(str, jobs.evaluate(arts, q.drop("gold"), gold, ["grp"]).collect()))
    by_row = jobs.evaluate(arts, q, None, ["grp"], unique=True)
    assert sorted(map(str, by_row.collect())) == want
    plan = jobs.evaluate(arts, q, None, ["grp"], unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and "hashpartitioning(grp" in plan


def test_question_rows_are_kept_packed(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "checkpoint", None)  # plain rows
    raw = spark.createDataFrame([("Đúng/Sai", "1. L", "2.0", "q", None, "a", "b", None, None, "f"),
                                 (None, "1", "1", "q", None, None, None, None, None, "f")],
                                "format string, law string, art string, quest string, anws string, A string, B string,"
                                " C string, D string, file string")
    q, gold = jobs.csv_questions(raw)
    assert [(r.kind, r.gold) for r in q.collect()] == [("tf", ["1-2"])] and [r.key for r in gold.collect()] == ["1-2"]


def test_index_keeps_the_asked_postings_only(spark):
    corpus = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, ""), (5, "a  c")], "k int, text string")
    asks = bm25.different_asks(spark.createDataFrame([("b a",), ("a b",), ("c",), (None,), ("z",)], "text string"))
    assert asks.count() == 3
    asked = asks.select(F.explode(F.split("text", " ")).alias("token")).distinct()
    whole, some = bm25.build_index(corpus, ["k"]), bm25.build_index(corpus, ["k"], asked=asked)
    assert {r.token for r in some.tf.select("token").collect()} == {"a", "b", "c"}
    assert some.stats.collect() == whole.stats.collect()
    assert sorted(some.vocab.collect()) == sorted(whole.vocab.collect())
    assert sorted(bm25.top1_of_asks(some, asks).collect()) == sorted(bm25.top1_of_asks(whole, asks).collect())


def test_vote_and_labels_of_a_row(spark):
    df = spark.createDataFrame([(1, "a", "b", "b", ["b"]), (2, "a", "b", None, ["a", "a"]), (3, None, None, None, ["x"]),
                                (4, None, "c", "a", None)], "q int, x string, y string, z string, g array<string>")
    got = qa.judge_rows(df.withColumn("p", qa.vote_row([F.col(c) for c in "xyz"])), "p", "g")
    assert [(r.p, r.n_gold, r.correct, r.any_match) for r in got.orderBy("q").collect()] == [
        ("b", 1, 1.0, 1.0), ("a", 2, 0.0, 1.0), (None, 1, 0.0, 0.0), ("c", 0, 0.0, 0.0)]

"""Votes, accuracy, choices (FIXTURES §6) and the containment join (FIXTURES §7)."""
import random

from pyspark.sql import functions as F

from statuta.operators import contain, qa


def test_vote_winner(spark):
    rows = [(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (1, 4, "z"),
            (2, 1, "x"), (2, 2, "y"), (2, 3, "y"), (2, 4, "x"),
            (3, 1, None)]
    df = spark.createDataFrame(rows, "qid bigint, choice_no bigint, key string")
    got = {r["qid"]: r["key"] for r in qa.vote(df, ["qid"], ["key"]).collect()}
    assert got == {1: "y", 2: "x"}


def test_accuracy_and_any_match(spark):
    preds = spark.createDataFrame([(1, "1-5"), (2, "1-6"), (3, "1-5")], "qid bigint, pred string")
    gold = spark.createDataFrame([(1, "1-5"), (2, "1-5"), (3, "1-5"), (3, "1-6")], "qid bigint, key string")
    j = qa.judge(preds, gold, ["qid"], "pred", "key")
    r = qa.accuracy(j.withColumn("g", F.lit(1)), ["g"]).first()
    assert (r["n"], r["accuracy"], r["any_match"]) == (3, round(1 / 3, 6), round(2 / 3, 6))


def test_expand_choices(spark):
    q = spark.createDataFrame([(1, "q", "a", None, "c", "d")], "qid bigint, quest string, A string, B string, C string, D string")
    got = sorted((r["choice"], r["text"]) for r in qa.expand_choices(q, ["qid"]).collect())
    assert got == [("A", "q\na"), ("C", "q\nc"), ("D", "q\nd")]
    nan = sorted(r["text"] for r in qa.expand_choices(q, ["qid"], drop_missing=False).collect())
    assert "q\nnan" in nan


def pairs(spark, passages, docs, compat=False):
    p = spark.createDataFrame(list(enumerate(passages)), "pid bigint, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    return sorted((r["pid"], r["doc_id"]) for r in contain.containment_pairs(p, ["pid"], d, "doc_id", compat=compat).collect())


def test_containment_fixture(spark):
    docs = ["x y z\nq", "y z", "ab c d", "xb c d"]
    passages = ["y z", "x y z", "q", "", "a b", "b c d"]
    assert pairs(spark, passages, docs) == [(0, 0), (0, 1), (1, 0), (2, 0), (5, 2), (5, 3)]
    with_blank = pairs(spark, passages, docs, compat=True)
    assert (3, 0) in with_blank and (3, 3) in with_blank


def test_containment_matches_brute_force(spark):
    rng = random.Random(11)
    alphabet = ["a", "b", "ab", "ba", "c", "", "a\nb"]
    docs = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    passages = []
    for _ in range(40):
        d = rng.choice(docs)
        i = rng.randint(0, len(d))
        passages.append(d[i:i + rng.randint(1, 8)])
    passages += [" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(20)]
    want = sorted((pi, di) for pi, p in enumerate(passages) for di, d in enumerate(docs)
                  if p.strip() != "" and p in d)
    assert pairs(spark, passages, docs) == want

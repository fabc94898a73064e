"""BM25 against FIXTURES §5 and a direct evaluation of the formula."""
import math
import random

from statuta.operators import bm25


def direct_scores(docs, query):
    n = len(docs)
    toks = [d.split(" ") for d in docs]
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: (eps if v < 0 else v) for w, v in raw.items()}
    out = []
    for t in toks:
        s = 0.0
        for q in query.split(" "):
            f = t.count(q)
            s += idf.get(q, 0.0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
        out.append(s)
    return out


def run(spark, docs, queries, compat=False):
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    qs = spark.createDataFrame(list(enumerate(queries)), "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    top = {r["qid"]: r["doc_id"] for r in bm25.top1(idx, qs, ["qid"], compat=compat).collect()}
    sc = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.scores(idx, qs, ["qid"]).collect()}
    return top, sc


def test_fixture_scores(spark):
    docs = ["a b a c", "b c d", "c d e e", "c f"]
    queries = ["a b", "c", "e e", "c a", "zzz"]
    top, sc = run(spark, docs, queries)
    assert round(sc[(0, 0)], 6) == 1.126841
    assert [round(sc[(1, d)], 6) for d in range(4)] == [0.013010, 0.014876, 0.013010, 0.017367]
    assert round(sc[(2, 2)], 6) == 2.253682
    assert top == {0: 0, 1: 3, 2: 2, 3: 0, 4: None}
    top_c, _ = run(spark, docs, queries, compat=True)
    assert top_c[4] == 0


def test_matches_direct_formula(spark):
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(12)]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    queries = [" ".join(rng.choice(vocab + ["zz"]) for _ in range(rng.randint(1, 4))) for _ in range(15)]
    top, sc = run(spark, docs, queries)
    for qi, q in enumerate(queries):
        want = [round(s, 6) for s in direct_scores(docs, q)]
        for d, s in enumerate(want):
            assert round(sc.get((qi, d), 0.0), 6) == s
        best = max(want)
        exp = want.index(best) if best > 0 else None
        assert top[qi] == exp


def test_topk_order(spark):
    docs = ["a b", "a", "b b", "c", "d", "e"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    qs = spark.createDataFrame([(0, "a b")], "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    got = [(r["rank"], r["doc_id"]) for r in bm25.topk(idx, qs, ["qid"], 2).orderBy("rank").collect()]
    want = direct_scores(docs, "a b")
    order = sorted(range(len(docs)), key=lambda d: (-want[d], d))
    assert got == [(1, order[0]), (2, order[1])]


def test_index_round_trip(spark, scratch):
    docs = ["a b a c", "b c d", "c d e e", "c f"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    qs = spark.createDataFrame([(0, "a b"), (1, "c")], "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    bm25.write_index(idx, f"{scratch}/idx")
    again = bm25.read_index(spark, f"{scratch}/idx")
    got = {r["qid"]: r["doc_id"] for r in bm25.top1(again, qs, ["qid"]).collect()}
    assert got == {0: 0, 1: 3}


def ranked_directly(docs, query, k, compat):
    want = [round(s, 6) for s in direct_scores(docs, query)]
    order = sorted(range(len(docs)), key=lambda d: (-want[d], d))
    return [(d, want[d] + 0.0) for d in order if compat or want[d] > 0][:k]


def check_ranking(spark, docs, queries, blocks=False, heavy=None, compats=(False, True)):
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    qs = spark.createDataFrame(list(enumerate(queries)), "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    idx = bm25.with_blocks(idx) if blocks else idx
    for compat in compats:
        got = {}
        for r in bm25.topk(idx, qs, ["qid"], 15, compat=compat).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["doc_id"], r["score"] + 0.0))
        best = {r["qid"]: r["doc_id"] for r in bm25.top1(idx, qs, ["qid"], compat=compat).collect()}
        for i, q in enumerate(queries):
            want = ranked_directly(docs, q, 15, compat)
            assert got.get(i, []) == want, (compat, q)
            assert best[i] == (want[0][0] if want else None)


def zipf_corpus(rng, n_docs, n_words, most=30):
    words = ["w%d" % i for i in range(n_words)]
    weights = [1 / (i + 1) for i in range(n_words)]
    return words, [" ".join(rng.choices(words, weights, k=rng.randint(1, most))) for _ in range(n_docs)]


def test_pruned_ranking_is_the_direct_one(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 4)
    rng = random.Random(3)
    words, docs = zipf_corpus(rng, 120, 200)
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(12)] + [docs[5], docs[7], "none such", ""]
    check_ranking(spark, docs, queries)
    check_ranking(spark, docs, queries, blocks=True, compats=(False,))


def test_negative_floor(spark):
    """Few words in nearly all documents: the mean idf, and so the floor, is negative."""
    rng = random.Random(4)
    docs = [" ".join(w for w in "abcd" if rng.random() < 0.9) or "a" for _ in range(30)] + ["e", "a e"]
    check_ranking(spark, docs, ["a b", "a", "e", "a e b", "zz", "d d c"])


def test_compat_fills_to_k(spark):
    docs = ["x y"] + ["a b"] * 3 + ["c"] * 40 + ["x"]
    check_ranking(spark, docs, ["x", "zz", "a"])


def test_batches_beyond_the_bound_are_scored_in_full(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_TERMS", 3)
    rng = random.Random(5)
    words, docs = zipf_corpus(rng, 40, 60)
    check_ranking(spark, docs, [" ".join(words[10:20]), docs[3]], compats=(False,))


def test_pairs_scored_in_full_are_few(spark):
    """Of all pairs of a passage and a document, under a tenth is scored in full."""
    rng = random.Random(6)
    words, docs = zipf_corpus(rng, 800, 3000, most=60)
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    queries = [" ".join(docs[i].split(" ")[:12]) for i in range(0, 800, 20)]
    qs = spark.createDataFrame(list(enumerate(queries)), "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    assert bm25.ranked(idx, qs, ["qid"], 1).count() < 0.1 * len(docs) * len(queries)
    assert bm25.scores(idx, qs, ["qid"]).count() > 0.3 * len(docs) * len(queries)


def test_queries_that_ask_the_same_are_ranked_once(spark):
    """Word order and copies do not matter; every query still has its own row."""
    corpus = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "c d")], "doc_id bigint, text string")
    qs = spark.createDataFrame([(i, "c d" if i % 2 else "d c") for i in range(40)] + [(40, "a"), (41, "zz")],
                               "qid bigint, text string")
    asks, asking = bm25.asked_once(qs, ["qid"])
    assert asks.select(bm25.ASK).distinct().count() == 3 and asking.count() == 42
    idx = bm25.build_index(corpus, ["doc_id"])
    got = {r.qid: r.doc_id for r in bm25.top1(idx, qs, ["qid"]).collect()}
    assert got == {**{i: 2 for i in range(40)}, 40: 0, 41: None}
    assert bm25.topk(idx, qs, ["qid"], 2).where("qid < 40 AND rank = 1 AND doc_id = 2").count() == 40


def test_many_near_pairs_are_added_up_in_place(spark, monkeypatch):
    """Pairs beyond a broadcast: the same ranking, and no shuffle by pair of query and document."""
    rng = random.Random(8)
    words, docs = zipf_corpus(rng, 200, 300)
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(4, "doc_id")
    queries = [" ".join(rng.choices(words, k=6)) for _ in range(10)]
    qs = spark.createDataFrame(list(enumerate(queries)), "qid bigint, text string")
    idx = bm25.build_index(corpus, ["doc_id"])
    monkeypatch.setattr(bm25, "QUERY_BROADCAST_ROWS", 0)
    found = bm25.ranked(idx, qs, ["qid"], 1)
    assert "Exchange hashpartitioning(_q" not in found._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    check_ranking(spark, docs, queries, compats=(False,))

"""Operator 9: terms of a text that is counted in parts, and ids with several texts."""
import random

import numpy as np

from tests.llm.helpers import DOCS, documents, labels

from statuta.llm import knn_quality


def test_parts_give_the_counts_of_one_pass(monkeypatch):
    rng = random.Random(9)
    table = knn_quality.class_table()
    pieces = ["word", "Word", "12", " ", "  ", "\n", "\n\n", ",", "é", "a a", "\t", "same line\n", "日本", "!?"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 120))) for _ in range(200)] + ["", None, "x" * 50, "\n", " "]
    whole = [knn_quality.term_counts(t, table) for t in texts]
    for chunk in (1, 7, 40):
        monkeypatch.setattr(knn_quality, "CHUNK", chunk)
        for text, counts in zip(texts, whole):
            assert np.array_equal(knn_quality.term_counts(text, table), counts), (chunk, text)
            assert "".join(knn_quality.text_parts(text or "")) == (text or "")


def test_several_texts_of_an_id_are_fitted_alike(spark):
    rows = [(i, f"{t} {i}", la, s) for i, t, la, s in DOCS if i is not None and t]
    rows += [(100 + i, "short and bad !!! " * (1 + i % 3), "en", "s") for i in range(12)]
    twice = rows + [(i, f"another text of {i} " * 5, la, s) for i, _, la, s in rows]
    marks = labels(spark, [(i, int(i < 100), 0) for i, *_ in rows])

    def scores(df):
        return sorted(((r["doc_id"], round(r["score"], 9)) for r in knn_quality.knn_quality(df, marks).collect()), key=str)

    df = documents(spark, twice)
    assert scores(df.repartition(5)) == scores(df.orderBy("text"))

"""Operator 5: licence scan with a positional index of rare licence words.

The index lists, for each licence template, the positions of its words.  Document
frequencies of all licence words are counted over the whole corpus; a template's anchors
are its words of highest inverse document frequency.  A file's anchor words are looked up,
and every posting gives the place where that template would start; postings of different
anchors are intersected by that place (a few words may have shifted), and the places that
``MIN_ANCHORS`` of them share are scored by the weighted share of template words found at
their relative positions.  A place counts only if the template's mandatory key phrases
stand there word for word, and if no rival template fits the same words better (so an
affero or lesser licence is not read as the general one).  Base phrases are found apart from
that.  Places of words and key phrases are listed once a file, so the time follows its length.

Counting is a Spark aggregation; the scan is one pass of Arrow batches with the index,
whose size is that of the fixed templates.  Nothing is shuffled but the word counts.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows each get a
row; templates of equal score at one place all count; other columns are not read.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import ship

ship(__name__)

# Base phrases, and licence notices with their mandatory key phrases.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
                   "license at http www apache org licenses license 2 0", ("compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("source and binary forms",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation", ("general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1",
     ("lesser general public license version 2 1",)),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3",
     ("lesser general public license version 3",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ("permission is hereby granted",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)
#: Highest-IDF words of a template that serve as its anchors.
ANCHORS = 3
#: Anchors that must agree on a place (all, of a template with fewer).
MIN_ANCHORS = 2
#: Least weighted share of a template's words, and the shift that still counts as in place.
MIN_SCORE = 0.6
SLACK = 2
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def places(words: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Starts of a phrase, given the places of its first word."""
    n = len(phrase)
    return [i for i in where.get(phrase[0], ()) if words[i:i + n] == phrase]


def build_index(idf: dict[bytes, float], templates=TEMPLATES) -> dict:
    """Postings of the anchor words, and the words, weights and key phrases of each template."""
    postings: dict[bytes, list[tuple[int, int]]] = {}
    entries, anchors = [], []
    for t, (label, text, keys) in enumerate(templates):
        words = words_of(text)
        entries.append((label, words, [idf.get(w, 0.0) for w in words], [words_of(k) for k in keys]))
        chosen = sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))[:ANCHORS]
        anchors.append(len(chosen))
        for anchor in chosen:
            postings.setdefault(anchor, []).extend((t, p) for p, w in enumerate(words) if w == anchor)
    return {"postings": postings, "entries": entries, "anchors": anchors}


def _fits(words: list[bytes], where: dict[bytes, list[int]], index: dict):
    """(matched weight, score, template, start) of the places where a template and its key phrases stand."""
    starts: dict[int, dict[int, set[bytes]]] = {}
    for word, postings in index["postings"].items():
        for i in where.get(word, ()):
            for t, p in postings:
                starts.setdefault(t, {}).setdefault(i - p, set()).add(word)
    phrases: dict[bytes, list[int]] = {}
    for t, found in starts.items():
        _, expected, weights, keys = index["entries"][t]
        total, needed = sum(weights), min(MIN_ANCHORS, index["anchors"][t])
        for start in found:
            low, high = start - SLACK, start + len(expected) + SLACK
            if len(set().union(*(found.get(s, ()) for s in range(low, start + SLACK + 1)))) < needed:
                continue
            for key in keys:
                name = b" ".join(key)
                if name not in phrases:
                    phrases[name] = places(words, where, key)
                at = bisect_left(phrases[name], low)
                if at == len(phrases[name]) or phrases[name][at] + len(key) > high:
                    break
            else:
                got = sum(weight for k, (w, weight) in enumerate(zip(expected, weights))
                          if w in words[max(0, start + k - SLACK):max(0, start + k + SLACK + 1)])
                if total > 0 and got >= MIN_SCORE * total:
                    yield got, min(1.0, got / total), t, start


def template_matches(words: list[bytes], where: dict[bytes, list[int]], index: dict) -> dict[str, float]:
    """Label -> best score of the templates found in a file, without those that a rival outdoes."""
    fits = list(_fits(words, where, index))
    # the most weight that a template matches around every place: it explains the words there best
    best: dict[int, float] = {}
    for got, _, _, start in fits:
        for place in range(start - SLACK, start + SLACK + 1):
            best[place] = max(best.get(place, 0.0), got)
    found: dict[str, float] = {}
    for got, score, t, start in fits:
        label = index["entries"][t][0]
        if got >= best[start] - 1e-9 and score > found.get(label, 0.0):
            found[label] = score
    return found


def scan(text: str | None, index: dict, needed: frozenset[bytes]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    where: dict[bytes, list[int]] = {}
    if not needed.isdisjoint(words):
        for i, w in enumerate(words):
            if w in needed:
                where.setdefault(w, []).append(i)
    base = {label: places(words, where, words_of(phrase)) for phrase, label in BASE.items()} if where else {}
    at = sorted(i for some in base.values() for i in some)
    base_labels = sorted(label for label, some in base.items() if some)
    found = template_matches(words, where, index) if where else {}
    return (len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(base_labels),
            ",".join(sorted({*base_labels, *found})), max(found.values(), default=0.0))


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches):
        counts, n = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            for text in batch["text"]:
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        yield pd.DataFrame({"word": ["", *(w.decode() for w in counts)],
                            "n": np.array([n, *counts.values()], dtype=np.int64)})

    return run


def _scan_rows(index: dict):
    needed = frozenset(index["postings"]) | {words_of(p)[0] for p in BASE} | {
        k[0] for *_, keys in index["entries"] for k in keys}

    def run(batches):
        for batch in batches:
            rows = [scan(t, index, needed) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score"])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), out], axis=1)

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Base places, labels and best template score of every document row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = frozenset(w for _, text, _ in templates for w in words_of(text))
    counted = {r["word"]: r["n"] for r in rows.select("text").mapInPandas(
        _frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counted.pop("", 0)
    idf = {w.encode(): math.log((n + 1) / (df + 1)) + 0.01 for w, df in counted.items()}
    return rows.mapInPandas(
        _scan_rows(build_index(idf, templates)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double")

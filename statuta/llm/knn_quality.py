"""Operator 9: quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the n-grams of its character classes (lower, upper, digit, space, line
break, each sign; runs collapsed), its hashed words, and how often a word or a line comes
again.  Their document frequencies are counted over all documents.  Latent directions are
fitted (SVD) on a bounded sample of labelled training documents, and the vectors of that
sample are broadcast: at most ``SAMPLE`` rows of ``DIMENSIONS`` numbers.  Every document
is then compared with all of them, in blocks of exact cosine products, and its ``NEIGHBOURS``
most similar ones vote with their similarity as weight.

Defined cases: null and empty texts have the zero vector and get the sample's share of
good documents; so does every text when there is no label; repeated labels of a document
count once (the lowest); repeated rows each get a row; other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, ship

ship(__name__)

SHAPE_TERMS = 2048
WORD_TERMS = 2048
REPEAT_TERMS = 3
TERMS = SHAPE_TERMS + WORD_TERMS + REPEAT_TERMS
#: Bound of the labelled sample that is fitted and broadcast (smallest hashes of doc_id).
SAMPLE = 2000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Weight of the three groups of terms.
SHAPE_WEIGHT, WORD_WEIGHT, REPEAT_WEIGHT = 1.0, 0.3, 1.0
BLOCK = 512
#: Characters of a text that are counted at a time, which bounds the memory of a long one.
CHUNK = 1 << 20
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")
LOWER, UPPER, DIGIT, SPACE, LINE = 1, 2, 3, 4, 5


def class_table() -> np.ndarray:
    """Class of each 16-bit code point; signs keep a class of their own."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch == "\n":
            table[c] = LINE
        elif ch.isspace():
            table[c] = SPACE
        elif ch.isdigit():
            table[c] = DIGIT
        elif ch.isalpha():
            table[c] = UPPER if ch.isupper() else LOWER
        else:
            table[c] = 6 + c % 251
    return table


def text_parts(text: str):
    """A text in parts of about CHUNK characters, cut behind white space."""
    at = 0
    while at < len(text):
        gap = BLANK.search(text, at + CHUNK)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def term_counts(text: str | None, table: np.ndarray) -> np.ndarray:
    """Counts of the hashed terms of one text; those of a long one are counted part by part,
    with what the parts share carried over."""
    counts = np.zeros(TERMS)
    tail, last = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    seen_words: set[bytes] = set()
    seen_lines: set[bytes] = set()
    line = hashlib.blake2b(digest_size=16)
    n_words = n_lines = 0
    for part in text_parts(text or ""):
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = np.concatenate((tail, table[np.minimum(chars, 0xFFFF)]))
        kept = classes[np.concatenate(([True], classes[1:] != classes[:-1]))]
        h = np.zeros(len(kept), dtype=np.uint32)
        for n in range(min(4, len(kept))):
            h = h[:len(kept) - n] * np.uint32(0x9E3779B1) + kept[n:]
            # runs of classes that end in the part before have been counted
            mixed = (h[max(0, len(tail) - n):] ^ (h[max(0, len(tail) - n):] >> np.uint32(15))) \
                * np.uint32(0x85EBCA77) >> np.uint32(21)
            counts[:SHAPE_TERMS] += np.bincount(mixed, minlength=SHAPE_TERMS)
        tail = kept[-3:]
        spoken = part.encode("utf-8", "surrogatepass").split()
        words = np.array([zlib.crc32(w) for w in spoken], dtype=np.uint32)
        counts[SHAPE_TERMS:SHAPE_TERMS + WORD_TERMS] += np.bincount(words % WORD_TERMS, minlength=WORD_TERMS)
        chained = np.concatenate((last, words))
        counts[-3] += np.count_nonzero(chained[1:] == chained[:-1])
        last = chained[-1:]
        n_words += len(spoken)
        seen_words.update(spoken)
        first, *more = part.split("\n")
        line.update(first.encode("utf-8", "surrogatepass"))
        for nxt in more:
            seen_lines.add(line.digest())
            n_lines += 1
            line = hashlib.blake2b(nxt.encode("utf-8", "surrogatepass"), digest_size=16)
    if text:
        seen_lines.add(line.digest())
        counts[-2] = n_words - len(seen_words)
        counts[-1] = n_lines + 1 - len(seen_lines)
    return counts


def _matrix(texts, table) -> np.ndarray:
    return np.stack([term_counts(t, table) for t in texts]) if len(texts) else np.zeros((0, TERMS))


def _frequencies(batches):
    """Documents that hold each term, summed per task."""
    table, found = class_table(), np.zeros(TERMS, dtype=np.int64)
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            found += (_matrix(batch["text"].iloc[at:at + BLOCK], table) > 0).sum(axis=0)
    yield pd.DataFrame({"term": np.arange(TERMS, dtype=np.int32), "n": found})


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length-normalised log counts times idf, each group of terms scaled to its weight."""
    x = np.log1p(counts) * idf
    for a, b, w in ((0, SHAPE_TERMS, SHAPE_WEIGHT), (SHAPE_TERMS, SHAPE_TERMS + WORD_TERMS, WORD_WEIGHT)):
        norm = np.linalg.norm(x[:, a:b], axis=1, keepdims=True)
        x[:, a:b] *= w / np.where(norm > 0, norm, 1)
    # shares of words or lines that come again
    total = np.maximum(counts[:, SHAPE_TERMS:SHAPE_TERMS + WORD_TERMS].sum(axis=1, keepdims=True), 1)
    x[:, -REPEAT_TERMS:] = REPEAT_WEIGHT * counts[:, -REPEAT_TERMS:] / total
    return x


def latent(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    z = x @ directions
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return (z / np.where(norm > 0, norm, 1)).astype(np.float32)


def vote(z: np.ndarray, known: np.ndarray, marks: np.ndarray, prior: float, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of good neighbours, from exact cosine products."""
    if not len(known):
        return np.full(len(z), prior)
    similar = z @ known.T
    k = min(k, len(known))
    near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(similar, near, axis=1), 0, None).astype(np.float64)
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * marks[near]).sum(axis=1) / np.where(total > 0, total, 1), prior)


def _scores(model):
    def run(batches):
        idf, directions, known, marks, prior = model.value
        table = class_table()
        for batch in batches:
            out = [np.empty(0)]
            for at in range(0, len(batch), BLOCK):
                counts = _matrix(batch["text"].iloc[at:at + BLOCK], table)
                out.append(vote(latent(weighted(counts, idf), directions), known, marks, prior))
            yield batch[["doc_id"]].assign(score=np.clip(np.concatenate(out), 0, 1))

    return run


def is_held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _sample_rows(batches):
    """(text, quality) -> (quality, term counts as bytes)."""
    table = class_table()
    for batch in batches:
        yield pd.DataFrame({"quality": batch["quality"].astype("int32"),
                            "counts": [c.astype("<f4").tobytes() for c in _matrix(batch["text"], table)]})


def leading_directions(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """The ``n`` leading right singular vectors of ``x``, by subspace iteration from a fixed start."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], min(n + 16, *x.shape))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :n]


def fit(counts: np.ndarray, marks: np.ndarray, idf: np.ndarray) -> tuple:
    """idf, latent directions, unit vectors, labels and share of good documents of a sample."""
    if not len(counts):
        return idf, np.zeros((TERMS, 1)), np.zeros((0, 1), dtype=np.float32), marks, 0.5
    x = weighted(counts, idf)
    directions = leading_directions(x, DIMENSIONS)
    return idf, directions, latent(x, directions), marks, float(marks.mean())


def knn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                mod: int = 3, rest: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out and score (higher: better) of every document row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = rows.count()
    found = rows.select("text").mapInPandas(_frequencies, "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS)
    for r in found:
        df[r["term"]] = r["n"]
    idf = np.log((n + 1) / (df + 1)) + 0.1
    # the labels of the sample are few; their documents are found by a join, then fitted here
    marks = (labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .where(~is_held_out(F.col("doc_id"), mod, rest))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = shared(marks, "quality-marks")
    # of several texts of an id, the one of smallest hash
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("first")
    train = (rows.join(chosen, "doc_id").groupBy("doc_id").agg(first).select("first.text", "first.quality")
             .mapInPandas(_sample_rows, "quality int, counts binary").collect())
    counts = np.stack([np.frombuffer(r["counts"], dtype="<f4") for r in train]) if train else np.zeros((0, TERMS))
    model = fit(counts, np.array([r["quality"] for r in train], dtype=np.float64), idf)
    scores = rows.mapInPandas(_scores(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return scores.select("doc_id", is_held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score")

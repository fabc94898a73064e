"""Operators on single texts: counts, tokens, licences, quality, toxicity."""
import collections
import hashlib
import math
import random
import re
import struct
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, PROSE, SF, documents, labels, rows_of

from statuta.llm import byte_bpe, knn_quality, license_scan, quality_rules, toxicity
from statuta.llm.queries import REGISTRY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- 1: quality rules -------------------------------------------------------

def brute_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_match_brute_force(spark):
    odd = [(100 + i, t, "en", "s") for i, t in enumerate(
        ["a a a a", "a b c a b c", "x\nx\n \nx", "a\x0bb\x0cc\rd", "a b c", "# * $|<>&%", "a b c d a b", "é ß 😀"])]
    df = quality_rules.count_features(documents(spark, DOCS + odd))
    got = rows_of(df, "doc_id", *COUNTS)
    assert got == sorted(((i, *brute_counts(t)) for i, t, *_ in DOCS + odd), key=str)


def test_counts_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    for r in REGISTRY["op1_quality_rules"](spark, SF).collect():
        n = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 1000, 0.01), (5, 2000, 0.004), (1, 5, 0.5), (7, 40_000, 0.001), (9, 10, 0.2), (0, 0, 0.1)]
    df = spark.createDataFrame(cases, "k long, n long, risk double")
    for r in df.select("*", F.expr(quality_rules.binomial_tail()).alias("p")).collect():
        k, n, e = r["k"], r["n"], r["risk"]
        want = 1.0 if n == 0 or k >= n * e else sum(math.comb(n, i) * e**i * (1 - e)**(n - i) for i in range(k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_calibration_rejects_bad_and_bounds_good(spark):
    bad_text = " ".join(f"{w}***" for w in PROSE.split()) + " " + " ".join(f"v{i}###" for i in range(40))
    good = [(i, f"{PROSE} number {i} " + " ".join(f"u{i * 7 + k}" for k in range(30)), "en", "s") for i in range(600)]
    bad = [(10_000 + i, f"{bad_text} {i}", "en", "s") for i in range(60)]
    other = [(20_000 + i, f"{bad_text} {i}", "zz", "s") for i in range(3)]
    marks = labels(spark, [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(None, 0, 0), (1, None, 0)])
    out = quality_rules.quality_rules(documents(spark, good + bad + other), marks, max_false_rejection=0.2)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i, *_ in good)
    assert not any(kept[i] for i, *_ in bad)
    assert all(kept[i] for i, *_ in other)  # a stratum without labels certifies nothing


def test_no_labels_or_documents(spark):
    out = quality_rules.quality_rules(documents(spark), labels(spark, []))
    assert all(r["kept"] != r["base_failed"] for r in out.collect())
    assert quality_rules.quality_rules(documents(spark, []), labels(spark, [(1, 1, 0)])).count() == 0


# --- 4: byte-level BPE ------------------------------------------------------

@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.default_ranks(), special_tokens={})


def test_encode_decode_matches_the_library(spark, encoding):
    rng = random.Random(5)
    letters = [chr(c) for c in [0, 9, 10, 11, 12, 13, 28, 31, 32, 32, 32, 0x85, 0xA0, 0x2003, 0x200B, 0x2028, 0x3000]]
    letters += list("ab'sS tRéß中あ😀12²Ⅷ!?#<|>")
    odd = [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 50))), "en", "s") for i in range(400)]
    odd += [(5000, "a" * 20_000 + " " * 999 + "xyzq" * 2000, "en", "s"), (5001, "<|endoftext|>", "en", "s")]
    rows = DOCS + odd
    out = byte_bpe.encode_decode(documents(spark, rows).repartition(3), block_chars=5000)
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((i, struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()))
    assert got == sorted(want, key=str)


def test_long_words_merge_like_short_ones():
    ranks, rng = byte_bpe.default_ranks(), random.Random(1)
    for _ in range(300):
        word = bytes(rng.choice(b"abcinge th") for _ in range(rng.randint(1, 47)))
        assert byte_bpe._merge_long(word, ranks) == byte_bpe.merge_word(word, ranks)


def test_empty_table_encodes_to_nothing(spark):
    assert byte_bpe.encode_decode(documents(spark, [])).count() == 0


# --- 5: licences ------------------------------------------------------------

LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_base(text):
    words = LICENCE_WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words))
          if words[i:i + len(phrase.split())] == phrase.split()]
    starts = sorted(i for i, _ in at)
    return (len(words), len(at), starts[0] if at else None, starts[-1] if at else None,
            ",".join(sorted({label for _, label in at})))


def test_licences(spark):
    odd = [(100, "Licensed under the Apache License, Version 2.0.", "en", "s"),
           (101, f"{PROSE}. Released under the MIT License.\nAll Rights Reserved. all rights reserved", "en", "s"),
           (102, "GENERAL PUBLIC LICENSE general public license", "en", "s"),
           (103, "apache helicopters flew, the license was revoked under version 2", "en", "s"),
           (104, "This work is licensed under the new GNU General Public License, version 3.", "en", "s"),
           (105, "Licensed under CC BY-NC 4.0. " * 50, "en", "s"), (106, "ﬁne CCé BY cc by", "en", "s")]
    out = license_scan.license_scan(documents(spark, DOCS + odd)).collect()
    texts = {i: t for i, t, *_ in DOCS + odd}
    for r in out:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    found = {r["doc_id"]: r["labels"] for r in out}
    assert found[100] == "apache-2.0" and found[101] == "mit,reserved" and found[102] == "gpl"
    assert found[103] == "" and found[104] == "gpl,gpl-3.0" and "cc-by-nc-4.0" in found[105]
    assert len(out) == len(DOCS + odd)
    assert license_scan.license_scan(documents(spark, [])).count() == 0


# --- 9 and 10: classifiers --------------------------------------------------

def auc(pairs):
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality_votes_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = REGISTRY["op9_knn_quality"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    pairs = [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert auc(pairs) > 0.95


def test_vote_is_exact_cosine():
    rng = np.random.default_rng(2)
    unit = lambda a: (a / np.linalg.norm(a, axis=1, keepdims=True)).astype(np.float32)
    z, known, marks = unit(rng.normal(size=(20, 6))), unit(rng.normal(size=(50, 6))), rng.integers(0, 2, 50).astype(float)
    got = knn_quality.vote(z, known, marks, 0.5, k=7)
    for i in range(20):
        near = sorted(range(50), key=lambda j: -float(z[i] @ known[j]))[:7]
        w = [max(0.0, float(z[i] @ known[j])) for j in near]
        assert got[i] == pytest.approx(sum(a * marks[j] for a, j in zip(w, near)) / sum(w), rel=1e-4)


def test_quality_odd_cases(spark):
    out = knn_quality.knn_quality(documents(spark), labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0)]))
    scores = [r["score"] for r in out.collect()]
    assert len(scores) == len(DOCS) and all(0 <= s <= 1 for s in scores)
    assert {r["score"] for r in knn_quality.knn_quality(documents(spark), labels(spark, [])).collect()} == {0.5}
    assert knn_quality.knn_quality(documents(spark, []), labels(spark, [(1, 1, 0)])).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in REGISTRY["op10_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in marks]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    right = collections.Counter((marks[r["doc_id"]], r["predicted"]) for r in rows)
    assert right[1, 1] >= 0.9 * (right[1, 1] + right[1, 0])
    assert right[0, 1] <= 0.02 * (right[0, 0] + right[0, 1])


@pytest.mark.parametrize("text, folded", [
    ("You IDIOT!!", " you idiot "), ("m0r0n", " moron "), ("іdіоt", " idiot "), ("st*pid 1d1ot", " st pid idiot "),
    ("ｓｃｕｍ", " scum "), ("c1own lo5er", " ciown ioser "), ("", " "), (None, " "), ("in 2024 and 10", " in and ")])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_exceptions_cancel_matches():
    found = toxicity.automaton({"trash": 5.0, "scu*": 2.0, "scum": 4.0}, ["trash can"])
    assert toxicity.matches(" the trash can ", found) == {}
    assert sorted(toxicity.matches(" trash can trash scum scuba ", found).values()) == [2.0, 4.0, 5.0]
    assert toxicity.matches(" rescum atrash ", found) == {}


def test_toxicity_odd_cases(spark):
    bad = [(100 + i, f"you are a stupid loser {i} and {PROSE}", "en", "s") for i in range(40)]
    good = [(200 + i, f"{PROSE} {i} with a trash can", "en", "s") for i in range(200)]
    marks = labels(spark, [(i, 1, 1) for i, *_ in bad] + [(i, 1, 0) for i, *_ in good] + [(1, None, None), (None, 0, 1)])
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents(spark, DOCS + bad + good), marks).collect()}
    assert min(out[i] for i, *_ in bad) > 0.3 > max(out[i] for i in [1, 2, 3, 4, 5, 8, 9] + [g[0] for g in good])
    assert toxicity.toxicity(documents(spark), labels(spark, [])).count() == len(DOCS)
    assert toxicity.toxicity(documents(spark, []), marks).count() == 0

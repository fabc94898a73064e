"""Operator 11 against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import DOCS, SF, documents

from statuta.llm import spelling_variants as sv
from statuta.llm.queries import REGISTRY


def brute_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    v = brute_vocabulary(rows)
    near = {w: set() for w in v}
    by_size = {}
    for w in v:
        by_size.setdefault(len(w), []).append(w)
    for size, words in by_size.items():
        for a in words:
            for b in words + by_size.get(size + 1, []):
                if one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else v[form[w]]) for w, n in v.items()}


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def odd_rows():
    rng = random.Random(5)
    words = ["colour", "color", "colours", "colou", "Üeber", "ÉTUDE", "éTUDE", "naïveté", "naivete", "aaaaa", "aaaaaa",
             "aaaaaaa", "x" * 70, "x" * 71, "x" * 69 + "y", "abcde", "bcdea", "abcdef"]
    texts = [" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=60)) for _ in range(12)]
    return [(100 + i, t, "en", "s") for i, t in enumerate(texts)]


def test_odd_rows_match_brute_force(spark):
    rows = DOCS + odd_rows()
    assert result(sv.spelling_variants(documents(spark, rows))) == brute([(i, t) for i, t, *_ in rows])


def test_slices_give_the_same_result(spark):
    rows = odd_rows()
    df = documents(spark, rows)
    assert result(sv.spelling_variants(df, slice_bytes=32)) == brute([(i, t) for i, t, *_ in rows])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(REGISTRY["op11_spelling_variants"](spark, SF)) == expected


def test_empty_table(spark):
    df = sv.spelling_variants(documents(spark, []))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


def test_long_chain_of_forms(spark):
    """Ten doublings: a chain of forms ends at its last word."""
    words = ["a" * (6 + i) for i in range(10)]
    text = " ".join(" ".join([w] * (3 * 2 ** i)) for i, w in enumerate(words))
    whole = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in words))
    got = result(sv.spelling_variants(documents(spark, [(whole, text, "en", "s")])))
    assert got == brute([(whole, text)]) and {r[2] for r in got} == {words[-1]}


@pytest.mark.parametrize("most", [32, 64, 320, 1 << 20])
def test_slices_cover_every_block_once(most):
    blocks = {5: 3, 6: 1, 64: 9}
    seen = [(s, b) for part in sv.slices(blocks, most) for s, low, high in part for b in range(low, high)]
    assert sorted(seen) == [(s, b) for s, n in blocks.items() for b in range(n)]
    assert all(sum(high - low for _, low, high in part) * sv.BLOCK_BYTES <= max(most, sv.BLOCK_BYTES)
               for part in sv.slices(blocks, most))


def test_edit_hashes_are_those_of_the_edited_words():
    words = ["banana", "aabbcc", "zürich"]
    vocabulary = {"anana", "banan", "abbcc", "aabbc", "bznana", "zürich", "zÿrich", "aabbcz", "züric"}
    lanes = {}
    for size in (5, 6):
        some = [w for w in vocabulary if len(w) == size]
        h = sv.word_hashes(sv._codes(some))
        bits = np.zeros((1, sv.LANES), np.uint32)
        for lane in range(sv.LANES):
            for b in sv.lane_bit(h, lane):
                bits[0, lane] |= np.uint32(1 << int(b))
        lanes[size] = (1, 0, bits)
    found = {(words[r], s) for r, s in sv.neighbours(words, lanes)}
    expected = {(w, v) for w in words for v in vocabulary if one_edit(w, v) and (len(v) < len(w) or w < v)}
    assert expected <= found
    assert len(list(sv.neighbours(words, lanes))) == len(found)

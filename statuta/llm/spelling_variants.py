"""Operator 11: spelling variants by Bloom-guided neighbourhoods.

Words are counted over all texts (per Arrow batch first, then one shuffle of words).  The
vocabulary is sharded by word length, and each shard has a blocked Bloom filter: a word sets
one bit in each of the eight lanes of one 256-bit block.  Every word then generates the
strings one edit away and asks the broadcast filter of their length; only the strings that
it holds are written and joined with the vocabulary, which removes the false positives.

Two words are near in both directions, so only half of the edits are generated: all
deletions (the longer word finds the shorter one) and the replacements by a later letter.
A word's hash is the sum of one value per position and letter; an edit's hash follows from
it by prefix and suffix sums, and the edited string is only built where the filter says yes.

Filters are built by an aggregation and broadcast in slices of at most ``SLICE_BYTES``; a
larger vocabulary takes more passes, one slice at a time, with the same result.  Chains of
forms are followed by pointer doubling; counts at least double along a chain, so the rounds
are few.

Defined cases: null, empty and letterless texts have no words; a null doc_id counts as an
empty one in the hash; repeated rows each count; other columns are not read; an empty table
gives no rows; words of equal count go by code-point order.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, ship

ship(__name__)

MIN_LETTERS = 5
MIN_COUNT = 3
#: One run in so many loses a letter.
DROP_EVERY = 97
RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % MIN_LETTERS)
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint64)
#: Words of this length and more share a shard.
LONGEST = 64
#: Eight lanes of 32 bits, kept as four 64-bit integers; words a block is sized for.
LANES, BLOCK_BYTES, WORDS_A_BLOCK = 8, 32, 16
#: Most bytes of filters that are broadcast in one pass.
SLICE_BYTES = 16 << 20
#: Distinct words a task holds before it hands its counts on, and letters of a block of words.
HELD_WORDS = 200_000
BLOCK_LETTERS = 1 << 15


# --- counting ---------------------------------------------------------------

def text_words(doc_id: int | None, text: str | None):
    """Words of a text after the seeded letter drops; those under MIN_LETTERS are left out."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    counts: dict[str, int] = {}
    for m in RUN.finditer(lower):
        run = m.group()
        counts[run] = counts.get(run, 0) + 1
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), seed)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= MIN_LETTERS:
            yield run, n


def _count(batches):
    held: dict[str, int] = {}

    def frame():
        return pd.DataFrame({"word": pd.Series(list(held), dtype=object),
                             "n": np.fromiter(held.values(), np.int64, len(held))})

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            for word, n in text_words(doc_id, text):
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield frame()
                held.clear()
    if held:
        yield frame()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with at least MIN_COUNT occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInPandas(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- hashes and filters -----------------------------------------------------

def _value(position, letter) -> np.ndarray:
    """A 64-bit value for a letter at a position (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (np.asarray(position, np.uint64) << np.uint64(21)) + np.asarray(letter, np.uint64)
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    return np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return _value(np.arange(codes.shape[1]), codes).sum(axis=1, dtype=np.uint64)


def block_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)


def lane_bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    return (hashes >> np.uint64(5 * lane)) & np.uint64(31)


def by_length(words: list[str], *others: list):
    """Groups of words of equal length, at most BLOCK_LETTERS letters each."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        size = len(words[order[start]])
        stop, most = start, max(1, BLOCK_LETTERS // size)
        while stop < len(order) and stop - start < most and len(words[order[stop]]) == size:
            stop += 1
        some = order[start:stop]
        yield size, [words[i] for i in some], *[[o[i] for i in some] for o in others]
        start = stop


def shard(length: int) -> int:
    return min(length, LONGEST)


def _bits(blocks: dict[int, int]):
    def run(batches):
        for batch in batches:
            for size, words in by_length(batch["word"].tolist()):
                h = word_hashes(_codes(words))
                out = {"shard": np.full(len(h), shard(size), np.int32), "block": block_of(h, blocks[shard(size)])}
                for k in range(LANES // 2):
                    low, high = (np.uint64(1) << lane_bit(h, lane) for lane in (2 * k, 2 * k + 1))
                    out[f"w{k}"] = (low | high << np.uint64(32)).view(np.int64)
                yield pd.DataFrame(out)

    return run


def filter_blocks(words: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Rows (shard, block, w0..w3) of all filters, and the number of blocks of each shard."""
    sizes = words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("shard")).count().collect()
    blocks = {r["shard"]: -(-r["count"] // WORDS_A_BLOCK) for r in sizes}
    lanes = [f"w{k}" for k in range(LANES // 2)]
    rows = words.select("word").mapInPandas(
        _bits(blocks), "shard int, block long, " + ", ".join(f"{w} long" for w in lanes))
    return rows.groupBy("shard", "block").agg(*[F.bit_or(w).alias(w) for w in lanes]), blocks


def slices(blocks: dict[int, int], most_bytes: int) -> list[list[tuple[int, int, int]]]:
    """Passes; each lists (shard, first block, end) and holds at most ``most_bytes``."""
    passes, room = [], 0
    for s in sorted(blocks):
        at = 0
        while at < blocks[s]:
            if room < 1:
                passes.append([])
                room = max(1, most_bytes // BLOCK_BYTES)
            take = min(room, blocks[s] - at)
            passes[-1].append((s, at, at + take))
            at, room = at + take, room - take
    return passes


def _slice_filters(rows: DataFrame, part: list[tuple[int, int, int]], blocks: dict[int, int]) -> dict:
    """The filters of one pass as arrays: shard -> (blocks of the shard, first block, lanes)."""
    inside = F.lit(False)
    for s, low, high in part:
        inside = inside | ((F.col("shard") == s) & (F.col("block") >= low) & (F.col("block") < high))
    got = rows.where(inside).toPandas()
    filters = {}
    for s, low, high in part:
        mine = got[got["shard"] == s]
        lanes = np.zeros((high - low, LANES // 2), np.int64)
        lanes[mine["block"].to_numpy() - low] = mine[[f"w{k}" for k in range(LANES // 2)]].to_numpy()
        filters[s] = (blocks[s], low, lanes.view(np.uint32).reshape(high - low, LANES))
    return filters


def held(hashes: np.ndarray, entry: tuple | None) -> np.ndarray:
    """Places of the hashes that the filter holds; lanes are asked one after the other."""
    if entry is None:
        return np.zeros(0, np.int64)
    n_blocks, low, lanes = entry
    block = block_of(hashes, n_blocks) - low
    at = np.flatnonzero((block >= 0) & (block < len(lanes))) if low or len(lanes) < n_blocks else np.arange(len(hashes))
    for lane in range(LANES):
        hit = (lanes[block[at], lane].astype(np.uint64) >> lane_bit(hashes[at], lane)) & np.uint64(1)
        at = at[hit.astype(bool)]
    return at


# --- neighbourhoods ---------------------------------------------------------

def neighbours(words: list[str], filters: dict):
    """(index of a word, string one edit away that its filter holds), for words of one length."""
    codes = _codes(words)
    size = codes.shape[1]
    values = _value(np.arange(size), codes)
    whole = values.sum(axis=1, dtype=np.uint64)
    same, shorter = filters.get(shard(size)), filters.get(shard(size - 1))
    if shorter is not None:
        zero = np.zeros((len(words), 1), np.uint64)
        before = np.concatenate([zero, values.cumsum(axis=1, dtype=np.uint64)], axis=1)
        moved = _value(np.arange(-1, size - 1).clip(0), codes)
        moved[:, 0] = 0
        after = moved.sum(axis=1, dtype=np.uint64)[:, None] - moved.cumsum(axis=1, dtype=np.uint64)
    for i in range(size):
        if shorter is not None:
            # of a run of equal letters, the first is dropped for all
            rows = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(words))
            for r in rows[held(before[rows, i] + after[rows, i], shorter)]:
                yield r, words[r][:i] + words[r][i + 1:]
        if same is not None:
            rows, letter = np.nonzero(codes[:, i, None] < LETTERS[None, :])
            with_letter = (whole - values[:, i])[rows] + _value(i, LETTERS)[letter]
            at = held(with_letter, same)
            for r, c in zip(rows[at], LETTERS[letter[at]]):
                yield r, words[r][:i] + chr(c) + words[r][i + 1:]


def _probe(filters):
    def run(batches):
        for batch in batches:
            for size, words, counts in by_length(batch["word"].tolist(), batch["n"].tolist()):
                if shard(size) in filters.value or shard(size - 1) in filters.value:
                    found = list(neighbours(words, filters.value))
                    yield pd.DataFrame({"word": pd.Series([words[r] for r, _ in found], dtype=object),
                                        "n": np.array([counts[r] for r, _ in found], np.int64),
                                        "other": pd.Series([s for _, s in found], dtype=object)})

    return run


def near_words(words: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``words`` (word, n, kept in a table) -> (word, n, other, other_n), both ways, one edit apart."""
    spark = words.sparkSession
    rows, blocks = filter_blocks(words)
    rows = shared(rows, "bloom")
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    links = None
    for part in slices(blocks, slice_bytes):
        filters = spark.sparkContext.broadcast(_slice_filters(rows, part, blocks))
        positive = words.mapInPandas(_probe(filters), "word string, n long, other string")
        found = shared(positive.join(exact, "other").select("word", "n", "other", "other_n"), "near")
        filters.unpersist()
        links = found if links is None else links.unionByName(found)
    if links is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    return links.union(links.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root), by pointer doubling."""
    jumps = shared(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = shared(jumps.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        jumps = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return jumps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = shared(vocabulary(docs, id_col, text_col), "vocabulary")
    near = near_words(words, slice_bytes)
    best: Column = F.min(F.struct((-F.col("other_n")).alias("by"), F.col("other").alias("word")))
    grouped = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has_form = -F.col("best.by") >= 2 * F.col("n")
    chosen = shared(grouped.select("word", "n_near", F.when(has_form, F.col("best.word")).alias("form"),
                                   F.when(has_form, -F.col("best.by")).alias("form_n")), "forms")
    up = roots(chosen.where("form IS NOT NULL"))
    return (words.join(chosen, "word", "left").join(up, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))

"""Operator 4: byte-level BPE encoding and decoding through one shuffle of distinct words.

Texts are cut into pre-tokens (words) and kept, block by block, as the block's distinct
words and one code per position; that is the exploded (document, position, word) relation
with its repeated words collapsed before any shuffle.  The words of all blocks then meet in
one global shuffle, dealt to buckets by hash and packed: each distinct word is merged once,
and its ids go back to the blocks that hold it, where they are laid out by position.
Decoding looks every id up in
the token-byte table (fixed by the vocabulary, about 50,000 rows, broadcast) and joins the
bytes in order.  A block holds at most ``BLOCK_CHARS`` characters (a longer text is a block
of its own), so no task sees more than a block and its words, and a word that every
document holds travels once per block.

Defined cases: a null text encodes as the empty text (no ids); repeated rows and null ids
each keep a row; special-token strings are ordinary text; other columns are not read.
"""
from __future__ import annotations

import base64
import heapq
import zlib
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import ship

ship(__name__)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 1 << 23
#: Positions whose codes share one row; bounds a row's size inside a block.
ROW_POSITIONS = 1 << 20
#: Blocks of one partition are numbered with this many bits.
SEQ_BITS = 20
#: Words up to this many bytes are merged by scanning, longer ones with a heap.
SCAN_BYTES = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f))}


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(VOCABULARY))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _compiled(pattern: str):
    # the rank files' pattern means Unicode white space
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                         .replace(r"\s", r"\p{White_Space}"))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE ids of one word: always the lowest-ranked pair, the leftmost of equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SCAN_BYTES:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    top = len(ranks)
    while len(parts) > 1:
        best, at = top, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], top)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # a part runs from its start to end[start]; 0 marks a merged-away start
    before = list(range(-1, n - 1))

    def pair(i: int):
        j = end[i]
        return ranks.get(word[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def _to_blocks(pattern: str, block_chars: int):
    """(doc_id, text) -> rows of blocks: pieces of documents with codes, then the block's words."""

    def run(batches):
        find = _compiled(pattern).findall
        partition, seq, chars = TaskContext.get().partitionId(), 0, 0
        docs, codes, words = [], array("I"), {}

        def flush():
            nonlocal seq, chars, docs, codes, words
            block = partition << SEQ_BITS | seq
            out = _frame(block, docs, codes, words)
            seq, chars, docs, codes, words = seq + 1, 0, [], array("I"), {}
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = find(text) if text else []
                if docs and chars + len(text or "") > block_chars:
                    yield flush()
                codes.extend([words.setdefault(w, len(words)) for w in found])
                docs.append((None if pd.isna(doc_id) else int(doc_id), len(found)))
                chars += len(text or "")
        if docs:
            yield flush()

    return run


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit integers, equal bytes side by side (most high bytes are zero), compressed."""
    return zlib.compress(b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 1)


def _unpack(packed: bytes, *sizes: int) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zlib.decompress(packed), dtype=np.uint8), [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at:at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def _frame(block, docs, codes, words) -> pd.DataFrame:
    """The rows of one block: pieces of documents with their codes, then its words in code order."""
    codes = np.frombuffer(codes, dtype=np.uint32)
    # the frequent words of the block get the small codes, which take least room
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    codes, rows, at, start = rank[codes], [], 0, 0
    while at < len(docs):
        upto, n = at, 0
        while upto < len(docs) and (upto == at or n + docs[upto][1] <= ROW_POSITIONS):
            n += docs[upto][1]
            upto += 1
        rows.append((block, [d[0] for d in docs[at:upto]], [d[1] for d in docs[at:upto]],
                     _pack(codes[start:start + n]), None))
        at, start = upto, start + n
    names = list(words)
    encoded = [names[i].encode() for i in order]
    lengths = np.array([len(w) for w in encoded], dtype="<u4").tobytes()
    rows.append((block, None, None, None, zlib.compress(lengths + b"".join(encoded), 1)))
    return pd.DataFrame(rows, columns=["block", "ids", "counts", "codes", "words"]).assign(
        n_words=[0] * (len(rows) - 1) + [len(encoded)])


def _block_words(n_buckets: int):
    """Blocks -> their distinct words, a row per block and bucket of words, packed."""

    def run(batches):
        for batch in batches:
            for block, packed, n in zip(batch["block"], batch["words"], batch["n_words"]):
                if packed is None or not n:
                    continue
                raw = zlib.decompress(packed)
                ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n)).tolist()
                text = raw[4 * n:]
                words = [text[a:b] for a, b in zip([0, *ends], ends)]
                bucket = np.array([zlib.crc32(w) % n_buckets for w in words])
                order = np.argsort(bucket, kind="stable")
                firsts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = []
                for a, b in zip(firsts, [*firsts[1:], n]):
                    mine = order[a:b]
                    some = [words[i] for i in mine]
                    rows.append((bucket[mine[0]], block, b - a, _pack(np.diff(mine, prepend=0),
                                                                      np.array([len(w) for w in some])),
                                 zlib.compress(b"".join(some), 1)))
                yield pd.DataFrame(rows, columns=["bucket", "block", "n", "codes", "words"])

    return run


def _encode_words(ranks):
    """Packed words sorted by bucket -> packed ids; each distinct word of a bucket is merged once."""

    def run(batches):
        table, now, known = ranks.value, None, {}
        for batch in batches:
            rows = []
            for bucket, block, n, codes, packed in zip(*(batch[c] for c in ("bucket", "block", "n", "codes", "words"))):
                if bucket != now:
                    now, known = bucket, {}
                steps, lengths = _unpack(codes, n, n)
                text, ends, ids = zlib.decompress(packed), np.cumsum(lengths).tolist(), []
                for a, b in zip([0, *ends], ends):
                    word = text[a:b]
                    if (found := known.get(word)) is None:
                        found = known[word] = np.array(merge_word(word, table), dtype="<u4").tobytes()
                    ids.append(found)
                flat = np.frombuffer(b"".join(ids), dtype="<u4")
                sizes = np.array([len(x) // 4 for x in ids])
                rows.append((block, n, len(flat), _pack(steps, sizes, flat)))
            yield pd.DataFrame(rows, columns=["block", "n", "m", "packed"])

    return run


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[start:start + length]``, one after another."""
    ends = np.cumsum(lengths)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]


def _lay_out(ranks):
    """A block's codes and its words' ids -> ids and decoded bytes of each of its documents."""

    def run(_, pieces: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(p, n, n, m) for p, n, m in zip(words["packed"], words["n"], words["m"])]
        found = [np.cumsum(steps, dtype=np.int64) for steps, _, _ in parts]
        n_words = sum(map(len, found))
        # ids stay as they came; each code knows where its ids start
        word_ids = np.concatenate([ids for *_, ids in parts]) if parts else np.empty(0, dtype="<u4")
        sizes = np.concatenate([s for _, s, _ in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        word_lengths, word_starts = np.zeros(n_words, dtype=np.int64), np.zeros(n_words, dtype=np.int64)
        if parts:
            at = np.concatenate(found)
            word_lengths[at], word_starts[at] = sizes, np.cumsum(sizes) - sizes
        tokens = [b""] * len(ranks.value)
        for token, rank in ranks.value.items():
            tokens[rank] = token
        token_lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        token_starts = np.cumsum(token_lengths) - token_lengths
        names, ids, texts = [], [], []
        for of, counts, packed in zip(pieces["ids"], pieces["counts"], pieces["codes"]):
            if packed is None:
                continue
            codes = _unpack(packed, sum(counts))[0]
            at = 0
            for name, n in zip(of, counts):
                mine = codes[at:at + n]
                at += n
                got = _gather(word_ids, word_starts[mine], word_lengths[mine])
                names.append(None if pd.isna(name) else int(name))
                ids.append(got.astype("<u4").tobytes())
                texts.append(_gather(token_bytes, token_starts[got], token_lengths[got]).tobytes())
        return pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "ids": ids, "decoded": texts})

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  ranks: dict[bytes, int] | None = None, pattern: str | None = None,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (bytes) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(ranks or default_ranks())
    # more buckets than partitions, so that a task holds the words of one of several at a time
    n_buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange of the blocks feeds both the global word shuffle and the final layout
    blocks = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
              .mapInPandas(_to_blocks(pattern or default_pattern(), block_chars),
                           "block long, ids array<long>, counts array<int>, codes binary, words binary, n_words int")
              .repartition("block"))
    words = (blocks.mapInPandas(_block_words(n_buckets), "bucket long, block long, n int, codes binary, words binary")
             .repartition("bucket").sortWithinPartitions("bucket")
             .mapInPandas(_encode_words(table), "block long, n int, m int, packed binary"))
    return (blocks.groupBy("block").cogroup(words.groupBy("block"))
            .applyInPandas(_lay_out(table), "doc_id long, ids binary, decoded binary"))

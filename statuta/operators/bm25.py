"""BM25 (Okapi) ranking written as joins and aggregations (AGG1-AGG4, JN5, TOP1-2).

Corpus rows are identified by ``key_cols``; their order (the tie-break) is the
ascending order of ``key_cols``.  Texts are tokenised on single spaces (TX13).

Plan shape, chosen for large corpora:

* ``tf``: explode tokens and count per (document, token).  Partial aggregation
  combines inside each map task, so only distinct (document, token) pairs are
  shuffled.  The row of each document's first token carries the document length,
  which gives N and the mean length without a second scan of the text.
* ``vocab``: document frequency per token (partial aggregation absorbs hot
  tokens), raw idf, the epsilon floor from the mean idf as a scalar subquery, and the
  token's highest share of a score in any document; ``blocks`` has that per block of
  documents (a hash of the key).
* postings stay where a document lies if the corpus comes partitioned by (some of) its key
  (``session.clustered``): then neither they nor the sums of pairs are shuffled.
* ranking (``ranked``) never builds all (query, document) pairs that share a token:

  1. the few heaviest terms of a query give partial scores, whose k-th best is a floor
     that the k-th result reaches at least;
  2. a document without one of the *essential* terms cannot reach the floor, so partial
     scores are only built over those; their k-th best raises the floor;
  3. a pair whose partial score and the most that the other terms can add stay below the
     floor leaves: by the terms' maxima, and, where the index has ``blocks`` (the highest
     share of each token in each block of documents), by those of the document's block;
  4. only what is left is scored in full.

  The terms of a batch of queries are few (checked) and their bounds are worked out as
  arrays; everything that grows with the corpus stays in joins and aggregations.
* ``scores`` has all pairs (statistics, and queries with fewer than k positive scores).
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import tokens
from statuta.session import broadcast_if_small

# Fixed values of the ranking function.
K1 = 1.5
B = 0.75
EPSILON = 0.25
# Contributions are added as whole multiples of 1 / SCORE_UNITS, so that sums do not depend
# on their order and equal documents tie exactly; scores are rounded for output only.
SCORE_UNITS = 1e12
SCORE_DECIMALS = 6

QUERY_BROADCAST_ROWS = 2_000_000
#: Terms of a batch that are worked out as arrays, and the share of the postings from which
#: essential terms save nothing.
QUERY_TERMS = 1_000_000
MOST_POSTINGS = 0.9
#: Documents of a block, and the share of a query's highest possible score whose terms give the first floor.
BLOCK_DOCS = 64
HEAVY_SHARE = 0.2


@dataclass
class Bm25Index:
    key_cols: list[str]
    tf: DataFrame        # key_cols..., token, tf, dl
    vocab: DataFrame     # token, df, idf, top (highest share of a score)
    vocab_raw: DataFrame  # the persisted frame that ``vocab`` reads
    stats: DataFrame     # one row: n_docs, total_len, avgdl, n_terms, mean_idf, eps
    first_key: DataFrame  # one row: key_cols of the first document
    blocks: DataFrame | None = None  # block, token, top; see ``with_blocks``
    known: tuple[int, float] | None = None

    def numbers(self) -> tuple[int, float]:
        """Documents and their mean length (two numbers, read once)."""
        if self.known is None:
            row = self.stats.select("n_docs", "avgdl").first()
            self.known = (row["n_docs"], float(row["avgdl"] or 0.0))
        return self.known

    def unpersist(self) -> None:
        for frame in (self.tf, self.vocab_raw, self.blocks):
            if frame is not None:
                frame.unpersist()


def term_frequencies(corpus: DataFrame, key_cols: list[str], text_col: str,
                     only: DataFrame | None = None) -> DataFrame:
    """(keys, token, tf, dl, first_pos) -- one row per distinct token of a document, or per
    distinct one of the tokens in ``only``."""
    # The length is computed before the generator so each exploded row carries an
    # int, not the token array (carrying the array makes the copy quadratic).
    exploded = (corpus
                .select(*key_cols, tokens(text_col).alias("toks"))
                .withColumn("dl", F.size("toks"))
                .select(*key_cols, "dl", F.posexplode("toks").alias("tpos", "token")))
    if only is not None:
        exploded = exploded.join(only, "token", "left_semi")
    return (exploded.groupBy(*key_cols, "dl", "token")
            .agg(F.count(F.lit(1)).alias("tf"), F.min("tpos").alias("first_pos")))


def share(avgdl: Column) -> Column:
    """What one token adds to a score, before its weight."""
    tf = F.col("tf")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))


def block_of(key_cols: list[str], n_docs: Column | int) -> Column:
    """A document's block, by its key alone."""
    return F.pmod(F.xxhash64(*key_cols), F.greatest(F.ceil(F.lit(n_docs) / BLOCK_DOCS), F.lit(1)))


def build_index(corpus: DataFrame, key_cols: list[str], text_col: str = "text",
                persist: bool = True, asked: DataFrame | None = None) -> Bm25Index:
    """``asked``: the different tokens (token) that the index will be asked for.  The statistics are
    those of all tokens, but only the postings of these are kept, if they can be broadcast.  The
    corpus is then read several times, and its keys must be unique."""
    tf = term_frequencies(corpus, key_cols, text_col)
    only, few = (None, False) if asked is None else broadcast_if_small(asked, QUERY_TERMS)
    every = tf
    if few:
        tf = term_frequencies(corpus, key_cols, text_col, only)
    if persist:
        tf = tf.persist(StorageLevel.MEMORY_AND_DISK)
    if few:
        docs = corpus.where(F.col(text_col).isNotNull()).select(*key_cols, F.size(tokens(text_col)).alias("dl"))
    else:
        every = tf
        docs = tf.where(F.col("first_pos") == 0).select(*key_cols, "dl")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    avgdl = docs.select(F.sum("dl") / F.count(F.lit(1))).scalar()
    vocab_raw = (every.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max(share(avgdl)).alias("top"))
                 .withColumn("raw_idf", F.log(n_docs - F.col("df") + 0.5)
                             - F.log(F.col("df") + 0.5)))
    if persist:
        vocab_raw = vocab_raw.persist(StorageLevel.MEMORY_AND_DISK)
    mean_idf = vocab_raw.select(F.avg("raw_idf")).scalar()
    eps = F.lit(EPSILON) * mean_idf
    vocab = vocab_raw.select(
        "token", "df",
        F.when(F.col("raw_idf") < 0, eps).otherwise(F.col("raw_idf")).alias("idf"), "top")
    stats = docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("dl").alias("total_len"),
    ).select(
        "n_docs", "total_len",
        (F.col("total_len") / F.col("n_docs")).alias("avgdl"),
        vocab_raw.select(F.count(F.lit(1))).scalar().alias("n_terms"),
        mean_idf.alias("mean_idf"),
        eps.alias("eps"),
    )
    first_key = docs.select(F.min(F.struct(*key_cols)).alias("k")).select("k.*")
    return Bm25Index(list(key_cols), tf, vocab, vocab_raw, stats, first_key)


def with_blocks(index: Bm25Index) -> Bm25Index:
    """The index with each token's highest share of a score in each block of documents.

    One more aggregation over ``tf``, for an index that answers many batches."""
    n_docs, avgdl = index.numbers()
    tops = (index.tf.select(block_of(index.key_cols, n_docs).alias("block"), "token", share(F.lit(avgdl)).alias("share"))
            .groupBy("block", "token").agg(F.max("share").alias("top")))
    return replace(index, blocks=tops.persist(StorageLevel.MEMORY_AND_DISK))


def query_terms(queries: DataFrame, qkey_cols: list[str], text_col: str = "text") -> DataFrame:
    """(qkeys, token, qtf): a token repeated in the query counts each time."""
    return (queries.select(*qkey_cols, F.explode(tokens(text_col)).alias("token"))
            .groupBy(*qkey_cols, "token").agg(F.count(F.lit(1)).alias("qtf")))


#: The key of the queries that ask for the same tokens as often.
ASK = "_ask"


def asked_once(queries: DataFrame, qkey_cols: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Queries that ask for the same tokens as often have the same scores, so they are ranked
    once: (_ask, token, qtf) of the different ones, and (qkeys, _ask)."""
    per_query = query_terms(queries, qkey_cols, text_col).groupBy(*qkey_cols).agg(
        F.array_sort(F.collect_list(F.struct("token", "qtf"))).alias("terms"))
    per_query = per_query.withColumn(ASK, F.sha2(F.to_json("terms"), 256)).persist(StorageLevel.MEMORY_AND_DISK)
    asks = per_query.groupBy(ASK).agg(F.first("terms").alias("terms")).select(ASK, F.inline("terms"))
    return asks.persist(StorageLevel.MEMORY_AND_DISK), per_query.select(*qkey_cols, ASK)


def ask_of(text: Column) -> Column:
    """The key of the queries that ask for the same tokens as often, by a query's own text; null
    for no text.  Tokens hold no spaces."""
    return F.sha2(F.array_join(F.array_sort(tokens(text)), " "), 256)


def different_asks(texts: DataFrame) -> DataFrame:
    """(_ask, text): one of the texts that ask for the same tokens."""
    return (texts.select(ask_of(F.col("text")).alias(ASK), "text").where(F.col(ASK).isNotNull())
            .groupBy(ASK).agg(F.first("text").alias("text")))


def top1_of_asks(index: Bm25Index, asks: DataFrame) -> DataFrame:
    """AGG4 for different asks (_ask, text): (_ask, keys, score), those of a positive score."""
    return _best(_term_ranked(index, query_terms(asks, [ASK]), [ASK], 1), [ASK], index.key_cols)


def scores(index: Bm25Index, queries: DataFrame, qkey_cols: list[str],
           text_col: str = "text") -> DataFrame:
    """(qkeys, keys, score) for every (query, document) sharing at least one token."""
    return _term_scores(index, query_terms(queries, qkey_cols, text_col), qkey_cols)


def _term_scores(index: Bm25Index, terms: DataFrame, qkey_cols: list[str]) -> DataFrame:
    """``scores`` of queries given as (qkeys, token, qtf)."""
    qt_small, small = broadcast_if_small(terms, QUERY_BROADCAST_ROWS)
    weighted = index.vocab.join(qt_small, "token").select(
        *qkey_cols, "token", (F.col("qtf") * F.col("idf")).alias("w"))
    # vocab tokens are unique, so weighted has at most as many rows as the query terms: the
    # check above bounds it too
    sums = _partial(index, F.broadcast(weighted) if small else weighted, qkey_cols)
    return sums.select(*qkey_cols, *index.key_cols, (F.col("units") / SCORE_UNITS).alias("score"))


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def _units(avgdl: float) -> Column:
    """A token's part of a score in whole units."""
    return F.round(F.col("w") * share(F.lit(avgdl)) * SCORE_UNITS).cast("bigint")


def _partial(index: Bm25Index, terms: DataFrame, qkey_cols: list[str]) -> DataFrame:
    """(qkeys, keys, units) over the given terms."""
    return (index.tf.join(terms, "token").groupBy(*qkey_cols, *index.key_cols)
            .agg(F.sum(_units(index.numbers()[1])).alias("units")))


class QueryTerms:
    """The terms of a batch of queries as arrays, with bounds in whole units.

    ``most`` and ``least`` bound what a term adds to any document's score, one unit wide of
    rounding; a negative weight can only lower a score.  A query's terms are sorted by
    ``most``, and ``before`` sums those that stand before.
    """

    def __init__(self, index: Bm25Index, asked: pa.Table, qkey_cols: list[str]):
        spark = index.vocab.sparkSession
        wanted = spark.createDataFrame(pa.table({"token": asked.column("token").unique()}))
        known = index.vocab.join(F.broadcast(wanted), "token").select("token", "df", "idf", "top").toArrow()
        found = asked.join(known, "token", join_type="inner")
        numbers: dict[tuple, int] = {}
        keys = zip(*(found.column(c).to_pylist() for c in qkey_cols))
        q = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
        token = np.array(found.column("token").to_pylist(), object)
        qtf, idf, top, df = (found.column(c).to_numpy().astype(float) for c in ("qtf", "idf", "top", "df"))
        w = qtf * idf
        most = np.where(w > 0, np.ceil(w * top * SCORE_UNITS) + 1, 0).astype(np.int64)
        order = np.lexsort((token.astype(str), -most, q))
        self.spark, self.qkey_cols = spark, qkey_cols
        self.schema = [found.schema.field(c) for c in qkey_cols]
        self.keys = list(numbers)
        self.q, self.token, self.w, self.most, self.df = (x[order] for x in (q, token, w, most, df))
        least = np.where(w < 0, np.floor(w * top * SCORE_UNITS) - 1, 0).astype(np.int64)
        n = len(numbers)
        self.total, self.below = (np.zeros(n, np.int64) for _ in range(2))
        np.add.at(self.total, q, most)
        np.add.at(self.below, q, least)
        starts = np.searchsorted(self.q, np.arange(n))
        sums = np.concatenate([[0], np.cumsum(self.most)])
        self.before = sums[:-1] - sums[starts][self.q]

    def frame(self, columns: dict) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(pa.table(columns)))

    def rows(self, where: np.ndarray) -> DataFrame:
        """(_q, token, w) of some terms."""
        return self.frame({"_q": self.q[where], "token": pa.array(self.token[where], pa.string()), "w": self.w[where]})

    def numbered(self) -> DataFrame:
        """(_q, qkeys)."""
        columns = [pa.array([k[i] for k in self.keys], f.type) for i, f in enumerate(self.schema)]
        return self.frame({"_q": np.arange(len(self.keys)), **dict(zip(self.qkey_cols, columns))})

    def floors(self, partial: DataFrame, k: int) -> np.ndarray:
        """A score that each query's k-th best reaches: the k-th best partial score, less what
        negative weights may take off; at least one unit, as any positive score."""
        if k == 1:
            kth = partial.groupBy("_q").agg(F.max("units").alias("kth"))
        else:
            w = Window.partitionBy("_q").orderBy(F.col("units").desc())
            kth = (partial.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
                   .where(F.col("n") == k).select("_q", F.col("units").alias("kth")))
        found = kth.toArrow()
        out = np.ones(len(self.keys), np.int64)
        at = found.column("_q").to_numpy()
        out[at] = np.maximum(out[at], found.column("kth").to_numpy() + self.below[at])
        return out


def ranked(index: Bm25Index, queries: DataFrame, qkey_cols: list[str], k: int,
           text_col: str = "text") -> DataFrame:
    """(qkeys, keys, score): every pair whose positive score may be among a query's ``k`` best,
    exactly scored; all of the ``k`` best are there.  A batch of more than ``QUERY_TERMS``
    terms, and one whose essential terms stand in most of the postings, is scored in full."""
    return _term_ranked(index, query_terms(queries, qkey_cols, text_col), qkey_cols, k)


def _term_ranked(index: Bm25Index, asked_terms: DataFrame, qkey_cols: list[str], k: int) -> DataFrame:
    """``ranked`` for queries given as (qkeys, token, qtf)."""
    keys = index.key_cols
    asked = asked_terms.limit(QUERY_TERMS + 1).toArrow()
    if asked.num_rows > QUERY_TERMS:
        return _term_scores(index, asked_terms, qkey_cols).where(F.col("score") > 0)
    n_docs, avgdl = index.numbers()
    terms = QueryTerms(index, asked, qkey_cols)
    heavy = (terms.before < HEAVY_SHARE * terms.total[terms.q]) & (terms.w > 0)
    floor = terms.floors(_partial(index, terms.rows(heavy), ["_q"]), k)
    essential = terms.total[terms.q] - terms.before >= floor[terms.q]
    if terms.df[essential].sum() > MOST_POSTINGS * terms.df.sum():
        return _in_full(index, terms, floor)
    rest = np.zeros(len(floor), np.int64)
    np.add.at(rest, terms.q[~essential], terms.most[~essential])
    # a pair that stays below the first floor stays below any other, and is not kept
    partial = _partial(index, terms.rows(essential), ["_q"]).join(
        terms.frame({"_q": np.arange(len(floor)), "floor": floor, "rest": rest}), "_q") \
        .where(F.col("units") + F.col("rest") >= F.col("floor")).persist(StorageLevel.MEMORY_AND_DISK)
    # at least k pairs of a query reach its first floor, so only they can raise it
    floor = np.maximum(floor, terms.floors(partial.where(F.col("units") >= F.col("floor")), k))
    near = partial.drop("floor").join(terms.frame({"_q": np.arange(len(floor)), "floor": floor}), "_q") \
        .where(F.col("units") + F.col("rest") >= F.col("floor"))
    others = terms.rows(~essential)
    if index.blocks is not None:
        near = near.withColumn("block", block_of(keys, n_docs))
        asked = near.select("_q", "block").distinct().join(others, "_q")
        most = F.when(F.col("w") > 0, F.ceil(F.col("w") * F.col("top") * SCORE_UNITS) + 1).otherwise(0).cast("bigint")
        by_block = (index.blocks.join(broadcast_if_small(asked, QUERY_BROADCAST_ROWS)[0], ["block", "token"])
                    .groupBy("_q", "block").agg(F.sum(most).alias("block_rest")))
        near = near.join(by_block, ["_q", "block"], "left").where(
            F.col("units") + F.coalesce("block_rest", F.lit(0)) >= F.col("floor"))
    near = near.select("_q", *keys, "units").persist(StorageLevel.MEMORY_AND_DISK)
    left, few = broadcast_if_small(near, QUERY_BROADCAST_ROWS)
    if not few:
        # pairs that cannot be broadcast would be joined to the postings by a shuffle of both
        near.unpersist()
        partial.unpersist()
        return _in_full(index, terms, floor)
    docs = index.tf.join(left.select(*keys), keys, "left_semi")
    added = docs.join(others, "token").join(left.select("_q", *keys), ["_q", *keys]) \
        .select("_q", *keys, _units(avgdl).alias("units"))
    sums = near.unionByName(added).groupBy("_q", *keys).agg(F.sum("units").alias("units"))
    return sums.where(F.col("units") > 0).join(terms.numbered(), "_q").select(
        *qkey_cols, *keys, (F.col("units") / SCORE_UNITS).alias("score"))


def _in_full(index: Bm25Index, terms: QueryTerms, floor: np.ndarray) -> DataFrame:
    """(qkeys, keys, score) of the pairs whose full score reaches the query's floor.  All terms
    are added up where a document's postings lie: nothing is shuffled or stored."""
    sums = _partial(index, terms.rows(np.ones(len(terms.q), bool)), ["_q"])
    reach = sums.join(terms.frame({"_q": np.arange(len(floor)), "floor": floor}), "_q") \
        .where(F.col("units") >= F.col("floor"))
    return reach.join(terms.numbered(), "_q").select(
        *terms.qkey_cols, *index.key_cols, (F.col("units") / SCORE_UNITS).alias("score"))


def _ordered(frame: DataFrame, qkey_cols: list[str], keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*qkey_cols).orderBy(F.col("score").desc(), *[F.col(c) for c in keys])
    return frame.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def filled(index: Bm25Index, queries: DataFrame, qkey_cols: list[str], found: DataFrame, k: int,
           text_col: str = "text") -> DataFrame:
    """(qkeys, keys, score): the ``k`` best of all documents for the queries with fewer than
    ``k`` positive scores in ``found``; zero and negative scores included, ties in corpus order.

    Documents that share no token score zero.  They are taken from the first documents of the
    corpus, twice as many each time until every query has its ``k``; only queries that
    still lack some take part.
    """
    keys = index.key_cols
    counts = found.groupBy(*qkey_cols).agg(F.count(F.lit(1)).alias("n"))
    lacking = queries.join(counts, qkey_cols, "left").where(F.coalesce("n", F.lit(0)) < k) \
        .select(*queries.columns).persist(StorageLevel.MEMORY_AND_DISK)
    if lacking.isEmpty():
        return found.select(*qkey_cols, *keys, "score").limit(0)
    all_scores = scores(index, lacking, qkey_cols, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    docs = index.tf.where(F.col("first_pos") == 0).select(*keys)
    n_docs, size = index.numbers()[0], 4 * k
    while True:
        first = docs.orderBy(*keys).limit(size)
        listed = first.agg(F.collect_list(F.struct(*keys)).alias("d"))
        pairs = lacking.select(*qkey_cols).withColumn("d", F.explode(listed.select("d").scalar())) \
            .select(*qkey_cols, *[F.col(f"d.{c}").alias(c) for c in keys])
        zeros = pairs.join(all_scores, [*qkey_cols, *keys], "left_anti").withColumn("score", F.lit(0.0))
        zeros = zeros.persist(StorageLevel.MEMORY_AND_DISK)
        enough = zeros.groupBy(*qkey_cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).count()
        if size >= n_docs or enough == lacking.count():
            break
        zeros.unpersist()
        size *= 2
    return _ordered(all_scores.select(*qkey_cols, *keys, "score").unionByName(zeros), qkey_cols, keys, k).drop("rank")


def top1(index: Bm25Index, queries: DataFrame, qkey_cols: list[str],
         text_col: str = "text", compat: bool = False) -> DataFrame:
    """AGG4: best document per query; ties go to the first document.

    Default: a query whose best score is not positive gets NULL keys.  ``compat`` ranks all
    documents: such a query gets the first one of the highest score, zero or negative.
    """
    keys = index.key_cols
    if compat:
        s = ranked(index, queries, qkey_cols, 1, text_col).persist(StorageLevel.MEMORY_AND_DISK)
        best = _best(s.unionByName(filled(index, queries, qkey_cols, s, 1, text_col)), qkey_cols, keys)
    else:
        asks, asking = asked_once(queries, qkey_cols, text_col)
        best = asking.join(_best(_term_ranked(index, asks, [ASK], 1), [ASK], keys), ASK).drop(ASK)
    return queries.select(*qkey_cols).join(best, qkey_cols, "left")


def _best(found: DataFrame, qkey_cols: list[str], keys: list[str]) -> DataFrame:
    """The first of a query's documents of the highest score."""
    return (found.groupBy(*qkey_cols)
            .agg(F.min_by(F.struct(*keys, "score"),
                          F.struct(-F.col("score"), *keys)).alias("best"))
            .select(*qkey_cols, *[F.col(f"best.{k}").alias(k) for k in keys],
                    rounded(F.col("best.score")).alias("score")))


def topk(index: Bm25Index, queries: DataFrame, qkey_cols: list[str], k: int,
         text_col: str = "text", compat: bool = False) -> DataFrame:
    """TOP2: the ``k`` best documents per query with positive score; with ``compat`` always
    ``k`` of them (all, if the corpus is smaller), zero and negative scores included.

    Order: score descending, then corpus order.  ``rank`` is 1-based.
    """
    keys = index.key_cols
    if not compat:
        asks, asking = asked_once(queries, qkey_cols, text_col)
        best = _ordered(_term_ranked(index, asks, [ASK], k), [ASK], keys, k)
        return asking.join(best, ASK).select(*qkey_cols, *keys, rounded(F.col("score")).alias("score"), "rank")
    s = ranked(index, queries, qkey_cols, k, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    more = filled(index, queries, qkey_cols, s, k, text_col)
    s = s.join(more.select(*qkey_cols).distinct(), qkey_cols, "left_anti").unionByName(more)
    return _ordered(s, qkey_cols, keys, k).withColumn("score", rounded(F.col("score")))


def write_index(index: Bm25Index, path: str) -> None:
    """Store an index as parquet tables in a shared folder (build once, probe many).

    ``tf`` is written clustered by token so a reader that filters on query tokens
    reads few row groups; ``vocab`` and ``stats`` are small companions.
    """
    # range partitions split a token that every document holds by its document keys
    (index.tf.repartitionByRange("token", *index.key_cols).sortWithinPartitions("token")
     .write.mode("overwrite").parquet(f"{path}/tf"))
    index.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    index = index if index.blocks is not None else with_blocks(index)
    index.blocks.repartitionByRange("block").write.mode("overwrite").parquet(f"{path}/blocks")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    index.first_key.write.mode("overwrite").parquet(f"{path}/first_key")
    index.tf.sparkSession.createDataFrame([(",".join(index.key_cols),)], "keys string") \
        .write.mode("overwrite").parquet(f"{path}/keys")


def read_index(spark, path: str) -> Bm25Index:
    """Open an index written by ``write_index``; nothing is recomputed."""
    keys = spark.read.parquet(f"{path}/keys").first()["keys"].split(",")
    vocab = spark.read.parquet(f"{path}/vocab")
    return Bm25Index(keys, spark.read.parquet(f"{path}/tf"), vocab, vocab, spark.read.parquet(f"{path}/stats"),
                     spark.read.parquet(f"{path}/first_key"), spark.read.parquet(f"{path}/blocks"))

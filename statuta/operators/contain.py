"""Containment join: which documents contain a passage as a substring (JN3).

Exact blocking rule: in ``p = t1 ' ' t2 ' ' ... ' ' tk`` every interior token
``ti`` (1 < i < k) stands between two spaces, so wherever ``p`` occurs in a text,
``ti`` is a whole token of ``split(text, ' ')``.  A passage with k >= 3 tokens is
therefore equi-joined to the documents holding its rarest interior token, and only
those candidates are checked with ``contains``.  Only tokens that some passage asks
for are kept when the documents' tokens are made distinct and counted.

A passage with one or two tokens has no interior token.  Its longer part then is a
substring of a single token of the text; passages are blocked on the first characters
of that part against the character n-grams of the distinct tokens, the tokens found
against the documents, and those candidates are checked with ``contains``.  This branch
is only planned when there are such passages.  There is no nested loop over documents
but for blank passages in ``compat`` (each of those is in every text that has as many
blanks, so its result is that large).
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import py_strip, tokens
from statuta.session import broadcast_if_small

CANDIDATE_BROADCAST_ROWS = 5_000_000
#: Characters that block a short passage.
GRAM = 3


def containment_pairs(passages: DataFrame, pkey_cols: list[str], docs: DataFrame,
                      doc_key: str, ptext: str = "text", dtext: str = "text",
                      compat: bool = False, dtokens: DataFrame | None = None,
                      dfreq: DataFrame | None = None) -> DataFrame:
    """(pkeys..., doc_key) for every passage contained in a document.

    Default drops blank passages (Q28); ``compat`` keeps them, and a blank passage
    is contained in every document.  ``dtokens`` (doc, token) and ``dfreq``
    (token, df) can be passed in from a BM25 index of the same documents.
    """
    p = passages.select(*pkey_cols, F.col(ptext).alias("ptext"))
    if not compat:
        p = p.where(py_strip(F.col("ptext")) != "")
    p = p.withColumn("ntok", F.size(tokens("ptext"))).persist(StorageLevel.MEMORY_AND_DISK)
    d = docs.select(doc_key, F.col(dtext).alias("dtext"))
    all_tokens = (dtokens.select(doc_key, "token") if dtokens is not None
                  else d.select(doc_key, F.explode(tokens("dtext")).alias("token")))
    out = _long_pairs(p.where(F.col("ntok") >= 3), pkey_cols, d, doc_key, all_tokens, dfreq)
    short_p = p.where(F.col("ntok") < 3)
    if short_p.isEmpty():
        return out
    return out.unionByName(_short_pairs(short_p, pkey_cols, d, doc_key, all_tokens, compat))


def _long_pairs(long_p: DataFrame, pkey_cols: list[str], d: DataFrame, doc_key: str,
                all_tokens: DataFrame, dfreq: DataFrame | None) -> DataFrame:
    """Passages with interior tokens, blocked on the rarest one."""
    interior = long_p.select(
        *pkey_cols,
        F.explode(F.array_distinct(F.slice(tokens("ptext"), 2, F.col("ntok") - 2))).alias("token"))
    interior_small, interior_is_small = broadcast_if_small(interior, CANDIDATE_BROADCAST_ROWS, persist=True)
    wanted, _ = broadcast_if_small(interior.select("token").distinct(), CANDIDATE_BROADCAST_ROWS, persist=True)
    # only tokens that a passage asks for are made distinct and counted
    dt = (all_tokens.join(wanted, "token", "left_semi").groupBy(doc_key, "token").agg(F.count(F.lit(1)).alias("tf"))
          .persist(StorageLevel.MEMORY_AND_DISK))
    df = (dfreq.select("token", "df") if dfreq is not None
          else dt.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    rated = df.join(interior_small, "token", "right").select(
        *pkey_cols, "token", F.coalesce(F.col("df"), F.lit(0)).alias("df"))
    pick = rated.groupBy(*pkey_cols).agg(
        F.min_by("token", F.struct("df", "token")).alias("token"))
    # one token per passage: bounded by the interior rows checked above
    pick_small = F.broadcast(pick) if interior_is_small else pick
    cand = dt.join(pick_small, "token").select(*pkey_cols, doc_key)
    return _verified(cand, long_p, pkey_cols, d, doc_key)


def _verified(cand: DataFrame, passages: DataFrame, pkey_cols: list[str], d: DataFrame, doc_key: str) -> DataFrame:
    """Candidate pairs whose document contains the passage."""
    cand = cand.join(passages.select(*pkey_cols, "ptext"), pkey_cols)
    cand_small, _ = broadcast_if_small(cand, CANDIDATE_BROADCAST_ROWS, persist=True)
    return (d.join(cand_small, doc_key)
            .where(F.col("dtext").contains(F.col("ptext")))
            .select(*pkey_cols, doc_key))


def _short_pairs(short_p: DataFrame, pkey_cols: list[str], d: DataFrame, doc_key: str,
                 all_tokens: DataFrame, compat: bool) -> DataFrame:
    """Passages of one or two tokens, blocked on n-grams of their longer part."""
    part = F.array_max(F.transform(tokens("ptext"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    keyed = short_p.withColumn("part", part)
    block = keyed.where(F.col("part") != "").select(
        *pkey_cols, "part", F.substring("part", 1, GRAM).alias("gram"))
    distinct = all_tokens.select("token").distinct().select("token", F.length("token").alias("n"))
    grams = distinct.where("n > 0").select("token", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("n")), lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(GRAM), F.col("n") - i + 1)),
            lambda k: F.substring(F.col("token"), i, k)))))).alias("gram"))
    block_small, _ = broadcast_if_small(block, CANDIDATE_BROADCAST_ROWS, persist=True)
    holding = (grams.join(block_small, "gram").where(F.col("token").contains(F.col("part")))
               .select(*pkey_cols, "token").distinct())
    holding_small, _ = broadcast_if_small(holding, CANDIDATE_BROADCAST_ROWS, persist=True)
    cand = all_tokens.join(holding_small, "token").select(*pkey_cols, doc_key).distinct()
    out = _verified(cand, short_p, pkey_cols, d, doc_key)
    if compat:
        blank = keyed.where(F.col("part") == "").select(*pkey_cols, "ptext")
        out = out.unionByName(d.join(blank, F.col("dtext").contains(F.col("ptext"))).select(*pkey_cols, doc_key))
    return out

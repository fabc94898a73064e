"""Operator 2: language identification by Bayesian evidence fusion.

For every text the posterior over languages multiplies four kinds of evidence:

* the likelihood of the text's character trigrams under a model per language, counted by a
  grouped aggregation over all texts with a declared language;
* the declared markup language, through how often texts of a language declare it;
* the address suffix (a language segment of the path, else the top-level domain), likewise;
* the prior of the host, smoothed towards its parent domain, and that towards all texts.
  A text's own vote is taken out of its host's counts.

Every well-formed declared code is a language, however rare.  One more class, other, gives
each trigram bucket the same chance and gathers votes like a language, so that a text that
is unlike every model belongs to none and is rejected.  A model of few texts is close to
that background.

Text likelihoods are taken as at most ``TEXT_WEIGHT`` independent trigrams, so that a long
text can outvote its declaration, but a few words cannot.  All counts are partial
aggregations, so a host that holds a third of the rows collapses in each map task; the
evidence tables are joined by Spark, broadcast only if their written size allows.  Plans do
not grow with the number of languages; the model (one float per language and bucket) and
the likelihoods of a row do.

Defined cases: a text without letters, and a text whose best language has a posterior under
``MIN_POSTERIOR``, is rejected (null and empty texts among them; they still get the
language of their other evidence); a text likest other has no text_lang; null or malformed declarations, suffixes and hosts are
no evidence; when no text declares a language, language and posterior are null and nothing
is rejected; repeated rows each get a row; other columns are not read.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import row_columns, shared, ship, whole_row

ship(__name__)

BUCKETS = 8192
TEXT_WEIGHT = 50
#: Pseudo-counts of the smoothed tables.
HOST_STRENGTH, EVIDENCE_STRENGTH = 10.0, 5.0
#: Trigrams a text needs for its vote to count in the evidence tables.
MIN_VOTE = 20
MIN_POSTERIOR = 0.5
#: Characters counted at a time, which bounds the memory of a very long text.
CHUNK = 1 << 20
#: Languages a task counts at a time, which bounds its memory.
HELD = 256
NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigram_counts(text: str | None) -> np.ndarray:
    """Hashed counts of the UTF-8 byte trigrams of a text's lower-cased words."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    text = text or ""
    for at in range(0, len(text), CHUNK):
        words = NOT_LETTERS.sub(" ", text[at:at + CHUNK].lower()).strip()
        if words:
            b = np.frombuffer(f" {words} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
            h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(19)
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def _count_trigrams(batches):
    """(text, declared) -> trigram counts per declared language, summed per task."""
    held = {}

    def rows():
        for code, total in held.items():
            bucket = np.flatnonzero(total)
            yield pd.DataFrame({"declared": code, "bucket": bucket.astype(np.int32), "n": total[bucket]})
        held.clear()

    for batch in batches:
        for text, code in zip(batch["text"], batch["declared"]):
            if code not in held:
                if len(held) == HELD:
                    yield from rows()
                held[code] = np.zeros(BUCKETS, dtype=np.int64)
            held[code] += trigram_counts(text)
    yield from rows()


def _model(languages: list[str], counted: pd.DataFrame) -> np.ndarray:
    """Log likelihood of each bucket per language, and of the class other in the first row."""
    model = np.zeros((len(languages) + 1, BUCKETS), dtype=np.float32)
    place = {code: i for i, code in enumerate(languages, 1)}
    model[counted["declared"].map(place).to_numpy(np.int64), counted["bucket"].to_numpy(np.int64)] = counted["n"]
    for row in model:
        row[:] = np.log((row + 0.5) / (row.sum(dtype=np.float64) + 0.5 * BUCKETS))
    return model


def _likelihoods(model):
    """Adds to each row its number of trigrams and its tempered log likelihood per language."""

    def run(batches):
        weights = model.value
        for batch in batches:
            sizes, rows = [], []
            for text in batch["text"]:
                counts = trigram_counts(text)
                n = int(counts.sum())
                held = np.flatnonzero(counts)
                rows.append((weights[:, held].astype(np.float64) @ counts[held] * (min(n, TEXT_WEIGHT) / n if n else 0.0)).tolist())
                sizes.append(n)
            yield batch.drop(columns="text").assign(n_grams=np.array(sizes, dtype=np.int64), log_text=rows)

    return run


def declared_code(declared: Column) -> Column:
    """Primary subtag of a declared language, or null."""
    code = F.regexp_extract(F.lower(F.coalesce(declared.cast("string"), F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(code != "", code)


def address_host(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def address_suffix(url: Column) -> Column:
    """``/xx`` for a language segment at the head of the path, else the top-level domain."""
    url = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+(/[a-z]{2})(?:[/?#]|$)", 1)
    domain = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#:]*(\.[a-z]+)(?:[:/?#]|$)", 1)
    return F.when(path != "", path).when(domain != "", domain)


def parent_domain(host: Column) -> Column:
    """The last two labels of a host; a host without dots has no parent."""
    found = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(found != "", found)


def page_text(html: Column) -> Column:
    """Visible text of a page."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(text, r"&#?\w+;", " ")


def page_language(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def _numbers(values: list[float]) -> Column:
    """A constant array that is one node of the plan."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def _totals(votes: DataFrame, k: int) -> list[float]:
    found = {r["vote"]: r["n"] for r in votes.groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [float(found.get(i + 1, 0)) for i in range(k)]


def _votes_by(votes: DataFrame, key: str, k: int) -> DataFrame:
    """One row per key value: the number of its votes per class as an array ``n``."""
    counted = votes.where(F.col(key).isNotNull()).groupBy(key, "vote").agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("m"))
    return lists.select(key, F.expr(f"transform(sequence(1, {k}), i -> cast(coalesce(m[i], 0) AS double))").alias("n"))


def _shares(votes: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Smoothed log P(key value | class) of a table of votes, one row per key value."""
    totals = _totals(votes.where(F.col(key).isNotNull()), k)
    share = f"aggregate(n, 0D, (a, x) -> a + x) / {max(sum(totals), 1.0)!r}D"
    logs = F.expr(f"transform(n, (x, i) -> ln((x + {EVIDENCE_STRENGTH}D * share) / (t[i] + {EVIDENCE_STRENGTH}D)))")
    per_value = _votes_by(votes, key, k).withColumn("share", F.expr(share)).withColumn("t", _numbers(totals))
    return shared(per_value.select(F.col(key).alias(f"_{name}"), logs.alias(name)), name)


def identify(texts: DataFrame, keys: list[str], min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``texts`` (keys, text, declared, suffix, host) -> keys, lang, posterior, text_lang, kept."""
    spark = texts.sparkSession
    rows = texts.select(*keys, "text", declared_code(F.col("declared")).alias("declared"), "suffix", "host")
    declaring = rows.where("declared IS NOT NULL")
    languages = sorted(r["declared"] for r in declaring.select("declared").distinct().collect())
    if not languages:
        null = F.lit(None).cast("string")
        return rows.select(*keys, null.alias("lang"), F.lit(None).cast("double").alias("posterior"),
                           null.alias("text_lang"), F.lit(True).alias("kept"))
    k = len(languages) + 1  # classes: other, then the languages
    counted = (declaring.select("text", "declared")
               .mapInPandas(_count_trigrams, "declared string, bucket int, n long")
               .groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    model = _model(languages, counted)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema]
    scored = shared(rows.mapInPandas(_likelihoods(spark.sparkContext.broadcast(model)),
                                     ", ".join([*kept, "n_grams long", "log_text array<double>"])), "likelihoods")
    best = F.when(F.col("n_grams") > 0, F.array_position("log_text", F.array_max("log_text")).cast("int"))
    scored = scored.withColumn("vote", best)
    votes = scored.where(F.col("n_grams") >= MIN_VOTE)
    own = F.expr(f"transform(sequence(1, {k}), i -> IF(i = vote AND n_grams >= {MIN_VOTE}, 1D, 0D))")
    declared = _shares(votes, "declared", k, "log_declared")
    suffix = _shares(votes, "suffix", k, "log_suffix")
    everywhere = [x + 1 for x in _totals(votes, k)]
    everywhere = _numbers([x / sum(everywhere) for x in everywhere])
    hosts = _host_priors(votes, everywhere, k)
    joined = (scored.withColumn("own", own)
              .join(declared, F.col("declared") == F.col("_log_declared"), "left")
              .join(suffix, F.col("suffix") == F.col("_log_suffix"), "left")
              .join(hosts, F.col("host") == F.col("_host"), "left"))
    rest = "aggregate(zip_with(host_n, own, (a, b) -> a - b), 0D, (a, x) -> a + x)"
    joined = joined.withColumn("rest", F.expr(rest))
    prior = F.when(F.col("host_n").isNull(), everywhere).otherwise(F.expr(
        "transform(sequence(0, size(own) - 1), i -> "
        f"(host_n[i] - own[i] + {HOST_STRENGTH} * host_prior[i]) / (rest + {HOST_STRENGTH}))"))
    none = F.array_repeat(F.lit(0.0), k)
    logs = joined.select(*keys, "vote", "n_grams", prior.alias("prior"), "log_text",
                         F.coalesce("log_declared", none).alias("d"), F.coalesce("log_suffix", none).alias("s"))
    logs = logs.withColumn("log", F.expr(
        "transform(sequence(0, size(prior) - 1), i -> ln(prior[i]) + log_text[i] + d[i] + s[i])"))
    logs = logs.withColumn("top", F.array_max("log")).withColumn("best", F.array_max(F.slice("log", 2, k - 1)))
    names = F.split(F.lit(",".join(languages)), ",")
    posterior = F.exp(F.col("best") - F.col("top")) / F.aggregate(
        "log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    place = F.array_position(F.slice("log", 2, k - 1), F.col("best")).cast("int") - 1
    return logs.select(
        *keys, F.get(names, place).alias("lang"), posterior.alias("posterior"),
        F.when(F.col("vote") > 1, F.get(names, F.col("vote") - 2)).alias("text_lang"),
        ((F.col("n_grams") > 0) & (posterior >= min_posterior)).alias("kept"))


def _host_priors(votes: DataFrame, everywhere: Column, k: int) -> DataFrame:
    """One row per host: its votes, and its prior from its parent domain and all texts."""
    per_host = shared(_votes_by(votes, "host", k).select(
        "host", parent_domain(F.col("host")).alias("parent"), F.col("n").alias("host_n")), "hosts")
    parents = _votes_by(votes.withColumn("parent", parent_domain(F.col("host"))), "parent", k)
    parents = parents.select(F.col("parent").alias("_parent"), F.col("n").alias("p"))
    joined = per_host.join(parents, F.col("parent") == F.col("_parent"), "left").withColumn("g", everywhere)
    # the parent's counts without this host's, smoothed towards all texts
    joined = joined.withColumn("others", F.expr("aggregate(zip_with(p, host_n, (a, b) -> a - b), 0D, (a, x) -> a + x)"))
    prior = F.when(F.col("p").isNull(), F.col("g")).otherwise(F.expr(
        "transform(sequence(0, size(g) - 1), i -> (p[i] - host_n[i] + {m} * g[i]) / (others + {m}))".format(
            m=HOST_STRENGTH)))
    return shared(joined.select(F.col("host").alias("_host"), "host_n", prior.alias("host_prior")), "host-priors")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of corpus documents: ``lang`` as the declaration, ``source`` as the host."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.col("source").cast("string").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: visible text, markup language, address suffix and host."""
    return pages.select("page_id", page_text(F.col("html")).alias("text"),
                        page_language(F.col("html")).alias("declared"),
                        address_suffix(F.col("url")).alias("suffix"), address_host(F.col("url")).alias("host"))


def _row_key(*columns) -> Column:
    # the hash skips nulls, so their places are hashed too
    return F.xxhash64(*columns, *[F.isnull(c) for c in columns])


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language stays open, with or without a doc_id."""
    # rows of one key have the same evidence
    key = _row_key("doc_id", "text", "lang", F.col("source").cast("string"))
    rejected = shared(identify(document_evidence(docs).withColumn("key", _row_key("doc_id", "text", "declared", "host")), ["key"])
                      .where("NOT kept").select("key").distinct(), "lang-rejected")
    rows = docs.select(whole_row(docs).alias("row"), key.alias("key"))
    return rows.join(rejected, "key", "left_anti").select(*row_columns(docs))

"""Operator 10: toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding undoes homoglyphs, full-width letters and digit or sign substitutions inside
words, and reads the look-alikes ``l``, and ``1``, ``!`` and ``|`` inside words, as ``i``.  Lexicon
entries are words and word beginnings; their weights are log odds of training documents
with and without the toxic label, counted over a bounded sample of labelled rows (``SAMPLE``,
those of smallest hash of doc_id).  An entry needs a share
of the toxic documents, which bounds the lexicon.  Phrases around a match that clean
documents use more than toxic ones are exceptions and cancel it, as do the fixed ones.  A
document's weights are summed, one entry per word, and divided by its length; a logistic
curve fitted to the counts of training documents per step turns that into the score.

Counting, joining and fitting counts run in Spark; Python tasks fold and match one text at
a time.  Only the lexicon (at most ``(terms of a document) / MIN_SHARE`` entries) and the
calibration histogram reach the driver.

Defined cases: null and empty texts have no match and score as clean; without toxic labels
only the seed words count, with a fixed weight; repeated labels of a document count once
(the higher); repeated rows each get a row; other columns are not read.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_right

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import shared, ship

ship(__name__)

# Seed words, exception phrases, look-alike characters.
SEEDS = ("idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "idiot proof", "pathetic fallacy")
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁɡһкмтвнαεορτυικνχ",
    "aeopcyxijsdghkmtbhaeoptuiknx")
FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
SUBSTITUTES = str.maketrans("034578@$", "oeastbas")
LOOK_ALIKES = str.maketrans("l1!|", "iiii")

#: Bound of the labelled sample that the lexicon is learnt from.
SAMPLE = 16_000
#: Shares of the toxic training documents that an entry, and documents that an exception, needs.
MIN_SHARE = 0.01
MIN_DOCS = 3
MIN_LOG_ODDS = 3.0
SEED_WEIGHT = 5.0
PREFIXES = (4, 5, 6)
#: Words added to every length, so that one match in a short text does not decide alone.
LENGTH_PRIOR = 50
STEPS = 200

FOREIGN = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "！-～]")
IN_WORD = re.compile(r"[^\W\d_][0134578@$!|]+(?=[^\W_])|(?<![^\W_])[0134578@$!|]+(?=[^\W\d_])")
BREAKS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The text's words in folded form, each between single spaces (empty text: one space)."""
    low = (text or "").lower()
    if FOREIGN.search(low):
        low = low.translate(FULL_WIDTH).lower().translate(HOMOGLYPHS)
    low = IN_WORD.sub(lambda m: m.group().translate(SUBSTITUTES).translate(LOOK_ALIKES), low)
    words = BREAKS.sub(" ", low.replace("l", "i")).strip()
    return f" {words} " if words else " "


def fold_entry(entry: str) -> str:
    return fold(entry).strip()


def terms(folded: str) -> set[str]:
    """Words and word beginnings of a folded text; a beginning ends in ``*``."""
    words = set(folded.split())
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _explode_terms(batches):
    for batch in batches:
        for toxic, part in batch.groupby("toxic"):
            found: dict[str, int] = {}
            for text in part["text"]:
                for t in terms(fold(text)):
                    found[t] = found.get(t, 0) + 1
            yield pd.DataFrame({"term": list(found), "n": np.fromiter(found.values(), np.int64, len(found)),
                                "toxic": np.full(len(found), toxic, dtype=np.int32)})


def automaton(lexicon: dict[str, float], exceptions: list[str]):
    """Aho-Corasick automaton over folded texts; an exception has no weight."""
    found = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        key = f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "
        found.add_word(key, (weight, len(key)))
    for phrase in exceptions:
        key = f" {phrase} "
        found.add_word(key, (None, len(key)))
    if len(found):
        found.make_automaton()
    return found


def matches(folded: str, found) -> dict[int, float]:
    """Start of each matched word -> its largest weight, without words inside an exception."""
    if not len(found):
        return {}
    hits: dict[int, float] = {}
    excepted = []
    for end, (weight, size) in found.iter(folded):
        start = end - size + 1
        if weight is None:
            excepted.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    if not excepted:
        return hits
    # spans in order, those that overlap as one; a word's span is the last that begins at or before it
    lows, highs = [], []
    for a, b in sorted(excepted):
        if highs and a <= highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)
    inside = {s: bisect_right(lows, s) - 1 for s in hits}
    return {s: w for s, w in hits.items() if inside[s] < 0 or s >= highs[inside[s]]}


def _explode_phrases(lexicon):
    """The two-word phrases around matches, by label."""

    def run(batches):
        found = automaton(lexicon.value, [])
        for batch in batches:
            rows = []
            for toxic, text in zip(batch["toxic"], batch["text"]):
                folded, own = fold(text), set()
                for start in matches(folded, found):
                    end = folded.index(" ", start + 1)
                    word, before = folded[start + 1:end], folded[folded.rfind(" ", 0, start) + 1:start]
                    after = folded[end + 1:max(end, folded.find(" ", end + 1))]
                    own |= {f"{before} {word}"} if before else set()
                    own |= {f"{word} {after}"} if after else set()
                rows += [(p, int(toxic)) for p in own]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"]).astype({"toxic": "int32"})

    return run


def _densities(lexicon, exceptions):
    def run(batches):
        found = automaton(lexicon.value, exceptions.value)
        for batch in batches:
            out = []
            for text in batch["text"]:
                folded = fold(text)
                out.append(100 * sum(matches(folded, found).values()) / (folded.count(" ") - 1 + LENGTH_PRIOR))
            yield batch.drop(columns="text").assign(density=np.array(out, dtype=np.float64))

    return run


def is_held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def learn(train: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Lexicon (entry -> weight) and exception phrases of labelled texts (text, toxic)."""
    spark = train.sparkSession
    counts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    seeds = {fold_entry(w): SEED_WEIGHT for w in SEEDS}
    if not toxic or not clean:
        return seeds, [fold_entry(p) for p in EXCEPTIONS]
    kind = "term string, n long, toxic int"
    # common terms of the toxic documents first; the clean ones are counted for those only
    common = shared(train.where("toxic = 1").select("text", "toxic").mapInPandas(_explode_terms, kind)
                    .groupBy("term").agg(F.sum("n").alias("n_toxic"))
                    .where(F.col("n_toxic") >= max(MIN_DOCS, math.ceil(MIN_SHARE * toxic))), "toxic-terms")
    innocent = (train.where("toxic = 0").select("text", "toxic").mapInPandas(_explode_terms, kind)
                .join(common.select("term"), "term").groupBy("term").agg(F.sum("n").alias("n_clean")))
    odds = (F.log((F.col("n_toxic") + 0.5) / (toxic + 1.0))
            - F.log((F.coalesce("n_clean", F.lit(0)) + 0.5) / (clean + 1.0)))
    entries = common.join(innocent, "term", "left").select("term", odds.alias("w")).where(F.col("w") >= MIN_LOG_ODDS)
    lexicon = seeds | {r["term"]: r["w"] for r in entries.collect()}
    by_phrase = (train.select("text", "toxic").mapInPandas(_explode_phrases(spark.sparkContext.broadcast(lexicon)),
                                                           "phrase string, toxic int")
                 .groupBy("phrase").agg(F.sum("toxic").alias("n_toxic"),
                                        F.sum(1 - F.col("toxic")).alias("n_clean"))
                 .where((F.col("n_clean") >= max(MIN_DOCS, math.ceil(MIN_SHARE * toxic)))
                        & (F.col("n_clean") > F.col("n_toxic"))))
    return lexicon, [fold_entry(p) for p in EXCEPTIONS] + sorted(r["phrase"] for r in by_phrase.collect())


def logistic(steps: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (x, n clean, n toxic), by Newton steps."""
    x, clean, toxic = (np.array(c, dtype=np.float64) for c in zip(*steps))
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.array([-3.0, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (toxic - (clean + toxic) * p) - 0.1 * beta
        curve = (design * ((clean + toxic) * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             mod: int = 4, rest: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, density and score of every document row."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    open_marks = shared(marks.where(~is_held_out(F.col("doc_id"), mod, rest)), "toxic-marks")
    chosen = F.broadcast(open_marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # copies of a text count once, by the text itself
    train = shared(rows.join(chosen, "doc_id").withColumn("_h", F.xxhash64("text"))
                   .groupBy("_h", F.length("text").alias("_n")).agg(F.first("text").alias("text"),
                                                                   F.max("toxic").alias("toxic")), "toxic-train")
    lexicon, exceptions = (sc.broadcast(x) for x in learn(train))
    scored = shared(rows.mapInPandas(_densities(lexicon, exceptions), "doc_id long, density double"), "toxic-density")
    x = F.log1p("density")
    steps = (scored.join(open_marks, "doc_id")
             .groupBy(F.least(F.floor(x * 40), F.lit(STEPS)).alias("step"))
             .agg(F.avg(x).alias("x"), F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")))
    curve = [(r["x"], r["clean"], r["toxic"]) for r in steps.orderBy("step").collect()]
    both = bool(curve) and sum(c for _, c, _ in curve) > 0 and sum(t for *_, t in curve) > 0
    a, b = logistic(curve) if both else (-3.0, 2.0)
    return scored.select("doc_id", is_held_out(F.col("doc_id"), mod, rest).alias("held_out"), "density",
                         (1 / (1 + F.exp(-(a + b * x)))).alias("score"))

"""Questions, choices, votes and accuracy (DS1, DS2, TX15, AGG5-AGG9, JN6, SET4)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import with_choice

CHOICE_LETTERS = ["A", "B", "C", "D"]


def expand_choices(questions: DataFrame, qkey_cols: list[str], quest: str = "quest",
                   choice_cols: list[str] = CHOICE_LETTERS, drop_missing: bool = True) -> DataFrame:
    """DS2 + TX15: one row per (question, choice) with ``question \\n choice``.

    Default drops missing choices (Q20); otherwise a missing choice becomes the
    text ``nan`` as in the original.
    """
    arr = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("choice_no"),
                             F.lit(c).alias("choice"), F.col(c).alias("ctext"))
                    for i, c in enumerate(choice_cols)])
    x = questions.select(*qkey_cols, F.col(quest).alias("quest"), F.inline(arr))
    if drop_missing:
        x = x.where(F.col("ctext").isNotNull())
    else:
        x = x.withColumn("ctext", F.coalesce(F.col("ctext"), F.lit("nan")))
    return x.select(*qkey_cols, "choice_no", "choice",
                    with_choice(F.col("quest"), F.col("ctext")).alias("text"))


def vote(predictions: DataFrame, qkey_cols: list[str], pred_cols: list[str],
         order_col: str = "choice_no") -> DataFrame:
    """AGG5 + AGG6: tally predictions per question; most votes wins, ties go to
    the prediction seen first (smallest ``order_col``).  NULL predictions do not
    vote.  Output: qkeys, pred cols, votes (questions with no vote are absent)."""
    tally = (predictions.where(F.col(pred_cols[0]).isNotNull())
             .groupBy(*qkey_cols, *pred_cols)
             .agg(F.count(F.lit(1)).alias("votes"), F.min(order_col).alias("first")))
    best = tally.groupBy(*qkey_cols).agg(
        F.min_by(F.struct(*pred_cols, "votes"), F.struct(-F.col("votes"), F.col("first"))).alias("w"))
    return best.select(*qkey_cols, *[F.col(f"w.{c}").alias(c) for c in pred_cols],
                       F.col("w.votes").alias("votes"))


def vote_row(preds: list[Column]) -> Column:
    """``vote`` over the predictions of one row, in choice order."""
    given = F.filter(F.array(*[F.struct(F.lit(i).alias("first"), p.alias("pred")) for i, p in enumerate(preds)]),
                     lambda s: s["pred"].isNotNull())
    tally = F.transform(given, lambda s: F.struct(
        (-F.size(F.filter(given, lambda o: o["pred"] == s["pred"]))).alias("votes"), s["first"], s["pred"]))
    return F.array_min(tally)["pred"]


def judge(preds: DataFrame, gold_pairs: DataFrame, qkey_cols: list[str],
          pred_col: str, gold_col: str) -> DataFrame:
    """JN6: attach ``n_gold``, ``correct`` and ``any_match`` to predictions.

    Right iff exactly one gold label equal to the prediction (Q8); any-match iff
    the prediction is one of the gold labels.  A label that is given twice counts twice,
    and one without a key (unknown law) counts but matches nothing.  Gold lists are never collected:
    the count is an aggregate and membership is an equi-join on (question, label).
    """
    stats = gold_pairs.groupBy(*qkey_cols).agg(F.count(F.lit(1)).alias("n_gold"))
    hit = gold_pairs.select(*qkey_cols, F.col(gold_col).alias(pred_col)).distinct().withColumn("hit", F.lit(1))
    j = preds.join(stats, qkey_cols, "left").join(hit, [*qkey_cols, pred_col], "left")
    return (j.withColumn("n_gold", F.coalesce(F.col("n_gold"), F.lit(0)).cast("bigint"))
            .withColumn("correct", F.when((F.col("n_gold") == 1) & (F.col("hit") == 1), 1.0).otherwise(0.0))
            .withColumn("any_match", F.when(F.col("hit") == 1, 1.0).otherwise(0.0))
            .drop("hit"))


def judge_rows(preds: DataFrame, pred_col: str, gold_col: str) -> DataFrame:
    """``judge`` for predictions that have their list of gold labels in ``gold_col``."""
    n_gold = F.coalesce(F.greatest(F.size(gold_col), F.lit(0)), F.lit(0)).cast("bigint")
    hit = F.coalesce(F.array_contains(gold_col, F.col(pred_col)), F.lit(False))
    return preds.withColumns({
        "n_gold": n_gold, "correct": F.when((n_gold == 1) & hit, 1.0).otherwise(0.0),
        "any_match": F.when(hit, 1.0).otherwise(0.0)})


def accuracy(judged: DataFrame, group_cols: list[str], total: str | None = None) -> DataFrame:
    """AGG8: mean of ``correct`` and ``any_match``; every row is in the denominator.
    ``total`` adds a row over all groups under that name (one, never null, group column)."""
    grouped = judged.rollup(*group_cols) if total else judged.groupBy(*group_cols)
    out = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("correct"), 6).alias("accuracy"),
        F.round(F.avg("any_match"), 6).alias("any_match"))
    return out.fillna(total, group_cols) if total else out

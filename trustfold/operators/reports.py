"""Run histories read back: best rounds, summaries, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.constants import EXCLUSION_LIMIT, INITIAL_SCORE
from trustfold.functions.positions import maximum_before
from trustfold.functions.sizing import broadcast_if_small


def best_so_far(log: DataFrame, run: list[str]) -> DataFrame:
    """Add ``best`` (running maximum) and ``is_new_best`` (strictly above all earlier rounds, from 0)."""
    earlier = maximum_before(log, run, "round", "accuracy", "_earlier")
    before = F.coalesce("_earlier", F.lit(0.0))
    return (
        earlier.withColumn("is_new_best", F.col("accuracy") > before)
        .withColumn("best", F.greatest(F.col("accuracy"), before))
        .drop("_earlier")
    )


def carried_score(rounds: DataFrame, history: DataFrame, run: list[str], out: str, client: int = 0) -> DataFrame:
    """(run, round, out): one client's score in every round of ``rounds``.

    A round in which the client was not seen has its last known score, the
    initial one before the first.
    """
    keys = [*run, "round"]
    seen = history.filter(F.col("client_id") == client).select(*keys, F.col("score").alias("_seen"))
    last = F.last("_seen", ignorenulls=True).over(Window.partitionBy(*run).orderBy("round"))
    every = rounds.select(*keys).distinct().join(seen, keys, "left")
    return every.select(*keys, F.coalesce(last, F.lit(INITIAL_SCORE)).alias(out))


def round_table(history: DataFrame, accuracy: DataFrame, run: list[str]) -> DataFrame:
    """``history`` with the accuracy columns of its round and the first client's score; no round is left out."""
    keys = [*run, "round"]
    scores = carried_score(history, history, run, "score_c0")
    return history.join(accuracy, keys, "left").join(scores, keys)


def run_summary(log: DataFrame, run: list[str], tail: int = 10) -> DataFrame:
    """Per run: rounds, final and best accuracy, first best round, mean of the last ``tail`` rounds.

    Every statistic is a mergeable aggregate; the tail mean takes the run's
    last round from a first, tiny aggregate.
    """
    lasts = log.groupBy(*run).agg(F.max("round").alias("_last"))
    marked = log.join(broadcast_if_small(lasts), run)
    in_tail = F.col("round") > F.col("_last") - tail
    return marked.groupBy(*run).agg(
        F.count(F.lit(1)).alias("rounds"),
        F.max_by("accuracy", "round").alias("final"),
        F.max("accuracy").alias("best"),
        F.min_by("round", F.struct(-F.col("accuracy"), F.col("round"))).alias("best_round"),
        F.avg(F.when(in_tail, F.col("accuracy"))).alias("tail_mean"),
    )


def detection(history: DataFrame, run: list[str], is_attacker: Column, limit: float = EXCLUSION_LIMIT) -> DataFrame:
    """Per run and client: first excluded round, rounds excluded, and what that means for its kind."""
    out = F.col("score") <= F.lit(limit)
    report = history.groupBy(*run, "client_id").agg(
        F.min(F.when(out, F.col("round"))).alias("first_excluded"),
        F.sum(out.cast("bigint")).alias("rounds_excluded"),
        F.count(F.lit(1)).alias("rounds"),
    )
    ever = F.col("first_excluded").isNotNull()
    verdict = (
        F.when(is_attacker & ever, "detected").when(is_attacker, "missed")
        .when(ever, "wrongly_excluded").otherwise("clean")
    )
    return report.withColumn("verdict", verdict)

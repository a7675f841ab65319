"""Accuracy logs: one row per round with the first client's score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.operators.reports import carried_score


def accuracy_log(accuracy: DataFrame, history: DataFrame, client: int = 0) -> DataFrame:
    """(Round, Accuracy, Credibility_C0) of every round of accuracy(round), with one client's score from the history.

    Where the client was not seen its last known score stands.
    """
    score = carried_score(accuracy, history, [], "Credibility_C0", client)
    return accuracy.join(score, "round").select(
        F.col("round").alias("Round"), F.col("accuracy").alias("Accuracy"), "Credibility_C0"
    )


def log_name(attack: int, ratio: float) -> str:
    return f"log_atk{attack}_ratio{ratio}.csv"


def write_log(log: DataFrame, path: str, attack: int, ratio: float) -> str:
    """CSV with header under ``path``; the folder's name carries attack and ratio."""
    target = f"{path}/{log_name(attack, ratio)}"
    log.orderBy("Round").write.mode("overwrite").option("header", True).csv(target)
    return target

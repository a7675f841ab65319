"""Distance threshold from two independent trainings per client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.functions.hashing import uniform
from trustfold.operators.aggregation import model_distance, threshold_value
from trustfold.operators.training import train_fullbatch, train_minibatch


def half_sample_distances(
    dealt: DataFrame, model: DataFrame, classes: int, lr: float, steps: int = 1, key: str = "client_id"
) -> DataFrame:
    """(key, dist) between full-batch trainings on two hashed half-samples of each client.

    Full-batch steps have no shuffling noise, so the spread comes from the samples.
    """
    trained = [
        train_fullbatch(
            dealt.filter(uniform(seed, "half", F.col("row_id")) < 0.5), model, classes, lr, steps, key
        )
        for seed in (1, 2)
    ]
    return model_distance(trained[0], trained[1], key)


def reshuffled_distances(
    dealt: DataFrame, model: DataFrame, classes: int, lr: float, key: str = "client_id", **options
) -> DataFrame:
    """(key, dist) between two mini-batch trainings that differ in their shuffles only."""
    trained = [train_minibatch(dealt, model, classes, lr=lr, seed=seed, key=key, **options) for seed in (1, 2)]
    return model_distance(trained[0], trained[1], key)


def estimate_threshold(distances: DataFrame) -> DataFrame:
    """One row: the threshold ``d_th`` and the spread of distances behind it, rounded for display."""
    return distances.agg(
        threshold_value().alias("d_th"),
        F.count("dist").alias("clients"),
        F.round(F.min("dist"), 4).alias("smallest"),
        F.round(F.max("dist"), 4).alias("largest"),
    )

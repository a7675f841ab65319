"""Best-model sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trustfold.schemas import PARAMS


def save_best(model: DataFrame, accuracy: float, best: float, path: str) -> tuple[float, str | None]:
    """Write ``model`` to a new version under ``path`` when it strictly beats ``best``.

    Returns the best accuracy so far and the new version's folder, or None.
    Versions are never overwritten, so a reader keeps a whole model.
    """
    if not accuracy > best:
        return best, None
    version = f"{path}/accuracy={accuracy:.6f}-{uuid.uuid4().hex[:8]}"
    model.write.parquet(version)
    return accuracy, version


def load_model(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.schema(PARAMS).parquet(version)

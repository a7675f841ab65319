"""Labelled rows: load, split, materialise once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.functions.hashing import uniform
from trustfold.schemas import LABELED, conform


def load_labeled(spark: SparkSession, path: str, id_col: str, features_col: str, label_col: str) -> DataFrame:
    """(row_id, features, label) from parquet; only the three columns are scanned."""
    raw = spark.read.parquet(path)
    missing = [c for c in (id_col, features_col, label_col) if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; has {raw.columns}")
    return conform(
        raw.select(
            F.col(id_col).alias("row_id"), F.col(features_col).alias("features"), F.col(label_col).alias("label")
        ),
        LABELED,
    )


def split(df: DataFrame, test_fraction: float, seed: int = 0, id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the id: the same rows whatever the partitioning."""
    draw = uniform(seed, "split", F.col(id_col))
    return df.filter(draw >= test_fraction), df.filter(draw < test_fraction)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once, then read the frozen rows: augmentation is not redrawn per round."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

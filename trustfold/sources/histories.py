"""Credibility histories: wide CSV out, long rows in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustfold.functions.sizing import broadcast_if_small

# --- fixed values: the history and log file formats ---
ROUND_COLUMN = "Round"
CLIENT_COLUMN = "Client_{id}"
CLIENT_HEADER = r"^Client_(\d+)$"
ATTACK_IN_NAME = r"_atk(\d+)_"
RATIO_IN_NAME = r"_atk\d+_(?:ratio)?(\d+(?:\.\d+)?)"
THRESHOLD_IN_NAME = r"_dth=(\d+(?:\.\d+)?)(?:\.csv)+$"


def wide_history(history: DataFrame, clients: Sequence[int]) -> DataFrame:
    """One row per (run_id, round), one column per client."""
    pivoted = history.groupBy("run_id", "round").pivot("client_id", list(clients)).agg(F.first("score"))
    return pivoted.select(
        "run_id", F.col("round").alias(ROUND_COLUMN),
        *[F.col(str(c)).alias(CLIENT_COLUMN.format(id=c)) for c in clients],
    )


def write_history(history: DataFrame, path: str, clients: Sequence[int]) -> None:
    """Wide CSV per run; a rerun replaces its own run's folder and no other."""
    (
        wide_history(history, clients)
        .repartition("run_id").sortWithinPartitions("run_id", ROUND_COLUMN)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("header", True).partitionBy("run_id").csv(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Long rows (path, segment, round, client_id, score) from wide CSV files.

    A file may hold several appended runs, each with its own header line.
    Segments count the header lines seen so far; an empty field is a client without a score. Files are read line by
    line and stay splittable: a line's place is (byte offset of its split,
    order inside the split), and header counts of earlier splits are added.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ).filter(F.length("line") > 0)
    is_header = F.startswith(F.col("line"), F.lit(ROUND_COLUMN + ","))
    marked = lines.withColumn("is_header", is_header)

    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        marked.groupBy("path", "block").agg(F.sum(F.col("is_header").cast("int")).alias("_headers"))
        .withColumn("_before", F.coalesce(F.sum("_headers").over(earlier), F.lit(0)))
        .drop("_headers")
    )
    so_far = F.sum(F.col("is_header").cast("int")).over(
        Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = (
        marked.withColumn("_local", so_far).join(blocks, ["path", "block"])
        .withColumn("segment", (F.col("_before") + F.col("_local")).cast("int"))
    )
    cells = placed.select(
        "path", "segment", "is_header", F.split("line", ",").alias("fields")
    ).select(
        "path", "segment", "is_header", F.col("fields")[0].alias("first"),
        F.posexplode(F.slice("fields", 2, F.size("fields"))).alias("pos", "field"),
    )
    names = cells.filter("is_header").select(
        "path", "segment", "pos",
        F.regexp_extract("field", CLIENT_HEADER, 1).try_cast("bigint").alias("named_id"),
    )
    return (
        cells.filter(~F.col("is_header") & (F.col("field") != "")).join(broadcast_if_small(names), ["path", "segment", "pos"], "left")
        .select(
            "path", "segment", F.col("first").cast("int").alias("round"),
            F.coalesce("named_id", F.col("pos").cast("bigint")).alias("client_id"),
            F.col("field").cast("double").alias("score"),
        )
    )


def _named(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def with_run_metadata(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add attack, ratio and threshold as the file name states them (NULL where it does not)."""
    name = F.regexp_replace(F.col(path_col), "%3D", "=")
    return (
        df.withColumn("attack", _named(name, ATTACK_IN_NAME).cast("int"))
        .withColumn("ratio", _named(name, RATIO_IN_NAME).cast("double"))
        .withColumn("d_th", _named(name, THRESHOLD_IN_NAME).cast("double"))
    )

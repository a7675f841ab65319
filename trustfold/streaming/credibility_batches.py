"""Scores on a stream whose clients may be very large: every micro-batch is a distributed fold.

State lives in tables, one version per micro-batch: the scores, the rows that
wait for the watermark, and the clock. A replayed batch reads the version
before it and overwrites its own, so a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trustfold.constants import INITIAL_SCORE, REHAB_EVERY
from trustfold.functions.positions import position
from trustfold.functions.storage import durable
from trustfold.operators.credibility import fold_credibility

ROWS = "client_id bigint, us bigint, event_id bigint, dist double, secure boolean"
SCORES = "client_id bigint, rounds bigint, score double"
CLOCK = "watermark_us bigint, late bigint"


def _version(path: str, epoch: int, name: str) -> str:
    return f"{path}/epoch={epoch}/{name}"


def _read(spark: SparkSession, path: str, epoch: int, name: str, schema: str) -> DataFrame:
    if epoch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_version(path, epoch, name))


def scores(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """(client_id, rounds, score) after micro-batch ``epoch``."""
    return _read(spark, path, epoch, "scores", SCORES)


def late_rows(spark: SparkSession, path: str, epoch: int) -> int:
    """Rows dropped behind the watermark up to micro-batch ``epoch``."""
    return _read(spark, path, epoch, "clock", CLOCK).first()["late"]


def apply_batch(
    rows: DataFrame, epoch: int, path: str, d_th: float, delay_us: int = 0, flush: bool = False,
    init: float = INITIAL_SCORE, rehab_every: int = REHAB_EVERY,
) -> None:
    """Fold one micro-batch (client_id, us, event_id, dist, secure) into version ``epoch``.

    Rows at or behind the earlier watermark are dropped and counted; rows
    ahead of the new one wait. The others apply in (us, event_id) order, each
    as one round. ``flush`` applies all waiting rows, as at the stream's end.
    """
    spark = rows.sparkSession
    clock = _read(spark, path, epoch - 1, "clock", CLOCK).first()
    watermark, late = (clock["watermark_us"], clock["late"]) if clock else (None, 0)

    behind = F.lit(False) if watermark is None else F.col("us") <= watermark
    fresh = rows.filter(~behind)
    seen = rows.agg(F.max("us").alias("top"), F.count_if(behind).alias("late")).first()
    if seen["top"] is not None:
        reached = seen["top"] - delay_us
        watermark = reached if watermark is None else max(watermark, reached)
    pending = _read(spark, path, epoch - 1, "waiting", ROWS).unionByName(fresh)
    passed = F.lit(True) if flush else F.lit(False) if watermark is None else F.col("us") <= watermark

    before = scores(spark, path, epoch - 1)
    due = durable(pending.filter(passed), "due")
    placed = position(due, ["client_id"], [F.col("us"), F.col("event_id")], "place")
    counted = placed.join(before.select("client_id", "rounds"), "client_id", "left").select(
        "client_id", (F.col("place") + 1).alias("seq"),
        (F.coalesce("rounds", F.lit(0)) + F.col("place") + 1).alias("round"), "dist", "secure",
    )
    folded = fold_credibility(counted, d_th, init, rehab_every, starts=before, seq="seq")
    after = before.join(
        folded.select("client_id", F.col("rounds").alias("more"), F.col("score").alias("moved")), "client_id", "full_outer"
    ).select(
        "client_id",
        (F.coalesce("rounds", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint").alias("rounds"),
        F.coalesce("moved", "score").alias("score"),
    )
    after.write.mode("overwrite").parquet(_version(path, epoch, "scores"))
    pending.filter(~passed).write.mode("overwrite").parquet(_version(path, epoch, "waiting"))
    spark.createDataFrame([(watermark, late + seen["late"])], CLOCK).write.mode("overwrite").parquet(
        _version(path, epoch, "clock")
    )


def score_stream(
    observations: DataFrame, path: str, d_th: float, delay_us: int = 0, init: float = INITIAL_SCORE,
    rehab_every: int = REHAB_EVERY,
) -> DataStreamWriter:
    """Writer that folds a stream (client_id, ts, event_id, dist, secure) batch by batch under ``path``."""
    rows = observations.select("client_id", F.unix_micros("ts").alias("us"), "event_id", "dist", "secure")

    def fold(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            apply_batch(kept, epoch, path, d_th, delay_us, init=init, rehab_every=rehab_every)
        finally:
            kept.unpersist()

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/checkpoint")

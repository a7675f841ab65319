"""The stream waits for the watermark, keeps order, and drops late rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from trustfold.functions.storage import fresh_path
from trustfold.streaming import credibility_batches as batches
from trustfold.streaming import credibility_stream as stream

SCHEMA = "client_id bigint, ts timestamp, event_id bigint, dist double, secure boolean"


def _at(second):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def _run(spark, base, rows, delay):
    spark.createDataFrame([(c, _at(s), i, d, ok) for c, s, i, d, ok in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    query = (
        stream.streaming_credibility(source, 6.0, delay).writeStream.outputMode("update")
        .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"))
        .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.schema("client_id bigint, rounds bigint, score double, epoch int").option("basePath", f"{base}/out").parquet(f"{base}/out")
    scores = {r["client_id"]: (r["rounds"], r["score"]) for r in out.groupBy("client_id").agg(
        F.max("rounds").alias("rounds"), F.max_by("score", "rounds").alias("score")).collect()}
    return scores, stream.late_rows(query)


def test_order_and_late_rows(spark):
    base = fresh_path(spark, "stream")
    # out of order inside the delay: reward at 1 s, penalty at 2 s
    scores, late = _run(spark, base, [(1, 2, 11, 9.0, True), (1, 1, 10, 1.0, True), (2, 30, 12, 1.0, True)], "10 seconds")
    assert scores == {1: (2, 0.6 * 0.01)} and late == 0
    scores, late = _run(spark, base, [(1, 3, 13, 1.0, True), (1, 25, 14, 1.0, True), (2, 60, 15, 9.0, True)], "10 seconds")
    assert late == 1
    assert scores == {1: (3, 0.6 * 0.01 + 0.1), 2: (1, 0.6)}


def _frame(spark, rows):
    return spark.createDataFrame([(c, s * 1_000_000, i, d, ok) for c, s, i, d, ok in rows], batches.ROWS)


def _scores(spark, path, epoch):
    return {r["client_id"]: (r["rounds"], r["score"]) for r in batches.scores(spark, path, epoch).collect()}


def test_batches_keep_order_count_late_rows_and_replay(spark):
    path = fresh_path(spark, "batches")
    delay = 10_000_000
    batches.apply_batch(_frame(spark, [(1, 2, 11, 9.0, True), (1, 1, 10, 1.0, True), (2, 30, 12, 1.0, True)]), 0, path, 6.0, delay)
    assert _scores(spark, path, 0) == {1: (2, 0.6 * 0.01)}
    second = _frame(spark, [(1, 3, 13, 1.0, True), (1, 25, 14, 1.0, True), (2, 60, 15, 9.0, True)])
    for _ in range(2):  # a replay after a lost driver
        batches.apply_batch(second, 1, path, 6.0, delay)
        assert _scores(spark, path, 1) == {1: (3, 0.6 * 0.01 + 0.1), 2: (1, 0.6)}
        assert batches.late_rows(spark, path, 1) == 1
    batches.apply_batch(_frame(spark, []), 2, path, 6.0, delay, flush=True)
    assert _scores(spark, path, 2) == {1: (3, 0.6 * 0.01 + 0.1), 2: (2, 0.6 * 0.01)}


def test_batches_of_a_hot_client_equal_one_sequence(spark, monkeypatch):
    from trustfold.operators import credibility

    monkeypatch.setattr(credibility.fold_credibility, "__defaults__", (0.5, 10, 7, None, "round"))
    rng = random.Random(8)
    rows = [(0 if i % 3 else 1 + i % 4, i, i, rng.choice([1.0, 7.0, 20.0]), rng.random() < 0.8) for i in range(1, 400)]
    path = fresh_path(spark, "batches")
    for epoch, part in enumerate((rows[:150], rows[150:160], rows[160:])):
        batches.apply_batch(_frame(spark, part), epoch, path, 6.0)
    want = {}
    for client, _, _, dist, secure in rows:
        n, score = want.get(client, (0, 0.5))
        want[client] = (n + 1, stream.next_score(score, dist, 6.0, secure, n > 0 and n % 10 == 0))
    assert _scores(spark, path, 2) == want


def test_waiting_rows_apply_in_time_order_across_calls():
    """The state step on plain arrays: late, missing and tied rows, one client, no frame sorted per call."""
    rows = [[5, 5, 6, 9], [2, 1, 3, 4], [10.0, 20.0, float("nan"), 200.0], [True, True, False, True], [True, False, True, True]]
    score, rounds = stream._apply((0.5, 0), rows, 100.0, 5)
    want = 0.5
    for dist, known, secure in zip(*rows[2:]):
        want = stream.next_score(want, dist if known else None, 100.0, secure, False)
    assert (score, rounds) == (want, 4)

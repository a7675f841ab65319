"""Positions and carries with a group that holds most rows."""

import random

from pyspark.sql import functions as F

from trustfold.functions import positions


def _rows(spark):
    rng = random.Random(4)
    rows = [(0 if i % 3 else i % 7, rng.randint(0, 50), i) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "g int, k int, id bigint").repartition(6)


def _places(rows):
    out, counts = {}, {}
    for g, k, i in sorted(rows):
        out[i] = counts.get(g, 0)
        counts[g] = out[i] + 1
    return out


def test_range_and_sliced_positions(spark):
    rows, df = _rows(spark)
    order = [F.col("k"), F.col("id")]
    ranged = positions.range_position(df, ["g"], order, "p")
    sliced = positions.sliced_position(df, ["g"], order, F.expr("k div 5"), "p")
    for out in (ranged, sliced):
        assert {r["id"]: r["p"] for r in out.collect()} == _places(rows)


def test_global_position(spark):
    rows, df = _rows(spark)
    got = {r["id"]: r["p"] for r in positions.range_position(df, [], [F.col("k").desc(), F.col("id")], "p").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-k, i) for _, k, i in rows))}
    assert got == want


def test_carries_cross_blocks(spark):
    rng = random.Random(2)
    steps = sorted(rng.sample(range(1, 5000), 300))
    rows = [("a", s, rng.random()) for s in steps] + [("b", 1, 0.3)]
    df = spark.createDataFrame(rows, "g string, step int, v double")
    prev = {(r["g"], r["step"]): r["p"] for r in positions.previous_value(df, ["g"], "step", "v", "p", block=37).collect()}
    top = {(r["g"], r["step"]): r["p"] for r in positions.maximum_before(df, ["g"], "step", "v", "p", block=37).collect()}
    seen = []
    for _, step, value in rows[:-1]:
        assert prev["a", step] == (seen[-1] if seen else None)
        assert top["a", step] == (max(seen) if seen else None)
        seen.append(value)
    assert prev["b", 1] is None and top["b", 1] is None


def test_position_splits_off_hot_groups(spark):
    rows, df = _rows(spark)
    order = [F.col("k"), F.col("id")]
    for limit in (10_000, 300, 5):
        got = positions.position(df, ["g"], order, "p", slice_rows=limit)
        assert {r["id"]: r["p"] for r in got.collect()} == _places(rows)

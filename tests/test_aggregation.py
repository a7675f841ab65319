"""Distances, thresholds, weighted averages, corruption."""

import pytest
from pyspark.sql import functions as F

from trustfold.operators import aggregation, corruption

CELLS = "client_id bigint, layer string, idx bigint, value double"


def _models(spark, models):
    return spark.createDataFrame(
        [(c, "w", i, float(v)) for c, values in models.items() for i, v in enumerate(values)], CELLS
    )


def _scores(spark, scores):
    return spark.createDataFrame(list(scores.items()), "client_id bigint, score double")


def test_weighted_average(spark):
    updates = _models(spark, {0: [1, 2], 1: [3, 4], 2: [100, 100], 3: [0, 0]})
    scores = _scores(spark, {0: 1.0, 1: 0.5, 2: 0.01, 3: 0.0100001})
    got = aggregation.robust_aggregate(updates, scores).orderBy("idx").collect()
    assert [r["value"] for r in got] == pytest.approx([1.655629028332098, 2.6490064453313567], abs=1e-14)


def test_a_client_without_update_carries_no_weight(spark):
    updates = _models(spark, {0: [1.0]})
    got = aggregation.robust_aggregate(updates, _scores(spark, {0: 0.5, 1: 1.0})).first()
    assert got["value"] == pytest.approx(1.0)


def test_nobody_trusted_keeps_the_model(spark):
    updates = _models(spark, {0: [5.0, 6.0]})
    previous = _models(spark, {0: [1.0, 2.0]}).drop("client_id")
    averaged = aggregation.robust_aggregate(updates, _scores(spark, {0: 0.01}))
    kept = aggregation.next_global(averaged, previous).orderBy("idx").collect()
    assert [(r["value"], r["kept"]) for r in kept] == [(1.0, True), (2.0, True)]


@pytest.mark.parametrize("cells", [[1.0], [1.0, 2.0, 3.0]])
def test_a_model_of_other_cells_raises(spark, cells):
    previous = _models(spark, {0: [1.0, 2.0]}).drop("client_id")
    with pytest.raises(Exception, match="other cells"):
        aggregation.next_global(_models(spark, {0: cells}).drop("client_id"), previous).collect()


def test_distances_in_both_layouts(spark):
    a, b = _models(spark, {0: [0, 0, 0], 1: [1, 1, 1]}), _models(spark, {0: [2, 3, 6], 1: [1, 1, 1]})
    want = {0: 7.0, 1: 0.0}
    assert {r[0]: r[1] for r in aggregation.model_distance(a, b).collect()} == want
    blocks = [aggregation.to_blocks(m, 2) for m in (a, b)]
    assert {r[0]: r[1] for r in aggregation.block_distance(*blocks).collect()} == want


def test_missing_cells(spark):
    a, b = _models(spark, {0: [1, 2], 1: [1, 2]}), _models(spark, {0: [1], 1: [1, 2]})
    with pytest.raises(Exception, match="missing on one side"):
        aggregation.model_distance(a, b).collect()
    with pytest.raises(Exception, match="missing on one side"):
        aggregation.block_distance(*[aggregation.to_blocks(m, 8) for m in (a, b)]).collect()
    pairs = spark.createDataFrame([(1, 0), (0, 1)], "verifier bigint, prover bigint")
    auth = b.withColumnRenamed("client_id", "verifier")
    held = aggregation.pair_distance(aggregation.match_updates(a, auth, pairs), missing="hold").collect()
    assert {r["prover"]: r["dist"] for r in held} == {0: 0.0, 1: None}


def test_threshold(spark):
    def limit(values):
        return spark.createDataFrame([(v,) for v in values], "dist double").agg(aggregation.threshold_value()).first()[0]
    assert limit([0.2, 3.2]) == 4.0 and limit([3.0]) == 3.0 and limit([]) == 6.0


@pytest.mark.parametrize("ratio, count", [(0.6, 6), (0.3, 3), (0.29, 2)])
def test_attacker_count_is_truncated(ratio, count):
    assert corruption.attacker_count(10, ratio) == count


def test_corruption(spark):
    updates = _models(spark, {c: [0.25] * 500 for c in range(4)})
    noise = {}
    for kind in range(4):
        out = corruption.corrupt(updates, kind, 4, 0.5, seed=1)
        values = {c: [r["value"] for r in out.filter(F.col("client_id") == c).orderBy("idx").collect()] for c in (0, 1, 2, 3)}
        assert values[2] == values[3] == [0.25] * 500
        noise[kind] = values[0]
    assert noise[0] == [0.25] * 500 and noise[3] == [1.0] * 500
    assert [a - 0.25 for a in noise[1]] == pytest.approx(noise[2])
    mean = sum(noise[2]) / 500
    spread = sum((v - mean) ** 2 for v in noise[2]) / 500
    assert abs(mean) < 0.15 and 0.8 < spread < 1.2

"""Dealing: shard sizes, hot labels, slices, sampling."""

import pytest
from pyspark.sql import functions as F

from trustfold.operators import dealing


def _rows(spark, n, hot=3):
    """A third and more of the rows carry label 0."""
    label = F.when(F.col("id") % hot == 0, 0).otherwise((F.col("id") * 7 % 10)).cast("int")
    return spark.range(n).select(F.col("id").alias("row_id"), label.alias("label")).repartition(5)


def _expected(rows, shards):
    ordered = sorted(rows, key=lambda r: (r["label"], r["row_id"]))
    base, extra = divmod(len(ordered), shards)
    sizes = [base + 1] * extra + [base] * (shards - extra)
    out, at = {}, 0
    for shard, size in enumerate(sizes):
        for row in ordered[at:at + size]:
            out[row["row_id"]] = shard
        at += size
    return out


@pytest.mark.parametrize("n, slice_rows", [(503, 1_000_000), (503, 20), (503, 1), (4000, 64), (40, 7)])
def test_shards_match_plain_slicing(spark, n, slice_rows):
    df = _rows(spark, n)
    got = {r["row_id"]: r["shard"] for r in dealing.label_shards(df, slice_rows=slice_rows).collect()}
    assert got == _expected(df.collect(), 40)


def test_shards_with_clustered_ids(spark):
    ids = list(range(-50, 50)) + [10**15 + i for i in range(60)]
    df = spark.createDataFrame([(i, abs(i) % 4) for i in ids], "row_id bigint, label int")
    got = {r["row_id"]: r["shard"] for r in dealing.label_shards(df, slice_rows=9).collect()}
    assert got == _expected(df.collect(), 40)


def test_shard_sizes(spark):
    sharded = dealing.label_shards(_rows(spark, 503))
    sizes = [r["n"] for r in sharded.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()]
    assert sizes == [13] * 23 + [12] * 17
    assert dealing.shard_audit(sharded).first()["even"]


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="at least 40"):
        dealing.label_shards(_rows(spark, 39))
    assert not dealing.check_capacity(_rows(spark, 39)).first()["ok"]


def test_deal_is_stable_and_complete(spark, monkeypatch):
    df = _rows(spark, 1000)
    first = {r["row_id"]: (r["client_id"], r["ord"]) for r in dealing.deal(df).collect()}
    again = {r["row_id"]: (r["client_id"], r["ord"]) for r in dealing.deal(df.repartition(11)).collect()}
    monkeypatch.setattr(dealing, "SLICE_ROWS", 50)
    sliced = {r["row_id"]: (r["client_id"], r["ord"]) for r in dealing.deal(df).collect()}
    assert first == again == sliced and len(first) == 1000
    for client in range(10):
        places = sorted(o for c, o in first.values() if c == client)
        assert places == list(range(100))


def test_subset_is_top_k_by_hash_for_hot_and_small_clients(spark):
    df = spark.range(5000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 4000, 0).when(F.col("id") < 4990, 1).otherwise(2).alias("client_id")
    )
    got = dealing.client_subset(df, 32, seed=5).collect()
    sizes = {c: sorted(r["pos"] for r in got if r["client_id"] == c) for c in (0, 1, 2)}
    assert sizes[0] == sizes[1] == list(range(32)) and sizes[2] == list(range(10))
    from hashlib import md5
    want = sorted(range(4000), key=lambda i: md5(f"5|subset|{i}".encode()).hexdigest())[:32]
    assert [r["row_id"] for r in sorted(got, key=lambda r: r["pos"]) if r["client_id"] == 0] == want


@pytest.mark.parametrize("rows", [0, 1, 1000, 3000, 100_000])
def test_subsets_of_any_size(spark, rows):
    from hashlib import md5

    df = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 15_000, 0).when(F.col("id") < 19_000, 1).cast("long").alias("client_id")
    )
    owner = lambda i: 0 if i < 15_000 else 1 if i < 19_000 else None
    want = {}
    for client in (0, 1, None):
        mine = sorted((i for i in range(20_000) if owner(i) == client), key=lambda i: md5(f"5|subset|{i}".encode()).hexdigest())
        want.update({i: (client, at) for at, i in enumerate(mine[:rows])})
    got = dealing.client_subset(df, rows, seed=5)
    assert got.columns == ["row_id", "client_id", "pos"]
    assert {r["row_id"]: (r["client_id"], r["pos"]) for r in got.collect()} == want


def test_subset_repeats_rows_that_repeat(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("row_id"), F.lit(0).alias("client_id"))
    assert sorted(r["pos"] for r in dealing.client_subset(df, 7).collect()) == list(range(7))


@pytest.mark.parametrize("ids", [
    [*range(1, 2000), 10**15], [-(2**63) + i * (2**64 // 2000) for i in range(2000)], list(range(2000)),
])
def test_shards_on_far_signed_and_dense_ids(spark, ids):
    from trustfold.functions.positions import cut_of, quantile_cuts

    df = spark.createDataFrame([(i, n % 3) for n, i in enumerate(ids)], "row_id bigint, label int")
    got = {r["row_id"]: r["shard"] for r in dealing.label_shards(df, 5, 2, slice_rows=50).collect()}
    order = sorted((n % 3, i) for n, i in enumerate(ids))
    assert [got[i] for _, i in order] == [rank * 10 // len(ids) for rank in range(len(ids))]
    cuts = quantile_cuts(df, "row_id", len(ids), 50)
    sizes = df.groupBy(cut_of(F.col("row_id"), cuts)).count().collect()
    assert len(sizes) >= 30 and max(r["count"] for r in sizes) <= 110


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shards_of_distinct_ids_move_no_rows(spark):
    sharded = dealing.label_shards(_rows(spark, 4000).coalesce(2), slice_rows=64)
    assert _plan(sharded).count("Exchange") == 1  # the one of the rows themselves


def test_equal_ids_across_borders(spark):
    ids = [7] * 90 + list(range(100, 160)) + [10**17] * 50 + [2**63 - 1] * 30
    df = spark.createDataFrame([(i, abs(i) % 3) for i in ids], "row_id bigint, label int")
    got = sorted((r["label"], r["row_id"], r["shard"]) for r in dealing.label_shards(df, slice_rows=9).collect())
    base, extra = divmod(len(ids), 40)
    shards = [s for s in range(40) for _ in range(base + (s < extra))]
    assert got == [(*row, s) for row, s in zip(sorted((abs(i) % 3, i) for i in ids), shards)]


def test_many_shards_by_lookup(spark):
    df = _rows(spark, 900)
    got = {r["row_id"]: r["shard"] for r in dealing.label_shards(df, clients=100, slice_rows=20).collect()}
    assert got == _expected(df.collect(), 400)


def test_order_keys_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(dealing, "SLICE_ROWS", 50)
    dealt = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("client_id"))
    plan = _plan(dealing.client_order(dealt, rows=1000))
    assert plan.index("unhex") < plan.index("Exchange hashpartitioning")  # a plan lists its last step first

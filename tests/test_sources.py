"""History files, logs, file names, splits, best model."""

import pytest
from pyspark.sql import functions as F

from trustfold.functions.storage import fresh_path
from trustfold.operators import reports
from trustfold.sources import histories, labeled, logs, models

HEADER = "Round,Client_0,Client_1,Client_2"


@pytest.fixture()
def dirty(tmp_path):
    lines = [HEADER, "1,0.005,0.6,0.6", "2,5e-05,0.7,0.10500000000000001", HEADER, "1,0.005,0.6,0.6", HEADER]
    lines += [f"{r},{5 * 10.0 ** -(2 * r + 1)!r},0.6,1.0" for r in range(1, 61)]
    (tmp_path / "client_atk3_0.6_dth=20.csv").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    (tmp_path / "client_atk2_0.4_dth=22.csv.csv").write_text(f"{HEADER}\n1,0.005,0.6,0.5\n")
    return str(tmp_path)


@pytest.mark.parametrize("split_bytes", ["134217728", "100"])
def test_appended_runs_become_segments(spark, dirty, split_bytes):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = histories.with_run_metadata(histories.read_history(spark, f"{dirty}/*")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    long = [r for r in rows if r["attack"] == 3]
    assert {s: len({r["round"] for r in long if r["segment"] == s}) for s in (1, 2, 3)} == {1: 2, 2: 1, 3: 60}
    assert {(r["attack"], r["ratio"], r["d_th"]) for r in rows} == {(3, 0.6, 20.0), (2, 0.4, 22.0)}
    found = {(r["segment"], r["round"], r["client_id"]): r["score"] for r in long}
    assert found[1, 2, 2] == 0.10500000000000001 and found[3, 60, 0] == 5 * 10.0 ** -121
    assert len(rows) == 3 * (63 + 1)


def test_log_names(spark):
    df = spark.createDataFrame([("x/log_run_atk1_ratio0.2.csv",), ("client_atk1_0.4_dth=22.csv",), ("other.csv",)], "path string")
    got = [(r["attack"], r["ratio"], r["d_th"]) for r in histories.with_run_metadata(df).collect()]
    assert got == [(1, 0.2, None), (1, 0.4, 22.0), (None, None, None)]
    assert logs.log_name(2, 0.6) == "log_atk2_ratio0.6.csv"


def test_a_rerun_replaces_only_its_own_run(spark):
    path = fresh_path(spark, "history")
    schema = "run_id string, round int, client_id bigint, score double"
    both = [("a", 1, 0, 0.6), ("a", 1, 1, 0.5), ("b", 1, 0, 0.1), ("b", 1, 1, 0.2)]
    histories.write_history(spark.createDataFrame(both, schema), path, range(2))
    histories.write_history(spark.createDataFrame([("b", 1, 0, 0.9), ("b", 1, 1, 0.8)], schema), path, range(2))
    back = spark.read.option("header", True).csv(path)
    assert sorted((r["run_id"], r["Client_0"], r["Client_1"]) for r in back.collect()) == [("a", "0.6", "0.5"), ("b", "0.9", "0.8")]


def test_split_is_disjoint_and_whole(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    train, test = labeled.split(df, 0.25)
    assert train.count() + test.count() == 2000 and train.join(test, "row_id").isEmpty()
    assert 400 < test.count() < 600


def test_load_names_missing_columns(spark, sf_dir):
    with pytest.raises(ValueError, match="vector"):
        labeled.load_labeled(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "vector", "label")


def test_best_model_needs_a_strict_gain(spark):
    path = fresh_path(spark, "best")
    model = spark.createDataFrame([("w", 0, 1.5)], "layer string, idx bigint, value double")
    best, version = models.save_best(model, 50.0, 0.0, path)
    assert best == 50.0 and models.load_model(spark, version).collect() == model.collect()
    assert models.save_best(model, 50.0, best, path) == (50.0, None)


def test_reports(spark):
    log = spark.createDataFrame(
        [("r", i, a) for i, a in enumerate([10.0, 40.0, 40.0, 30.0, 55.0, 20.0], start=1)], "run string, round int, accuracy double"
    )
    best = reports.best_so_far(log, ["run"]).orderBy("round").collect()
    assert [r["is_new_best"] for r in best] == [True, True, False, False, True, False]
    assert [r["best"] for r in best] == [10.0, 40.0, 40.0, 40.0, 55.0, 55.0]
    row = reports.run_summary(log, ["run"], tail=3).first()
    assert (row["rounds"], row["final"], row["best"], row["best_round"], row["tail_mean"]) == (6, 20.0, 55.0, 5, 35.0)
    tied = reports.run_summary(log.filter("round < 5"), ["run"]).first()
    assert (tied["best"], tied["best_round"]) == (40.0, 2)


def test_detection(spark):
    rows = [("r", i, c, s) for c, path in enumerate([[0.005, 0.0], [0.6, 0.7], [0.005, 0.1]]) for i, s in enumerate(path, 1)]
    history = spark.createDataFrame(rows, "run string, round int, client_id bigint, score double")
    got = {r["client_id"]: (r["verdict"], r["first_excluded"], r["rounds_excluded"]) for r in reports.detection(history, ["run"], F.col("client_id") < 2).collect()}
    assert got == {0: ("detected", 1, 2), 1: ("missed", None, 0), 2: ("wrongly_excluded", 1, 1)}


def test_log_keeps_rounds_without_the_first_client(spark):
    from trustfold.sources.logs import accuracy_log

    accuracy = spark.createDataFrame([(r, 0.1 * r) for r in range(1, 5)], "round bigint, accuracy double")
    history = spark.createDataFrame([(2, 0, 0.7), (3, 1, 0.2), (1, 1, 0.4)], "round bigint, client_id int, score double")
    rows = accuracy_log(accuracy, history).orderBy("Round").collect()
    assert [(r["Round"], r["Credibility_C0"]) for r in rows] == [(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.7)]

"""Runs that share their jobs: the same as runs apart, and as the round that works cell by cell."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.checks.queries import ROUND, _test_rows, _train_rows
from trustfold.functions.storage import durable, fresh_path
from trustfold.operators import training
from trustfold.plans import rounds, runs


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return durable(_train_rows(spark, sf_dir)), durable(_test_rows(spark, sf_dir))


@pytest.fixture(scope="module")
def prepared(data):
    return rounds.prepare_clients(data[0], ROUND)


def _by(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


@pytest.mark.parametrize("trainer, sealed", [("fullbatch", False), ("minibatch", True)])
def test_two_rounds_equal_the_cell_by_cell_ones(spark, data, prepared, trainer, sealed):
    settings = replace(ROUND, trainer=trainer, sealed=sealed, rounds=2, d_th=1.0, ratio=0.3, attack=2, lr=0.05)
    report = _by(runs.federated_fit(*data, settings, prepared=prepared).collect(), "round", "client_id")
    state = rounds.initial_state(spark, settings)
    for round_no in (1, 2):
        state, table = rounds.run_round(*prepared, state, 1.0, settings, round_no)
        model = durable(state.model)
        state = rounds.State(model, durable(state.credibility), durable(state.history))
        reached = rounds.evaluate(data[1], model, settings.classes).first()["accuracy"]
        for row in table.collect():
            mine = report[round_no, row["client_id"]]
            assert (mine["verifier"], mine["secure"], mine["score"], mine["score_before"]) == (row["verifier"], row["secure"], row["score"], row["score_before"])
            assert mine["dist"] == pytest.approx(row["dist"], rel=1e-9) and mine["accuracy"] == pytest.approx(reached)


def test_runs_together_equal_runs_apart(data):
    settings = replace(ROUND, rounds=2, d_th=1.0)
    grid = runs.experiment_grid(*data, settings, attacks=(1, 3), ratios=(0.2, 0.6)).collect()
    alone = runs.federated_fit(*data, replace(settings, attack=3, ratio=0.6)).collect()
    together = _by([r for r in grid if r["run_id"] == "atk3_ratio0.6"], "round", "client_id")
    assert len(grid) == 4 * len(alone) and len(together) == len(alone)
    for row in alone:
        mine = together[row["round"], row["client_id"]]
        assert mine["score"] == row["score"] and mine["dist"] == pytest.approx(row["dist"]) and mine["accuracy"] == row["accuracy"]


def test_clients_of_many_blocks(spark, prepared, tmp_path):
    """Full batches are exact whatever the blocks; local SGD takes every block once a pass and averages by rows."""
    settings = replace(ROUND, steps=2, lr=0.1)
    start = training.init_model(spark, 10, 64, 3)
    vectors = spark.createDataFrame([("a", training.model_vector(start).tolist())], "run_id string, vector array<double>")
    whole = training.train_fullbatch(prepared[0], start, 10, 0.1, steps=2)
    want = {r["client_id"]: r["w"] for r in whole.groupBy("client_id").agg(training._vector_of_group().alias("w")).collect()}
    packed = runs.pack_clients(spark, lambda: prepared, settings, str(tmp_path / "full"), rows_per_block=7)
    assert not packed.single and packed.blocks.agg(F.max("n")).first()[0] == 7
    found = runs.train_runs(packed, vectors, settings, 1, str(tmp_path / "full"))
    for r in found.collect():
        assert np.allclose(r["vector"], want[r["client_id"]], atol=1e-12)
    small = replace(settings, trainer="minibatch", epochs=2, batch=4)
    moved = runs.train_runs(packed, vectors, small, 1, str(tmp_path / "mini")).collect()
    assert len(moved) == 10 and all(not np.allclose(r["vector"], want[r["client_id"]]) for r in moved)


@pytest.mark.parametrize("rows_per_block", [7, 40])
def test_mini_batches_do_not_depend_on_the_size_of_a_block(spark, tmp_path, rows_per_block):
    """Clients of many blocks take the steps of those of one, bit for bit; rows that share an id or come twice are among them."""
    rng = np.random.default_rng(3)
    rows = [
        (c, at, c * 1000 + at // 2, rng.normal(size=4).tolist(), int(rng.integers(0, 3)))
        for c, n in enumerate((150, 33, 40, 41, 1)) for at in range(n)
    ]
    dealt = spark.createDataFrame(rows, "client_id long, ord long, row_id long, features array<double>, label int")
    samples = dealt.withColumnRenamed("ord", "pos")
    vectors = spark.createDataFrame([(r, rng.normal(size=15).tolist()) for r in "cab"], "run_id string, vector array<double>")
    settings = rounds.Settings(classes=3, features=4, clients=5, epochs=3, batch=16, lr=0.1, seed=5)

    def trained(name, rows_per_block=None):
        packed = runs.pack_clients(spark, lambda: (dealt, samples), settings, str(tmp_path / name), rows_per_block)
        found = runs.train_runs(packed, vectors, settings, 2, str(tmp_path / name)).collect()
        return packed, {(r["run_id"], r["client_id"]): r["vector"] for r in found}, len(found)

    whole, want, n = trained("whole")
    parted, found, m = trained("parted", rows_per_block)
    assert whole.single and not parted.single and n == m == 15
    assert found == want


def test_large_clients_equal_the_cell_by_cell_trainer(spark, prepared, tmp_path):
    settings = replace(ROUND, trainer="minibatch", epochs=2, batch=4, lr=0.1)
    start = training.init_model(spark, 10, 64, 3)
    vectors = spark.createDataFrame([("a", training.model_vector(start).tolist())], "run_id string, vector array<double>")
    exact = training.train_minibatch(prepared[0], start, 10, epochs=2, batch=4, lr=0.1, round_no=3)
    want = {r["client_id"]: r["w"] for r in exact.groupBy("client_id").agg(training._vector_of_group().alias("w")).collect()}
    packed = runs.pack_clients(spark, lambda: prepared, settings, str(tmp_path), rows_per_block=7)
    found = runs.train_runs(packed, vectors, settings, 3, str(tmp_path)).collect()
    assert not packed.single and len(found) == 10
    for r in found:
        assert np.allclose(r["vector"], want[r["client_id"]], rtol=0, atol=1e-12)


def test_no_exchange_moves_features(spark, prepared, tmp_path):
    settings = replace(ROUND)
    packed = runs.pack_clients(spark, lambda: prepared, settings, str(tmp_path))
    vectors = spark.createDataFrame([("a", [0.0] * 650)], "run_id string, vector array<double>")
    plan = runs.train_runs(packed, vectors, settings, 1, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange hashpartitioning" not in plan.split("Subquery")[0]


def test_altered_updates_are_noticed_in_a_run(spark, data, prepared):
    settings = replace(ROUND, rounds=1, ratio=0.0, d_th=1.0)
    real = runs.play_round
    alter = lambda df: df.withColumn("values", F.when(
        (F.col("client_id") == 4) & F.col("verifier").isNull(), F.transform("values", lambda x: x + 0.01)).otherwise(F.col("values")))
    runs.play_round = lambda *args, **named: real(*args, **named, in_transit=alter)
    try:
        rows = runs.federated_fit(*data, settings, prepared=prepared).collect()
    finally:
        runs.play_round = real
    assert [r["client_id"] for r in rows if not r["secure"]] == [4]


def test_wrong_rows_and_keys_raise_before_round_one(spark, data, prepared):
    keys = spark.createDataFrame([(0, bytearray(32))], "client_id long, secret binary")
    with pytest.raises(ValueError, match="secret"):
        runs.federated_fit(*data, replace(ROUND, rounds=1, d_th=1.0), prepared=prepared, keys=keys)
    with pytest.raises(ValueError, match="features"):
        runs.federated_fit(*data, replace(ROUND, rounds=1, d_th=1.0, features=63), prepared=prepared)


def test_a_resumed_fit_takes_the_rows_it_stored(spark, data, monkeypatch):
    settings = replace(ROUND, rounds=1)
    path = fresh_path(spark, "fit")
    first = runs.federated_fit(*data, settings, path=path).collect()
    monkeypatch.setattr(runs, "prepare_clients", None)  # dealing again would fail
    again = runs.federated_fit(*data, replace(settings, rounds=2), path=path)
    assert again.filter("round = 2").count() == 10 and again.filter("round = 1").count() == len(first)


@pytest.mark.parametrize("orientation", ["reversed", "emitted"])
def test_pairs_by_task_equal_pairs_by_plan(spark, monkeypatch, orientation):
    import random

    draw = random.Random(1)
    scores = spark.createDataFrame([(r, c, draw.choice([0.1, 0.5, 0.6])) for r in "ab" for c in range(7)], "run_id string, client_id long, score double")
    history = spark.createDataFrame([("a", k, draw.randrange(7), draw.randrange(7)) for k in range(1, 28)], "run_id string, seq long, verifier long, prover long")
    pairing = spark.createDataFrame([("a", k, k, (k + 2) % 7) for k in range(7)], "run_id string, rank long, verifier long, prover long")
    found = [tuple(r) for r in runs._handed_out(history, pairing, scores, 7, orientation).select("kind", "run_id", "seq", "rank", "verifier", "prover").collect()]
    monkeypatch.setattr(runs, "SLICE_ROWS", 0)
    plan = [tuple(r) for r in runs._handed_out(history, pairing, scores, 7, orientation).select("kind", "run_id", "seq", "rank", "verifier", "prover").collect()]
    assert sorted(map(str, found)) == sorted(map(str, plan)) and len(found) == 30 + 14


def test_every_client_has_files_of_its_own(spark, prepared, tmp_path):
    """Clients that share a file train one after the other, however many cores there are."""
    packed = runs.pack_clients(spark, lambda: prepared, ROUND, str(tmp_path))
    for part in (packed.blocks, packed.samples):
        assert len(part.inputFiles()) == part.count() == 10


def test_models_go_to_blocks_of_test_rows(spark, monkeypatch):
    """The models of all rounds are sent once a block of rows, not beside every row."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 4)), rng.integers(0, 3, 50)
    test = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "features array<double>, label int").repartition(2)
    vectors = {(r, n): rng.normal(size=15) for r in "ab" for n in (1, 2)}
    models = spark.createDataFrame([(*k, v.tolist()) for k, v in vectors.items()], "run_id string, round int, vector array<double>")
    assert runs._test_blocks(test).count() == 2
    monkeypatch.setattr(runs, "CELLS_AT_ONCE", 4 * 7)
    blocks = runs._test_blocks(test).collect()
    assert max(len(r["y"]) for r in blocks) == 7 and sum(len(r["y"]) for r in blocks) == 50
    found = runs.evaluate_models(test, models, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    for r in found.collect():
        assert r["accuracy"] == 100.0 * (training._logits(x, vectors[r["run_id"], r["round"]], 3).argmax(axis=1) == y).sum() / 50


def test_runs_trained_together_equal_runs_trained_alone(spark):
    """Every run of a sample takes its own number of steps; the vectors are those of one run at a time, bit for bit."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(70, 4)), rng.integers(0, 3, 70)
    starts, steps = {r: rng.normal(size=15) for r in "abc"}, {"a": 5, "b": 9, "c": 5}
    tasks = [{"run_id": r, "verifier": k, "prover": 1, "steps": steps[r]} for k, r in enumerate("abc")]
    samples = spark.createDataFrame(
        [(x.ravel().tolist(), y.tolist(), tasks)], "x array<double>, y array<int>, tasks array<struct<run_id string, verifier long, prover long, steps long>>"
    )
    vectors = spark.createDataFrame([(r, v.tolist()) for r, v in starts.items()], "run_id string, vector array<double>")
    found = runs.authenticate_runs(samples, vectors, rounds.Settings(classes=3, features=4)).collect()
    assert sorted((r["run_id"], r["verifier"], r["prover"]) for r in found) == [("a", 0, 1), ("b", 1, 1), ("c", 2, 1)]
    cycle = list(training._batches(70, 32))
    for r in found:
        want = starts[r["run_id"]].copy()
        batches = (cycle[k % len(cycle)] for k in range(steps[r["run_id"]]))
        training._sgd(x, y, batches, want, np.zeros_like(want), 3, 0.01, 0.9, 5e-4)
        assert r["vector"] == want.tolist()
    alone, together = np.array(list(starts.values())), np.array(list(starts.values()))
    training._sgd_together(x, y, training._batches(70, 32), together, np.zeros_like(together), 3, 0.1, 0.9, 5e-4)
    for vector in alone:
        training._sgd(x, y, training._batches(70, 32), vector, np.zeros_like(vector), 3, 0.1, 0.9, 5e-4)
    assert np.array_equal(alone, together)

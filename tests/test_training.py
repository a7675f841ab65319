"""Training kernels against plain numpy; chunks against whole clients."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustfold.operators import training


def _rows(n=260, features=5, classes=3, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, features)) + y[:, None]
    client = np.where(np.arange(n) < n * 2 // 3, 0, 1)
    order = np.concatenate([np.arange((client == c).sum()) for c in (0, 1)])
    return pd.DataFrame({
        "row_id": np.arange(n), "client_id": client, "ord": order, "features": list(x), "label": y.astype("int32"),
    })


def _table(spark, pdf):
    rows = [(int(r.row_id), int(r.client_id), int(r.ord), [float(v) for v in r.features], int(r.label)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "row_id bigint, client_id bigint, ord bigint, features array<double>, label int").repartition(3)


def _vectors(df, key="client_id"):
    out = {}
    for r in df.orderBy(key, "layer", "idx").collect():
        out.setdefault(r[key], []).append(r["value"])
    return {k: np.array(v) for k, v in out.items()}


def _gradient(x, y, vector, classes):
    w, b = vector[classes:].reshape(classes, -1), vector[:classes]
    z = x @ w.T + b
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    e = (p - np.eye(classes)[y]) / len(y)
    return np.concatenate([e.sum(axis=0), (e.T @ x).ravel()])


@pytest.mark.parametrize("steps", [1, 3])
def test_fullbatch(spark, steps):
    pdf = _rows()
    got = _vectors(training.train_fullbatch(_table(spark, pdf), training.init_model(spark, 3, 5), 3, 0.3, steps))
    start = training.model_vector(training.init_model(spark, 3, 5))
    for client, rows in pdf.groupby("client_id"):
        vector = start.copy()
        for _ in range(steps):
            vector = vector - 0.3 * _gradient(np.stack(rows["features"]), rows["label"].to_numpy(), vector, 3)
        np.testing.assert_allclose(got[client], vector, atol=1e-12)


def test_blocks_do_not_matter(spark):
    df = _table(spark, _rows())
    small = training.row_blocks(df, rows=7)
    assert small.agg(F.max(F.size("y"))).first()[0] == 7
    assert small.agg(F.sum(F.size("y"))).first()[0] == 260


def test_chunks_equal_whole_clients(spark):
    df, model = _table(spark, _rows()), training.init_model(spark, 3, 5)
    whole = _vectors(training.train_minibatch(df, model, 3, epochs=2, batch=16))
    chunked = _vectors(training.train_minibatch(df, model, 3, epochs=2, batch=16, rows_per_task=48))
    for client in whole:
        np.testing.assert_array_equal(whole[client], chunked[client])


def test_minibatch_ignores_partitioning_and_follows_the_seed(spark):
    df, model = _table(spark, _rows()), training.zero_model(spark, 3, 5)
    one = _vectors(training.train_minibatch(df, model, 3))
    same = _vectors(training.train_minibatch(df.repartition(9), model, 3))
    other = _vectors(training.train_minibatch(df, model, 3, seed=9))
    np.testing.assert_array_equal(one[0], same[0])
    assert not np.array_equal(one[0], other[0])


def test_single_batch_epoch_is_one_full_step(spark):
    df, model = _table(spark, _rows()), training.zero_model(spark, 3, 5)
    mini = _vectors(training.train_minibatch(df, model, 3, epochs=1, batch=1000, lr=0.1, momentum=0.0, decay=0.0))
    full = _vectors(training.train_fullbatch(df, model, 3, 0.1))
    for client in full:
        np.testing.assert_allclose(mini[client], full[client], atol=1e-12)


def test_authentication_cycles_through_the_sample(spark):
    pdf = _rows(40)
    sample = _table(spark, pdf).withColumnRenamed("client_id", "verifier").withColumnRenamed("ord", "pos")
    steps = spark.createDataFrame([(0, 5), (1, 2)], "client_id bigint, steps bigint")
    got = _vectors(training.train_auth(sample, training.zero_model(spark, 3, 5), steps, 3, batch=10), "verifier")
    for client, count in ((0, 5), (1, 2)):
        rows = pdf[pdf.client_id == client].sort_values("ord")
        x, y = np.stack(rows["features"]), rows["label"].to_numpy()
        batches = [slice(i, i + 10) for i in range(0, len(y), 10)]
        vector, velocity = np.zeros(18), np.zeros(18)
        for s in range(count):
            b = batches[s % len(batches)]
            grad = _gradient(x[b], y[b], vector, 3) + 5e-4 * vector
            velocity = 0.9 * velocity + grad
            vector = vector - 0.01 * (grad + 0.9 * velocity)
        np.testing.assert_allclose(got[client], vector, atol=1e-12)


def test_empty_client_is_reported(spark):
    roster = spark.range(3).withColumnRenamed("id", "client_id")
    status = {r["client_id"]: (r["steps"], r["status"]) for r in training.training_status(roster, training.training_steps(_table(spark, _rows()))).collect()}
    assert status == {0: (9, "trained"), 1: (6, "trained"), 2: (0, "empty")}


def test_predict_and_accuracy(spark):
    pdf = _rows()
    df, model = _table(spark, pdf), training.init_model(spark, 3, 5, seed=2)
    scored = training.predict(df, model, 3).withColumn("predicted", training.argmax_class())
    vector = training.model_vector(model)
    want = (np.stack(pdf["features"]) @ vector[3:].reshape(3, -1).T + vector[:3]).argmax(axis=1)
    assert {r["row_id"]: r["predicted"] for r in scored.collect()} == dict(zip(pdf["row_id"], want))
    hit = 100.0 * (want == pdf["label"].to_numpy()).mean()
    assert training.accuracy(scored).first()["accuracy"] == pytest.approx(hit)


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 2.0, 2.0],)], "logits array<double>")
    assert [r[0] for r in df.select(training.argmax_class()).collect()] == [1, 0]


def test_an_epoch_is_written_without_a_shuffle(spark, monkeypatch):
    plans = {}

    def recorded(df, name="table", partition_by=None, write=training.durable):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, partition_by)

    monkeypatch.setattr(training, "durable", recorded)
    df = training.durable(_table(spark, _rows()), "rows")
    training.train_minibatch(df, training.zero_model(spark, 3, 5), 3, epochs=2, batch=16, rows_per_task=48)
    assert len(plans["epoch"]) == 2 and not any("Exchange" in plan for plan in plans["epoch"])

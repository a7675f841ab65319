"""Per-client training and scoring of a linear softmax classifier.

A model is the long table (layer, idx, value) with layer ``bias`` (idx = class)
and ``weight`` (idx = class * features + feature). Inside a task it is one
vector in (layer, idx) order: all biases, then all weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trustfold.constants import (
    AUTH_BATCH_ROWS, BATCH_ROWS, EPOCHS, LEARNING_RATE, MOMENTUM, WEIGHT_DECAY,
)
from trustfold.functions.hashing import normal
from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable

ROWS_PER_BLOCK = 1024
#: Feature values (64 MB of doubles) of one client that one task may hold for mini-batch training.
CELLS_PER_TASK = 8_000_000
#: Standard deviations by which a hashed slice of a client is planned below the rows a task may hold.
SLICE_SLACK = 6


# --- model tables ---

def _grid(spark: SparkSession, classes: int, features: int) -> DataFrame:
    pos = F.col("id")
    return spark.range(classes * (features + 1)).select(
        F.when(pos < classes, F.lit("bias")).otherwise(F.lit("weight")).alias("layer"),
        F.when(pos < classes, pos).otherwise(pos - classes).alias("idx"),
    )


def zero_model(spark: SparkSession, classes: int, features: int) -> DataFrame:
    return _grid(spark, classes, features).withColumn("value", F.lit(0.0))


def init_model(spark: SparkSession, classes: int, features: int, seed: int = 0) -> DataFrame:
    """Normal weights with variance 2 / fan-out (the class count), zero biases."""
    std = F.sqrt(F.lit(2.0) / F.lit(float(classes)))
    draw = normal(seed, F.col("layer"), F.col("idx")) * std
    return _grid(spark, classes, features).withColumn(
        "value", F.when(F.col("layer") == "bias", F.lit(0.0)).otherwise(draw)
    )


def _vector_of_group() -> Column:
    """Aggregate: the model vector of the group's (layer, idx, value) rows."""
    cells = F.array_sort(F.collect_list(F.struct("layer", "idx", "value")))
    return F.transform(cells, lambda c: c["value"])


def model_vector(model: DataFrame) -> np.ndarray:
    """The one global model as a vector; classes x (features + 1) numbers, whatever the row count."""
    return np.array(model.agg(_vector_of_group().alias("w")).first()["w"], dtype=np.float64)


def _named_cells(df: DataFrame, key: str, classes: int) -> DataFrame:
    """(key, pos, value) -> (key, layer, idx, value)."""
    pos = F.col("pos").cast("bigint")
    return df.select(
        key,
        F.when(pos < classes, F.lit("bias")).otherwise(F.lit("weight")).alias("layer"),
        F.when(pos < classes, pos).otherwise(pos - classes).alias("idx"),
        "value",
    )


# --- numpy kernels, run inside tasks on bounded arrays ---

def _logits(x: np.ndarray, vector: np.ndarray, classes: int) -> np.ndarray:
    return x @ vector[classes:].reshape(classes, -1).T + vector[:classes]


def _gradient_sum(x: np.ndarray, y: np.ndarray, vector: np.ndarray, classes: int) -> np.ndarray:
    """Sum over rows of the cross-entropy gradient, in model-vector order."""
    z = _logits(x, vector, classes)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1.0
    return np.concatenate([p.sum(axis=0), (p.T @ x).ravel()])


def _sgd(
    x: np.ndarray, y: np.ndarray, batches: Iterator[np.ndarray], vector: np.ndarray, velocity: np.ndarray,
    classes: int, lr: float, momentum: float, decay: float,
) -> None:
    """Nesterov SGD over row-index batches; updates ``vector`` and ``velocity`` in place."""
    for rows in batches:
        grad = _gradient_sum(x[rows], y[rows], vector, classes) / len(rows) + decay * vector
        velocity *= momentum
        velocity += grad
        vector -= lr * (grad + momentum * velocity)


def _gradient_sums(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, classes: int) -> np.ndarray:
    """``_gradient_sum`` of every row of ``vectors`` on the same rows, by one call a step; the same numbers."""
    w = vectors[:, classes:].reshape(len(vectors), classes, -1)
    p = np.matmul(x, w.transpose(0, 2, 1))
    p += vectors[:, None, :classes]
    p -= p.max(axis=2, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(len(y)), y] -= 1.0
    return np.concatenate([p.sum(axis=1), np.matmul(p.transpose(0, 2, 1), x).reshape(len(vectors), -1)], axis=1)


def _sgd_together(
    x: np.ndarray, y: np.ndarray, batches: Iterator[np.ndarray], vectors: np.ndarray, velocities: np.ndarray,
    classes: int, lr: float, momentum: float, decay: float,
) -> None:
    """``_sgd`` of every row of ``vectors`` over the same batches, each batch's rows taken once."""
    for rows in batches:
        grads = _gradient_sums(x[rows], y[rows], vectors, classes) / len(rows) + decay * vectors
        velocities *= momentum
        velocities += grads
        vectors -= lr * (grads + momentum * velocities)


# --- full-batch training: blocks of rows, map-side gradients, tiny aggregates ---

def row_blocks(df: DataFrame, key: str = "client_id", order: str = "ord", rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """(key, block, x, y): up to ``rows`` consecutive rows of a client as one flat matrix.

    One shuffle for any number of training steps; a hot client has many blocks.
    """
    cells = F.array_sort(F.collect_list(F.struct(order, "features", "label")))
    return (
        df.withColumn("block", F.expr(f"`{order}` div {rows}L"))
        .groupBy(key, "block").agg(cells.alias("cells"))
        .select(
            key, "block",
            F.flatten(F.transform("cells", lambda c: c["features"])).alias("x"),
            F.transform("cells", lambda c: c["label"]).alias("y"),
        )
    )


def _block_gradient(classes: int):
    @pandas_udf("array<double>")
    def gradient(x: pd.Series, y: pd.Series, vector: pd.Series) -> pd.Series:
        return pd.Series([
            _gradient_sum(xi.reshape(len(yi), -1), yi, wi, classes) for xi, yi, wi in zip(x, y, vector)
        ])
    return gradient


def train_fullbatch(
    df: DataFrame, model: DataFrame, classes: int, lr: float = LEARNING_RATE, steps: int = 1,
    key: str = "client_id", order: str = "ord",
) -> DataFrame:
    """``steps`` full-batch softmax steps per client from the global model, as aggregates.

    Each block emits one gradient vector; these are summed per (client, cell)
    with map-side combine, so what is shuffled per step depends on the number
    of clients and cells and not on the rows. Returns (key, layer, idx, value).
    """
    blocks = row_blocks(df, key, order)
    if steps > 1:
        blocks = durable(blocks, "blocks")
    start = model.agg(_vector_of_group().alias("w")).scalar()
    vector_bytes = 64 + 8 * model.count() if steps > 1 else 0  # a joined row holds a whole model
    weighted = blocks.withColumn("w", start)
    for step in range(steps):
        if step:
            vectors = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
            vectors = vectors.select(key, F.transform("cells", lambda c: c["value"]).alias("w"))
            weighted = blocks.join(broadcast_if_small(vectors, row_bytes=vector_bytes), key)
        slope = _block_gradient(classes)("x", "y", "w")
        per_cell = weighted.select(
            key, F.size("y").alias("n"), F.posexplode(F.arrays_zip(slope.alias("g"), F.col("w").alias("w")))
        ).select(key, "n", "pos", F.col("col.g").alias("g"), F.col("col.w").alias("w"))
        cells = per_cell.groupBy(key, "pos").agg(
            (F.max("w") - F.lit(float(lr)) * F.sum("g") / F.sum("n")).alias("value")
        )
        if step + 1 < steps:
            cells = durable(cells, "step")
    return _named_cells(cells, key, classes)


# --- mini-batch training: sequential by nature, in bounded chunks ---

def _batches(n: int, size: int) -> Iterator[np.ndarray]:
    for start in range(0, n, size):
        yield np.arange(start, min(start + size, n))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def training_steps(df: DataFrame, epochs: int = EPOCHS, batch: int = BATCH_ROWS, key: str = "client_id") -> DataFrame:
    """(key, rows, steps): gradient steps a client takes over its rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "steps", (F.ceil(F.col("rows") / batch) * epochs).cast("bigint")
    )


def _epoch_key(seed: int, round_no: int, epoch: int, key: str) -> Column:
    """Signed 64-bit hash to shuffle by; its high bits cut a client into even slices."""
    return F.xxhash64(F.lit(seed), F.lit(round_no), F.lit(epoch), F.col(key), F.col("row_id"))


def train_minibatch(
    df: DataFrame, model: DataFrame, classes: int, epochs: int = EPOCHS, batch: int = BATCH_ROWS,
    lr: float = LEARNING_RATE, momentum: float = MOMENTUM, decay: float = WEIGHT_DECAY,
    seed: int = 0, round_no: int = 1, key: str = "client_id", rows_per_task: int | None = None,
) -> DataFrame:
    """Mini-batch Nesterov SGD per client, rows reshuffled by hash each epoch.

    When every client fits ``rows_per_task`` (by default as many rows as hold
    CELLS_PER_TASK values), one grouped pass trains all.
    Otherwise each epoch is cut by hash into chunks of fewer rows and the
    clients' (vector, velocity) go from chunk to chunk through a written
    table: the same batches in the same order, hence the same result, with
    no task ever holding more than one chunk, unless millions of rows of a
    client share one id. Returns (key, layer, idx, value).
    """
    largest = df.groupBy(key).count().agg(F.max("count").alias("n")).first()["n"] or 0
    start = model_vector(model)
    if rows_per_task is None:
        rows_per_task = max(batch, CELLS_PER_TASK // (len(start) // classes))
    if largest <= rows_per_task:
        cells = _train_whole(df, start, classes, epochs, batch, lr, momentum, decay, seed, round_no, key)
    else:
        chunk = rows_per_task // batch * batch
        if chunk == 0:
            raise ValueError(f"rows_per_task {rows_per_task} is below one batch of {batch}")
        cells = _train_in_chunks(
            df, start, classes, epochs, batch, lr, momentum, decay, seed, round_no, key, chunk, largest
        )
    return _named_cells(cells, key, classes)


def _train_whole(df, start, classes, epochs, batch, lr, momentum, decay, seed, round_no, key) -> DataFrame:
    keys = [_epoch_key(seed, round_no, e, key).alias(f"_key{e}") for e in range(epochs)]

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(rows["features"]), rows["label"].to_numpy()
        vector, velocity = start.copy(), np.zeros_like(start)
        for e in range(epochs):
            order = np.lexsort((rows["row_id"].to_numpy(), rows[f"_key{e}"].to_numpy()))
            _sgd(x, y, (order[b] for b in _batches(len(y), batch)), vector, velocity, classes, lr, momentum, decay)
        return pd.DataFrame({key: rows[key].iloc[0], "pos": np.arange(len(vector)), "value": vector})

    moved = df.select(key, "row_id", "features", "label").repartition(key)
    return (
        moved.select("*", *keys)
        .groupBy(key).applyInPandas(train, f"{key} bigint, pos bigint, value double")
    )


def _train_in_chunks(
    df, start, classes, epochs, batch, lr, momentum, decay, seed, round_no, key, chunk, largest
) -> DataFrame:
    """Chunks are slices of the epoch's hash order, at most about ``chunk`` rows of a client each.

    Every epoch writes the rows once by slice, straight from their scan. A
    slice's rows then move once, to their client; rows behind its last whole
    batch wait in the state for the next slice, so batches are those of the
    whole order.
    """
    state_schema = f"{key} bigint, vector array<double>, velocity array<double>, x array<double>, y array<int>"
    width = len(start) // classes - 1
    nothing = F.array().cast("array<double>"), F.array().cast("array<int>")
    state = durable(
        df.select(key).distinct().select(
            key, F.lit(start.tolist()).alias("vector"), F.lit(np.zeros_like(start).tolist()).alias("velocity"),
            nothing[0].alias("x"), nothing[1].alias("y"),
        ),
        "sgd-state",
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = -(-largest // max(batch, chunk - SLICE_SLACK * math.isqrt(chunk)))

    def advance(final: bool):
        def run(state_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            found = state_rows.iloc[0]
            vector, velocity = np.array(found["vector"], dtype=np.float64), np.array(found["velocity"], dtype=np.float64)
            x, y = np.array(found["x"], dtype=np.float64).reshape(-1, width), np.array(found["y"], dtype=np.int64)
            if len(rows):
                order = np.lexsort((rows["row_id"].to_numpy(), rows["_key"].to_numpy()))
                x = np.concatenate([x, _matrix(rows["features"])[order]])
                y = np.concatenate([y, rows["label"].to_numpy()[order]])
            done = len(y) if final else len(y) // batch * batch
            _sgd(x, y, _batches(done, batch), vector, velocity, classes, lr, momentum, decay)
            return pd.DataFrame({
                key: [found[key]], "vector": [vector], "velocity": [velocity], "x": [x[done:].ravel()], "y": [y[done:]],
            })
        return run

    for epoch in range(epochs):
        shuffled = _epoch_key(seed, round_no, epoch, key)
        # the top 32 bits, from 0 up, cut evenly
        at = F.shiftright((F.shiftright(shuffled, 32) + F.lit(1 << 31)) * F.lit(slices), 32).cast("int")
        rows = df.select(key, "row_id", "features", "label", at.alias("_slice"))
        sliced = durable(rows, "epoch", partition_by="_slice")
        for c in range(slices):
            moved = sliced.filter(F.col("_slice") == c).drop("_slice").repartition(parts, key)
            state = durable(
                state.repartition(parts, key).groupBy(key).cogroup(moved.withColumn("_key", shuffled).groupBy(key))
                .applyInPandas(advance(c + 1 == slices), state_schema),
                "sgd-state",
            )
    return state.select(key, F.posexplode("vector").alias("pos", "value"))


def train_auth(
    delivered: DataFrame, model: DataFrame, steps: DataFrame, classes: int, batch: int = AUTH_BATCH_ROWS,
    lr: float = LEARNING_RATE, momentum: float = MOMENTUM, decay: float = WEIGHT_DECAY,
) -> DataFrame:
    """Each verifier retrains from the global model on the sample it was sent.

    ``delivered`` holds (verifier, pos, features, label), at most the subset
    size per verifier; ``steps`` holds (client_id, steps). Unshuffled batches
    cycle through the sample until the verifier's own step count is reached.
    Returns (verifier, layer, idx, value).
    """
    start = model_vector(model)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x, y = _matrix(rows["features"]), rows["label"].to_numpy()
        vector, velocity = start.copy(), np.zeros_like(start)
        cycle = list(_batches(len(y), batch))
        batches = (cycle[i % len(cycle)] for i in range(int(rows["steps"].iloc[0])))
        _sgd(x, y, batches, vector, velocity, classes, lr, momentum, decay)
        return pd.DataFrame({"verifier": rows["verifier"].iloc[0], "pos": np.arange(len(vector)), "value": vector})

    own_steps = steps.select(F.col("client_id").alias("verifier"), "steps")
    cells = (
        delivered.select("verifier", "pos", "features", "label")
        .join(broadcast_if_small(own_steps), "verifier")
        .groupBy("verifier").applyInPandas(train, "verifier bigint, pos bigint, value double")
    )
    return _named_cells(cells, "verifier", classes)


def training_status(roster: DataFrame, steps: DataFrame) -> DataFrame:
    """(client_id, rows, steps, status): an empty client is reported and the round goes on."""
    return roster.join(steps, "client_id", "left").select(
        "client_id",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps"),
        F.when(F.col("rows").isNull(), F.lit("empty")).otherwise(F.lit("trained")).alias("status"),
    )


# --- scoring ---

def predict(df: DataFrame, model: DataFrame, classes: int) -> DataFrame:
    """Add ``logits`` (array) per row; Arrow batches against the one global model."""
    vector = model_vector(model)

    @pandas_udf("array<double>")
    def logits(features: pd.Series) -> pd.Series:
        return pd.Series(list(_logits(_matrix(features), vector, classes))) if len(features) else pd.Series([], dtype=object)

    return df.withColumn("logits", logits("features"))


def argmax_class(logits: str | Column = "logits") -> Column:
    """Class of the largest logit, the first one on ties."""
    col = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def accuracy(scored: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """One row: percentage of rows whose predicted class is the label."""
    hit = (F.col(predicted) == F.col(label)).cast("int")
    return scored.agg((F.lit(100.0) * F.avg(hit)).alias("accuracy"))

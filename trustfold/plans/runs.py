"""Fits of many runs in one chain of jobs.

Every table carries ``run_id``: pairing, training, corruption, signatures,
distances, scores and averages of all runs are rows of the same plans, so a
grid of runs costs as many jobs as one run. The clients' rows are packed into
blocks once: a round brings the runs' models to the blocks, a task trains all
runs on the rows it holds, and only vectors are shuffled. Rows of clients that
have several blocks move once a pass of mini-batches, to be taken in its order.
A round writes its updates, its scores and its next state, and last its
outcome, which makes it whole; a killed fit goes on behind it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cache, reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustfold import constants as C
from trustfold.functions.positions import SLICE_ROWS
from trustfold.functions.sizing import BROADCAST_BYTES, broadcast_if_small
from trustfold.functions.storage import fresh_path
from trustfold.operators import training
from trustfold.operators.blocks import BLOCK, block_mac, block_vectors, corrupted, squared_distance, vector_blocks, vector_sums
from trustfold.operators.corruption import attacker_count
from trustfold.operators.credibility import status, update_credibility
from trustfold.operators.exchange import CELLS_PER_BLOCK
from trustfold.operators.reports import best_so_far, carried_score
from trustfold.plans.rounds import Settings, client_keys, estimate, initial_state, prepare_clients
from trustfold.sources.histories import write_history
from trustfold.sources.logs import accuracy_log, write_log
from trustfold.sources.models import save_best

RUN = "run_id"
#: Files of samples aimed at; up to as many clients have one each.
CLIENT_FILES = 1_000
#: Values (32 MB of doubles) of test rows that one task evaluates at a time.
CELLS_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Run:
    """What sets one run apart from the others."""

    run_id: str
    attack: int
    ratio: float


@dataclass(frozen=True)
class Packed:
    """Rows as flat matrices: clients' ``blocks`` (client_id, block, n, ids, x, y), their ``samples``, and ``steps``.

    ``large`` (client_id, place) numbers the clients of several blocks from 0 up;
    ``n_large`` counts them, ``n_small`` the others.
    """

    blocks: DataFrame
    samples: DataFrame
    steps: DataFrame
    large: DataFrame
    n_large: int
    n_small: int

    @property
    def single(self) -> bool:
        """Whether every client is one block."""
        return self.n_large == 0


@dataclass(frozen=True)
class State:
    """What a round hands on: (run_id, ...) tables of model blocks, scores, pairs handed out, and the next pairs."""

    model: DataFrame
    scores: DataFrame
    history: DataFrame
    pairing: DataFrame


# --- rows as blocks ---

def _stored(spark: SparkSession, make: Callable[[], DataFrame], path: str, rows_per_file: int) -> DataFrame:
    """What a former run wrote whole under ``path``, else ``make()``, written there in files of a few rows.

    A file is the least a task reads: clients that share one would train one after the other in every round.
    """
    try:
        spark.read.parquet(f"{path}.whole")
    except AnalysisException:
        make().write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.whole")
    return spark.read.parquet(path)


def _matrix_rows(df: DataFrame, order: str, rows: int) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct(order, "row_id", "features", "label")))
    packed = df.withColumn("block", F.expr(f"`{order}` div {rows}L")).groupBy("client_id", "block").agg(cells.alias("cells"))
    return packed.select(
        "client_id", "block", F.size("cells").cast("long").alias("n"), F.transform("cells", lambda c: c["row_id"]).alias("ids"),
        F.flatten(F.transform("cells", lambda c: c["features"])).alias("x"), F.transform("cells", lambda c: c["label"]).alias("y"),
    )


def pack_clients(
    spark: SparkSession, prepared: Callable[[], tuple[DataFrame, DataFrame]], settings: Settings, path: str, rows_per_block: int | None = None,
) -> Packed:
    """Clients' rows and samples as matrices under ``path``, each written once; ``prepared()`` deals them if they aren't there."""
    rows = rows_per_block or max(settings.batch, training.CELLS_PER_TASK // settings.features)
    per_file = -(-settings.clients // CLIENT_FILES)
    blocks = _stored(spark, lambda: _matrix_rows(prepared()[0], "ord", rows), f"{path}/blocks", per_file)
    samples = _stored(spark, lambda: _matrix_rows(prepared()[1], "pos", max(1, settings.subset_rows)), f"{path}/samples", per_file)
    sizes = blocks.groupBy("client_id").agg(F.sum("n").alias("rows"), F.max("block").alias("last"))
    steps = sizes.select("client_id", (F.ceil(F.col("rows") / settings.batch) * settings.epochs).cast("long").alias("steps"))
    wrong = blocks.filter((F.size("x") != F.col("n") * settings.features) | (F.array_min("y") < 0) | (F.array_max("y") >= settings.classes))
    if not wrong.isEmpty():
        raise ValueError(f"rows need {settings.features} features and labels below {settings.classes}")
    place = (F.row_number().over(Window.orderBy("client_id")) - 1).cast("int")
    large = _written(sizes.filter("last > 0").select("client_id", place.alias("place")), f"{path}/large")
    n_large = large.count()
    return Packed(blocks, samples, steps, large, n_large, sizes.count() - n_large)


# --- training in the tasks that hold the rows ---

def _emitted(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _one_row_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts; arrays of numbers as numpy views, also those in a list, lists of structs as Python lists."""
    def numbers(kind: pa.DataType) -> bool:
        return pa.types.is_list(kind) and not pa.types.is_nested(kind.value_type)

    def plain(cell: pa.Scalar):
        if numbers(cell.type):
            return cell.values.to_numpy(zero_copy_only=False)
        if pa.types.is_list(cell.type) and numbers(cell.type.value_type) and cell.is_valid:
            return [plain(part) for part in cell]
        return cell.as_py()

    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: plain(column[at]) for name, column in zip(batch.schema.names, batch.columns)}


def _pass_key(seed: int, p: int, row_id: Column) -> Column:
    """Hash by which a pass shuffles a client's rows, as ``train_minibatch`` does."""
    return F.xxhash64(F.lit(seed), "round_no", F.lit(p), "client_id", row_id)


def local_models(blocks: DataFrame, settings: Settings, passes: range) -> DataFrame:
    """(client_id, run_id, n, vector): the models of every run after ``passes`` over one block.

    ``blocks`` carry ``starts``, a list of struct<run_id, vector>, and for
    mini-batches ``orders``, each pass's keys to shuffle by. A full-batch pass
    is one step on the whole block, so that the mean of blocks by rows is the
    step on all of them.
    """
    how = settings
    names, types = ["client_id", RUN, "n", "vector"], [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64())]
    passed = len(passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_row_at_a_time(batches):
            y = row["y"]
            x = row["x"].reshape(len(y), -1)
            vectors = np.array([start["vector"] for start in row["starts"]])
            if how.trainer == "fullbatch":
                for vector in vectors:  # a whole block's logits of one run at a time
                    for _ in range(passed):
                        vector -= how.lr / len(y) * training._gradient_sum(x, y, vector, how.classes)
            else:
                velocities = np.zeros_like(vectors)
                for keys in row["orders"]:
                    order = np.lexsort((row["ids"], keys))
                    batched = (order[b] for b in training._batches(len(y), how.batch))
                    training._sgd_together(x, y, batched, vectors, velocities, how.classes, how.lr, C.MOMENTUM, C.WEIGHT_DECAY)
            yield _emitted([(row["client_id"], start[RUN], len(y), v.tolist()) for start, v in zip(row["starts"], vectors)], names, types)

    if how.trainer == "fullbatch":
        orders = F.lit(None).cast("array<array<bigint>>")
    else:
        key = lambda p: F.transform("ids", lambda i: _pass_key(how.seed, p, i))
        orders = F.array(*map(key, passes))
    rows = blocks.select("client_id", "ids", "x", "y", "starts", orders.alias("orders"))
    return rows.mapInArrow(run, "client_id long, run_id string, n long, vector array<double>")


def _starts(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.array_sort(F.collect_list(F.struct(RUN, "vector"))))


def _whole_clients(blocks: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(run_id, client_id, vector): all passes over clients of one block each."""
    passes = settings.steps if settings.trainer == "fullbatch" else settings.epochs
    return local_models(blocks.withColumn("starts", _starts(vectors).scalar()), settings, range(passes)).select(RUN, "client_id", "vector")


def _averaged_passes(blocks: DataFrame, packed: Packed, vectors: DataFrame, settings: Settings, path: str) -> DataFrame:
    """(run_id, client_id, vector): full-batch steps on blocks in parallel, averaged by rows after each."""
    first = blocks.withColumn("starts", _starts(vectors).scalar())
    for p in range(settings.steps):
        summed = vector_sums(local_models(first, settings, range(p, p + 1)), [RUN, "client_id"], "vector", "n")
        mean = summed.select(RUN, "client_id", F.transform("values", lambda x: x / F.col("weight")).alias("vector"))
        mean = _written(mean, f"{path}/pass={p}")
        starts = mean.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct(RUN, "vector"))).alias("starts"))
        first = blocks.join(broadcast_if_small(starts, row_bytes=64 + 8 * settings.classes * (settings.features + 1)), "client_id")
    return mean


def _sequential_pass(blocks: DataFrame, states: DataFrame, places: int, settings: Settings, p: int) -> DataFrame:
    """(place, client_id, run_id, vector, velocity): ``states`` of the same columns after mini-batches of pass ``p`` over all rows of ``blocks``.

    A task has the client of one ``place``: the states of its runs, then its
    rows in the pass's order as the sort hands them on, so that it holds an
    Arrow batch and the rows behind its last whole mini-batch, however many
    blocks there are.
    """
    how = settings
    names, types = ["place", "client_id", RUN, "vector", "velocity"], [pa.int32(), pa.int64(), pa.string(), *[pa.list_(pa.float64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, vectors = [], None
        x, y = np.empty((0, how.features)), np.empty(0, np.int64)
        step = lambda rows: training._sgd_together(
            x, y, training._batches(rows, how.batch), vectors, velocities, how.classes, how.lr, C.MOMENTUM, C.WEIGHT_DECAY)
        for batch in batches:
            states = batch.num_rows - batch.column(RUN).null_count
            for at in range(states):
                *of, state = (batch.column(name)[at] for name in ("place", "client_id", RUN, "values"))
                found.append((*(key.as_py() for key in of), state.values.to_numpy()))
            if states == batch.num_rows:
                continue
            if vectors is None:
                vectors, velocities = (np.array(part) for part in zip(*(np.split(state, 2) for *_, state in found)))
            rows = batch.slice(states)
            x = np.concatenate([x, rows.column("values").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)])
            y = np.concatenate([y, rows.column("label").to_numpy(zero_copy_only=False)])
            done = len(y) // how.batch * how.batch
            step(done)
            x, y = x[done:], y[done:]
        if found:
            step(len(y))
            yield _emitted([(*of, v.tolist(), u.tolist()) for (*of, _), v, u in zip(found, vectors, velocities)], names, types)

    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    each = blocks.select("place", "client_id", "round_no", "block", "x", "y", F.posexplode("ids").alias("pos", "row_id"))
    rows = each.select(
        "place", "client_id", no("string", RUN), _pass_key(how.seed, p, F.col("row_id")).alias("key"), "row_id", "block", "pos",
        F.slice("x", F.col("pos") * how.features + 1, how.features).alias("values"), F.get("y", "pos").alias("label"),
    )
    first = states.select("place", "client_id", RUN, F.concat("vector", "velocity").alias("values"))
    stream = rows.unionByName(first, allowMissingColumns=True).repartitionById(places, "place")
    # states have no key; rows of one id keep their places, as they do in one block
    stream = stream.sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("row_id").asc_nulls_last(), "block", "pos")
    schema = "place int, client_id long, run_id string, vector array<double>, velocity array<double>"
    return stream.select("place", "client_id", RUN, "values", "label").mapInArrow(run, schema)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with its end; otherwise every pass's rows stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sequential_passes(blocks: DataFrame, packed: Packed, vectors: DataFrame, settings: Settings, path: str) -> DataFrame:
    """(run_id, client_id, vector): mini-batch SGD through all rows of each client, one pass after the other."""
    states = packed.large.crossJoin(vectors).withColumn("velocity", F.transform("vector", lambda _: F.lit(0.0)))
    with _shuffles_dropped(blocks.sparkSession):
        for p in range(settings.epochs):
            states = _written(_sequential_pass(blocks, states, packed.n_large, settings, p), f"{path}/pass={p}")
    return states.select(RUN, "client_id", "vector")


def train_runs(packed: Packed, vectors: DataFrame, settings: Settings, round_no: int, path: str) -> DataFrame:
    """(run_id, client_id, vector): every client's update of every run's model ``vectors`` (run_id, vector).

    Clients of one block take all passes in one task. Larger ones take the same
    steps: full batches as the mean of their blocks by rows, mini-batches in
    the order of all their rows, with the velocity carried along. So what a
    client reports depends neither on the size of a block nor on the others.
    """
    blocks = packed.blocks.withColumn("round_no", F.lit(round_no))
    if packed.single:
        return _whole_clients(blocks, vectors, settings)
    known = broadcast_if_small(packed.large, packed.n_large)
    passes = _averaged_passes if settings.trainer == "fullbatch" else _sequential_passes
    trained = passes(blocks.join(known, "client_id"), packed, vectors, settings, path)
    if packed.n_small:  # else their plan would read all blocks for nothing
        trained = trained.unionByName(_whole_clients(blocks.join(known, "client_id", "left_anti"), vectors, settings))
    return trained


def authenticate_runs(samples: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(run_id, verifier, prover, vector): models that verifiers train on the samples they were sent.

    ``samples`` carry x, y and ``tasks``, a list of struct<run_id, verifier, prover, steps>.
    """
    how = settings
    names, types = [RUN, "verifier", "prover", "vector"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_row_at_a_time(batches):
            y = row["y"]
            x = row["x"].reshape(len(y), -1)
            starts = {s[RUN]: s["vector"] for s in row["starts"]}
            tasks = sorted(row["tasks"], key=lambda task: -task["steps"])
            vectors = np.array([starts[task[RUN]] for task in tasks])
            if how.trainer == "fullbatch":
                for vector in vectors:
                    for _ in range(how.steps):
                        vector -= how.lr / len(y) * training._gradient_sum(x, y, vector, how.classes)
            else:
                cycle, velocities, done = list(training._batches(len(y), C.AUTH_BATCH_ROWS)), np.zeros_like(vectors), 0
                for steps in sorted({task["steps"] for task in tasks}):  # those with fewer steps stand still from there on
                    going = sum(task["steps"] >= steps for task in tasks)
                    batches_of = (cycle[k % len(cycle)] for k in range(done, steps))
                    training._sgd_together(x, y, batches_of, vectors[:going], velocities[:going], how.classes, how.lr, C.MOMENTUM, C.WEIGHT_DECAY)
                    done = steps
            yield _emitted([(task[RUN], task["verifier"], task["prover"], v.tolist()) for task, v in zip(tasks, vectors)], names, types)

    rows = samples.withColumn("starts", _starts(vectors).scalar()).select("x", "y", "tasks", "starts")
    return rows.mapInArrow(run, "run_id string, verifier long, prover long, vector array<double>")


def _sealed(samples: DataFrame, keys: DataFrame, round_no: int, clients: int, path: str) -> DataFrame:
    """Samples sealed for each verifier, written, and opened again; what doesn't open is left out."""
    one = samples.select("client_id", "x", "y", F.explode("tasks").alias("task"))
    secret = lambda c, out: broadcast_if_small(keys.select(F.col("client_id").alias(c), F.col("secret").alias(out)), clients)
    named = one.select("client_id", "x", "y", "task", F.col("task.verifier").alias("verifier"))
    keyed = named.join(secret("client_id", "_sender"), "client_id").join(secret("verifier", "_recipient"), "verifier")
    place = [F.lit(str(round_no)), F.col("task.run_id"), F.col("verifier").cast("string"), F.col("client_id").cast("string")]
    keyed = keyed.withColumn("_key", F.unhex(F.sha2(F.concat_ws("|", F.hex("_sender"), *place), 256)))
    keyed = keyed.withColumn("iv", F.unhex(F.md5(F.concat(F.lit("iv|"), F.hex("_key")))))
    keyed = keyed.withColumn("_rows", F.to_json(F.struct("x", "y")))
    digest = lambda rows: F.sha2(F.concat_ws("|", F.hex("_key"), *place, rows), 256)
    packages = _written(keyed.select(
        "client_id", "verifier", "task",
        F.aes_encrypt(F.concat(digest(F.col("_rows")), "_rows"), "_key", F.lit("CBC"), F.lit("PKCS"), "iv").alias("sealed"),
        F.aes_encrypt("_key", "_recipient", F.lit("GCM"), F.lit("DEFAULT"), F.substring("iv", 1, 12)).alias("wrapped"),
    ), f"{path}/packages")
    opened = packages.join(secret("verifier", "_recipient"), "verifier")
    opened = opened.withColumn("_key", F.try_aes_decrypt("wrapped", "_recipient", F.lit("GCM"), F.lit("DEFAULT")))
    opened = opened.withColumn("_text", F.try_aes_decrypt("sealed", "_key", F.lit("CBC"), F.lit("PKCS")).cast("string"))
    opened = opened.withColumn("_rows", F.substring("_text", 65, 2**31 - 1)).filter(F.substring("_text", 1, 64) == digest(F.col("_rows")))
    rows = F.from_json("_rows", "x array<double>, y array<int>")
    return opened.withColumn("_open", rows).select("client_id", "_open.x", "_open.y", F.array("task").alias("tasks"))


# --- one round of all runs ---

def pair_runs(scores: DataFrame, history: DataFrame, clients: int, orientation: str) -> DataFrame:
    """(run_id, rank, verifier, prover): in every run, rank i verifies rank i + offset, the run's smallest unused offset."""
    if orientation not in ("reversed", "emitted"):
        raise ValueError(f"orientation must be 'reversed' or 'emitted', got {orientation!r}")
    order = Window.partitionBy(RUN).orderBy(F.col("score").desc(), F.col("client_id").asc())
    ranks = scores.select(RUN, "client_id", (F.row_number().over(order) - 1).cast("bigint").alias("rank"))
    of = lambda who, rank: ranks.select(RUN, F.col("client_id").alias(who), F.col("rank").alias(rank))
    past = history.join(of("verifier", "_rv"), [RUN, "verifier"]).join(of("prover", "_rp"), [RUN, "prover"])
    gap = F.col("_rv") - F.col("_rp") if orientation == "reversed" else F.col("_rp") - F.col("_rv")
    used = past.select(RUN, F.pmod(gap, F.lit(clients)).cast("bigint").alias("offset")).distinct()
    # the answer is 1 or the successor of a used offset
    seen = used.groupBy(RUN).agg(F.collect_set("offset").alias("used"))
    least = F.array_min(F.filter(
        F.concat(F.array(F.lit(1).cast("bigint")), F.transform("used", lambda o: o + 1)),
        lambda o: (o <= max(1, clients - 1)) & ~F.array_contains("used", o),
    ))
    offsets = seen.select(RUN, least.alias("offset"))
    verifiers = ranks.join(offsets, RUN, "left").select(
        RUN, "rank", F.col("client_id").alias("verifier"),
        F.pmod(F.col("rank") + F.coalesce("offset", F.lit(1)), F.lit(clients)).cast("bigint").alias("_target"),
    )
    provers = ranks.select(RUN, F.col("rank").alias("_target"), F.col("client_id").alias("prover"))
    return verifiers.join(provers, [RUN, "_target"]).select(RUN, "rank", "verifier", "prover")


def _retained(history: DataFrame, pairing: DataFrame, keep: int = C.HISTORY_KEPT) -> DataFrame:
    """Each run's pairs handed out, the last ``keep`` of them."""
    last = history.groupBy(RUN).agg(F.max("seq").alias("_last"))
    new = pairing.join(last, RUN, "left").select(RUN, (F.coalesce("_last", F.lit(0)) + F.col("rank") + 1).cast("bigint").alias("seq"), "verifier", "prover")
    newest = Window.partitionBy(RUN).orderBy(F.col("seq").desc())
    whole = history.unionByName(new).withColumn("_place", F.row_number().over(newest))
    return whole.filter(F.col("_place") <= keep).drop("_place")


def _handed_out(history: DataFrame, pairing: DataFrame, scores: DataFrame, clients: int, orientation: str) -> DataFrame:
    """(kind, run_id, seq, rank, verifier, prover): each run's retained history and next pairs, as ``_retained`` and ``pair_runs`` find them.

    Up to SLICE_ROWS clients, as many as one window ranks, a run's few numbers
    meet in one task, by a single shuffle of narrow rows; beyond that the
    plans of windows and joins take over.
    """
    kinds = lambda df, kind: df.withColumn("kind", F.lit(kind))
    if clients > SLICE_ROWS:
        kept = _retained(history, pairing)
        return kinds(kept, "history").unionByName(kinds(pair_runs(scores, kept, clients, orientation), "pairing"), allowMissingColumns=True)
    if orientation not in ("reversed", "emitted"):
        raise ValueError(f"orientation must be 'reversed' or 'emitted', got {orientation!r}")
    sign = 1 if orientation == "reversed" else -1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        old, last = rows[rows["kind"] == "history"], rows[rows["kind"] == "pairing"]
        new = last.assign(seq=(0 if old.empty else old["seq"].max()) + last["rank"] + 1)
        kept = pd.concat([part for part in (old, new) if len(part)] or [old]).nlargest(C.HISTORY_KEPT, "seq").assign(kind="history", rank=None)
        ranked = rows[rows["kind"] == "score"].sort_values(["score", "verifier"], ascending=[False, True])["verifier"].to_numpy()
        rank = {client: at for at, client in enumerate(ranked)}
        used = {sign * (rank[v] - rank[p]) % clients for v, p in zip(kept["verifier"], kept["prover"]) if v in rank and p in rank}
        offset = min((o for o in {1, *(u + 1 for u in used)} if o <= max(1, clients - 1) and o not in used), default=1)
        at = (np.arange(len(ranked)) + offset) % clients
        ok = at < len(ranked)
        pairs = pd.DataFrame({"kind": "pairing", "seq": None, "rank": np.flatnonzero(ok), "verifier": ranked[ok], "prover": ranked[at[ok]]})
        numbers = ["seq", "rank", "verifier", "prover"]
        whole = pd.concat([part[["kind", *numbers]].astype({c: "Int64" for c in numbers}) for part in (kept, pairs)])
        return whole.assign(run_id=rows[RUN].iloc[0])[["kind", RUN, *numbers]]

    parts = [kinds(history, "history"), kinds(pairing, "pairing"), kinds(scores.withColumnRenamed("client_id", "verifier"), "score")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(RUN).applyInPandas(run, "kind string, run_id string, seq bigint, rank bigint, verifier bigint, prover bigint")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mac(round_no: int) -> list:
    return [F.col(RUN), F.lit(round_no), F.col("client_id"), F.col("layer"), F.col("block_id"), F.col("total")]


def play_round(
    packed: Packed, state: State, runs: DataFrame, n_runs: int, d_th: float, settings: Settings, round_no: int, keys: DataFrame,
    path: str, in_transit: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One round of all runs; writes ``table`` (scores) and ``state`` under ``path``. ``in_transit`` may alter what was signed."""
    clients = settings.clients
    vectors = block_vectors(state.model, [RUN])
    trained = train_runs(packed, vectors, settings, round_no, path)
    total = F.lit(1 + -(-settings.classes * settings.features // CELLS_PER_BLOCK))
    secrets = broadcast_if_small(keys.select("client_id", "secret"), clients)
    sent = vector_blocks(trained, settings.classes).withColumn("total", total)
    sent = sent.join(broadcast_if_small(runs, n_runs), RUN)
    sent = sent.withColumn("values", corrupted(F.col("attack"), F.col("client_id") < F.col("bad"), settings.seed, round_no))
    sent = sent.join(secrets, "client_id").withColumn("mac", block_mac(F.col("secret"), _mac(round_no), F.col("values")))
    no = lambda kind: F.lit(None).cast(kind)
    own = sent.select(RUN, "client_id", no("bigint").alias("verifier"), *BLOCK, "values", "total", "mac")

    assigned = state.pairing.join(broadcast_if_small(packed.steps.withColumnRenamed("client_id", "verifier"), clients), "verifier")
    tasks = assigned.groupBy(F.col("prover").alias("client_id")).agg(F.array_sort(F.collect_list(F.struct(RUN, "verifier", "prover", "steps"))).alias("tasks"))
    delivered = packed.samples.join(broadcast_if_small(tasks, clients, 64 + 100 * n_runs), "client_id")
    if settings.sealed:
        delivered = _sealed(delivered, keys, round_no, clients, path)
    checked = vector_blocks(authenticate_runs(delivered, vectors, settings), settings.classes)
    theirs = checked.select(RUN, F.col("prover").alias("client_id"), "verifier", *BLOCK, "values", total.alias("total"), no("string").alias("mac"))
    updates = _written(own.unionByName(theirs), f"{path}/updates")
    if in_transit is not None:
        updates = _written(in_transit(updates), f"{path}/arrived")

    is_own = F.col("verifier").isNull()
    signed = updates.join(secrets, "client_id").withColumn(
        "ok", F.when(is_own, F.col("mac") == block_mac(F.col("secret"), _mac(round_no), F.col("values")))
    )
    pairs = signed.groupBy(RUN, "client_id", *BLOCK).agg(
        F.first(F.when(is_own, F.col("values")), ignorenulls=True).alias("w"), F.first(F.when(~is_own, F.col("values")), ignorenulls=True).alias("w_hat"),
        F.first("verifier", ignorenulls=True).alias("verifier"), F.first("ok", ignorenulls=True).alias("ok"), F.first("total").alias("total"),
    )
    square = squared_distance(F.col("w"), F.col("w_hat"))
    found = pairs.groupBy(RUN, "client_id").agg(
        F.max("verifier").alias("verifier"), F.when((F.count(square) == F.count(F.lit(1))) & (F.count(F.lit(1)) == F.max("total")), F.sqrt(F.sum(square))).alias("dist"),
        (F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False))), F.lit(False)) & (F.count("w") == F.max("total"))).alias("secure"),
        (F.count("w") > 0).alias("reported"),
    )
    rehab = round_no > 1 and (round_no - 1) % C.REHAB_EVERY == 0
    scored = state.scores.join(found, [RUN, "client_id"], "left").withColumn("secure", F.coalesce("secure", F.lit(False))).withColumn("rehab", F.lit(rehab))
    scored = update_credibility(scored, d_th, missing="hold").select(
        RUN, "client_id", "verifier", "dist", "secure", F.col("score").alias("score_before"), F.col("new_score").alias("score"),
        F.coalesce("reported", F.lit(False)).alias("reported"),
    )
    table = _written(scored, f"{path}/table")

    voters = table.filter((F.col("score") > C.EXCLUSION_LIMIT) & F.col("reported")).select(RUN, "client_id", "score")
    votes = updates.filter(is_own).join(broadcast_if_small(voters, clients * n_runs), [RUN, "client_id"])
    sums = vector_sums(votes, [RUN, *BLOCK], "values", "score").withColumnRenamed("values", "sums")
    model = state.model.join(sums, [RUN, *BLOCK], "left").select(
        RUN, *BLOCK,
        F.when(F.col("sums").isNull(), F.col("values"))
        .otherwise(F.transform("sums", lambda x: x / (F.col("weight") + C.WEIGHT_EPSILON))).alias("values"),
    )
    scores = table.select(RUN, "client_id", "score")
    model = model.withColumn("kind", F.lit("model"))
    pairs = _handed_out(state.history, state.pairing, scores, clients, settings.orientation)
    model.unionByName(pairs, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/state")


STATE = "kind string, run_id string, layer string, block_id bigint, values array<double>, seq bigint, rank bigint, verifier bigint, prover bigint"
PARTS = {"model": [*BLOCK, "values"], "history": ["seq", "verifier", "prover"], "pairing": ["rank", "verifier", "prover"]}


def _part(state: DataFrame, kind: str, *more: str) -> DataFrame:
    return state.filter(F.col("kind") == kind).select(RUN, *more, *PARTS[kind])


def _read_state(spark: SparkSession, path: str, round_no: int) -> State:
    at = _round_path(path, round_no)
    stored = spark.read.schema(STATE).parquet(f"{at}/state")
    scores = spark.read.schema("run_id string, client_id bigint, score double").parquet(f"{at}/table")
    return State(_part(stored, "model"), scores, _part(stored, "history"), _part(stored, "pairing"))


def _first_state(spark: SparkSession, runs: list[Run], settings: Settings, model: DataFrame | None, path: str) -> State:
    base = initial_state(spark, settings, model)
    names = spark.createDataFrame([(r.run_id,) for r in runs], "run_id string")
    cells = F.array_sort(F.collect_list(F.struct("idx", "value")))
    blocks = base.model.withColumn("block_id", F.expr(f"idx div {CELLS_PER_BLOCK}L")).groupBy(*BLOCK).agg(cells.alias("cells"))
    blocks = blocks.select(*BLOCK, F.transform("cells", lambda c: c["value"]).alias("values"), F.explode(F.array(*(F.lit(r.run_id) for r in runs))).alias(RUN))
    model_blocks = _written(blocks.select(RUN, *BLOCK, "values"), f"{path}/start/model")
    scores = base.credibility.select(F.explode(F.array(*(F.lit(r.run_id) for r in runs))).alias(RUN), "client_id", "score")
    scores = _written(scores, f"{path}/start/scores")
    history = names.limit(0).select(RUN, *(F.lit(None).cast("bigint").alias(c) for c in ("seq", "verifier", "prover")))
    pairing = _written(pair_runs(scores, history, settings.clients, settings.orientation), f"{path}/start/pairing")
    return State(model_blocks, scores, history, pairing)


# --- rounds in sequence ---

def _round_path(path: str, round_no: int) -> str:
    return f"{path}/round={round_no:05d}"


def _outcome(spark: SparkSession, path: str, round_no: int):
    """The outcome row of a round that was stored whole, else None."""
    try:
        return spark.read.parquet(f"{_round_path(path, round_no)}/outcome").first()
    except AnalysisException:
        return None


def fit_runs(
    train: DataFrame, test: DataFrame, settings: Settings, runs: list[Run], path: str | None = None, model: DataFrame | None = None,
    prepared: tuple[DataFrame, DataFrame] | None = None, keys: DataFrame | None = None, retry_failed: bool = False,
    rows_per_block: int | None = None,
) -> DataFrame:
    """All rounds of all runs; the report with one row per run, round and client.

    The loop on the driver only sequences rounds. The dealt rows, the samples
    and each round are written under ``path``; a killed fit resumes behind its
    last whole round with the same rows and threshold. A round that fails is
    recorded with its outcome and leaves models, scores and history of all
    runs untouched; ``retry_failed`` tries those behind the last good round
    again. Wrong rows or keys raise before the first round.
    """
    spark = train.sparkSession
    path = path or fresh_path(spark, "runs")
    dealt = cache(lambda: prepared or prepare_clients(train, settings))  # once, and only where it isn't stored
    packed = pack_clients(spark, dealt, settings, path, rows_per_block)
    state = _first_state(spark, runs, settings, model, path)
    roster = state.scores.select("client_id").distinct()
    keys = _written(client_keys(roster, settings.seed) if keys is None else keys.select("client_id", "secret"), f"{path}/start/keys")
    if not roster.join(keys, "client_id", "left_anti").isEmpty():
        raise ValueError("every client needs a secret")
    stored = {n: done for n in range(1, settings.rounds + 1) if (done := _outcome(spark, path, n)) is not None}
    last_good = max((n for n, done in stored.items() if done["outcome"] == "ok"), default=0)
    d_th = settings.d_th
    if d_th is None:
        d_th = next(iter(stored.values()))["d_th"] if stored else estimate(dealt()[0], initial_state(spark, settings, model).model, settings)
    table = spark.createDataFrame([(r.run_id, r.attack, attacker_count(settings.clients, r.ratio)) for r in runs], "run_id string, attack int, bad int")
    for round_no in range(1, settings.rounds + 1):
        done = None if retry_failed and round_no > last_good else stored.get(round_no)
        at = _round_path(path, round_no)
        outcome = done["outcome"] if done else "ok"
        if done is None:
            try:
                play_round(packed, state, table, len(runs), d_th, settings, round_no, keys, at)
            except Exception as error:  # a failed round is skipped, whatever broke it
                outcome = f"failed: {type(error).__name__}: {str(error)[:200]}"
            row = spark.createDataFrame([(round_no, outcome, float(d_th))], "round int, outcome string, d_th double")
            row.coalesce(1).write.mode("overwrite").parquet(f"{at}/outcome")
        if outcome == "ok":
            state = _read_state(spark, path, round_no)
    return runs_report(spark, test, settings, path)


def _test_blocks(test: DataFrame) -> DataFrame:
    """(x, y): the test rows of a task as flat matrices, packed where they are read."""
    rows = test.select("features", "label")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_once = max(1, CELLS_AT_ONCE * batch.num_rows // max(1, len(batch.column(0).flatten())))
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (part.column(0).flatten(), part.column(1))]
                yield pa.RecordBatch.from_arrays(whole, names=["x", "y"])

    return rows.mapInArrow(run, f"x {kinds['features']}, y array<{kinds['label']}>")


def evaluate_models(test: DataFrame, models: DataFrame, classes: int) -> DataFrame:
    """(run_id, round, accuracy) of all model vectors (run_id, round, vector), in one pass over the test rows.

    The models go with blocks of rows, once a block, not with every row.
    """
    names, types = [RUN, "round", "hits", "n"], [pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = {}, None
        for batch in batches:
            for *block, listed in zip(*batch.columns):
                x, y = (part.values.to_numpy(zero_copy_only=False) for part in block)
                x = x.reshape(len(y), -1)
                if held is None:
                    held = [(m[RUN], m["round"], np.array(m["vector"])) for m in listed.as_py()]
                for run_id, round_no, vector in held:
                    hits, n = sums.get((run_id, round_no), (0, 0))
                    sums[run_id, round_no] = (hits + int((training._logits(x, vector, classes).argmax(axis=1) == y).sum()), n + len(y))
        if sums:
            yield _emitted([(*k, *v) for k, v in sums.items()], names, types)

    listed = models.agg(F.array_sort(F.collect_list(F.struct(RUN, "round", "vector")))).scalar()
    counts = _test_blocks(test).withColumn("models", listed).mapInArrow(run, "run_id string, round int, hits long, n long")
    return counts.groupBy(RUN, "round").agg((F.lit(100.0) * F.sum("hits") / F.sum("n")).alias("accuracy"))


def runs_report(spark: SparkSession, test: DataFrame, settings: Settings, path: str) -> DataFrame:
    """One row per run, round and client; a failed round shows as one row without clients. Keeps each run's best model."""
    outcomes = spark.read.parquet(*[f"{_round_path(path, n)}/outcome" for n in range(1, settings.rounds + 1)])
    good = sorted(r["round"] for r in outcomes.filter("outcome = 'ok'").select("round").collect())  # numbers of rounds
    if not good:
        raise RuntimeError(f"no round succeeded: {outcomes.select('round', 'outcome').take(3)}")
    read = lambda name: spark.read.option("basePath", path).parquet(*[f"{_round_path(path, n)}/{name}" for n in good])
    models = block_vectors(_part(read("state").withColumn("round", F.col("round").cast("int")), "model", "round"), [RUN, "round"])
    names = [r[RUN] for r in spark.read.parquet(f"{path}/start/scores").select(RUN).distinct().collect()]  # runs, a parameter
    model_bytes = 8 * settings.classes * (settings.features + 1)
    at_once = max(1, BROADCAST_BYTES // 4 // max(1, model_bytes * len(names)))
    reached = [
        evaluate_models(test, models.filter(F.col("round").isin(good[k : k + at_once])), settings.classes) for k in range(0, len(good), at_once)
    ]
    # a folder of its own: reports of a fit that is resumed later stay readable
    reached = _written(reduce(DataFrame.unionByName, reached), f"{path}/accuracies/report={time.time_ns()}")
    best = best_so_far(reached, [RUN]).withColumnRenamed("is_new_best", "is_best")
    tables = status(read("table").withColumn("round", F.col("round").cast("int")).drop("reported"))
    every = outcomes.select("round", "outcome", "d_th", F.explode(F.array(*map(F.lit, names))).alias(RUN))
    first = carried_score(every, tables, [RUN], "score_c0")
    report = (
        every.join(best, [RUN, "round"], "left").join(tables, [RUN, "round"], "left").join(first, [RUN, "round"])
    )
    so_far = F.coalesce(F.max("best").over(Window.partitionBy(RUN).orderBy("round")), F.lit(0.0))
    report = report.withColumn("best", so_far).withColumn("is_best", F.coalesce("is_best", F.lit(False)))
    return report.select(
        RUN, "round", "outcome", "d_th", "accuracy", "best", "is_best", "score_c0",
        "client_id", "verifier", "dist", "secure", "score_before", "score", "status",
    )


def best_of(spark: SparkSession, path: str, run_id: str, into: str) -> str:
    """Folder of a new version of the run's model of highest accuracy in the last report, the first one on ties."""
    found = spark.read.parquet(f"{path}/accuracies").filter(F.col(RUN) == run_id)
    top = found.orderBy(F.col("report").desc(), F.col("accuracy").desc(), "round").first()
    blocks = _part(spark.read.schema(STATE).parquet(f"{_round_path(path, top['round'])}/state"), "model").filter(F.col(RUN) == run_id)
    cells = blocks.select("layer", "block_id", F.posexplode("values").alias("pos", "value"))
    model = cells.select("layer", (F.col("block_id") * CELLS_PER_BLOCK + F.col("pos")).cast("bigint").alias("idx"), "value")
    return save_best(model, top["accuracy"], -1.0, into)[1]


def federated_fit(
    train: DataFrame, test: DataFrame, settings: Settings, path: str | None = None, model: DataFrame | None = None,
    prepared: tuple[DataFrame, DataFrame] | None = None, keys: DataFrame | None = None, output: str | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """All rounds of one run; the report (round, outcome, accuracy, best, is_best, client_id, score, ...).

    ``keys`` (client_id, secret) are the clients' secrets; without them
    stand-ins are derived, which protect nothing. With ``output`` the wide
    history and the accuracy log are written there as CSV. The model of
    highest accuracy is kept under ``path/best``. See ``fit_runs``.
    """
    spark = train.sparkSession
    path = path or fresh_path(spark, "fit")
    run = Run(f"atk{settings.attack}_ratio{settings.ratio}", settings.attack, settings.ratio)
    whole = fit_runs(train, test, settings, [run], path, model, prepared, keys, retry_failed)
    best_of(spark, path, run.run_id, f"{path}/best")
    report = whole.drop(RUN)
    if output is not None:
        seen = report.filter(F.col("client_id").isNotNull()).select(F.lit(run.run_id).alias(RUN), "round", "client_id", "score")
        write_history(seen, f"{output}/history", range(settings.clients))
        per_round = report.filter(F.col("accuracy").isNotNull()).select("round", "accuracy").distinct()
        write_log(accuracy_log(per_round, seen), output, settings.attack, settings.ratio)
    return report


def experiment_grid(
    train: DataFrame, test: DataFrame, settings: Settings,
    attacks: tuple[int, ...] = (C.ADDITIVE_NOISE, C.REPLACEMENT_NOISE, C.CONSTANT_VALUE),
    ratios: tuple[float, ...] = (0.2, 0.4, 0.6), keys: DataFrame | None = None, path: str | None = None,
) -> DataFrame:
    """Every attack at every ratio, keyed by ``run_id``; all runs share the rows, the threshold and each round's jobs."""
    runs = [Run(f"atk{a}_ratio{r}", a, r) for a, r in product(attacks, ratios)]
    return fit_runs(train, test, replace(settings), runs, path, keys=keys)

"""Named queries, one or more per operator: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold import constants as C
from trustfold.checks import tables as t
from trustfold.checks.tables import rounded
from trustfold.functions.hashing import uniform
from trustfold.functions.storage import durable, fresh_path
from trustfold.operators import aggregation, corruption, credibility, dealing, exchange, features, pairing, reports, training
from trustfold.plans import rounds, runs, threshold
from trustfold.sources import histories, labeled, logs, models
from trustfold.streaming import credibility_batches, credibility_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEST_FRACTION = 0.2
LEARNING_RATE = 0.5
SUBSET = 20
#: Rows of a sample beyond what a window limits early.
LARGE_SUBSET = 2_000
ROUND = rounds.Settings(trainer="fullbatch", lr=LEARNING_RATE, subset_rows=SUBSET, attack=C.REPLACEMENT_NOISE, ratio=0.6)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _cells(df: DataFrame, *keys: str, col: str = "features", digits: int = 9) -> DataFrame:
    """Array column as long rows (keys, pos, value)."""
    return df.select(*keys, F.posexplode(col).alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), rounded(F.col("value"), digits).alias("value")
    )


def _values(df: DataFrame, *keys: str, digits: int = 9) -> DataFrame:
    """Long model rows with the value rounded for comparison."""
    return df.select(*keys, "layer", F.col("idx").cast("bigint").alias("idx"), rounded(F.col("value"), digits).alias("value"))


def _train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeled.split(t.embedding_rows(spark, sf_dir), TEST_FRACTION)[0]


def _test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeled.split(t.embedding_rows(spark, sf_dir), TEST_FRACTION)[1]


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealing.deal(_train_rows(spark, sf_dir))


def _zero(spark: SparkSession) -> DataFrame:
    return training.zero_model(spark, ROUND.classes, ROUND.features)


# --- sources, sinks, features ---

@query
def labeled_source(spark, sf_dir):
    return _cells(t.embedding_rows(spark, sf_dir), "row_id", "label")


@query
def train_test_split(spark, sf_dir):
    train, test = labeled.split(t.embedding_rows(spark, sf_dir), TEST_FRACTION)
    tagged = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return tagged.select("row_id", "label", "part")


@query
def materialized_training(spark, sf_dir):
    augmented = features.prepare(_train_rows(spark, sf_dir), "train")
    return _cells(labeled.materialize(augmented, fresh_path(spark, "augmented")), "row_id", "label")


@query
def scale_unit(spark, sf_dir):
    return _cells(features.scale_unit(t.lineitem_rows(spark, sf_dir)), "row_id")


@query
def normalize(spark, sf_dir):
    return _cells(features.normalize(t.lineitem_rows(spark, sf_dir)), "row_id")


@query
def random_crop(spark, sf_dir):
    return _cells(features.random_crop(t.embedding_rows(spark, sf_dir)), "row_id")


@query
def random_hflip(spark, sf_dir):
    return _cells(features.random_hflip(t.embedding_rows(spark, sf_dir)), "row_id")


@query
def prepare_test(spark, sf_dir):
    return _cells(features.prepare(_test_rows(spark, sf_dir), "test"), "row_id")


def _run_history(spark, sf_dir) -> DataFrame:
    return t.unpack_run(credibility.trace_credibility(t.run_observations(spark, sf_dir), t.RUN_THRESHOLD))


@query
def wide_history(spark, sf_dir):
    return histories.wide_history(_run_history(spark, sf_dir), range(C.CLIENTS))


@query
def history_round_trip(spark, sf_dir):
    """Written as wide CSV per run, read back as long rows."""
    path = fresh_path(spark, "history")
    histories.write_history(_run_history(spark, sf_dir), path, range(C.CLIENTS))
    long = histories.read_history(spark, f"{path}/*")
    counted = long.withColumn("run_id", F.regexp_extract("path", r"run_id=(\w+)", 1))
    # every run is written to its own file, which holds one segment
    return counted.select("run_id", "segment", F.col("round").cast("bigint").alias("round"), "client_id", "score")


@query
def history_segments(spark, sf_dir):
    """A file per run with the whole run and a restart that stopped after 15 rounds, each under its header."""
    wide = durable(histories.wide_history(_run_history(spark, sf_dir), range(C.CLIENTS)), "wide")
    names = [c for c in wide.columns if c not in ("run_id", "Round")]
    scores = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    rows = wide.select("run_id", F.col("Round").alias("at"), F.concat_ws(",", "Round", *scores).alias("value"))
    headers = wide.select("run_id").distinct().select(
        "run_id", F.lit(0).cast("bigint").alias("at"), F.lit(",".join(["Round", *names])).alias("value")
    )
    whole = rows.unionByName(headers).withColumn("part", F.lit(1))
    restart = rows.filter(F.col("at") <= 15).unionByName(headers).withColumn("part", F.lit(2))
    path = fresh_path(spark, "appended")
    (
        whole.unionByName(restart).repartition("run_id").sortWithinPartitions("run_id", "part", "at")
        .select("run_id", "value").write.partitionBy("run_id").text(path)
    )
    long = histories.read_history(spark, f"{path}/*")
    return long.select(
        F.regexp_extract("path", r"run_id=(\w+)", 1).alias("run_id"), "segment",
        F.col("round").cast("bigint").alias("round"), "client_id", "score",
    )


@query
def run_file_metadata(spark, sf_dir):
    """File names of one run per document source and language, parsed back."""
    named = t.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("runs/client_atk"), F.length("lang"), F.lit("_0."), (F.col("doc_id") % 10).cast("string"),
            F.lit("_dth="), F.col("n_chars").cast("string"),
            F.when(F.col("doc_id") % 7 == 0, F.lit(".csv.csv")).otherwise(F.lit(".csv")),
        ).alias("path"),
    )
    return histories.with_run_metadata(named).select("doc_id", "attack", "ratio", "d_th")


@query
def accuracy_log(spark, sf_dir):
    """One run's log written as CSV, read back."""
    accuracy = t.run_accuracy(spark, sf_dir)
    history = _run_history(spark, sf_dir)
    parts = []
    for run in range(len(t.EVENT_TYPES)):
        mine = F.col("run_id") == f"run{run}"
        log = logs.accuracy_log(accuracy.filter(mine), history.filter(mine).drop("run_id"))
        target = logs.write_log(log, fresh_path(spark, "log"), run, 0.2)
        read = spark.read.option("header", True).schema("Round bigint, Accuracy double, Credibility_C0 double").csv(target)
        parts.append(read.select(F.lit(f"run{run}").alias("run_id"), "*"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def best_model(spark, sf_dir):
    """Model after each of as many steps as a fit has rounds, kept only where the accuracy strictly improves."""
    dealt = durable(_dealt(spark, sf_dir), "dealt")
    path, best, model, kept = fresh_path(spark, "best"), 0.0, _zero(spark), None
    everyone = dealt.select("client_id").distinct().withColumn("score", F.lit(1.0))
    for _ in range(C.ROUNDS):
        updates = durable(training.train_fullbatch(dealt, model, ROUND.classes, LEARNING_RATE), "updates")
        model = durable(aggregation.robust_aggregate(updates, everyone), "model")
        reached = rounds.evaluate(_test_rows(spark, sf_dir), model, ROUND.classes).first()["accuracy"]
        best, version = models.save_best(model, reached, best, path)
        kept = version or kept
    return models.load_model(spark, kept)


@query
def params_in_order(spark, sf_dir):
    """Place of each cell in the flattened model."""
    return aggregation.to_vectors(t.supplier_updates(spark, sf_dir)).select(
        "client_id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("value"), 6).alias("value")
    )


@query
def params_in_blocks(spark, sf_dir):
    blocks = aggregation.to_blocks(t.embedding_updates(spark, sf_dir), cells_per_block=16)
    return blocks.select(
        "client_id", "layer", "block_id", F.size("values").cast("bigint").alias("cells"),
        rounded(F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
    )


@query
def attacker_roster(spark, sf_dir):
    roster = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("client_id"))
    return corruption.attackers(roster, roster.count(), 0.29)


@query
def trust_status(spark, sf_dir):
    return credibility.status(t.supplier_scores(spark, sf_dir)).select("client_id", "status")


@query
def proof_flags(spark, sf_dir):
    """Events as proof packages: none, empty, refused or accepted."""
    package = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_type") == "view", F.expr("cast(map() as map<string,boolean>)"))
        .otherwise(F.create_map(F.lit("zkp_status"), F.col("event_type") != "signup"))
    )
    return t.table(spark, sf_dir, "events").select("event_id", exchange.proof_ok(package).alias("accepted"))


# --- dealing ---

@query
def capacity_check(spark, sf_dir):
    return dealing.check_capacity(t.lineitem_rows(spark, sf_dir))


@query
def label_shards(spark, sf_dir):
    return dealing.label_shards(t.embedding_rows(spark, sf_dir)).select("row_id", "label", "shard")


@query
def label_shards_lineitem(spark, sf_dir):
    return dealing.label_shards(t.lineitem_rows(spark, sf_dir)).select("row_id", "label", "shard")


@query
def shard_audit(spark, sf_dir):
    return dealing.shard_audit(dealing.label_shards(t.lineitem_rows(spark, sf_dir)))


@query
def client_deal(spark, sf_dir):
    sharded = dealing.label_shards(t.lineitem_rows(spark, sf_dir))
    return dealing.assign_clients(sharded).select("row_id", "shard", "client_id")


@query
def client_order(spark, sf_dir):
    return dealing.deal(t.lineitem_rows(spark, sf_dir)).select("row_id", "client_id", "ord")


@query
def client_layout(spark, sf_dir):
    laid = dealing.layout(dealing.deal(t.lineitem_rows(spark, sf_dir)), rows_per_block=1000)
    return laid.groupBy("client_id", "block").agg(F.count(F.lit(1)).alias("n"))


@query
def client_subset(spark, sf_dir):
    sharded = dealing.label_shards(t.lineitem_rows(spark, sf_dir))
    subset = dealing.client_subset(dealing.assign_clients(sharded), C.SUBSET_ROWS)
    return subset.select("client_id", "row_id", "pos")


@query
def client_subset_large(spark, sf_dir):
    """Samples too large for a window's early limit."""
    sharded = dealing.label_shards(t.lineitem_rows(spark, sf_dir))
    dealt = durable(dealing.assign_clients(sharded).select("client_id", "row_id"), "dealt")
    return dealing.client_subset(dealt, LARGE_SUBSET).select("client_id", "row_id", "pos")


@query
def label_skew(spark, sf_dir):
    skew = dealing.label_skew(dealing.assign_clients(dealing.label_shards(t.lineitem_rows(spark, sf_dir))))
    return skew.withColumn("share", rounded(F.col("share"), 9))


@query
def label_skew_documents(spark, sf_dir):
    """Documents dealt by language, checked for skew of the quality label."""
    docs = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id")
    skew = dealing.label_skew(docs.select(F.col("lang").alias("client_id"), F.col("quality").alias("label")))
    return skew.withColumn("share", rounded(F.col("share"), 9))


# --- joins ---

def _first_pairing(spark) -> DataFrame:
    state = rounds.initial_state(spark, ROUND)
    return pairing.pair(state.credibility, state.history)


@query
def sample_delivery(spark, sf_dir):
    subsets = dealing.client_subset(_dealt(spark, sf_dir), SUBSET)
    return exchange.deliver(subsets, _first_pairing(spark)).select("verifier", "prover", "pos", "row_id", "label")


@query
def matched_updates(spark, sf_dir):
    """Suppliers' updates beside their verifiers', paired by score."""
    nothing = spark.createDataFrame([], "seq bigint, verifier bigint, prover bigint")
    pairs = durable(pairing.pair(t.supplier_scores(spark, sf_dir), nothing), "pairs")
    auth = t.supplier_updates(spark, sf_dir, part=2).withColumnRenamed("client_id", "verifier")
    matched = aggregation.match_updates(t.supplier_updates(spark, sf_dir, part=1), auth, pairs)
    return matched.select(
        "prover", "verifier", "layer", "idx", rounded(F.col("w"), 6).alias("w"), rounded(F.col("w_hat"), 6).alias("w_hat")
    )


@query
def key_lookup(spark, sf_dir):
    keys = t.secrets(t.supplier_scores(spark, sf_dir))
    lines = t.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("client_id"))
    return exchange.with_key(lines, keys, "client_id").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"), F.lower(F.hex(F.max("secret"))).alias("secret_hex")
    )


@query
def score_lookup(spark, sf_dir):
    scored = aggregation.with_score(t.supplier_updates(spark, sf_dir), t.supplier_scores(spark, sf_dir))
    return scored.select("client_id", "layer", "idx", rounded(F.col("value") * F.col("score"), 6).alias("weighted"))


def _second_round_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers by balance, and the last pairs of a first pairing without history."""
    scores = durable(t.customer_scores(spark, sf_dir), "scores")
    empty = spark.createDataFrame([], "seq bigint, verifier bigint, prover bigint")
    return scores, durable(pairing.retain(empty, pairing.pair(scores, empty)), "pairs")


@query
def used_offsets(spark, sf_dir):
    scores, past = _second_round_inputs(spark, sf_dir)
    ranks = pairing.rank_clients(scores)
    clients = scores.count()
    found = [
        pairing.used_offsets(ranks, past, clients, side).withColumn("orientation", F.lit(side))
        for side in ("reversed", "emitted")
    ]
    return found[0].unionByName(found[1])


# --- distances, thresholds, averages ---

@query
def model_distance(spark, sf_dir):
    halves = [durable(t.supplier_updates(spark, sf_dir, part), "updates") for part in (1, 2)]
    found = aggregation.model_distance(*halves)
    return found.select("client_id", rounded(F.col("dist"), 6).alias("dist"))


@query
def block_distance(spark, sf_dir):
    """Each embedding against its own mirror image, in block layout."""
    rows = t.embedding_rows(spark, sf_dir)
    sides = []
    for values in (F.col("features"), F.reverse("features")):
        long = rows.select(F.col("row_id").alias("client_id"), F.lit("embedding").alias("layer"), F.posexplode(values).alias("p", "value"))
        sides.append(aggregation.to_blocks(long.select("client_id", "layer", F.col("p").cast("bigint").alias("idx"), "value"), 16))
    return aggregation.block_distance(*sides).select("client_id", rounded(F.col("dist"), 9).alias("dist"))


@query
def threshold_estimate(spark, sf_dir):
    distances = threshold.half_sample_distances(_dealt(spark, sf_dir), _zero(spark), ROUND.classes, LEARNING_RATE)
    return threshold.estimate_threshold(distances)


@query
def threshold_reshuffled(spark, sf_dir):
    """The spread between two differently shuffled mini-batch trainings."""
    dealt = durable(_dealt(spark, sf_dir), "dealt")
    distances = threshold.reshuffled_distances(dealt, _zero(spark), ROUND.classes, LEARNING_RATE)
    return threshold.estimate_threshold(distances)


@query
def trusted_clients(spark, sf_dir):
    return aggregation.trusted(t.supplier_scores(spark, sf_dir)).select("client_id", rounded(F.col("score"), 9).alias("score"))


@query
def weighted_average(spark, sf_dir):
    updates = durable(t.supplier_updates(spark, sf_dir), "updates")
    return _values(aggregation.robust_aggregate(updates, t.supplier_scores(spark, sf_dir)), digits=6)


@query
def next_global_model(spark, sf_dir):
    """The second half's average follows the first's; a run trusting nobody keeps the first."""
    scores = t.supplier_scores(spark, sf_dir)
    halves = [durable(t.supplier_updates(spark, sf_dir, p), "updates") for p in (1, 2)]
    first, second = [aggregation.robust_aggregate(half, scores) for half in halves]
    nobody = aggregation.robust_aggregate(halves[1], scores.withColumn("score", F.lit(0.0)))
    followed = aggregation.next_global(second, first).withColumn("voters", F.lit("trusted"))
    held = aggregation.next_global(nobody, first).withColumn("voters", F.lit("none"))
    return _values(followed.unionByName(held), "voters", "kept", digits=6)


@query
def run_summary(spark, sf_dir):
    summary = reports.run_summary(t.run_accuracy(spark, sf_dir), ["run_id"])
    return summary.withColumn("tail_mean", rounded(F.col("tail_mean"), 6))


@query
def detection_report(spark, sf_dir):
    """Attackers are the first six clients of each run."""
    return reports.detection(_run_history(spark, sf_dir), ["run_id"], F.col("client_id") < 6)


# --- pairing ---

def _paired(spark, sf_dir, orientation: str) -> DataFrame:
    scores, past = _second_round_inputs(spark, sf_dir)
    return pairing.pair(scores, past, orientation)


@query
def pairing_reversed(spark, sf_dir):
    return _paired(spark, sf_dir, "reversed")


@query
def pairing_emitted(spark, sf_dir):
    return _paired(spark, sf_dir, "emitted")


@query
def history_retention(spark, sf_dir):
    scores, past = _second_round_inputs(spark, sf_dir)
    return pairing.retain(past, pairing.pair(scores, past, "emitted"))


@query
def client_ranking(spark, sf_dir):
    ranked = pairing.rank_clients(t.customer_scores(spark, sf_dir))
    return ranked.select("client_id", "rank")


@query
def rehab_rounds(spark, sf_dir):
    seen = t.event_observations(spark, sf_dir)
    return seen.groupBy("round").agg(F.count(F.lit(1)).alias("n")).withColumn("rehab", pairing.is_rehab())


# --- credibility ---

@query
def credibility_step(spark, sf_dir):
    """Every event as one update of a hashed score."""
    draw = uniform("step", F.col("event_id"))
    scored = t.table(spark, sf_dir, "events").select(
        "event_id", (draw * draw * draw * draw).alias("score"), F.col("value").alias("dist"),
        (F.col("event_type") != "error").alias("secure"), (F.col("event_type") == "view").alias("rehab"),
    )
    return credibility.update_credibility(scored, t.EVENT_THRESHOLD).select("event_id", "new_score")


@query
def credibility_fold(spark, sf_dir):
    return credibility.fold_credibility(t.event_observations(spark, sf_dir), t.EVENT_THRESHOLD)


@query
def credibility_fold_blocks(spark, sf_dir):
    """The same fold with short blocks, so that every client spans several."""
    return credibility.fold_credibility(t.event_observations(spark, sf_dir), t.EVENT_THRESHOLD, block_rounds=16)


@query
def credibility_trace(spark, sf_dir):
    return credibility.trace_credibility(t.event_observations(spark, sf_dir), t.EVENT_THRESHOLD)


@query
def best_so_far(spark, sf_dir):
    return reports.best_so_far(t.run_accuracy(spark, sf_dir), ["run_id"])


@query
def transition_audit(spark, sf_dir):
    """Traced scores with every error-run score of day 5 replaced, which no rule can explain."""
    history = _run_history(spark, sf_dir)
    forged = (F.col("run_id") == "run1") & (F.col("round") == 5)
    broken = history.withColumn("score", F.when(forged, F.col("score") * 0.37).otherwise(F.col("score")))
    return credibility.audit_transitions(broken, ["run_id"]).select("run_id", "round", "client_id", "transition")


def _event_stream(spark, sf_dir, base: str):
    """Append the events in three slices in time; yields the stream to run after each append."""
    events = t.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("dist"), (F.col("event_type") != "error").alias("secure"),
    )
    us = F.unix_micros("ts")
    borders = events.agg(F.percentile_approx(us, [1 / 3, 2 / 3]).alias("b")).first()["b"]
    for chosen in (us <= borders[0], (us > borders[0]) & (us <= borders[1]), us > borders[1]):
        events.filter(chosen).write.mode("append").parquet(f"{base}/events")
        yield spark.readStream.schema(events.schema).parquet(f"{base}/events")


@query
def streaming_credibility(spark, sf_dir):
    """Per-client state behind a watermark; each run of the stream resumes from its checkpoint."""
    base = fresh_path(spark, "stream")

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/scores/epoch={epoch}")

    for stream in _event_stream(spark, sf_dir, base):
        scores = credibility_stream.streaming_credibility(stream, t.EVENT_THRESHOLD, delay="0 seconds")
        running = (
            scores.writeStream.outputMode("update").foreachBatch(append)
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    emitted = spark.read.parquet(f"{base}/scores/epoch=*")
    return emitted.groupBy("client_id").agg(F.max("rounds").alias("rounds"), F.max_by("score", "rounds").alias("score"))


@query
def streaming_credibility_batches(spark, sf_dir):
    """Micro-batches as distributed folds, an hour of delay, waiting rows applied at the end."""
    base = fresh_path(spark, "batches")
    for stream in _event_stream(spark, sf_dir, base):
        writer = credibility_batches.score_stream(stream, f"{base}/state", t.EVENT_THRESHOLD, delay_us=3_600_000_000)
        writer.trigger(availableNow=True).start().awaitTermination()
    nothing = spark.createDataFrame([], credibility_batches.ROWS)
    credibility_batches.apply_batch(nothing, 3, f"{base}/state", t.EVENT_THRESHOLD, flush=True)
    return credibility_batches.scores(spark, f"{base}/state", 3)


# --- training and scoring ---

@query
def model_init(spark, sf_dir):
    """One row per class and feature of the embeddings."""
    shape = t.embedding_rows(spark, sf_dir).agg(
        F.countDistinct("label").alias("classes"), F.max(F.size("features")).alias("features")
    ).first()
    return _values(training.init_model(spark, shape["classes"], shape["features"]))


@query
def fullbatch_step(spark, sf_dir):
    return _values(training.train_fullbatch(_dealt(spark, sf_dir), _zero(spark), ROUND.classes, LEARNING_RATE), "client_id")


@query
def fullbatch_two_steps(spark, sf_dir):
    trained = training.train_fullbatch(
        _dealt(spark, sf_dir), training.init_model(spark, ROUND.classes, ROUND.features), ROUND.classes, 0.1, steps=2
    )
    return _values(trained, "client_id", digits=7)


@query
def fullbatch_lineitem(spark, sf_dir):
    dealt = dealing.deal(t.lineitem_rows(spark, sf_dir))
    trained = training.train_fullbatch(dealt, training.zero_model(spark, 6, 4), 6, LEARNING_RATE)
    return _values(trained, "client_id")


@query
def minibatch_training(spark, sf_dir):
    dealt = durable(dealing.deal(t.lineitem_rows(spark, sf_dir)), "dealt")
    return _values(training.train_minibatch(dealt, training.zero_model(spark, 6, 4), 6), "client_id")


@query
def authentication_fullbatch(spark, sf_dir):
    subsets = dealing.client_subset(_dealt(spark, sf_dir), SUBSET)
    delivered = exchange.deliver(subsets, _first_pairing(spark))
    trained = training.train_fullbatch(
        delivered, _zero(spark), ROUND.classes, LEARNING_RATE, key="verifier", order="pos"
    )
    return _values(trained, "verifier")


@query
def authentication_training(spark, sf_dir):
    dealt = durable(_dealt(spark, sf_dir), "dealt")
    delivered = exchange.deliver(dealing.client_subset(dealt, SUBSET), _first_pairing(spark))
    trained = training.train_auth(delivered, _zero(spark), training.training_steps(dealt), ROUND.classes)
    return _values(trained, "verifier")


@query
def empty_clients(spark, sf_dir):
    """Customers as clients and orders as rows: who has nothing to train on."""
    roster = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))
    rows = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"))
    return training.training_status(roster, training.training_steps(rows, batch=4))


def _average_model(spark, sf_dir) -> DataFrame:
    updates = durable(
        training.train_fullbatch(_dealt(spark, sf_dir), _zero(spark), ROUND.classes, LEARNING_RATE), "updates"
    )
    equal = updates.select("client_id").distinct().withColumn("score", F.lit(0.5))
    return aggregation.robust_aggregate(updates, equal)


@query
def predictions(spark, sf_dir):
    scored = training.predict(_test_rows(spark, sf_dir), _average_model(spark, sf_dir), ROUND.classes)
    return _cells(scored, "row_id", col="logits")


@query
def argmax_class(spark, sf_dir):
    """Largest feature of each order line, the first on ties."""
    rows = t.lineitem_rows(spark, sf_dir)
    return rows.select("row_id", training.argmax_class("features").alias("predicted"))


@query
def model_accuracy(spark, sf_dir):
    reached = rounds.evaluate(_test_rows(spark, sf_dir), _average_model(spark, sf_dir), ROUND.classes)
    return reached.select(rounded(F.col("accuracy"), 6).alias("accuracy"))


def _corrupted(spark, sf_dir, kind: int) -> DataFrame:
    updates = t.supplier_updates(spark, sf_dir)
    clients = t.table(spark, sf_dir, "supplier").count()
    return _values(corruption.corrupt(updates, kind, clients, 0.4), "client_id", digits=6)


@query
def corruption_none(spark, sf_dir):
    return _corrupted(spark, sf_dir, C.NO_CORRUPTION)


@query
def corruption_additive(spark, sf_dir):
    return _corrupted(spark, sf_dir, C.ADDITIVE_NOISE)


@query
def corruption_replacement(spark, sf_dir):
    return _corrupted(spark, sf_dir, C.REPLACEMENT_NOISE)


@query
def corruption_constant(spark, sf_dir):
    return _corrupted(spark, sf_dir, C.CONSTANT_VALUE)


# --- exchange ---

@query
def sealed_round_trip(spark, sf_dir):
    """Samples sealed for their verifier and opened again, feature by feature."""
    delivered = exchange.deliver(dealing.client_subset(_dealt(spark, sf_dir), SUBSET), _first_pairing(spark))
    keys = t.secrets(spark.range(C.CLIENTS).select(F.col("id").alias("client_id")))
    opened = exchange.open_(durable(exchange.seal(delivered, keys, chunk_rows=8), "packages"), keys)
    return _cells(opened, "verifier", "prover", "row_id", "label")


@query
def opened_with_wrong_key(spark, sf_dir):
    """Packages per verifier, and how many open with a foreign key."""
    delivered = exchange.deliver(dealing.client_subset(_dealt(spark, sf_dir), SUBSET), _first_pairing(spark))
    roster = spark.range(C.CLIENTS).select(F.col("id").alias("client_id"))
    packages = durable(exchange.seal(delivered, t.secrets(roster), chunk_rows=8), "packages")
    opened = exchange.open_packages(packages, t.secrets(roster, "other"))
    return opened.groupBy("verifier").agg(F.count(F.lit(1)).alias("packages"), F.count("rows").alias("opened"))


@query
def attestations(spark, sf_dir):
    updates = t.embedding_updates(spark, sf_dir)
    return exchange.attest(updates, t.secrets(updates), cells_per_block=16)


def _tampered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Updates and links after signing: label 1 changed a value, label 2 lost a row, label 3 lost its key."""
    updates = t.embedding_updates(spark, sf_dir)
    keys = t.secrets(updates)
    sent = exchange.attest(updates, keys, cells_per_block=16)
    labels = t.embedding_rows(spark, sf_dir).select(F.col("row_id").alias("client_id"), "label")
    marked = updates.join(labels, "client_id")
    tampered = marked.filter(~((F.col("label") == 2) & (F.col("idx") == 63))).withColumn(
        "value", F.when((F.col("label") == 1) & (F.col("idx") == 0), F.col("value") + 0.001).otherwise(F.col("value"))
    ).drop("label")
    wrong = keys.join(labels, "client_id").select(
        "client_id",
        F.when(F.col("label") == 3, F.unhex(F.md5(F.col("client_id").cast("string")))).otherwise(F.col("secret")).alias("secret"),
    )
    return labels, exchange.verify(tampered, sent, wrong, cells_per_block=16)


@query
def verification(spark, sf_dir):
    return _tampered(spark, sf_dir)[1]


@query
def tamper_drill(spark, sf_dir):
    labels, links = _tampered(spark, sf_dir)
    scored = links.join(labels, "client_id").select(
        "client_id", "secure", F.lit(0.5).alias("score"), F.col("label").cast("double").alias("dist"), F.lit(False).alias("rehab")
    )
    return credibility.update_credibility(scored, 6.0).select("client_id", "new_score")


# --- rounds ---

@query
def training_round(spark, sf_dir):
    """The whole first round under replacement noise by six of ten clients."""
    table = rounds.flagship_round(_train_rows(spark, sf_dir), _test_rows(spark, sf_dir), ROUND)
    return table.withColumn("dist", rounded(F.col("dist"), 6)).withColumn("accuracy", rounded(F.col("accuracy"), 6))


@query
def training_round_constant(spark, sf_dir):
    settings = replace(ROUND, attack=C.CONSTANT_VALUE, ratio=0.2)
    table = rounds.flagship_round(_train_rows(spark, sf_dir), _test_rows(spark, sf_dir), settings)
    return table.withColumn("dist", rounded(F.col("dist"), 6)).withColumn("accuracy", rounded(F.col("accuracy"), 6))


@query
def federated_fit(spark, sf_dir):
    settings = rounds.Settings(lr=0.05, sealed=True)
    return runs.federated_fit(_train_rows(spark, sf_dir), _test_rows(spark, sf_dir), settings)


@query
def experiment_grid(spark, sf_dir):
    settings = rounds.Settings(lr=0.05)
    return runs.experiment_grid(_train_rows(spark, sf_dir), _test_rows(spark, sf_dir), settings)


@query
def round_report(spark, sf_dir):
    """Rounds of all runs: accuracy, best so far, first client's score, label of every client."""
    best = reports.best_so_far(t.run_accuracy(spark, sf_dir), ["run_id"])
    history = credibility.status(_run_history(spark, sf_dir))
    return reports.round_table(history, best, ["run_id"]).select(
        "run_id", "round", "accuracy", "best", "is_new_best", "score_c0", "client_id", "score", "status"
    )

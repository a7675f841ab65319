"""One federated round, cell by cell; ``plans/runs.py`` chains rounds of many runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold import constants as C
from trustfold.functions.storage import durable
from trustfold.operators.aggregation import (
    match_updates, next_global, pair_distance, robust_aggregate,
)
from trustfold.operators.corruption import corrupt
from trustfold.operators.credibility import status, update_credibility
from trustfold.operators.dealing import client_subset, deal
from trustfold.operators.exchange import attest, deliver, open_, seal, verify
from trustfold.operators.pairing import pair, retain
from trustfold.operators.training import (
    accuracy, argmax_class, predict, train_auth, train_fullbatch, train_minibatch, training_steps, zero_model,
)
from trustfold.plans.threshold import estimate_threshold, half_sample_distances, reshuffled_distances


@dataclass(frozen=True)
class Settings:
    """What a run depends on."""

    classes: int = 10
    features: int = 64
    clients: int = C.CLIENTS
    shards_per_client: int = C.SHARDS_PER_CLIENT
    deal_seed: int = C.DEAL_SEED
    subset_rows: int = C.SUBSET_ROWS
    rounds: int = C.ROUNDS
    trainer: str = "minibatch"
    lr: float = C.LEARNING_RATE
    epochs: int = C.EPOCHS
    batch: int = C.BATCH_ROWS
    steps: int = 1
    attack: int = C.REPLACEMENT_NOISE
    ratio: float = 0.6
    orientation: str = "reversed"
    d_th: float | None = None
    sealed: bool = False
    seed: int = 0


@dataclass(frozen=True)
class State:
    """What one round hands to the next: three tables."""

    model: DataFrame
    credibility: DataFrame
    history: DataFrame


def initial_state(spark: SparkSession, settings: Settings, model: DataFrame | None = None) -> State:
    scores = spark.range(settings.clients).select(
        F.col("id").alias("client_id"), F.lit(C.INITIAL_SCORE).alias("score")
    )
    history = spark.createDataFrame([], "seq bigint, verifier bigint, prover bigint")
    return State(model or zero_model(spark, settings.classes, settings.features), scores, history)


def prepare_clients(train: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(dealt rows, subsets), both written once and reused in every round."""
    dealt = durable(deal(train, settings.clients, settings.shards_per_client, settings.deal_seed), "dealt")
    subsets = durable(client_subset(dealt, settings.subset_rows, settings.seed), "subsets")
    return dealt, subsets


def estimate(dealt: DataFrame, model: DataFrame, settings: Settings) -> float:
    """The distance threshold, one number."""
    if settings.trainer == "fullbatch":
        distances = half_sample_distances(dealt, model, settings.classes, settings.lr, settings.steps)
    else:
        distances = reshuffled_distances(
            dealt, model, settings.classes, settings.lr, epochs=settings.epochs, batch=settings.batch
        )
    return estimate_threshold(distances).first()["d_th"]


def _train(dealt: DataFrame, model: DataFrame, settings: Settings, round_no: int) -> DataFrame:
    if settings.trainer == "fullbatch":
        return train_fullbatch(dealt, model, settings.classes, settings.lr, settings.steps)
    return train_minibatch(
        dealt, model, settings.classes, settings.epochs, settings.batch, settings.lr,
        seed=settings.seed, round_no=round_no,
    )


def _authenticate(dealt: DataFrame, delivered: DataFrame, model: DataFrame, settings: Settings) -> DataFrame:
    if settings.trainer == "fullbatch":
        return train_fullbatch(
            delivered, model, settings.classes, settings.lr, settings.steps, key="verifier", order="pos"
        )
    own = training_steps(dealt, settings.epochs, settings.batch)
    return train_auth(delivered, model, own, settings.classes, lr=settings.lr)


def client_keys(credibility: DataFrame, seed: int) -> DataFrame:
    """Stand-in for the user's key table: one derived 32-byte secret per client."""
    secret = F.unhex(F.sha2(F.concat_ws("|", F.lit(f"secret-{seed}"), F.col("client_id")), 256))
    return credibility.select("client_id", secret.alias("secret"))


def run_round(
    dealt: DataFrame, subsets: DataFrame, state: State, d_th: float, settings: Settings, round_no: int = 1,
    keys: DataFrame | None = None, in_transit: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[State, DataFrame]:
    """One round: pair, deliver, train, corrupt, sign, retrain, compare, score, average.

    Returns the next state and the round's table (client_id, verifier, dist,
    secure, score_before, score). Clients sign what they send; attestations
    and updates are written apart, and verification, distance and average read
    the updates that arrived. ``in_transit`` stands for what happens to them
    on the way.
    """
    keys = client_keys(state.credibility, settings.seed) if keys is None else keys
    clients = settings.clients
    pairing = durable(pair(state.credibility, state.history, settings.orientation, clients), "pairing")
    delivered = deliver(subsets, pairing, clients)
    if settings.sealed:
        delivered = open_(durable(seal(delivered, keys, round_no, clients=clients), "packages"), keys, clients)

    trained = _train(dealt, state.model, settings, round_no)
    updates = durable(
        corrupt(trained, settings.attack, settings.clients, settings.ratio, settings.seed, round_no), "updates"
    )
    attestations = durable(attest(updates, keys, clients=clients), "attestations")
    if in_transit is not None:
        updates = durable(in_transit(updates), "arrived")
    auth = _authenticate(dealt, delivered, state.model, settings)
    # a client without rows has no update: its score and its prover's are held, and the round goes on
    distances = pair_distance(match_updates(updates, auth, pairing, clients), missing="hold")
    links = verify(updates, attestations, keys, clients=clients)

    rehab = round_no > 1 and (round_no - 1) % C.REHAB_EVERY == 0
    scored = (
        distances.select(F.col("prover").alias("client_id"), "verifier", "dist")
        .join(links, "client_id")
        .join(state.credibility, "client_id", "right")
        .withColumn("secure", F.coalesce("secure", F.lit(False)))
        .withColumn("rehab", F.lit(rehab))
    )
    table = durable(
        update_credibility(scored, d_th, missing="hold").select(
            "client_id", "verifier", "dist", "secure",
            F.col("score").alias("score_before"), F.col("new_score").alias("score"),
        ),
        "scores",
    )
    credibility = table.select("client_id", "score")
    averaged = next_global(robust_aggregate(updates, credibility, clients=clients), state.model)
    following = State(averaged.drop("kept"), credibility, retain(state.history, pairing))
    return following, table


def evaluate(test: DataFrame, model: DataFrame, classes: int) -> DataFrame:
    """One row (accuracy)."""
    return accuracy(predict(test, model, classes).withColumn("predicted", argmax_class()))


def flagship_round(train: DataFrame, test: DataFrame, settings: Settings, keys: DataFrame | None = None) -> DataFrame:
    """First round from the zero model as one table: per client its distance, score and status,
    beside the threshold and the accuracy of the new global model."""
    spark = train.sparkSession
    state = initial_state(spark, settings)
    dealt, subsets = prepare_clients(train, settings)
    d_th = settings.d_th if settings.d_th is not None else estimate(dealt, state.model, settings)
    following, table = run_round(dealt, subsets, state, d_th, settings, keys=keys)
    reached = evaluate(test, following.model, settings.classes).scalar()
    return status(table).select(
        "client_id", "verifier", "dist", "secure", "score_before", "score", "status",
        (F.col("score") > C.EXCLUSION_LIMIT).alias("is_trusted"),
        F.lit(float(d_th)).alias("d_th"), reached.alias("accuracy"),
    )

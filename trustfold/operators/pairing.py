"""Pairing of verifiers and provers by credibility rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustfold.constants import HISTORY_KEPT, REHAB_EVERY
from trustfold.functions.positions import SLICE_ROWS, range_position
from trustfold.functions.sizing import broadcast_if_small


def rank_clients(credibility: DataFrame, clients: int | None = None) -> DataFrame:
    """Add 0-based ``rank`` by score descending, then id; ``clients`` is the row count where known."""
    order = [F.col("score").desc(), F.col("client_id").asc()]
    clients = credibility.count() if clients is None else clients
    if clients <= SLICE_ROWS:
        return credibility.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    return range_position(credibility, [], order, "rank")


def used_offsets(ranks: DataFrame, history: DataFrame, clients: int, orientation: str = "reversed") -> DataFrame:
    """Rotation offsets that would repeat a pair of the history, from two equi-joins.

    ``reversed`` compares the history with the pair turned round, as observed
    in practice; ``emitted`` compares it with the pair as it is handed out.
    """
    if orientation not in ("reversed", "emitted"):
        raise ValueError(f"orientation must be 'reversed' or 'emitted', got {orientation!r}")
    of_verifier = ranks.select(F.col("client_id").alias("verifier"), F.col("rank").alias("_rv"))
    of_prover = ranks.select(F.col("client_id").alias("prover"), F.col("rank").alias("_rp"))
    past = (
        broadcast_if_small(history.select("verifier", "prover"))
        .join(of_verifier, "verifier").join(of_prover, "prover")
    )
    gap = F.col("_rv") - F.col("_rp") if orientation == "reversed" else F.col("_rp") - F.col("_rv")
    return past.select(F.pmod(gap, F.lit(clients)).cast("bigint").alias("offset")).distinct()


def free_offset(used: DataFrame, clients: int) -> DataFrame:
    """One row: the smallest offset in 1..clients-1 not in ``used``, 1 when all are used.

    The answer is 1 or the successor of a used offset, so the candidates
    grow with the history and not with the client count.
    """
    spark = used.sparkSession
    candidates = (
        spark.range(1, 2).select(F.col("id").alias("offset"))
        .unionByName(used.select((F.col("offset") + 1).alias("offset")))
        .filter(F.col("offset") <= max(1, clients - 1))
    )
    free = candidates.join(used, "offset", "left_anti")
    return free.agg(F.coalesce(F.min("offset"), F.lit(1)).cast("bigint").alias("offset"))


def pair(
    credibility: DataFrame, history: DataFrame, orientation: str = "reversed", clients: int | None = None
) -> DataFrame:
    """(rank, verifier, prover): rank i verifies rank i + offset, the smallest unused offset."""
    clients = credibility.count() if clients is None else clients
    ranks = rank_clients(credibility, clients).select("client_id", "rank")
    offset = free_offset(used_offsets(ranks, history, clients, orientation), clients).scalar()
    verifiers = ranks.select(
        "rank", F.col("client_id").alias("verifier"),
        F.pmod(F.col("rank") + offset, F.lit(clients)).cast("bigint").alias("_target"),
    )
    provers = ranks.select(F.col("rank").alias("_target"), F.col("client_id").alias("prover"))
    return verifiers.join(provers, "_target").select("rank", "verifier", "prover")


def retain(history: DataFrame, pairing: DataFrame, keep: int = HISTORY_KEPT) -> DataFrame:
    """History plus the new pairs in rank order, the last ``keep`` of them."""
    last = history.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    new = pairing.select((last + F.col("rank") + 1).cast("bigint").alias("seq"), "verifier", "prover")
    return history.unionByName(new).orderBy(F.col("seq").desc()).limit(keep)


def is_rehab(round_col: str = "round", every: int = REHAB_EVERY):
    """True in rounds every + 1, 2 * every + 1, ... (rounds count from 1)."""
    r = F.col(round_col)
    return ((r - 1) % every == 0) & (r > 1)

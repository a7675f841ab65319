"""Corrupted updates: who corrupts, and how."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.constants import ADDITIVE_NOISE, CONSTANT_VALUE, NO_CORRUPTION, REPLACEMENT_NOISE
from trustfold.functions.hashing import normal


def attacker_count(clients: int, ratio: float) -> int:
    """Truncated, not rounded: 10 clients at 0.29 give 2."""
    return math.trunc(clients * ratio)


def attackers(roster: DataFrame, clients: int, ratio: float) -> DataFrame:
    """Roster with ``is_attacker``: the first ``trunc(clients * ratio)`` ids."""
    return roster.withColumn("is_attacker", F.col("client_id") < attacker_count(clients, ratio))


def corrupt(
    updates: DataFrame, kind: int, clients: int, ratio: float, seed: int = 0, round_no: int = 1
) -> DataFrame:
    """Replace the attackers' trained values, a map-only projection.

    Kind 0 leaves all as is, 1 adds standard normal noise, 2 replaces by
    standard normal noise, 3 sets every value to 1. Apply it to the trained
    update before signing, never to the authentication update.
    """
    if kind == NO_CORRUPTION:
        return updates
    noise = normal(seed, round_no, F.col("client_id"), F.col("layer"), F.col("idx"))
    changed = {
        ADDITIVE_NOISE: F.col("value") + noise,
        REPLACEMENT_NOISE: noise,
        CONSTANT_VALUE: F.lit(1.0),
    }.get(kind)
    if changed is None:
        raise ValueError(f"unknown corruption kind {kind}")
    bad = F.col("client_id") < attacker_count(clients, ratio)
    return updates.withColumn("value", F.when(bad, changed).otherwise(F.col("value")))

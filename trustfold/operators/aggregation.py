"""Distances between models and credibility-weighted averaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.constants import DEFAULT_DISTANCE_THRESHOLD, EXCLUSION_LIMIT, WEIGHT_EPSILON
from trustfold.functions.sizing import broadcast_if_small

CELL = ["layer", "idx"]


def to_vectors(params: DataFrame, key: str = "client_id") -> DataFrame:
    """(key, pos, layer, idx, value) with ``pos`` the cell's place in (layer, idx) order.

    Offsets come from the layer sizes, so no model is sorted as a whole;
    ``idx`` runs from 0 inside a layer.
    """
    sizes = params.groupBy(key, "layer").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        params.join(broadcast_if_small(offsets), [key, "layer"])
        .select(key, (F.col("_start") + F.col("idx")).alias("pos"), "layer", "idx", "value")
    )


def to_blocks(params: DataFrame, cells_per_block: int = 4096, key: str = "client_id") -> DataFrame:
    """(key, layer, block_id, values): the compact layout for large models."""
    return (
        params.withColumn("block_id", F.expr(f"idx div {cells_per_block}L"))
        .groupBy(key, "layer", "block_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("cells"))
        .select(key, "layer", "block_id", F.transform("cells", lambda c: c["value"]).alias("values"))
    )


def match_updates(
    trained: DataFrame, auth: DataFrame, pairing: DataFrame, clients: int | None = None
) -> DataFrame:
    """(prover, verifier, layer, idx, w, w_hat): a prover's cells beside its verifier's.

    Full outer on the cell, so a missing side shows as NULL.
    """
    pairs = broadcast_if_small(pairing.select("verifier", "prover"), clients)
    w = trained.select(F.col("client_id").alias("prover"), *CELL, F.col("value").alias("w")).join(pairs, "prover")
    w_hat = auth.select("verifier", *CELL, F.col("value").alias("w_hat")).join(pairs, "verifier")
    return w.join(w_hat, ["prover", "verifier", *CELL], "full_outer")


def pair_distance(matched: DataFrame, missing: str = "error") -> DataFrame:
    """(prover, verifier, dist): Euclidean distance over all cells.

    ``missing='error'`` raises on a cell that only one side has;
    ``missing='hold'`` gives a NULL distance, which keeps the score.
    """
    if missing not in ("error", "hold"):
        raise ValueError(f"missing must be 'error' or 'hold', got {missing!r}")
    gap = F.col("w").isNull() | F.col("w_hat").isNull()
    gaps = F.sum(gap.cast("bigint"))
    whole = F.sqrt(F.sum(F.pow(F.col("w") - F.col("w_hat"), 2)))
    absent = F.lit(None).cast("double")
    if missing == "error":
        absent = F.raise_error(F.lit("a model cell is missing on one side")).cast("double")
    return matched.groupBy("prover", "verifier").agg(F.when(gaps == 0, whole).otherwise(absent).alias("dist"))


def model_distance(left: DataFrame, right: DataFrame, key: str = "client_id") -> DataFrame:
    """(key, dist) between two long model tables; a cell missing on one side raises."""
    a = left.select(key, *CELL, F.col("value").alias("w"))
    b = right.select(key, *CELL, F.col("value").alias("w_hat"))
    matched = a.join(b, [key, *CELL], "full_outer")
    matched = matched.withColumn("prover", F.col(key)).withColumn("verifier", F.col(key))
    return pair_distance(matched).select(F.col("prover").alias(key), "dist")


def block_distance(left: DataFrame, right: DataFrame, key: str = "client_id") -> DataFrame:
    """(key, dist) between two block tables: one joined row per block of cells."""
    a = left.withColumnRenamed("values", "w")
    b = right.withColumnRenamed("values", "w_hat")
    short = F.col("w").isNull() | F.col("w_hat").isNull() | (F.size("w") != F.size("w_hat"))
    squares = F.aggregate(
        F.zip_with("w", "w_hat", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, x: acc + x
    )
    checked = F.when(short, F.raise_error(F.lit("a model block is missing on one side")).cast("double"))
    joined = a.join(b, [key, "layer", "block_id"], "full_outer").select(key, checked.otherwise(squares).alias("sq"))
    return joined.groupBy(key).agg(F.sqrt(F.sum("sq")).alias("dist"))


def threshold_value(dist: str = "dist") -> Column:
    """Aggregate: the largest distance rounded up, or the default when no client reported."""
    return F.coalesce(F.ceil(F.max(dist)).cast("double"), F.lit(DEFAULT_DISTANCE_THRESHOLD))


def trusted(credibility: DataFrame, limit: float = EXCLUSION_LIMIT) -> DataFrame:
    return credibility.filter(F.col("score") > F.lit(limit))


def with_score(updates: DataFrame, credibility: DataFrame) -> DataFrame:
    return updates.join(broadcast_if_small(credibility.select("client_id", "score")), "client_id")


def robust_aggregate(
    updates: DataFrame, credibility: DataFrame, limit: float = EXCLUSION_LIMIT, clients: int | None = None
) -> DataFrame:
    """(layer, idx, value): average of the trusted clients' updates, weighted by score.

    The weight total is summed over the clients that reported an update, once,
    as a scalar subquery; the cells are summed with map-side combine.
    """
    reporting = updates.select("client_id").distinct()
    voters = trusted(credibility, limit).select("client_id", "score").join(reporting, "client_id", "left_semi")
    total = voters.agg(F.sum("score")).scalar()
    weighted = updates.join(broadcast_if_small(voters, clients), "client_id")
    return weighted.groupBy(*CELL).agg(F.sum(F.col("value") * F.col("score")).alias("_sum")).select(
        *CELL, (F.col("_sum") / (total + F.lit(WEIGHT_EPSILON))).alias("value")
    )


def next_global(aggregate: DataFrame, previous: DataFrame) -> DataFrame:
    """The aggregate, or the previous model flagged ``kept`` when nobody was trusted.

    An aggregate whose cells are not exactly those of the previous model raises.
    """
    old = previous.select(*CELL, F.col("value").alias("_old"), F.lit(True).alias("_had"))
    new = aggregate.select(*CELL, F.col("value").alias("_new"), F.lit(True).alias("_has"))
    kept = aggregate.agg(F.count(F.lit(1)) == 0).scalar()
    differs = F.raise_error(F.lit("the new model has other cells than the previous one")).cast("double")
    value = F.when(kept, F.col("_old")).when(F.col("_had") & F.col("_has"), F.col("_new")).otherwise(differs)
    return old.join(new, CELL, "full_outer").select(*CELL, value.alias("value"), F.coalesce(kept, F.lit(False)).alias("kept"))

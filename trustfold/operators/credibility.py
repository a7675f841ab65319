"""Credibility scores: one step, the fold over many rounds, audits and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.constants import (
    ATTACKER_LABEL_LIMIT, INITIAL_SCORE, INSECURE_FACTOR, PENALTY_FACTOR, REHAB_BASE, REHAB_BONUS, REHAB_CAP,
    REHAB_DISTANCE_FACTOR, REHAB_EVERY, REHAB_SCORE_LIMIT, REWARD_STEP,
)
from trustfold.functions.positions import previous_value
from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable

BLOCK_ROUNDS = 4096
PATH_RUN = 64


# --- the rule as column expressions ---

def _ordinary(score: Column, dist: Column, d_th: Column, secure: Column) -> Column:
    """Additive reward or multiplicative penalty, times the link factor, clamped to [0, 1].

    Never decreases in ``score``; a NaN distance counts as a penalty.
    """
    moved = F.when(dist <= d_th, score + F.lit(REWARD_STEP)).otherwise(score * F.lit(PENALTY_FACTOR))
    linked = moved * F.when(secure, F.lit(1.0)).otherwise(F.lit(INSECURE_FACTOR))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), linked))


def _recovered(dist: Column, d_th: Column) -> Column:
    overlap = F.greatest(F.lit(0.0), dist - d_th)
    return F.least(F.lit(REHAB_CAP), F.lit(REHAB_BASE) + F.lit(REHAB_BONUS) / (F.lit(1.0) + overlap))


def _near(dist: Column, d_th: Column) -> Column:
    return dist <= d_th * F.lit(REHAB_DISTANCE_FACTOR)


def credibility_step(score: Column, dist: Column, d_th: Column, secure: Column, rehab: Column) -> Column:
    """Next score. In a rehabilitation round a locked client (score <= 0.01) that is
    near enough gets a fixed small score instead, even after a signature failure.
    A missing distance holds the score, whatever the round."""
    locked = score <= F.lit(REHAB_SCORE_LIMIT)
    return F.when(dist.isNull(), score).when(rehab & locked & _near(dist, d_th), _recovered(dist, d_th)).otherwise(
        _ordinary(score, dist, d_th, secure)
    )


def update_credibility(scored: DataFrame, d_th: float | Column, missing: str = "error") -> DataFrame:
    """Add ``new_score`` to rows (score, dist, secure, rehab), a map-only projection.

    A NULL distance raises, or with ``missing='hold'`` keeps the score as the fold does.
    """
    if missing not in ("error", "hold"):
        raise ValueError(f"missing must be 'error' or 'hold', got {missing!r}")
    limit = F.lit(float(d_th)) if isinstance(d_th, (int, float)) else d_th
    step = credibility_step(F.col("score"), F.col("dist"), limit, F.col("secure"), F.col("rehab"))
    absent = F.col("score") if missing == "hold" else F.raise_error(F.lit("distance is missing")).cast("double")
    return scored.withColumn("new_score", F.when(F.col("dist").isNull(), absent).otherwise(step))


# --- the fold over rounds ---

def _rehab_round(round_no: Column, every: int) -> Column:
    return (round_no > 1) & ((round_no - 1) % every == 0)


def _image(low: Column, high: Column, steps: str, d_th: float, every: int) -> Column:
    """Bounds of the score after ``steps`` when it starts anywhere in [low, high].

    The ordinary step keeps order, so bounds map to bounds. A rehabilitation
    step sends locked scores to one value; an interval on both sides of the
    limit gets bounds that enclose both images. Equal bounds stay equal, so
    low = high runs the exact rule.
    """
    limit = F.lit(float(d_th))
    lock = F.lit(REHAB_SCORE_LIMIT)

    def step(acc: Column, s: Column) -> Column:
        def ordinary(score: Column) -> Column:
            return _ordinary(score, s["dist"], limit, s["secure"])

        fixed = _recovered(s["dist"], limit)
        rehab = _rehab_round(s["round"], every) & _near(s["dist"], limit)
        held = s["dist"].isNull()
        low_next = (
            F.when(held, acc["low"]).when(~rehab | (acc["low"] > lock), ordinary(acc["low"]))
            .when(acc["high"] <= lock, fixed)
            .otherwise(F.least(fixed, ordinary(lock)))
        )
        high_next = (
            F.when(held, acc["high"]).when(~rehab | (acc["low"] > lock), ordinary(acc["high"]))
            .when(acc["high"] <= lock, fixed)
            .otherwise(F.greatest(fixed, ordinary(acc["high"])))
        )
        return F.struct(low_next.alias("low"), high_next.alias("high"))

    return F.aggregate(steps, F.struct(low.alias("low"), high.alias("high")), step)


def _path(start: Column, steps: str, d_th: float, every: int) -> Column:
    """Array of (round, score) after each of ``steps``.

    Appending copies the array, so the steps are cut into short runs: one
    pass finds the score before every run, the next one writes the runs out.
    """
    limit = F.lit(float(d_th))
    count = F.size(steps)
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / PATH_RUN).cast("int")),
        lambda i: F.slice(steps, i * PATH_RUN + 1, F.lit(PATH_RUN)),
    )

    def after(score: Column, s: Column) -> Column:
        return credibility_step(score, s["dist"], limit, s["secure"], _rehab_round(s["round"], every))

    def empty(kind: str) -> Column:
        return F.expr(f"cast(array() as array<{kind}>)")

    def next_run(acc: Column, run: Column) -> Column:
        return F.struct(
            F.aggregate(run, acc["score"], after).alias("score"),
            F.array_append(acc["befores"], acc["score"]).alias("befores"),
        )

    def next_step(acc: Column, s: Column) -> Column:
        score = after(acc["score"], s)
        point = F.struct(s["round"].alias("round"), score.alias("score"))
        return F.struct(score.alias("score"), F.array_append(acc["path"], point).alias("path"))

    def written(run: Column, before: Column) -> Column:
        seed = F.struct(before.alias("score"), empty("struct<round:bigint,score:double>").alias("path"))
        return F.aggregate(run, seed, next_step, lambda acc: acc["path"])

    seed = F.struct(start.alias("score"), empty("double").alias("befores"))
    befores = F.aggregate(runs, seed, next_run, lambda acc: acc["befores"])
    return F.flatten(F.zip_with(runs, befores, written))


def _step_blocks(
    observations: DataFrame, block_rounds: int, init: float, starts: DataFrame | None, seq: str
) -> DataFrame:
    """(client_id, block, init, steps): each client's rounds in order, at most ``block_rounds`` per row."""
    blocks = (
        observations.withColumn("block", F.expr(f"cast((`{seq}` - 1) div {block_rounds}L as bigint)"))
        .groupBy("client_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("round", "dist", "secure"))).alias("steps"))
    )
    if starts is None:
        return blocks.withColumn("init", F.lit(float(init)))
    known = starts.select("client_id", F.col("score").alias("_start"))
    return (
        blocks.join(broadcast_if_small(known), "client_id", "left")
        .withColumn("init", F.coalesce("_start", F.lit(float(init)))).drop("_start")
    )


def _block_starts(blocks: DataFrame, d_th: float, every: int) -> DataFrame:
    """(client_id, block, start, end): the exact score before and after every block.

    Each block maps the whole range [0, 1] at once. Penalties contract the
    range by 100 and rewards saturate at 1, so after some rounds every start
    has led to the same double: the block's end is known without its start,
    and all blocks of a hot client run in parallel. Blocks that have not
    collapsed are run again from the bounds of the block before, until all
    ends are exact; each pass settles at least one more block per client.
    """
    in_order = Window.partitionBy("client_id").orderBy("block")
    image = _image(F.col("low"), F.col("high"), "steps", d_th, every)

    def run(selected: DataFrame) -> DataFrame:
        return selected.withColumn("image", image).select(
            "client_id", "block", "init", F.col("image.low").alias("end_low"), F.col("image.high").alias("end_high")
        )

    # only block numbers enter this window; the rounds stay in their blocks
    first = blocks.select("client_id", "block").withColumn("first", F.lag("block").over(in_order).isNull())
    ranged = (
        blocks.join(first, ["client_id", "block"])
        .withColumn("low", F.when(F.col("first"), F.col("init")).otherwise(F.lit(0.0)))
        .withColumn("high", F.when(F.col("first"), F.col("init")).otherwise(F.lit(1.0)))
    )
    ends = durable(run(ranged), "ends")
    unsettled = F.col("end_low") != F.col("end_high")
    while True:
        linked = (
            ends.withColumn("low", F.coalesce(F.lag("end_low").over(in_order), F.col("init")))
            .withColumn("high", F.coalesce(F.lag("end_high").over(in_order), F.col("init")))
        )
        narrowed = linked.filter(unsettled).select("client_id", "block", "low", "high")
        if narrowed.isEmpty():
            return linked.select("client_id", "block", F.col("low").alias("start"), F.col("end_low").alias("end"))
        again = run(blocks.join(narrowed, ["client_id", "block"]))
        ends = durable(ends.filter(~unsettled).unionByName(again), "ends")


def _in_one_block(observations: DataFrame, block_rounds: int, seq: str) -> bool:
    span = observations.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    return span["lo"] is None or (span["lo"] - 1) // block_rounds == (span["hi"] - 1) // block_rounds


def fold_credibility(
    observations: DataFrame, d_th: float, init: float = INITIAL_SCORE, rehab_every: int = REHAB_EVERY,
    block_rounds: int = BLOCK_ROUNDS, starts: DataFrame | None = None, seq: str = "round",
) -> DataFrame:
    """(client_id, rounds, score): final score after applying every round in order, bit for bit.

    ``starts`` (client_id, score) replaces ``init`` where a client has a score
    already. ``seq`` names the column that cuts blocks: it must rise with the
    round, from 1; rounds themselves do when a client's history is complete.
    """
    blocks = _step_blocks(observations, block_rounds, init, starts, seq)
    if _in_one_block(observations, block_rounds, seq):
        end = _image(F.col("init"), F.col("init"), "steps", d_th, rehab_every)["low"]
        return blocks.select("client_id", F.size("steps").cast("bigint").alias("rounds"), end.alias("score"))
    blocks = durable(blocks, "steps")
    settled = _block_starts(blocks, d_th, rehab_every)
    sizes = blocks.groupBy("client_id").agg(F.sum(F.size("steps")).cast("bigint").alias("rounds"))
    last = settled.groupBy("client_id").agg(F.max_by("end", "block").alias("score"))
    return sizes.join(last, "client_id")


def trace_credibility(
    observations: DataFrame, d_th: float, init: float = INITIAL_SCORE, rehab_every: int = REHAB_EVERY,
    block_rounds: int = BLOCK_ROUNDS,
) -> DataFrame:
    """(client_id, round, score): the score after every round."""
    blocks = _step_blocks(observations, block_rounds, init, None, "round")
    if _in_one_block(observations, block_rounds, "round"):
        started = blocks.withColumn("start", F.col("init"))
    else:
        blocks = durable(blocks, "steps")
        settled = _block_starts(blocks, d_th, rehab_every).select("client_id", "block", "start")
        started = blocks.join(broadcast_if_small(settled), ["client_id", "block"])
    path = _path(F.col("start"), "steps", d_th, rehab_every)
    return started.select("client_id", F.explode(path).alias("p")).select("client_id", "p.round", "p.score")


# --- labels and audits ---

def status(credibility: DataFrame, limit: float = ATTACKER_LABEL_LIMIT) -> DataFrame:
    label = F.when(F.col("score") <= F.lit(limit), F.lit("attacker")).otherwise(F.lit("honest"))
    return credibility.withColumn("status", label)


def audit_transitions(
    history: DataFrame, run: list[str] | None = None, init: float = INITIAL_SCORE, rehab_every: int = REHAB_EVERY
) -> DataFrame:
    """Add ``previous`` and ``transition``: which branch of the rule explains each step, or ``illegal``."""
    group = [*(run or []), "client_id"]
    linked = previous_value(history, group, "round", "score", "previous").withColumn(
        "previous", F.coalesce("previous", F.lit(float(init)))
    )
    old, new = F.col("previous"), F.col("score")
    yes, no, one, two = F.lit(True), F.lit(False), F.lit(1.0), F.lit(2.0)
    rehab = _rehab_round(F.col("round"), rehab_every) & (old <= REHAB_SCORE_LIMIT)
    transition = (
        F.when(rehab & (new > REHAB_BASE) & (new <= REHAB_BASE + REHAB_BONUS), "rehab")
        .when(new == _ordinary(old, one, one, yes), "reward")
        .when(new == _ordinary(old, two, one, yes), "penalty")
        .when(new == _ordinary(old, one, one, no), "reward_insecure")
        .when(new == _ordinary(old, two, one, no), "penalty_insecure")
        .otherwise("illegal")
    )
    return linked.withColumn("transition", transition)

"""Pairing: hand cases, brute force, and the path for many clients."""

import random

import pytest

from trustfold.operators import pairing

PAIRS = "seq bigint, verifier bigint, prover bigint"
SCORES = {0: 0.5, 1: 0.9, 2: 0.9, 3: 0.1, 4: 1.0}


def _table(spark, scores):
    return spark.createDataFrame(list(scores.items()), "client_id bigint, score double")


def _history(spark, pairs):
    return spark.createDataFrame([(i + 1, v, p) for i, (v, p) in enumerate(pairs)], PAIRS)


def _pair(spark, scores, past, orientation="reversed"):
    out = pairing.pair(_table(spark, scores), _history(spark, past), orientation).collect()
    return {r["verifier"]: r["prover"] for r in out}


@pytest.mark.parametrize("scores, past, want", [
    (SCORES, [], {4: 1, 1: 2, 2: 0, 0: 3, 3: 4}),
    (SCORES, [(1, 4)], {4: 2, 1: 0, 2: 3, 0: 4, 3: 1}),
    (SCORES, [(4, 1)], {4: 1, 1: 2, 2: 0, 0: 3, 3: 4}),
    ({0: 0.5, 1: 0.5, 2: 0.5}, [(1, 0), (2, 0)], {0: 1, 1: 2, 2: 0}),
])
def test_hand_cases(spark, scores, past, want):
    assert _pair(spark, scores, past) == want


def _brute(scores, past, orientation):
    ranked = sorted(scores, key=lambda c: (-scores[c], c))
    n = len(ranked)

    def clash(offset):
        rotation = {(ranked[i], ranked[(i + offset) % n]) for i in range(n)}
        if orientation == "reversed":
            rotation = {(p, v) for v, p in rotation}
        return bool(rotation & set(past))

    offset = next((o for o in range(1, n) if not clash(o)), 1)
    return {ranked[i]: ranked[(i + offset) % n] for i in range(n)}


@pytest.mark.parametrize("orientation", ["reversed", "emitted"])
def test_against_brute_force(spark, orientation):
    rng = random.Random(orientation)
    for _ in range(6):
        n = rng.randint(2, 9)
        scores = {c: rng.choice([0.1, 0.5, 1.0]) for c in range(n)}
        past = [tuple(rng.sample(range(n + 2), 2)) for _ in range(rng.randint(0, 12))]
        got = _pair(spark, scores, past, orientation)
        assert got == _brute(scores, past, orientation)
        assert sorted(got.values()) == sorted(scores) and all(v != p for v, p in got.items())


def test_many_clients_rank_alike(spark, monkeypatch):
    rng = random.Random(1)
    scores = {c: rng.choice([0.2, 0.5, 0.7]) for c in range(400)}
    small = {r["client_id"]: r["rank"] for r in pairing.rank_clients(_table(spark, scores)).collect()}
    monkeypatch.setattr(pairing, "SLICE_ROWS", 10)
    large = {r["client_id"]: r["rank"] for r in pairing.rank_clients(_table(spark, scores)).collect()}
    assert large == small


def test_history_keeps_the_last_pairs(spark):
    past = _history(spark, [(i, i + 1) for i in range(28)])
    pairs = pairing.pair(_table(spark, SCORES), past)
    kept = pairing.retain(past, pairs).orderBy("seq").collect()
    assert [r["seq"] for r in kept] == list(range(4, 34))
    assert [(r["verifier"], r["prover"]) for r in kept[-5:]] == [(4, 1), (1, 2), (2, 0), (0, 3), (3, 4)]


def test_rehab_rounds(spark):
    rounds = spark.range(1, 61).withColumnRenamed("id", "round")
    assert [r["round"] for r in rounds.filter(pairing.is_rehab()).orderBy("round").collect()] == [11, 21, 31, 41, 51]

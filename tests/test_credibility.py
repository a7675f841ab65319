"""The score rule: hand cases, the blocked fold, the stream's plain form, audits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trustfold.operators import credibility
from trustfold.streaming.credibility_stream import next_score

# (score, dist, d_th, secure, rehab, expected)
CASES = [
    (0.5, 6.0, 6.0, True, False, 0.6),
    (0.5, 6.0001, 6.0, True, False, 0.005),
    (0.95, 1.0, 6.0, True, False, 1.0),
    (0.5, 1.0, 6.0, False, False, 0.006),
    (0.5, 9.0, 6.0, False, False, 5e-05),
    (0.005, 1.0, 6.0, True, False, 0.10500000000000001),
    (0.005, 1.0, 6.0, True, True, 0.05),
    (0.005, 1.0, 6.0, False, True, 0.05),
    (0.01, 7.0, 6.0, True, True, 0.035),
    (0.0101, 7.0, 6.0, True, True, 0.000101),
    (0.005, 9.0, 6.0, True, True, 0.0275),
    (0.005, 9.0001, 6.0, True, True, 5e-05),
    (0.5, math.nan, 6.0, True, False, 0.005),
    (0.0, 7.0, 6.0, True, False, 0.0),
]


def test_hand_cases(spark):
    rows = [(i, *case) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, score double, dist double, d_th double, secure boolean, rehab boolean, want double")
    out = credibility.update_credibility(df, F.col("d_th")).orderBy("i").collect()
    assert [r["new_score"] for r in out] == [r["want"] for r in out]


def test_plain_form_equals_column_form():
    assert [next_score(*c[:5]) for c in CASES] == [c[5] for c in CASES]


def test_missing_distance(spark):
    df = spark.createDataFrame([(0.3, None, True, False)], "score double, dist double, secure boolean, rehab boolean")
    assert credibility.update_credibility(df, 6.0, missing="hold").first()["new_score"] == 0.3
    with pytest.raises(Exception, match="distance is missing"):
        credibility.update_credibility(df, 6.0).collect()


def _observations(client, rounds, rng, bad, insecure):
    return [
        (client, r, rng.choice([7.0, 8.9, 9.5, 20.0]) if rng.random() < bad else rng.random() * 6.0, rng.random() >= insecure)
        for r in range(1, rounds + 1)
    ]


def _replayed(rows, every=10):
    paths = {}
    for client, r, dist, secure in sorted(rows):
        score = paths[client][-1][1] if client in paths else 0.5
        paths.setdefault(client, []).append((r, next_score(score, dist, 6.0, secure, r > 1 and (r - 1) % every == 0)))
    return paths


@pytest.mark.parametrize("block", [3, 16, 100, 4096])
def test_blocked_fold_is_bit_exact_with_a_hot_client(spark, block):
    rng = random.Random(block)
    rows = _observations(0, 3000, rng, 0.3, 0.1)
    for client, (bad, insecure) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.5, 0.5), (0.9, 0.0), (0.05, 0.9)], start=1):
        rows += _observations(client, 200, rng, bad, insecure)
    df = spark.createDataFrame(rows, "client_id bigint, round bigint, dist double, secure boolean").repartition(7)
    want = _replayed(rows)
    got = {r["client_id"]: (r["rounds"], r["score"]) for r in credibility.fold_credibility(df, 6.0, block_rounds=block).collect()}
    assert got == {c: (len(p), p[-1][1]) for c, p in want.items()}
    trace = {(r["client_id"], r["round"]): r["score"] for r in credibility.trace_credibility(df, 6.0, block_rounds=block).collect()}
    assert trace == {(c, r): s for c, p in want.items() for r, s in p}


def test_fold_with_gaps_between_rounds(spark):
    rows = [(1, r, 1.0 if r % 3 else 9.9, True) for r in (1, 2, 40, 41, 90, 91, 300)]
    df = spark.createDataFrame(rows, "client_id bigint, round bigint, dist double, secure boolean")
    got = credibility.fold_credibility(df, 6.0, block_rounds=8).first()
    assert got["score"] == _replayed(rows)[1][-1][1]


def test_known_paths(spark):
    bad = [(1, r, 99.0, True) for r in range(1, 4)]
    good = [(2, r, 1.0, True) for r in range(1, 7)]
    df = spark.createDataFrame(bad + good, "client_id bigint, round bigint, dist double, secure boolean")
    path = {(r["client_id"], r["round"]): r["score"] for r in credibility.trace_credibility(df, 6.0).collect()}
    assert [path[1, r] for r in (1, 2)] == [0.005, 5e-05]
    assert [path[2, r] for r in range(1, 7)] == [0.6, 0.7, 0.7999999999999999, 0.8999999999999999, 0.9999999999999999, 1.0]


def test_audit_flags_what_no_rule_explains(spark):
    rows = [("a", 1, 0, 0.005), ("a", 2, 0, 5e-05), ("a", 3, 0, 5e-06), ("a", 4, 0, 5e-06), ("a", 1, 1, 0.6), ("a", 2, 1, 0.7),
            ("a", 1, 2, 0.006), ("a", 1, 3, 5e-05)]
    rows += [("b", r, 0, s) for r, s in ((10, 0.005), (11, 0.05), (12, 0.15000000000000002))]
    df = spark.createDataFrame(rows, "run_id string, round int, client_id bigint, score double")
    found = {(r["run_id"], r["round"], r["client_id"]): r["transition"] for r in credibility.audit_transitions(df, ["run_id"]).collect()}
    assert [found["a", r, 0] for r in (1, 2, 3, 4)] == ["penalty", "penalty", "illegal", "illegal"]
    assert [found["a", r, 1] for r in (1, 2)] == ["reward", "reward"]
    assert found["a", 1, 2] == "reward_insecure" and found["a", 1, 3] == "penalty_insecure"
    assert [found["b", r, 0] for r in (11, 12)] == ["rehab", "reward"]


def test_missing_distance_holds_in_every_form(spark):
    """Rounds 11 and 21 are rehabilitation rounds; a report that is missing there must not rehabilitate."""
    from trustfold.streaming.credibility_stream import next_score

    rows = [(0, r, None if r in (11, 21) else 50.0, True) for r in range(1, 24)]
    df = spark.createDataFrame(rows, "client_id int, round int, dist double, secure boolean")
    score, path = 0.5, []
    for _, r, dist, secure in rows:
        score = next_score(score, dist, 6.0, secure, r > 1 and (r - 1) % 10 == 0)
        path.append(score)
    assert path[10] == path[9] and path[20] == path[19] and path[10] < 1e-9
    for block in (4096, 4):
        traced = {p["round"]: p["score"] for p in credibility.trace_credibility(df, 6.0, block_rounds=block).collect()}
        assert [traced[r] for r in range(1, 24)] == path
        assert credibility.fold_credibility(df, 6.0, block_rounds=block).first()["score"] == path[-1]
    step = spark.createDataFrame([(0.001, None, True, True)], "score double, dist double, secure boolean, rehab boolean")
    assert credibility.update_credibility(step, 6.0, missing="hold").first()["new_score"] == 0.001

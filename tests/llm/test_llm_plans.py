"""What the plans hold: no Python where none is allowed, no cross joins, no text in a shuffle that needs none."""

import re

import pytest
from pyspark.sql import DataFrame

from trustfold.functions import storage
from trustfold.llm import decontamination, fingerprints, licenses, packing, pii, queries, quality, sharding, simhash

NATIVE = [name for name in queries.QUERIES if re.match(r"op(3|4|5|7)_", name)]


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of all tables that are written on the way."""
    seen = []

    def kept(df: DataFrame, *args, **named) -> DataFrame:
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.durable(df, *args, **named)

    for module in (decontamination, fingerprints, licenses, packing, pii, quality, sharding, simhash):
        if hasattr(module, "durable"):
            monkeypatch.setattr(module, "durable", kept)
    return seen


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf_dir, plans, name):
    last = queries.QUERIES[name](spark, sf_dir)
    for plan in [*plans, last._jdf.queryExecution().executedPlan().toString()]:
        assert not re.search(r"Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["op1_cost_balanced_packing", "op2_packed_matrices", "op6_attention_quality"])
def test_narrow_queries_shuffle_nothing(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_texts_move_once(spark, sf_dir):
    plan = queries.op4_one_permutation_minhash(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 or plan.count("hashpartitioning(slice") <= 2

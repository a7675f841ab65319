"""Physical plans: no nested loops, map-only projections, early limits, narrow scans."""

import re

import pytest
from pyspark.sql import functions as F

from trustfold.checks.queries import QUERIES
from trustfold.operators import dealing


@pytest.fixture()
def plan_of(spark, sf_dir, capsys):
    def plan(name):
        df = QUERIES[name](spark, sf_dir)
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out
    return plan


@pytest.mark.parametrize("name", [
    "label_shards_lineitem", "client_order", "client_subset", "sample_delivery", "matched_updates", "model_distance",
    "weighted_average", "next_global_model", "pairing_emitted", "credibility_fold_blocks", "fullbatch_lineitem",
    "attestations", "verification", "transition_audit", "run_summary", "round_report",
])
def test_no_cross_or_nested_loop_join(plan_of, name):
    plan = plan_of(name)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", [
    "train_test_split", "scale_unit", "random_crop", "random_hflip", "prepare_test", "credibility_step",
    "trust_status", "proof_flags", "predictions", "run_file_metadata",
])
def test_projections_move_no_rows(plan_of, name):
    assert "Exchange" not in plan_of(name)


def test_sampling_limits_before_it_shuffles(plan_of):
    plan = plan_of("client_subset")
    assert plan.count("WindowGroupLimit") >= 4


@pytest.mark.parametrize("rows", [1_001, 100_000])
def test_large_samples_sort_slices_of_a_client_only(spark, rows):
    dealt = spark.range(200_000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("client_id"))
    plan = dealing.client_subset(dealt, rows)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^,]+), ([^,]+),", plan)
    assert [e[1].startswith("_slice") for e in exchanges] == [True]
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # a plan lists its last step first


def test_scans_read_only_what_is_asked(plan_of):
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan_of("credibility_step")
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan_of("client_ranking")
    assert "ReadSchema: struct<o_custkey:bigint>" in plan_of("empty_clients")


def test_steps_shuffle_gradients_not_rows(plan_of):
    plan = plan_of("fullbatch_two_steps")
    assert "ArrowEvalPython" in plan and "features" not in plan

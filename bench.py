"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trustfold.checks.queries import QUERIES  # noqa: E402
from trustfold.session import local_session  # noqa: E402

HEADLINE = [
    "label_shards_lineitem", "client_order", "client_subset", "label_skew", "scale_unit", "random_crop",
    "fullbatch_lineitem", "minibatch_training", "predictions", "threshold_estimate", "matched_updates",
    "model_distance", "weighted_average", "corruption_additive", "pairing_emitted", "credibility_step",
    "credibility_fold", "credibility_trace", "transition_audit", "attestations", "sealed_round_trip",
    "round_report", "training_round",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    QUERIES["fullbatch_step"](spark, sf_dir).count()  # starts the Python workers and warms the JVM
    seconds = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        # noop keeps every row and column, unlike count(), and moves nothing to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()

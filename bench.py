"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pairwise_report",
    "prompt_collapsed",
    "holm_family_runs",
    "canonical_runs",
    "plan_pairs",
    "join_scores_to_runs",
    "pointwise_z",
    "native_score",
    "paired_bootstrap",
    "prompt_level_rate",
    "length_report",
    "compute_report",
    "spearman",
    "cross_judge_metrics",
    "judge_agreement",
    "krippendorff_alpha",
    "transitions",
    "trace_summary",
    "sequence_distribution",
    "cycle_association",
    "timestamp_plausibility",
    "tokens_cost_generation",
    "hard_prompts",
    "redact_terms",
    "validate_pointwise",
)


def main() -> int:
    from pairlens.plans.catalog import REGISTRY
    from pairlens.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    for name in ("lineitem", "part", "events", "documents"):
        spark.read.parquet(f"{folder}/{name}.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        try:
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
            times[name] = -1.0
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(v for v in times.values() if v > 0), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from costproof.plans import catalog  # noqa: E402
from costproof.runtime import local_session  # noqa: E402

HEADLINE = (
    "call_cost_per_success",
    "spend_rollup",
    "run_ledger",
    "usage_normalization",
    "arm_summary",
    "paired_counts_and_power",
    "cost_ratio_interval",
    "threshold_search",
    "cascade_tier_shares",
    "score_auroc_by_tier",
    "session_totals",
    "prompt_token_counts",
    "prompt_duplicate_instructions",
    "token_ratio_fit",
    "judged_comparison",
    "workload_fingerprint",
    "split_assignment",
    "sample_agreement",
    "threshold_settings_four_tiers",
    "certificate_looks",
    "annotation_rates",
    "prefix_findings",
    "graph_waste",
    "prompt_rules",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["arm_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline jobs: one JSON line on stdout.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
The subscriber mart is built first and timed as ``subscriber_mart``; every
other figure is one run of a job over that mart, all result rows produced.
"""

from __future__ import annotations

import json
import os
import time

from staywise.plans import catalog
from staywise.plans.mart import load_mart
from staywise.session import local_session

HEADLINES = (
    "portfolio_kpis", "revenue_by_contract", "churn_by_category", "revenue_hierarchy", "vulnerability_stats",
    "pearson_matrix", "numeric_description", "numeric_box_by_contract_churn", "category_description", "distinct_counts",
    "value_quadrants", "contract_accepted", "contract_rejected", "violation_report", "category_bad_values",
    "stratified_split", "stratified_folds", "batch_scores", "batch_summary", "risk_tiers", "intervention_counts",
    "result_records", "threshold_sweep", "roc_curve", "precision_recall_curve", "ranking_summary", "calibration_table",
    "threshold_report", "linear_attribution", "individual_explanations", "global_importance", "global_direction",
    "fixed_tree_attribution", "scenario_attribution_deltas", "probability_differences", "label_agreement",
    "contract_comparison", "what_if_scores", "best_scenario", "campaign_economics", "streamed_scores", "tier_report",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "staywise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock does
    seconds = {"subscriber_mart": timed(lambda: load_mart(spark, folder))}
    for name in HEADLINES:
        seconds[name] = timed(lambda: catalog.jobs[name](spark, folder).write.format("noop").mode("overwrite").save())
    scale = os.path.basename(folder).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

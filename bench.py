"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark.plans.census import survey  # noqa: E402
from tallyspark.plans.queries import QUERIES  # noqa: E402
from tallyspark.session import local_session  # noqa: E402

HEADLINE = [
    "scan_persons", "harmonize_codes", "household_rollup", "column_audit", "missingness", "duplicate_ids", "logical_checks",
    "category_consistency", "harmonization_coverage", "outlier_summary", "structural_breaks", "household_indices", "wealth_class",
    "weighted_gini", "yearly_gini", "summary_stats", "gender_gap_year", "cohort_profiles", "region_year_wealth", "beta_convergence",
    "spearman_rank", "robustness_specs", "progress_means", "priority_sample", "stratified_split", "classification_metrics",
    "subgroup_metrics", "household_ols", "person_returns_ols", "gender_wealth_ols", "clf_logreg", "clf_random_forest",
    "permutation_importance", "kmeans_clusters", "isolation_forest", "bn_edges", "bn_predict", "bn_scenarios",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    # One job first, so that starting the JVM and its pools is not charged to a query.
    run(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    times: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    tables = survey(spark, folder)
    timed("build_master", lambda: tables.harmonized)
    timed("build_households", lambda: tables.households)
    timed("build_enriched", lambda: tables.enriched)
    timed("build_cells", lambda: tables.cells)
    for name in HEADLINE:
        timed(name, lambda: run(QUERIES[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_QUERIES an optional comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s1_read_facts", "p24_cut_quantiles", "j6_min_volume", "j9_attach_scores", "r3_to_long", "a3_indicator_rates",
    "a7_profile_by", "a8_mean_annual", "a15_attr_stability", "a17_crosstab_pct", "a19_quantile_table", "a22_table_one",
    "a25_box_stats", "w5_midranks_by", "d1_entity_profile", "d4_relative_risk", "d5_entity_risk", "d8_quadrants",
    "m9_oe_within_entity", "e2_calibration_se", "e5_roc_curve", "e6_auc", "f1_dummies_full", "f2_design_matrix",
    "i1_binom_test_by", "i3_wilcoxon_by", "i5_permutation_cases", "i6_bootstrap_rr", "i6_bootstrap_poisson", "i8_svy_mean",
    "i5_permutation_case_values", "i6_bootstrap_totals",
    "m7_fit_random_intercept", "m3_fit_risk_rf",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("riskframe-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from riskframe.plans import catalog
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

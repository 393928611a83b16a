"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run twice, building the plan included, and its second time counts. Results go to Spark's no-op sink,
so all rows are computed and none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from peoplelens.session import build_session  # noqa: E402

HEADLINE = (
    "a1_dataset_metrics a3_column_report a5_quantiles_lineitem a6_moments a7_value_frequency a10_low_variance "
    "a12_pearson_matrix a13_target_correlation a15_duplicate_summary a16_histogram a20_hierarchy q1_noise_report "
    "q7_consistency_report q14_modified_zscore_outliers q17_data_summary q18_health_score c2_canonical_casing c9_drop_duplicates "
    "c11_impute c13_outlier_preview f3_yeo_johnson_fit f7_binning_on_the_fly f10_label_encoding f11_one_hot f14_robust_scaling "
    "e1_cramers_v e4_association_ranking e7_target_rate_by_segment e10_rate_cross_tab e22_segments_by_occupation e25_archetype "
    "n1_insight_record q22_full_audit f15_nine_steps_encoded f16_before_after_table e28_dashboard"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g",
        spark_python_sql_dataFrameDebugging_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

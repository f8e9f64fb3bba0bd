"""Headline queries on stored tables: one JSON line with the median seconds of three runs of each query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from palmares.catalog import QUERIES  # noqa: E402
from palmares.plans.roles import participation  # noqa: E402
from palmares.session import build_session  # noqa: E402

HEADLINE = """
q0_prepare q0b_prepare_early q1a_medal_groups q1b_medal_table q1c_medals_by_age q1d_country_map q1d_medal_hierarchy
q2a_top_sport_medals q2b_top_sport_pivot q2c_mean_age_medal q2d_age_sex_share q3a_body_profiles q3b_body_hierarchy
q3c_parallel_axes q4a_double_winners q4b_golds_by_age q4c_age_at_first_gold q4d_wait_share q4e_winner_hierarchy
q4e_winner_flows pf01_null_profile pf12_filter_set jn02_attach_one_key jn05_distinct_per_key jn07_lookup_default
ag07_distinct_count ag13_distinct_whole_rows ag16_hierarchy ag19_yearly_profile ag22_flows wn01_group_count wn02_lag
wn06_second_success sl04_top_k_per_group bn01_fixed_bins bn02_equal_width_bins im01_three_stage im02_group_mean_fill
en01_label_index ml02_exact_sample ml05_boosted_trees ml08_autoregression q4f_achievement_forecast
""".split()


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "palmares-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="palmares-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    participation(spark, folder)
    times = {"load_and_prepare": statistics.median(seconds(lambda: participation(spark, folder, True)) for _ in range(runs))}
    for name in HEADLINE:
        def run(query=QUERIES[name]) -> None:
            query(spark, folder).write.format("noop").mode("overwrite").save()

        times[name] = statistics.median(seconds(run) for _ in range(runs))
    times = {name: round(value, 3) for name, value in times.items()}
    print(json.dumps({
        "metric": "sum of median seconds per headline query",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

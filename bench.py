"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (once by default); the median counts. A run builds the plan, executes it and reads
every column of every result row.
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("flagship_baselines load_transactions load_demographics export_report eligible_customers tie_report cohort_funnel cohort_customers "
            "windows_at_lengths variable_windows draw_customers prepare_splits activity_table psi_numeric ecdf_points score_baselines markov_fit "
            "full_features classification_metrics probability_metrics class_calibration cost_threshold subgroup_metrics poisson_bootstrap "
            "paired_comparison significance_table build_samples_full trace_numbers").split()


def main():
    from tillflow.plans.catalog import QUERIES
    from tillflow.sources.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tillflow-bench")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

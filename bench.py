"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is written
to a no-op sink, so all rows and columns are computed. A first run of each query
warms up the JVM; the second one is reported.
"""
import json
import os
import time

from barloom.session import build_session

HEADLINE = ("bars", "feature_frame", "ranked_screen", "topk_per_bucket", "diversified_topn", "horizon_offset_join", "asof_latest",
            "calibration_ece", "economic_performance", "cross_section_rank", "clean_bars", "validate_bars", "paired_permutation",
            "portfolio_plan", "intraday_features", "final_action", "model_report")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true", "spark.log.level": "ERROR"})
    from barloom.plans.catalog import QUERIES
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

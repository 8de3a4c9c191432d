"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from wavefold import plans

ROOT = os.path.dirname(os.path.abspath(__file__))

HEADLINE = (
    "flagship_windows", "m01_resample_spectral", "p06_drop_reasons", "w03_baseline", "w09_frame_rms", "w12_segment_plans", "w16_focus", "m03_zscore", "m05_mfcc", "m06_stratified_split",
    "m09_augment_windows", "m12_weighted_resample", "m16_score", "a13_confusion", "a15_latency", "j01_header_detail", "p07_strict_windows", "p10_validate_packets", "s02_parse_packets", "s09_manifest", "t02_reassemble",
)


def main() -> None:
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)  # for Python workers
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["a02_value_counts"](spark, sf).collect()  # starts the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()

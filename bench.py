"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "p9_exposure_report", "p9_frame_verdict", "p8_pattern", "a1_gray_stats", "a2_exposure", "a4_robust_std", "a5_edge_activity",
    "a6_radial_profile", "a12_topk_gradient", "w1_gaussian5", "w2_sobel", "a8_otsu", "a10_largest_blob", "p11_check_only",
    "a18_roundness", "j11_polygon_spans", "w4_longest_zero_run", "w7_crossings", "w9_early_stop", "w10_focus_decision",
    "a15_repeat_median", "t5_z_sweep", "p17_plan_absolute", "p18_snap", "j1_messages", "j5_range_select", "w11_queue",
    "a21_run_summary", "a22_tablet_images", "run_outcomes", "p24_classify_failure", "s10_log_records", "s11_parse_positions",
    "a13_laplacian_score", "a20_inscribed_square", "presence_check", "autofocus_scans", "r1_lamp_auto_off", "j8_asof_contour", "w12_dedupe_errors", "w15_last_good", "w16_lamp_intervals", "w17_reconnect_cycles", "w18_throttle_errors")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.TemporaryDirectory(prefix="granulite-bench-")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("granulite-bench").config("spark.checkpoint.dir", shared.name)
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from granulite.queries import QUERIES

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run("p9_exposure_report")  # warm the JVM and the Python workers once
    run("w2_sobel")
    times = {n: round(run(n), 3) for n in HEADLINE}
    spark.stop()
    shared.cleanup()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(os.path.normpath(sf)).removeprefix("sf")}))


if __name__ == "__main__":
    main()

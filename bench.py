"""Times headline queries; prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
Each query writes to the no-op sink, so all of its rows are made, three times
warm; its median counts. The daily panel and the bars are derived and stored
once, as in a session of work: `derive_sec` is what that and the start of the
JVM took. `feature_build` is the pair of queries that compares with the
published budget of 5 s for over 30,000 rows; it is also timed on sf0.01 beside
the folder, the size that comes nearest (53,307 rows). So is `dataset_build`, the
widest counterpart: data set, snapshot block and trailing features together.
`total_with_derivation_sec` holds the headline queries and what they stand on.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402

from tapewright.plans import fixtures, registry  # noqa: E402

HEADLINE = ("daily_pick_returns", "p1_prepare_panel", "p9_back_adjust", "c4_asof_strict", "f1_cross_section", "f2_history", "f6_trailing", "b7_path_features", "b15_tick_bar_relation", "l7_forward_exit", "u12_portfolio", "e7_nav", "g5_round_trips")
FEATURES = ("f1_cross_section", "f2_history")
DATASET = ("m7_dataset_build", "f12_snapshot_block", "f6_trailing")
RUNS = 3


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"file://{scratch}/warehouse")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", f"file://{scratch}/shared"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str, sf_dir: str) -> float:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - began

    def median(name: str, sf_dir: str) -> float:
        run(name, sf_dir)
        return round(statistics.median(run(name, sf_dir) for _ in range(RUNS)), 3)

    began = time.time()
    fixtures.price_history(spark, folder)
    fixtures.bars_1m(spark, folder)
    derived = round(time.time() - began, 3)
    took = {name: median(name, folder) for name in HEADLINE}
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "derive_sec": derived, "total_with_derivation_sec": round(sum(took.values()) + derived, 3), "feature_build_sec": round(sum(took[n] for n in FEATURES), 3), "sf": os.path.basename(folder)}
    near = os.path.join(os.path.dirname(folder), "sf0.01")
    if near != folder and os.path.isdir(near):
        out["feature_build_sf0.01_sec"] = round(sum(median(n, near) for n in FEATURES), 3)
        out["dataset_build_sf0.01_sec"] = round(sum(median(n, near) for n in DATASET), 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

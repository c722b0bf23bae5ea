"""Benchmark of the headline jobs; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each job runs to completion through the ``noop`` sink (nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="vellum-bench-")

    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("vellum-bench")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from pyspark.sql import functions as F

    from vellum.operators import index as ix
    from vellum.operators import ranking as rk
    from vellum.operators import search as se
    from vellum.operators import snippet as sn
    from vellum.plans.catalog import QUERIES
    from vellum.sources import tables as tb

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        timings[name] = round(time.perf_counter() - t0, 3)

    # Warm-up on the smallest dataset (JIT, Python workers, code paths);
    # not timed.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    ix.write_index(tb.documents(spark, warm_dir), os.path.join(scratch, "warm-index"), buckets=4)
    warm = ix.read_index(spark, os.path.join(scratch, "warm-index"))
    run(rk.ranked(warm, tb.or_queries(spark, warm_dir)))
    run(tb.documents(spark, sf_dir).select("id"))

    index_path = os.path.join(scratch, "index")
    timed("index_build", lambda: ix.write_index(tb.documents(spark, sf_dir), index_path, buckets=8))
    idx = ix.read_index(spark, index_path)
    clauses = tb.or_queries(spark, sf_dir).cache()
    clauses.count()
    timed("search_bm25", lambda: run(rk.ranked(idx, clauses)))
    timed("search_phrase", lambda: run(se.search(idx, tb.benchmark_clauses(spark, sf_dir, "phrase"))))
    sn.write_documents(tb.documents(spark, sf_dir), index_path)
    docs = sn.read_documents(spark, index_path)
    timed("search_snippets", lambda: run(sn.with_snippets(rk.ranked(idx, clauses), docs, idx, clauses)))
    for name in ["tree_text", "apply_changes", "similar_entities", "create_entities", "backlinks",
                 "scan_vault_documents"]:
        timed(name, lambda n=name: run(QUERIES[n](spark, sf_dir)))

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

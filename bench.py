"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma list, default the headline set below).
Every query runs to completion through Spark's ``noop`` sink, so the whole
plan executes and nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from simpairs.plans.queries import QUERIES  # noqa: E402
from simpairs.session import local_session  # noqa: E402

HEADLINE = [
    "sts_eval", "pearson_by_stage", "spearman_by_stage", "mean_batch_loss",
    "stratified_split", "split_chain", "negatives_pair", "batches",
    "cosent_loss", "angle_loss", "inbatch_loss", "triplet_eval",
    "best_epoch", "early_stop", "report_sorted", "tokenise_pad",
    "encode_score", "stream_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))
    # Warm-up: JVM, codegen caches, parquet footers.
    QUERIES["pearson_by_stage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    failed = {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # keep the other numbers; report the failure
            times[name] = None
            failed[name] = f"{type(exc).__name__}: {exc}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(t for t in times.values() if t is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        **({"failed": failed} if failed else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

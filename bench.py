"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Each query runs once
to warm up and is then timed writing its whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "quarter_inventory",
    "memory_inventory",
    "record_uuid5",
    "record_order",
    "delta_compute",
    "delta_of_few_changes",
    "delta_chain",
    "snapshot_rebuild",
    "record_set_diff",
    "validate_records",
    "validate_manifests",
    "validate_lines",
    "json_round_trip",
    "md_sections",
    "section_tags",
    "note_records",
    "table_records",
    "redact_documents",
    "files_openclaw",
    "embedding_decode",
    "sync_plan",
    "restore_plan",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from memloom.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("memloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "memloom headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veilspan.plans import catalogue
from veilspan.session import build_session

HEADLINE = (
    "flagship", "detect_union_all", "merge_union_default", "merge_union_fold", "merge_intersection", "allow_list_verdict", "anonymize_policy",
    "mapping_table", "restore_exact", "inspect_report", "known_value_propagation", "leak_audit", "page_secrets", "leaf_walk", "token_windows", "stream_restore",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # The tables are files of one row group each; see catalogue.table.
    spark.conf.set(catalogue.DEAL, spark.sparkContext.defaultParallelism)
    catalogue.QUERIES["detect_email"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

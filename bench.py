"""Time the registered queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from corpusflow.catalog import QUERIES
from corpusflow.session import local_session

HEADLINE = (
    "token_estimate", "detect_language", "sentence_units", "packed_chunks", "chunk_rows", "page_articles",
    "line_articles", "carry_forward", "snapshot_diff", "manifest_latest", "hash_embedding", "knn_exact", "knn_ivf",
    "prompts", "citations", "intent_routes", "parsed_outputs", "distinct_findings", "document_reports",
    "conflict_candidates", "sessions", "session_activity")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sorted(QUERIES) if sys.argv[1:] == ["--all"] else sys.argv[1:] or HEADLINE
    spark = local_session(cpus, cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        # The noop sink computes every column of every row and moves nothing to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

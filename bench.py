"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run twice over a noop sink and the faster run counts, so that compiling code isn't measured.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import fields

from tagloom.operators.components import materialised
from tagloom.plans import fixtures, registry
from tagloom.session import session

HEADLINE = ("q_search_relevance_page", "q_search_thresholds", "q_search_nested", "q_relevance", "q_stats", "q_stats_thresholds", "q_documents_top16", "q_untagged", "q_dup_edges", "q_dup_clusters", "q_tags_capped", "q_tags_series", "q_upsert_files", "q_write_batch_links", "q_scan_changes")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus), app="bench", memory=os.environ.get("BENCH_MEMORY", "8g"))
    # The catalog is derived from the star schema once and written: the operators are timed, not that derivation.
    made = fixtures.catalog(spark, sf_dir)
    stored = fixtures.Relations(*(materialised(getattr(made, f.name), f.name) for f in fields(made)))
    registry.catalog = lambda *_: stored
    queries = registry.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

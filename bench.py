"""Wall-clock of the headline queries; prints one JSON line.

``build_index`` makes canonical tables, chunks, postings and vectors; the search queries after it run on
those tables, as a service would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.plans import registry, search_queries  # noqa: E402
from threadloom.session import build_session  # noqa: E402

HEADLINE = [
    "linear_nodes",
    "active_branch",
    "hard_split",
    "chunks",
    "postings",
    "build_index",
    "bm25_topk",
    "cosine_topk",
    "recent_scores",
    "hybrid_search",
    "context_window",
    "memory_stats",
    "index_state_latest",
    "tag_updates",
    "duplicate_exports",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        if name == "build_index":
            search_queries.built(spark, sf_dir).corpus
        else:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

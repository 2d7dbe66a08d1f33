"""Times the headline queries and prints one JSON line.

One untimed run of the first query starts the Python workers and loads the classes all queries share. `service` has the seconds of
the service's calls over the pages table (a first ingestion, a second one of the same pages, a question, the question again from the
cache), and `spin_ms` the milliseconds of a fixed loop, by which runs on machines of different speed can be compared; neither is
part of the total.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleanery.config import Settings  # noqa: E402
from gleanery.plans.catalogue import EMBEDDER, QUERIES, QUESTION  # noqa: E402
from gleanery.plans.stored_queries import QUERIES as STORED  # noqa: E402
from gleanery.service import Gleanery  # noqa: E402
from gleanery.session import build_session, ensure_checkpoint_dir  # noqa: E402
from gleanery.sources.tables import web_pages  # noqa: E402

HEADLINE = (
    "hybrid_topk", "bm25_topk", "bm25_index_topk", "bm25_term_stats", "knn_cosine", "knn_batch", "cache_semantic_best",
    "tree_topk", "section_paths", "tree_node_chunks", "chunk_recursive", "chunk_hard_split", "page_chunks", "html_links",
    "content_fingerprint_of_documents", "change_detection_status", "cache_evict",
)
#: Builds and reads of stored indexes, timed beside the others.
INDEXED = ("bm25_blocks_topk", "knn_contains_indexed", "ann_batch")


def spin_ms() -> float:
    """Milliseconds of a fixed loop: the least of some."""
    times = []
    for _ in range(20):
        started = time.perf_counter()
        sum(range(1_000_000))
        times.append(time.perf_counter() - started)
    return round(min(times) * 1000, 2)


def service_seconds(spark, folder: str) -> dict[str, float]:
    """The service's calls over the pages table."""
    app = Gleanery(spark, Settings.load(root=f"{ensure_checkpoint_dir(spark)}/bench-service"), EMBEDDER)
    pages = web_pages(spark, folder)
    calls = {
        "ingest_first": lambda: app.ingest(pages),
        "ingest_again": lambda: app.ingest(pages),
        "query_miss": lambda: app.query(QUESTION),
        "query_exact_hit": lambda: app.query(QUESTION),
    }
    seconds = {}
    for name, call in calls.items():
        started = time.perf_counter()
        call()
        seconds[name] = round(time.perf_counter() - started, 3)
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            # The tables are files of one row group.
            "spark.gleanery.inputPartitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    every = QUERIES | STORED

    def run(name: str) -> None:
        # Every row and column is computed and thrown away.
        every[name](spark, folder).write.format("noop").mode("overwrite").save()

    run(HEADLINE[0])
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - started, 3)
    indexed: dict[str, float] = {}
    for name in INDEXED:
        started = time.perf_counter()
        run(name)
        indexed[name] = round(time.perf_counter() - started, 3)
    service = service_seconds(spark, folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "indexed": indexed,
                "service": service,
                "spin_ms": spin_ms(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog
from postlens.session import build_session

HEADLINE = (
    "posting_page_orders",
    "posting_page",
    "posting_list_columns",
    "dashboard_postings",
    "company_rollup",
    "source_overview",
    "fulltext_documents",
    "normalized_text",
    "page_text",
    "canonical_urls",
    "posting_labels",
    "posting_scores",
    "normalized_postings",
    "content_hashes",
    "board_a_postings",
    "jsonld_postings",
    "page_cards",
    "newest_versions",
    "source_fingerprints",
    "presence_history",
    "upserted_postings",
    "aged_postings",
    "advanced_sources",
    "source_completions",
    "retention_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the session, the Python workers and the code caches.
    catalog.QUERIES["canonical_urls"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

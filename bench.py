"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
Each query is run once to warm up and then timed in full, to a sink that reads every column.
"""

from __future__ import annotations

import json
import os
import time

from postmill.plans.catalog import load
from postmill.session import build_session

HEADLINE = (
    "reconcile", "score_pairs", "run_cycle",
    "pipeline_health", "accuracy_by_category", "daily_trend", "graduation_candidates", "weekly_report",
    "prefilter", "triage", "rules_as_data", "label_batches", "eligible", "preflight", "cleanup",
    "contact_index", "prior_commitment", "route_orders", "fill_templates", "lint_drafts", "cue_features",
    "mime_body", "flush_staging", "parse_kb", "kb_build", "new_entries", "chunks",
    "cosine_topk", "bm25", "hybrid_topk", "graph_rescue", "similarity_clusters",
    "stream_reconcile", "stream_trend", "stream_inbox",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    def run(name: str) -> float:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(run(name), 3)
    # Result rows a second of the two steps whose cost is in the texts: replies compared, messages classified.
    rates = {
        unit: round(queries[name](spark, sf_dir).count() / times[name])
        for unit, name in (("pairs_per_sec", "score_pairs"), ("messages_per_sec", "triage"))
    }
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, **rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from keepsake.catalog import ENTRIES
from keepsake.session import local_session

HEADLINE = [
    "bm25_index_stats", "bm25_topk", "knn_topk", "hybrid_recall", "budget_pack", "similar_pairs", "consolidation_report",
    "merge_clusters", "lifecycle_stats", "feedback_apply", "rule_facts_distinct", "admission_factors", "redact", "turn_windows",
    "cooccur_edges", "k_hop", "tool_transitions", "session_digest", "rolling_context", "persona_entries", "windowed_f1", "jaccard_pairs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        ENTRIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

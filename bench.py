"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from docloom.plans import load_catalogue
from docloom.session import get_spark

HEADLINE = (
    "stored_index_terms", "bm25_topk", "fts_bm25_topk", "l2_topk", "cosine_topk", "rrf_fuse", "weighted_rrf", "alpha_fuse_minmax", "scoped_rank_per_group",
    "parent_expand", "collapse_cards", "collapse_in_budget", "structured_and", "structured_or_groups", "structured_tristate",
    "multiset_diff", "unique_pairing", "numeric_multiset_f1", "levenshtein_cer", "heading_tree", "structural_chunks", "child_chunks",
    "recall_mrr_ndcg", "latency_percentiles", "latest_artifact", "turn_outcomes",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", cores=int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)))
    queries = load_catalogue().QUERIES
    spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").count().collect()  # the session is up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

Three queries run first, untimed, so that the JVM and the Python workers are warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from passagekit.catalog.queries import QUERIES  # noqa: E402
from passagekit.session import build_session  # noqa: E402

HEADLINE = [
    "knn_topk", "hash_knn", "hash_embed_weights", "bm25_terms", "bm25_topk", "bm25_fill", "hybrid_splice", "rerank_by_source",
    "sections_article", "chunk_documents", "chunk_serving", "page_texts", "resolve_uris", "index_build", "index_written",
    "index_stream", "document_index", "token_counts", "prompt_rows", "normalize_text", "tag_classifier", "conversation_cost",
    "hybrid_contexts", "answer_questions", "answer_stream", "judged_scores", "bm25_saved_index", "bm25_scores", "token_budget",
    "conversation_routes",
]
WARM_UP = ["knn_topk", "index_build", "hybrid_contexts"]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        seconds(spark, name, folder)
    times = {name: seconds(spark, name, folder) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

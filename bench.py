"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from loomspan.plans import all_queries
from loomspan.session import local_session

HEADLINE = ("C4_chunk_rows", "A17_keyword_stats", "T2_bm25_topk", "T1_vector_topk", "T1_vector_topk_kernel", "T4_hybrid_search", "A6_reconcile", "J5_manifest_delta", "J8_traces", "W6_ema")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus=cpus, partitions=cpus)
    queries, took = all_queries(), {}
    queries["A1_corpus_stats"](spark, sf_dir).collect()  # start-up
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()

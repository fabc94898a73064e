"""Bench: run the headline catalogue queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default HEADLINE), BENCH_WARMUP_DIR (default
/root/testdata/sf0.001; empty to skip).  Each query is executed in full with the
``noop`` sink (no driver collect); the value is the sum of query times.  One
untimed pass over the same queries on the tiny warm-up tables comes first, so JVM
start-up and code generation are not charged to the first timed query.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_top1",
    "bm25_top15",
    "bm25_choice_vote",
    "passage_containment",
    "sentence_hits",
    "retrieval_accuracy",
    "articles_all",
    "strip_tags_plain",
    "normalize_whitespace",
    "paragraphs_merged",
    "page_links_union",
    "element_counts",
    "insert_if_absent_text",
    "frontier_reach",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from statuta.session import build_session
    from statuta.plans.catalog import REGISTRY

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
             if n in REGISTRY]
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir:
        for name in names:
            try:
                REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001 - reported by the timed pass
                pass
            spark.catalog.clearCache()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus),
           "warmup": f"one untimed pass at {os.path.basename(warm_dir)}" if warm_dir else "none"}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()

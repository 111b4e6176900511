"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and print one JSON line.

Each query is forced with the ``noop`` sink (full computation, nothing
collected to the driver).  Times include the jobs a query runs while it is
built (written tables, size checks).  ``corpus_build`` chunks and indexes the
two document corpora of the cascade and all documents together, once (what a
deployment does before it serves questions); the answering queries after it
run against those stored indexes.  ``fit_index`` separately times a full index
build of all documents from the raw texts.  The total includes everything.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from sparqa.plans import corpus as K  # noqa: E402
from sparqa.plans.registry import QUERIES  # noqa: E402
from sparqa.session import build_session  # noqa: E402

HEADLINE = [
    "chunk_text",          # C1 over every document
    "fit_index",           # D1-D7: TF-IDF postings of all documents
    "retrieve_chunks",     # E7: benchmark questions, top-3
    "route_answers",       # F6: the full cascade over both corpora
    "answer_questions",    # F7: cascade + answer formatting
    "evaluate_questions",  # G1 over F7
    "events_summary",      # G11 over the events result table
    "latency_stats",       # G8 (exact median) over the events result table
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app_name="sparqa-bench")
    # warm-up: JVM, codegen caches, file listing
    QUERIES["normalize_question"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    t0 = time.time()
    for kind in ("main", "uploaded", "all"):
        K.cached_corpus(spark, sf_dir, kind)
    times["corpus_build"] = round(time.time() - t0, 3)
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    n_questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    spark.stop()
    per_q = {f"{k}_ms_per_question": round(times[k] * 1000 / n_questions, 2)
             for k in ("retrieve_chunks", "route_answers", "answer_questions") if k in times}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "questions": n_questions,
        "derived": per_q,
    }))


if __name__ == "__main__":
    main()

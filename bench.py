"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

One warm-up pass, then each query timed (median of $BENCH_REPS runs) with a
full materialisation (``count`` over the result's rows via a noop write).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dhvani.plans.registry import QUERIES  # noqa: E402
from dhvani.session import get_spark  # noqa: E402

HEADLINE = [
    "split_summary",        # filter -> bin -> stratified split -> summary
    "normalize_by_lang",    # per-row text rules over documents
    "wer", "cer",           # corpus error rates
    "char_accuracy", "char_macro_prf",
    "bleu", "chrf",
    "trim_silence",         # silence split over embeddings
    "parallel_split",       # align -> clean -> seeded slices
    "transcript_last_wins",
    "combine_dedupe",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q in QUERIES]
    spark = get_spark(f"local[{cpus}]", "dhvani-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})

    def run(q):
        df = QUERIES[q](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()

    times = {}
    for q in names:
        run(q)  # warm-up
        ts = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(q)
            ts.append(time.perf_counter() - t0)
        times[q] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

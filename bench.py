"""Benchmark: run the registered queries at one scale factor and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query is executed in full with the ``noop`` sink (nothing is collected to
the driver).  ``value`` is the sum over the headline queries.  The brute-force
Hamming join (the reference's full scan, as a Spark theta join) is timed
separately under ``baseline`` so the banded join can be compared with it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hashsieve import plans  # noqa: E402
from hashsieve.operators.similarity import similarity_join  # noqa: E402
from hashsieve.plans import standins as SI  # noqa: E402
from hashsieve.session import local_session  # noqa: E402
from tests.brute import brute_force_join  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    qs = plans.queries()
    names = sys.argv[1:] or sorted(qs)
    # warm-up (JVM JIT, codegen caches): the flagship pipeline on the smallest
    # tables, which share nothing with the timed runs but the code paths
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        run(qs["ded6_batch_dedup"](spark, warm))
    run(SI.table(spark, sf_dir, "documents").select("doc_id"))
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)
    baseline = {}
    if not sys.argv[1:]:
        fps = SI.doc_fingerprints(spark, sf_dir).filter(F.col("fp").isNotNull()).cache()
        fps.count()
        # 8 near copies of every fingerprint (one deterministic bit flipped each):
        # the brute-force join grows with the square of the rows, the banded one does not
        fan = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
        wide = (fps.select("doc_id", "fp", fan)
                .select((F.col("doc_id") * 8 + F.col("k")).alias("doc_id"),
                        F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"),
                                                                ((F.col("doc_id") * 7 + F.col("k") * 13) % 64).cast("int")))
                        .alias("fp"))
                .cache())
        wide.count()
        for data, tag in ((fps, ""), (wide, "_x8")):
            for label, fn in (("ded2_banded_pairs", similarity_join), ("ded2_bruteforce_pairs", brute_force_join)):
                t0 = time.perf_counter()
                run(fn(data, data, 5, left_id="doc_id", right_id="doc_id", order="lt"))
                baseline[label + tag] = round(time.perf_counter() - t0, 3)
        fps.unpersist()
        wide.unpersist()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "baseline": baseline, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

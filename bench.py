"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Results are computed in full and dropped by the ``noop`` writer, so no rows travel to the driver. Every query runs
twice: ``queries`` are the first runs (plans, generated code and Python workers are new), ``warm`` the second ones.
What a query writes for itself is deleted after it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stackwise.plans import catalog as C  # noqa: E402
from stackwise.session import local_session, scratch_run  # noqa: E402

HEADLINE = [
    "prepare_table",         # cleaning + one-hot + impute + min-max over all of lineitem (2 passes)
    "prepare_text_table",    # orders as a quoted text table, read once: statistics observed while typed rows are written
    "nn_forward",            # network scoring as a JVM projection over lineitem
    "nn_gradient",           # back-propagation step (Arrow/numpy) over lineitem
    "nn_gradient_sparse",    # the same on sparse samples of 120 slots over orders, noise and sparsity in one pass
    "outer_product_mean",    # gradient kernel over lineitem
    "mini_batches",          # seeded batch assignment over events
    "nn_fit_unkeyed",        # network fit on lineitem, which has no key
    "gaussian_rbm_fit",      # Gaussian RBM, 2 steps, embeddings
    "nn_fit_dropout",        # network fit with dropout, 2 steps, embeddings
    "nn_predict_wide",       # wide network (Arrow form) over embeddings
    "prepare_wide_table",    # 41-column preparation over all of orders
    "events_dbn_end_to_end",  # pretrain -> unfold -> fine-tune -> score over all of events
    "dbn_end_to_end",        # flagship over all of orders: prepare -> pretrain -> unfold -> fine-tune -> score
]


def timed(spark, name: str, sf_dir: str) -> float:
    t0 = time.time()
    with scratch_run(spark):
        C.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="stackwise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM-side codegen and one Python worker outside the timings
    for name in ("count_samples", "outer_product_mean"):
        timed(spark, name, "/root/testdata/sf0.001")
    cold = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    warm = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(cold.values()), 3), "unit": "sec", "queries": cold, "warm": warm, "warm_total": round(sum(warm.values()), 3),
                      "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()

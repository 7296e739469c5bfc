"""Many documents make slight differences between words certain; they must not drown the telling ones."""

import random
import tracemalloc

import numpy as np

from stackwise.llm import toxicity as X


def test_slight_differences_are_no_evidence(spark):
    r = random.Random(4)
    filler = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(150)]
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 2
        words = [w for w in filler if r.random() < (0.36 if toxic else 0.24)]
        docs.append((i, " ".join(words + (["idiot", "loser"] if toxic else []))))
        labels.append((i, toxic))
    out = X.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 500 and all(r.predicted == r.doc_id % 2 for r in held)
    assert all(r.evidence == 0 for r in out if r.doc_id % 2 == 0)  # no filler word speaks


def test_weights_by_slices(monkeypatch):
    """A slice at a time gives the weights of all classes at once, the edges of slices included."""
    g = np.random.default_rng(3)
    n0, n1, second = 5000, 700, X.SLICE
    acc = np.zeros(2 * X.CLASSES + (1 << 16), dtype=np.int32)
    acc[:X.CLASSES], acc[X.CLASSES:2 * X.CLASSES] = g.integers(0, n0 + 1, X.CLASSES), g.integers(0, n1 + 1, X.CLASSES)
    acc[[0, second, X.CLASSES - 1]], acc[[X.CLASSES, X.CLASSES + second, 2 * X.CLASSES - 1]] = 0, n1
    acc[2 * X.CLASSES:2 * X.CLASSES + 2] = n0, n1
    sliced = X.class_weights(acc)
    monkeypatch.setattr(X, "SLICE", X.CLASSES)
    assert np.array_equal(sliced, X.class_weights(acc))
    assert sliced[0] == 0 and sliced[second] > 0 and sliced[-1] > 0 and sliced.dtype == np.float32 and len(sliced) == X.CLASSES
    acc[2 * X.CLASSES + 1] = 0
    assert not X.class_weights(acc).any()


def test_memory_of_the_driver(spark):
    """The driver holds the counters, the weights and small slices, not an array of every step of the formula."""
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "fine words") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        out = X.toxicity_scores(docs, labels).collect()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(r.predicted == r.doc_id % 2 for r in out)
    assert peak < 130 << 20, peak

"""The driver holds the sketch's levels, a byte a counter, and not its counters as numbers."""

from __future__ import annotations

import tracemalloc

import numpy as np

from sieveline.llm import jaccard


def test_levels_of_the_largest_sketch_stay_small(spark):
    cells, rng = jaccard.MAX_SKETCH, np.random.default_rng(5)
    count = np.zeros(cells, np.uint32)
    count[rng.integers(0, cells // 2, 300_000)] += 3
    count[rng.integers(0, cells // 2, 2000)] += rng.integers(1, 100_000, 2000).astype(np.uint32)
    parts = [(k, bytearray(jaccard._packed(count[k * jaccard.CHUNK : (k + 1) * jaccard.CHUNK]))) for k in range(cells // jaccard.CHUNK // 2)]
    scan = spark.createDataFrame([*parts, *parts[:3]], "kind int, blob binary")
    count[: 3 * jaccard.CHUNK] *= 2

    tracemalloc.start()
    try:
        got = jaccard._levels(scan, cells)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    base = max(8.0, count.mean() + 6 * count.mean() ** 0.5)
    assert (got == np.where(count > base, 1 + np.log2(np.maximum(count / base, 1)), 0).astype(np.uint8)).all()
    assert got.any()
    print("peak MB", peak / 1e6)
    assert peak < 8 * cells  # a float a counter

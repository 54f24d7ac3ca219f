"""Trust and distrust on a long chain of hosts, against the converged values."""

from __future__ import annotations

import pytest

from sieveline.llm import common, url_filter


def test_long_chain(spark):
    n = 26
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(n)], "src string, dst string, w bigint")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), (f"h{n}", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, seeds, common.Scratch(spark, "chain")).collect()}
    assert got == {f"h{k}": pytest.approx((0.85**k, 0.85 ** (n - k))) for k in range(n + 1)}

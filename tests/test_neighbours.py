"""Nearest-neighbour mutual information against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import neighbours as NB


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def brute(x, y, k):
    pairs = [(round(a * 10**12), c) for a, c in zip(x, y, strict=True) if a is not None and not math.isnan(a) and c is not None]
    size = {c: sum(d == c for _, d in pairs) for _, c in pairs}
    terms = []
    for i, (a, c) in enumerate(pairs):
        if size[c] < 2:
            continue
        own = min(k, size[c] - 1)
        r = sorted(abs(a - b) for j, (b, d) in enumerate(pairs) if d == c and j != i)[own - 1]
        m = sum(abs(a - b) < r or a == b for b, _ in pairs)
        terms.append((psi(own), psi(size[c]), psi(m)))
    if not terms:
        return 0.0
    return max(0.0, psi(len(terms)) + np.mean([t[0] - t[1] - t[2] for t in terms]))


@pytest.mark.parametrize(("parts", "k"), [(1, 3), (8, 3), (23, 1), (23, 7)])
def test_equals_brute_force(spark, parts, k):
    rng = np.random.default_rng(7)
    n = 240
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]).tolist()
    cols = {"far": [float(rng.normal()) + 3 * (c == "b") for c in y], "grid": [float(v) / 10 for v in rng.integers(0, 6, n)],
            "hot": [0.25 if i % 3 else float(v) for i, v in enumerate(rng.random(n))], "flat": [1.0] * n, "gaps": [None if i % 5 == 0 else math.nan if i % 7 == 0 else float(i % 11) for i in range(n)],
            "none": [None] * n}
    y[3], y[4], y[5] = "single", None, "two"
    y[6] = "two"
    rows = [(*(cols[c][i] for c in cols), y[i], 1) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", label string, x int").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.feature: r.mi for r in NB.knn_information(df, list(cols), "label", k).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for c in cols:
        assert got[c] == pytest.approx(brute(cols[c], y, k), abs=2e-9), c
    assert got["far"] > 0.2 and got["flat"] == got["none"] == 0


def test_edges(spark):
    schema = "v double, label string"
    assert NB.knn_information(spark.createDataFrame([], schema), ["v"], "label").first().mi == 0
    with pytest.raises(Exception, match="infinite"):
        NB.knn_information(spark.createDataFrame([(math.inf, "a")], schema), ["v"], "label").collect()
    out = spark.range(1, 400).select("id", NB.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-11 for r in out)

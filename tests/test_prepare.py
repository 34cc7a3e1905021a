
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import encode as EN
from flowlens.operators import prepare as PR
from flowlens.operators import select as SE
from flowlens.plans import prepare as PP
from flowlens.sources import records as RC

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def split(spark):
    return PP.labelled_split(RC.read_records(spark, SF_SMALL), PP.record_split_key())


def test_split_exact_quota_and_whole(spark, split):
    rows = split.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if("is_test").alias("t")).collect()
    for r in rows:
        assert r.t == math.floor(r.n * 0.2 + 0.5)
    # every input row lands in exactly one half (the row key is not unique here)
    src = PR.label_records(RC.read_records(spark, SF_SMALL))
    assert split.drop("is_test").exceptAll(src).count() == 0
    assert src.exceptAll(split.drop("is_test")).count() == 0


def test_split_default_key_and_small_buckets(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7 == 0).cast("string").alias("label"))
    out = PR.stratified_split(df, bucket_bits=4)       # few buckets: many rows ranked at the boundary
    for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == math.floor(r.n * 0.2 + 0.5)
    assert out.count() == 5000


def test_scaler_identity_and_range(spark, split):
    train = split.filter(~F.col("is_test"))
    p = EN.fit_scaler(train, K.NUMERIC_COLUMNS)
    enc = EN.ColumnTransformer(p, EN.Vocabulary([], {})).transform(train)
    pdf = enc.toPandas()
    raw = train.select(*K.NUMERIC_COLUMNS).toPandas()
    for i, c in enumerate(K.NUMERIC_COLUMNS):
        x, y = raw[c].to_numpy(), pdf[c].to_numpy()
        assert y.min() >= -1e-12 and y.max() <= 1 + 1e-12
        if x.max() > x.min():
            np.testing.assert_allclose(y, (x - x.min()) / (x.max() - x.min()), atol=1e-12)
        else:
            assert np.all(y == 0.0)          # constant column: scale 1, not 0.5


def test_zero_iqr_column_keeps_scale_one(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (0.0,), (9.0,)], "v double")
    p = EN.fit_scaler(df, ["v"])
    assert p.scale(0) == 1.0
    got = [r[0] for r in EN.ColumnTransformer(p, EN.Vocabulary([], {})).transform(df).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_onehot_unknown_is_all_zero_and_missing_feature(spark):
    train = spark.createDataFrame([("tcp",), ("udp",)], "protocol_type string")
    v = EN.fit_vocabulary(train, ["protocol_type"])
    tr = EN.ColumnTransformer(EN.ScalerParams([], [], [], [], [], []), v)
    test = spark.createDataFrame([("icmp",), ("tcp",), (None,)], "protocol_type string")
    rows = tr.transform(test).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    sel = tr.transform_selected(test, ["protocol_type_udp", "service_http", "protocol_type_tcp"]).collect()
    assert [tuple(r) for r in sel] == [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)]


def test_mutual_information_matches_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    a = (y == 1).astype(float)                     # informative one-hot
    b = rng.random(400)                            # noise in [0, 1)
    df = spark.createDataFrame([(float(i), float(j), str(k)) for i, j, k in zip(a, b, y)],
                               "a double, b double, label string")
    got = {r.feature: r.mi for r in SE.mutual_information(df, ["a", "b"], bins=8).collect()}

    def mi(xb, yy):
        n = len(yy); tot = 0.0
        for xv in np.unique(xb):
            for yv in np.unique(yy):
                nxy = np.sum((xb == xv) & (yy == yv))
                if nxy:
                    tot += nxy / n * math.log(nxy * n / (np.sum(xb == xv) * np.sum(yy == yv)))
        return tot
    assert got["a"] == pytest.approx(mi(np.minimum(np.floor(a * 8), 7), y), abs=1e-9)
    assert got["b"] == pytest.approx(mi(np.minimum(np.floor(b * 8), 7), y), abs=1e-9)
    sel = SE.select_k_best(SE.mutual_information(df, ["a", "b"], bins=8), 1).collect()
    assert [r.feature for r in sel] == ["a"]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    w = {r.label: r.weight for r in PR.class_weights(df).collect()}
    assert w == pytest.approx({"a": 8 / (2 * 6), "b": 8 / (2 * 2)})


def test_exact_quantiles_multi_level_against_numpy(spark):
    from flowlens.operators.quantiles import exact_percentiles
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.lognormal(3, 2, 3000), np.zeros(500), np.full(200, 7.0)])
    b = np.round(rng.normal(0, 1, 3700), 2)
    c = np.full(3700, 5.0)
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)],
                               "a double, b double, c double")
    got = exact_percentiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75], grid=4)
    for col, v in (("a", a), ("b", b), ("c", c)):
        srt = np.sort(v)
        for p, q in zip([0.25, 0.5, 0.75], got[col][0]):
            rn = (len(v) - 1) * p
            lo, hi = srt[math.floor(rn)], srt[math.ceil(rn)]
            assert q == lo + (hi - lo) * (rn - math.floor(rn))
        assert got[col][1] == v.min() and got[col][2] == v.max() and got[col][3] == len(v)


@pytest.mark.parametrize("grid,rounds", [(4, 1), (4, 3), (256, 2), (256, 0)])
def test_exact_quantiles_nan_null_and_extreme_values(spark, grid, rounds):
    from flowlens.operators.quantiles import exact_percentiles
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 1000), np.full(600, 0.25), [1e300, -1e300]])   # a third equal
    rows = [(float(x),) for x in v] + [(float("nan"),), (None,)] * 50
    got = exact_percentiles(spark.createDataFrame(rows, "a double").repartition(5), ["a"],
                            [0.0, 0.1, 0.5, 0.999, 1.0], grid=grid, rounds=rounds)["a"]
    srt = np.sort(v)
    for p, q in zip([0.0, 0.1, 0.5, 0.999, 1.0], got[0]):
        at = (len(v) - 1) * p
        lo, hi = srt[math.floor(at)], srt[math.ceil(at)]
        assert q == lo + (hi - lo) * (at - math.floor(at))
    assert got[1:] == (-1e300, 1e300, len(v))


def test_quantiles_of_infinite_and_empty_columns(spark):
    from flowlens.operators.quantiles import exact_percentiles
    df = spark.createDataFrame([(1.0, None), (float("inf"), None)], "a double, b double")
    with pytest.raises(ValueError, match="'a'"):
        exact_percentiles(df, ["a"], [0.5])
    assert exact_percentiles(df, ["b"], [0.5]) == {"b": (None, None, None, 0)}


def test_split_with_heavy_copies(spark):
    # a third of the rows are copies of one row: counts stay exact, rows stay whole
    base = spark.range(3000).select(F.col("id"), (F.col("id") % 5 == 0).cast("string").alias("label"))
    copies = spark.range(1500).select(F.lit(7).cast("long").alias("id"), F.lit("false").alias("label"))
    df = base.unionByName(copies)
    out = PR.stratified_split(df, bucket_bits=2, copy_chunk=100)
    for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == math.floor(r.n * 0.2 + 0.5)
    assert out.drop("is_test").exceptAll(df).count() == 0 and df.exceptAll(out.drop("is_test")).count() == 0


def test_mutual_information_onehot_from_nominal(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 500)
    svc = np.where(y == 1, "http", rng.choice(["ftp", "smtp", "http"], 500))
    df = spark.createDataFrame([(str(s), str(k)) for s, k in zip(svc, y)], "service string, label string")
    v = EN.fit_vocabulary(df, ["service"])
    tr = EN.ColumnTransformer(EN.ScalerParams([], [], [], [], [], []), v)
    enc = tr.transform(df, keep=["service", "label"])
    plain = {r.feature: r.mi for r in SE.mutual_information(enc, tr.feature_names).collect()}
    fast = {r.feature: r.mi for r in SE.mutual_information(enc, tr.feature_names,
                                                             onehot=tr.onehot_sources()).collect()}
    assert plain == pytest.approx(fast, abs=1e-12) and max(plain.values()) > 0


def test_out_of_range_test_values_not_clipped(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,)], "v double")
    p = EN.fit_scaler(train, ["v"])
    test = spark.createDataFrame([(-3.0,), (1.0,), (5.0,), (13.0,)], "v double")
    got = [r[0] for r in EN.ColumnTransformer(p, EN.Vocabulary([], {})).transform(test).collect()]
    assert got == pytest.approx([-1.0, 0.0, 1.0, 3.0])


def test_frequency_cuts_against_numpy(spark):
    from flowlens.operators.quantiles import frequency_cuts
    rng = np.random.default_rng(9)
    a = np.concatenate([rng.lognormal(2, 2, 900), np.zeros(300)])
    b = rng.integers(0, 3, 1200).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = frequency_cuts(df, ["a", "b"], 8, grid=4)
    for col, v in (("a", a), ("b", b)):
        srt, n = np.sort(v), len(v)
        assert got[col] == sorted({float(srt[min(n - 1, (j * n) // 8)]) for j in range(1, 8)})
    assert got["b"] == [0.0, 1.0, 2.0]


def test_interval_counts_match_numpy(spark):
    import numpy as np
    from flowlens.operators import quantiles as Q
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=3000), 2)
    y = rng.integers(0, 9, 3000).astype(float)
    rows = [(float(a), None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    spans = [(0, 0.5, 1.25), (0, -np.inf, -0.75), (1, 2.0, np.inf), (0, -0.75, 0.5)]
    groups = [[Q._Target(c, 0, 1, lo=lo, hi=hi)] for c, lo, hi in spans]
    bounds = {0: [0.6, 1.0], 1: [-0.8], 2: [3.0, 4.0, 8.0], 3: [-0.0, 0.25]}
    kept = [np.array([v for v in col if v is not None and v == v]) for col in zip(*rows)]
    want, cells = {}, {}
    for g, (c, lo, hi) in enumerate(spans):
        for v in kept[c][(kept[c] > lo) & (kept[c] < hi)].tolist():
            seg = sum(b < v for b in bounds[g]) + sum(b <= v for b in bounds[g])
            want[g, seg] = want.get((g, seg), 0) + 1
            cells[g] = cells.get(g, 0) + 1
    got = {}
    for r in Q._segments(df, ["x", "y"], groups, bounds).collect():
        got[r.g, r.seg] = got.get((r.g, r.seg), 0) + r.n
    assert got == want
    assert {r.g: r["count"] for r in Q._cells(df, ["x", "y"], groups).groupBy("g").count().collect()} == cells


def test_scores_need_no_encoded_table(spark, monkeypatch):
    from flowlens.plans import prepare as PP
    written, write = [], PP.write_scratch
    monkeypatch.setattr(PP, "write_scratch", lambda df, name: written.append(name) or write(df, name))
    prep = PP.prepare_records(spark, SF_SMALL)
    assert len(prep.selected) > 0 and "encoded" not in written
    assert prep.train.count() + prep.test.count() == prep.split.count()
    assert written.count("encoded") == 1


def test_contingency_counts_rows_where_they_are(spark):
    from flowlens.operators import select as SE
    rows = [(1.0, 0.1, "a", "x"), (None, float("nan"), "b", "x"), (float("nan"), 0.99, None, "y"), (2.0, 1.5, "c", None), (2.5, -0.2, "a", "y")]
    df = spark.createDataFrame(rows, "p double, q double, n string, label string").repartition(2)
    cont = SE.contingency(df, ["p", "q", "n_a", "n_b"], "label", bins=4, onehot={"n_a": ("n", "a"), "n_b": ("n", "b")}, cuts={"p": [1.0, 2.5]})
    got = sorted((r.pos, r.bin, r.label or "", r.n_xy) for r in cont.collect())
    assert got == sorted([(0, 1, "x", 1), (0, 0, "x", 1), (0, 2, "y", 2), (0, 1, "", 1), (1, 0, "x", 2), (1, 3, "y", 1), (1, 3, "", 1), (1, 0, "y", 1),
                          (2, 3, "x", 1), (2, 3, "y", 1), (2, 0, "x", 1), (2, 0, "y", 1), (3, 3, "x", 1), (3, 0, "x", 1), (3, 0, "y", 2), (2, 0, "", 1), (3, 0, "", 1)])
    plain = SE.contingency(df, ["p", "q"], "label", bins=4, cuts={"p": [1.0, 2.5]})
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_quartiles_and_bins_by_one_search(spark, monkeypatch):
    from flowlens.operators import quantiles as Q
    from flowlens.plans import prepare as PP
    searches, search = [], Q.order_statistics
    monkeypatch.setattr(Q, "order_statistics", lambda *a, **kw: searches.append(1) or search(*a, **kw))
    prep = PP.prepare_records(spark, SF_SMALL)
    assert len(searches) == 1
    train = prep.split.where(~F.col(PP.SPLIT_COL))
    tr = EN.fit_transformer(train, K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS)
    assert tr.scaler == prep.transformer.scaler and tr.vocab == prep.transformer.vocab
    varied = [c for c in K.NUMERIC_COLUMNS if c not in tr.constant_features()]
    assert EN.fit_with_cuts(train, K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS, 32)[1] == Q.frequency_cuts(tr.transform(train), varied, 32)


def test_sketches_get_few_values_of_a_task(spark):
    from flowlens.operators import quantiles as Q
    rows = [(float(i), None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i % 3)) for i in range(6400)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(2)
    groups = [[Q._Target(0, 0, 1)], [Q._Target(1, 0, 1, lo=0.5, hi=1.5)], [Q._Target(0, 0, 1, lo=6000.5, hi=6001.5)]]
    groups[0][0].hi = 6000.5
    got = {r.g: r["count"] for r in Q._thinned(df, ["x", "y"], groups).groupBy("g").count().collect()}
    inside = {r.g: r["count"] for r in Q._cells(df, ["x", "y"], groups).groupBy("g").count().collect()}
    assert got[2] == 1 and all(n // Q.STEP - 2 <= got[g] <= n // Q.STEP + 3 for g, n in inside.items())


def test_ends_of_columns_with_nan(spark):
    from flowlens.operators import quantiles as Q
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, None, nan), (3.0, 2.0, None, nan), (None, -5.0, None, None)], "a double, b double, c double, d double")
    assert Q._column_stats(df, ["a", "b", "c", "d"]) == {0: (2, 1.0, 3.0), 1: (2, -5.0, 2.0)}

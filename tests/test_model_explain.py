
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlens.operators import explain as XP
from flowlens.operators import metrics as ME
from flowlens.operators import model as MO
from flowlens.plans import prepare as PP
from flowlens.session import scratch_path

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    prep = PP.prepare_records(spark, SF_SMALL)
    clf = MO.train_classifier(prep.train, prep.selected, params=MO.TrainParams(num_trees=10))
    return prep, clf


def test_probabilities_and_confidence(trained):
    prep, clf = trained
    rows = clf.predict(prep.test).select("probs", "confidence", MO.PREDICTION, "prediction").collect()
    for r in rows:
        assert sum(r.probs) == pytest.approx(1.0, abs=1e-9)
        assert r.confidence == pytest.approx(r.probs[int(r[MO.PREDICTION])])
        assert r.prediction == clf.labels[int(r[MO.PREDICTION])]
    assert clf.labels == sorted(clf.labels)


def test_model_and_transformer_round_trip(spark, trained):
    prep, clf = trained
    path = scratch_path(spark, "model-test")
    clf.save(path)
    MO.save_transformer(spark, prep.transformer, prep.selected, path)
    clf2 = MO.Classifier.load(spark, path)
    tr2, sel2 = MO.load_transformer(spark, path)
    assert sel2 == prep.selected and clf2.labels == clf.labels
    a = [r.prediction for r in clf.predict(prep.test).orderBy("l_orderkey", "l_linenumber").collect()]
    b = [r.prediction for r in clf2.predict(prep.test).orderBy("l_orderkey", "l_linenumber").collect()]
    assert a == b
    assert tr2.feature_names == prep.transformer.feature_names


def _brute(nodes_by_tree, x, n_feat, n_cls):
    def ev(nodes, nid, S):
        n = nodes[nid]
        if n.leftChild < 0:
            s = np.array(n.impurityStats)
            return s / s.sum()
        f, thr = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
        if f in S:
            return ev(nodes, n.leftChild if x[f] <= thr else n.rightChild, S)
        cl = sum(nodes[n.leftChild].impurityStats)
        cr = sum(nodes[n.rightChild].impurityStats)
        return (cl * ev(nodes, n.leftChild, S) + cr * ev(nodes, n.rightChild, S)) / (cl + cr)
    out = np.zeros((n_cls, n_feat))
    for nodes in nodes_by_tree.values():
        root = min(nodes)
        for i in range(n_feat):
            others = [j for j in range(n_feat) if j != i]
            for k in range(n_feat):
                for S in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(n_feat - k - 1) / math.factorial(n_feat)
                    out[:, i] += w * (ev(nodes, root, set(S) | {i}) - ev(nodes, root, set(S)))
    return out / len(nodes_by_tree)


def test_shapley_equals_brute_force_and_is_additive(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.integers(0, 5)), float(rng.random()), float(rng.integers(0, 3)), int(rng.integers(0, 3)))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    m = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=1, minInstancesPerNode=5).fit(v)
    tab = XP.build_leaf_table(spark, m, 3)
    path = scratch_path(spark, "bf")
    m.write().overwrite().save(path)
    nodes = {}
    for r in spark.read.parquet(path + "/data").collect():
        nodes.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    x = np.array([r[:3] for r in rows[:12]])
    phi = XP.shap_matrix(x, tab)
    for i in range(len(x)):
        np.testing.assert_allclose(phi[i], _brute(nodes, x[i], 3, 3), atol=1e-12)
    prob = np.array([r.probability.toArray() for r in m.transform(v).limit(12).collect()])
    np.testing.assert_allclose(tab.base[None, :] + phi.sum(axis=2), prob, atol=1e-12)
    # distributed path gives the same numbers
    svdf = XP.shap_values(df.limit(12), ["a", "b", "c"], tab, keep=["a", "b", "c"], with_values=True)
    sv = svdf.collect()
    got = {(r.a, r.b, r.c): np.array(r.shap) for r in sv}
    for i in range(len(x)):
        np.testing.assert_allclose(got[tuple(x[i])], phi[i], atol=1e-12)
    long = XP.shap_long(svdf, ["a", "b", "c"], ["f", "g", "h"], ["k0", "k1", "k2"]).collect()
    assert len(long) == len(sv) * 3 * 3
    assert all(r.feature_value == {"f": r.a, "g": r.b, "h": r.c}[r.feature] for r in long)


def test_top_impacts_tie_by_feature_order_and_waterfall(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0, "f0", 0.2), (1, 0.5, 1, "f1", -0.2), (1, 0.5, 2, "f2", 0.1), (1, 0.5, 3, "f3", 0.2)],
        "rid int, base_value double, position int, feature string, impact double")
    top = XP.top_impacts(df, ["rid"], 3).first()
    assert top.top_features == ["f0", "f1", "f3"]
    wf = XP.waterfall(df, ["rid"]).orderBy("step").collect()
    assert [r.feature for r in wf] == ["f0", "f1", "f3", "f2"]
    assert wf[-1].running_total == pytest.approx(0.5 + 0.3)


def test_in_row_impacts_equal_the_long_form(spark):
    from flowlens.plans import fixed_forest as FF
    rows = [(i, float(i % 50), (i % 11) / 100, (i % 9) / 100) for i in range(60)] + [(60, 0.0, 0.0, 0.0)] * 2
    df = FF.predict(spark.createDataFrame(rows, "rid long, count double, serror_rate double, rerror_rate double"))
    sv = XP.shap_values(df, FF.FEATURES, FF.leaf_table(), keep=["rid", MO.PREDICTION])
    once = sv.dropDuplicates(["rid"])
    long = XP.predicted_class_impacts(once, FF.FEATURES, MO.PREDICTION)
    want = {r.rid: (list(r.top_features), r.features) for r in XP.top_impacts(long, ["rid"], 2).collect()}
    got = XP.with_top_impacts(sv, FF.FEATURES, MO.PREDICTION, 2).collect()
    assert len(got) == 62 and len(want) == 61
    assert all((list(r.top_features), r.features) == want[r.rid] for r in got)
    steps = {(r.rid, r.step): (r.feature, r.impact, r.running_total) for r in XP.waterfall(long, ["rid"]).collect()}
    for r in XP.waterfall_rows(once, ["rid"], FF.FEATURES, MO.PREDICTION).collect():
        feature, impact, total = steps[(r.rid, r.step)]
        assert (r.feature, r.impact) == (feature, impact) and r.running_total == pytest.approx(total, abs=1e-12)
    empty = df.limit(0)
    assert XP.with_top_impacts(XP.shap_values(empty, FF.FEATURES, FF.leaf_table(), keep=["rid", MO.PREDICTION]),
                               FF.FEATURES, MO.PREDICTION).count() == 0


def test_pattern_tables_within_their_bound_give_the_same_values(monkeypatch):
    from flowlens.plans import fixed_forest as FF
    x = np.random.default_rng(3).random((50, 3)) * [50, 0.11, 0.09]
    whole = FF.leaf_table()
    monkeypatch.setattr(XP, "PATTERN_BYTES", 100)
    bounded = FF.leaf_table()
    assert all(leaf.table is not None for leaf in whole.leaves)
    assert sum(leaf.table.nbytes for leaf in bounded.leaves if leaf.table is not None) <= 100
    assert any(leaf.table is None for leaf in bounded.leaves)
    np.testing.assert_allclose(XP.shap_matrix(x, bounded), XP.shap_matrix(x, whole), atol=1e-15)


def test_metrics_zero_division_and_brute_force(spark):
    pairs = [("dos", "dos")] * 5 + [("dos", "normal")] * 2 + [("normal", "normal")] * 4 + \
            [("u2r", "normal")] * 1 + [("probe", "dos")] * 1
    df = spark.createDataFrame(pairs, "label string, prediction string")
    rep = {r["class"]: r for r in ME.class_report(ME.confusion_long(df)).collect()}
    assert rep["u2r"].precision == 0.0 and rep["u2r"].recall == 0.0 and rep["u2r"].f1 == 0.0
    assert rep["dos"].precision == pytest.approx(5 / 6) and rep["dos"].recall == pytest.approx(5 / 7)
    s = ME.summary(ME.confusion_long(df)).first()
    assert s.accuracy == pytest.approx(9 / 13) and s.support == 13
    f1s = [2 * 5 / (2 * 5 + 1 + 2), 2 * 4 / (2 * 4 + 3 + 0), 0.0, 0.0]
    assert s.macro_f1 == pytest.approx(sum(f1s) / 4)


def test_critical_case_priority(spark):
    df = spark.createDataFrame([(0, "normal", "normal"), (1, "dos", "dos"), (2, "r2l", "r2l"), (3, "u2r", "dos")],
                               "rid int, label string, prediction string")
    assert XP.critical_case(df, "rid").first().rid == 2
    assert XP.critical_case(df.filter(F.col("rid") != 2), "rid").first().rid == 1
    assert XP.critical_case(df.filter(F.col("rid") == 3), "rid").first().rid == 3


def test_report_files_and_importance(spark, trained):
    prep, clf = trained
    conf = ME.confusion_long(clf.predict(prep.test))
    path = scratch_path(spark, "report")
    ME.write_report(spark, ME.class_report(conf), ME.summary(conf), path, {"train_sec": 1.5})
    text = "\n".join(r.value for r in spark.read.text(f"{path}/report_txt").collect())
    assert "macro avg" in text and "weighted avg" in text
    assert spark.read.json(f"{path}/summary").first().train_sec == 1.5
    imp = MO.forest_importance(clf, 3).collect()
    assert len(imp) == 3 and imp[0].importance >= imp[1].importance >= imp[2].importance


def test_binary_detector(spark, trained):
    prep, _ = trained
    known = prep.train.filter(F.col("label") != "unknown")
    m = MO.train_binary(known, prep.selected, max_iter=10)
    out = m.transform(prep.test).select("prediction").distinct().collect()
    assert {r.prediction for r in out} <= {0.0, 1.0}


@pytest.mark.parametrize("kind", ["logistic", "svm", "forest"])
def test_binary_detector_after_an_observed_query(spark, kind):
    from pyspark.sql import Observation
    rows = spark.createDataFrame([("normal" if i % 3 == 0 else "dos", float(i % 3), float(i % 5)) for i in range(120)],
                                 "label string, a double, b double")
    seen = Observation("seen")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 120
    if kind == "forest":
        scored = MO.train_classifier(rows, ["a", "b"], params=MO.TrainParams(num_trees=2)).predict(rows)
    else:
        scored = MO.train_binary(rows, ["a", "b"], kind=kind, max_iter=3).transform(rows)
    assert scored.select("prediction").distinct().count() <= 2


def test_training_rows_are_split_by_their_number(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 1).select(
        F.when(F.col("id") % 3 == 0, "normal").otherwise("dos").alias("label"),
        (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    fitted, fit = [], MO.RandomForestClassifier.fit
    monkeypatch.setattr(MO.RandomForestClassifier, "fit", lambda self, df: fitted.append(df) or fit(self, df))
    clf = MO.train_classifier(rows, ["a", "b"], params=MO.TrainParams(num_trees=2, rows_per_task=20))
    assert fitted[0].rdd.getNumPartitions() == 20 and fitted[0].count() == 400
    assert clf.predict(rows).filter("prediction = label").count() == 400
    MO.train_classifier(rows, ["a", "b"], params=MO.TrainParams(num_trees=2))
    assert fitted[1].rdd.getNumPartitions() == 1


def test_dealt_training_rows_are_kept_in_whole_rounds_of_cores(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 1).select(F.when(F.col("id") % 3 == 0, "normal").otherwise("dos").alias("label"), (F.col("id") % 3).cast("double").alias("a"))
    seen, fit = [], MO.RandomForestClassifier.fit
    monkeypatch.setattr(MO.RandomForestClassifier, "fit", lambda self, df: seen.append((df, df.rdd.getNumPartitions(), df.storageLevel.useDisk)) or fit(self, df))
    MO.train_classifier(rows, ["a"], params=MO.TrainParams(num_trees=2, rows_per_task=70))  # 6 tasks, 4 cores
    (df, tasks, kept), = seen
    assert tasks == 8 and kept and not df.storageLevel.useDisk


def test_training_run_writes_no_table_twice(spark, monkeypatch):
    from flowlens.plans import train as TR
    written = {}
    for module in (PP, TR):
        write = module.write_scratch
        monkeypatch.setattr(module, "write_scratch", lambda df, name, write=write: written.setdefault(name, df.columns) and write(df, name))
    TR.run_training_on_records(spark, SF_SMALL, scratch_path(spark, "train-run"), params=MO.TrainParams(num_trees=2))
    assert "split" in written and "encoded" not in written
    assert "prediction" in written["scored"] and "src_bytes" not in written["scored"]


def test_training_run_and_request_scoring(spark):
    from flowlens.plans import alerting as AP
    from flowlens.plans import registry as R
    from flowlens.plans import serve as SV
    from flowlens.plans import train as TR
    from flowlens.sources import requests as RQ
    out = scratch_path(spark, "train-run")
    summ = TR.run_training_on_records(spark, SF_SMALL, out, params=MO.TrainParams(num_trees=5))
    assert summ["support"] > 0 and summ["train_sec"] > 0 and 0 <= summ["accuracy"] <= 1
    assert spark.read.parquet(f"{out}/processed/train").count() > 0
    # requests built from flow records, two files = two batches
    rec = AP.flow_records(spark, SF_SMALL, R.BATCH_WINDOW)
    req_path = scratch_path(spark, "requests-in")
    RQ.requests_from_records(rec, "192.168.1.9").repartition(2).write.mode("overwrite").json(req_path)
    alerts = SV.score_request_files(spark, req_path, f"{out}/model", out_dir=out).collect()
    verdicts = spark.read.parquet(f"{out}/verdicts")
    assert verdicts.count() == rec.count()
    assert len(alerts) >= 2 and all(len(a.features) == 3 for a in alerts)
    firsts = {a.seq for a in alerts}
    assert len({r.batch for r in verdicts.select("batch").distinct().collect()}) == 2
    assert firsts


def test_scoring_tolerates_missing_values(spark, trained):
    prep, clf = trained
    row = prep.test.limit(3).withColumn(clf.features[0], F.lit(None).cast("double"))
    out = clf.predict(row).collect()
    assert len(out) == 3 and all(r.prediction in clf.labels for r in out)



def test_boosted_defaults_are_the_source_settings(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: (self, rows.agg(F.sum("_y")).first()[0]))
    df = spark.createDataFrame([(float(i), lab) for i, lab in enumerate(["normal", "dos", "dos", "probe", "unknown"])], "a double, label string")
    bst = MO.train_boosted(df, ["a"], label_col="label")
    assert [n for _, n in bst.models] == [2.0, 1.0, 1.0] and bst.labels == ["dos", "normal", "probe"]
    for m, _ in bst.models:
        assert (m.getMaxIter(), m.getMaxDepth(), m.getStepSize()) == (300, 10, 0.03)
        assert (m.getMinInstancesPerNode(), m.getSubsamplingRate(), m.getFeatureSubsetStrategy()) == (20, 0.8, "0.8")


def test_boosted_one_vs_rest_and_margin_shapley(spark, trained):
    prep, _ = trained
    bst = MO.train_boosted(prep.train, prep.selected, params=MO.BoostParams(rounds=4, max_depth=3))
    scored = bst.predict(prep.test)
    rows = scored.select("probs", "margins", "confidence", "prediction", MO.PREDICTION, *bst.features).limit(40).collect()
    for r in rows:
        assert sum(r.probs) == pytest.approx(1.0, abs=1e-9)
        assert r.confidence == max(r.probs) and r.prediction == bst.labels[int(r[MO.PREDICTION])]
    acc = ME.summary(ME.confusion_long(scored)).first().accuracy
    assert acc > 0.5
    tab = XP.build_margin_table(spark, bst.models, len(bst.features))
    x = np.array([[r[f] for f in bst.features] for r in rows])
    phi = XP.shap_matrix(x, tab)
    np.testing.assert_allclose(tab.base[None, :] + phi.sum(axis=2), np.array([r.margins for r in rows]), atol=1e-9)
    path = scratch_path(spark, "boosted")
    bst.save(path)
    again = MO.BoostedClassifier.load(spark, path).predict(prep.test).select("prediction").collect()
    assert [r.prediction for r in again] == [r.prediction for r in scored.select("prediction").collect()]


def test_leaf_phi_by_definition():
    """The quadrature against Shapley's sum over coalitions."""
    from itertools import combinations
    from math import factorial
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 5, 8):
        o, z = rng.integers(0, 2, (6, d)).astype(float), rng.random(d)
        z[0] = 0.0
        want = np.zeros((6, d))
        for r in range(6):
            v = lambda s: np.prod([o[r, j] if j in s else z[j] for j in range(d)])  # noqa: B023, E731
            for i in range(d):
                others = [j for j in range(d) if j != i]
                want[r, i] = sum(factorial(k) * factorial(d - k - 1) / factorial(d) * (v({*s, i}) - v(set(s))) for k in range(d) for s in combinations(others, k))
        np.testing.assert_allclose(XP.leaf_phi(o, z), want, atol=1e-14)
    deep = XP.leaf_phi(np.ones((2, 60)), np.full(60, 0.9))  # 2^60 patterns would be needed otherwise
    np.testing.assert_allclose(deep.sum(axis=1), 1 - 0.9**60, atol=1e-12)


def test_leaf_groups_add_up(spark, trained):
    prep, clf = trained
    table = XP.build_leaf_table(spark, clf.forest, len(clf.features))
    rows = prep.test.limit(60)
    whole = XP.shap_values(rows, clf.features, table, keep=["label"], with_values=True)
    size = len(table.leaves) * 900 // 4
    assert 2 < len(XP.leaf_groups(table, size)) < 40
    parts = XP.shap_values(rows, clf.features, table, keep=["label"], with_values=True, group_bytes=size)
    assert parts.columns == whole.columns
    key = lambda r: (r.label, tuple(r["values"]))
    for a, b in zip(sorted(whole.collect(), key=key), sorted(parts.collect(), key=key), strict=True):
        assert key(a) == key(b) and a.base == b.base
        np.testing.assert_allclose(np.array(a.shap), np.array(b.shap), atol=1e-12)


def test_path_tests_hold_for_every_value():
    import numpy as np
    from flowlens.operators import explain as XP
    rng = np.random.default_rng(3)
    conds = [(0, "cont", 0.5, True), (1, "cont", -1.0, False), (0, "cont", -0.25, False), (0, "cont", 0.25, True),
             (2, "cat", frozenset({1.0, 2.0}), False), (1, "cont", 0.0, False)]
    z = np.array([0.3, 0.6, 0.8])
    leaves = [XP.Leaf(np.array([2, 0, 1]), z, conds, np.array([0.25, 0.75])),
              XP.Leaf(np.array([0]), z[:1], [(0, "cont", 0.0, True), (0, "cont", 0.0, False)], np.array([1.0, 0.0]))]
    XP._add_patterns(leaves)
    table = XP.LeafTable(3, 2, 1, leaves, np.zeros(2))
    x = np.column_stack([rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0, np.nan], 500), rng.choice([0.0, 1.0, 2.0, 3.0], 500),
                         rng.choice([-0.25, -0.2, 0.25, 0.3, 0.5, np.inf, -np.inf, np.nan], 500)])
    want = np.zeros((500, 2, 3))
    for leaf in leaves:
        o = np.ones((500, len(leaf.features)))
        for slot, kind, thr, left in leaf.conds:
            v = x[:, leaf.features[slot]]
            o[:, slot] *= ((v <= thr) if kind == "cont" else np.isin(v, list(thr))) == left
        for k, phi in enumerate(XP.leaf_phi(o, leaf.z).T):
            want[:, :, leaf.features[k]] += phi[:, None] * leaf.value
    np.testing.assert_allclose(XP.shap_matrix(x, table), want, atol=1e-12)
    cuts, tests = XP.path_tests(table)
    assert tests[0][1] == (2, 0) and tests[1][0][1] < 0 and cuts[2].tolist() == [-0.25, 0.25, 0.5]


def test_checks_of_the_forest_write_no_encoded_table(spark, monkeypatch):
    from flowlens.plans import prepare as PP, registry, stored
    written, write = [], PP.write_scratch
    monkeypatch.setattr(PP, "write_scratch", lambda df, name: written.append(name) or write(df, name))
    for query in (registry.q_probability_check, stored.saved_model_check):
        assert all(r.n == r.n_holds for r in query(spark, SF_SMALL).collect())
    assert "split" in written and "encoded" not in written


def test_rows_at_the_same_places_are_explained_once(monkeypatch):
    rng = np.random.default_rng(4)
    leaves = []
    for _ in range(60):
        f = rng.choice(9, 4, replace=False)
        conds = [(i, "cont", float(rng.integers(0, 200)), bool(rng.integers(2))) for i in range(3)] + [(3, "cat", frozenset({1.0, 2.0}), True)]
        f[3] = 8
        leaves.append(XP.Leaf(f if len(set(f.tolist())) == 4 else np.array([0, 1, 2, 8]), rng.random(4), conds, rng.random(2)))
    XP._add_patterns(leaves)
    for table in (XP.LeafTable(9, 2, 3, leaves, np.zeros(2)), XP.LeafTable(9, 2, 3, leaves[:2], np.zeros(2))):
        x = np.column_stack([rng.choice([-1.0, 0.0, 50.5, 100.0, 150.0, np.nan, np.inf], 300) for _ in range(8)] + [rng.choice([0.0, -0.0, 1.0, 2.0, np.nan], 300)])
        x = x[rng.integers(0, 40, 300)]
        want, worked, matrix = XP.shap_matrix(x, table), [], XP.shap_matrix
        monkeypatch.setattr(XP, "shap_matrix", lambda x, t: worked.append(len(x)) or matrix(x, t))
        explain = XP.Explainer(table)
        for _ in range(2):
            np.testing.assert_array_equal(explain(x), want)
        assert sum(worked) <= 40
        monkeypatch.setattr(XP, "SEEN_BYTES", 8 * 18 * 3)  # no room for most
        explain = XP.Explainer(table)
        np.testing.assert_array_equal([explain(x), explain(x[::-1])[::-1]], [want, want])
        monkeypatch.undo()


def test_explained_queries_write_no_scored_table(spark, monkeypatch):
    from flowlens.plans import registry
    written, write = [], registry.write_scratch
    monkeypatch.setattr(registry, "write_scratch", lambda df, name: written.append(name) or write(df, name))
    assert registry.q_shap_values(spark, SF_SMALL).count() > 0
    assert not written

"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads whole tables under
``sf_dir``; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import scalar as S
from flowlens.operators import boosting as BO
from flowlens.operators import encode as EN
from flowlens.operators import flows as FL
from flowlens.operators import metrics as ME
from flowlens.operators import model as MO
from flowlens.operators import neighbours as NB
from flowlens.operators import prepare as PR
from flowlens.operators import select as SE
from flowlens.operators import alerts as AL
from flowlens.operators import explain as XP
from flowlens.plans import alerting as AP
from flowlens.plans import fixed_forest as FF
from flowlens.plans import oracle_alert_sql as OA
from flowlens.plans import oracle_boost_sql as OB
from flowlens.plans import oracle_explain_sql as OX
from flowlens.plans import oracle_prep_sql as OP
from flowlens.plans import oracle_sql as O
from flowlens.plans import oracle_stored_sql as OS
from flowlens.plans import prepare as PP
from flowlens.plans import stored as ST
from flowlens.session import scratch_path, write_scratch
from flowlens.sources import records as RC
from flowlens.sources.packets import read_dense_packets, read_packets

Builder = Callable[[SparkSession, str], DataFrame]

BATCH_WINDOW = "1 day"   # the test packets are sparse: daily batches (FIXTURES.md §3)


def q_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 (+P6–P10): bidirectional flows per daily batch."""
    return FL.aggregate_flows(read_packets(spark, sf_dir), BATCH_WINDOW)


def q_flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 → A2/W1/W2 → P11–P15: the 41-attribute record of every flow."""
    return FL.flow_records(read_packets(spark, sf_dir), BATCH_WINDOW)


CAPTURE_WINDOW = "4 seconds"   # the agent's capture interval


def q_flow_records_4s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 → A2 → P11–P15 with the agent's 4-second batches (ST1 in batch form)."""
    return FL.flow_records(read_packets(spark, sf_dir), CAPTURE_WINDOW)


def q_flows_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on packets of many clients to few servers (a day as window)."""
    return FL.aggregate_flows(read_dense_packets(spark, sf_dir), BATCH_WINDOW)


def q_flow_records_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, P12, P13 where a host sees many flows in a window (counters reach
    their caps) and a client may be its own server (land)."""
    return FL.flow_records(read_dense_packets(spark, sf_dir), BATCH_WINDOW)


# -- E1: preparation ---------------------------------------------------------

SELECT_K_QUERY = 20   # of the 48 encoded stand-in columns; the pipeline default is 100


def _split(spark, sf_dir, materialize=False):
    return PP.labelled_split(RC.read_records(spark, sf_dir), PP.record_split_key(), materialize)


def q_labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty dropped, label mapped to its category."""
    lab = PR.label_records(RC.read_records(spark, sf_dir))
    return lab.select(*RC.ROW_KEY, *K.ATTRIBUTE_COLUMNS, K.LABEL_COLUMN)


def q_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attack names, their category, and how many rows carry each."""
    recs = RC.read_records(spark, sf_dir)
    return (recs.select(F.col("label").alias("raw_label"), S.label_category("label").alias("category"))
                .groupBy("raw_label", "category").agg(F.count(F.lit(1)).alias("n")))


def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact stratified 80/20 split, per row."""
    return _split(spark, sf_dir).select(*RC.ROW_KEY, K.LABEL_COLUMN, PP.SPLIT_COL)


def q_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train/test sizes per class."""
    return _split(spark, sf_dir).groupBy(K.LABEL_COLUMN).agg(
        F.count_if(~F.col(PP.SPLIT_COL)).alias("n_train"),
        F.count_if(F.col(PP.SPLIT_COL)).alias("n_test"))


def q_scaler_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: quartiles, median, min, max per numeric column (train rows only)."""
    train = _split(spark, sf_dir).filter(~F.col(PP.SPLIT_COL))
    return EN.fit_scaler(train, K.NUMERIC_COLUMNS).to_df(spark)


def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: sorted category vocabulary per nominal column (train rows only)."""
    train = _split(spark, sf_dir).filter(~F.col(PP.SPLIT_COL))
    return EN.fit_vocabulary(train, K.NOMINAL_COLUMNS).to_df(spark, offset=len(K.NUMERIC_COLUMNS))


def q_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M2/M3: every row (train and test) encoded with the train-fitted transformer."""
    split = _split(spark, sf_dir, materialize=True)
    tr = EN.fit_transformer(split.filter(~F.col(PP.SPLIT_COL)), K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS)
    enc = tr.transform(split, keep=RC.ROW_KEY + [K.LABEL_COLUMN, PP.SPLIT_COL])
    return enc.select(*RC.ROW_KEY, K.LABEL_COLUMN, PP.SPLIT_COL, *K.NUMERIC_COLUMNS,
                      PP.onehot_active(tr).alias("onehot_active"))


def q_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: binned mutual information of every encoded column with the class."""
    return _prepared(spark, sf_dir).scores


def q_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k columns by mutual information, in original column order."""
    scores = _prepared(spark, sf_dir).scores
    return SE.select_k_best(scores, SELECT_K_QUERY)


def q_knn_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the nearest-neighbour estimate for numeric columns, exact counts for
    one-hot columns."""
    split = _split(spark, sf_dir, materialize=True)
    tr = EN.fit_transformer(split.filter(~F.col(PP.SPLIT_COL)), K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS)
    encoded = tr.transform(split, keep=[K.LABEL_COLUMN, PP.SPLIT_COL] + K.NOMINAL_COLUMNS)
    return PP.neighbour_scores(write_scratch(encoded.filter(~F.col(PP.SPLIT_COL)), "encoded-train"), tr)


def q_knn_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4/T1 with the nearest-neighbour estimate, as the source selects."""
    return SE.select_k_best(write_scratch(q_knn_information(spark, sf_dir), "knn-scores"), SELECT_K_QUERY)


def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights of the training rows."""
    train = _split(spark, sf_dir).filter(~F.col(PP.SPLIT_COL))
    return PR.class_weights(train)


# -- E2: evaluation -----------------------------------------------------------

def _rule_scored_test(spark, sf_dir):
    test = _split(spark, sf_dir).filter(F.col(PP.SPLIT_COL))
    return test.select(K.LABEL_COLUMN, AP.rule_prediction().alias("prediction"))


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts on the test split (rule predictions)."""
    return ME.confusion_long(_rule_scored_test(spark, sf_dir))


def q_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision, recall, F1, support (rule predictions)."""
    return ME.class_report(ME.confusion_long(_rule_scored_test(spark, sf_dir)))


def q_summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro and weighted averages (rule predictions)."""
    return ME.summary(ME.confusion_long(_rule_scored_test(spark, sf_dir)))


def _prepared(spark, sf_dir):
    """E1 on the stand-in records."""
    return PP.prepare_records(spark, sf_dir)


def _trained(spark, sf_dir):
    """Prepared stand-in records and the forest trained on them."""
    prep = _prepared(spark, sf_dir)
    return prep, MO.train_classifier(prep.train_rows, prep.selected)


def q_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest trained on the train split, test rows scored."""
    prep, clf = _trained(spark, sf_dir)
    scored = clf.predict(prep.test_rows)
    return scored.select(*RC.ROW_KEY, K.LABEL_COLUMN, "prediction", "confidence")


def q_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 over the trained model's test predictions."""
    prep, clf = _trained(spark, sf_dir)
    return ME.summary(ME.confusion_long(clf.predict(prep.test_rows)))


def q_boosted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: softmax boosting with the source's settings on the train split; A9
    summary of the test predictions."""
    prep = _prepared(spark, sf_dir)
    model = BO.train_softmax(prep.train_rows, prep.selected)
    return ME.summary(ME.confusion_long(model.predict(prep.test_rows)))


def q_boosted_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the nodes of the first round's trees, grown over all labelled
    records from the gradients of the class shares and given cut points."""
    labelled = PR.label_records(RC.read_records(spark, sf_dir))
    params = BO.BoostingParams(rounds=1, rate=OB.RATE, max_leaves=1 << OB.DEPTH, max_depth=OB.DEPTH, min_rows=OB.MIN_ROWS,
                               columns=1.0, balanced=False, local_rows=0)
    model = BO.train_softmax(labelled, list(OB.FEATURES), params=params, cuts=list(OB.FEATURES.values()))
    return BO.node_table(spark, model)


def q_boosted_shapley_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1/X2 of the softmax booster, whose margins the source explains: test
    rows per class, and how many have base plus impacts equal to the margin of
    every class (ten rounds)."""
    prep = _prepared(spark, sf_dir)
    model = BO.train_softmax(prep.train_rows, prep.selected, params=BO.BoostingParams(rounds=10))
    scored = write_scratch(model.predict(prep.test_rows), "boosted-scored")
    sv = XP.shap_values(scored, model.features, XP.build_softmax_table(model), keep=[K.LABEL_COLUMN, "margins"])
    gap = F.transform(F.arrays_zip("base", "shap", "margins"), lambda e: F.abs(
        F.aggregate(e["shap"], e["base"], lambda a, x: a + x) - e["margins"]))
    return sv.groupBy(K.LABEL_COLUMN).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_max(gap) < 1e-9).alias("n_holds"))


def q_forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-9 features by the trained forest's importance."""
    prep, clf = _trained(spark, sf_dir)
    return MO.forest_importance(clf, 9)


def q_binary_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normal/anomaly logistic detector on the train split, test rows scored;
    returns the binary confusion counts."""
    prep = _prepared(spark, sf_dir)
    known = prep.train_rows.filter(F.col(K.LABEL_COLUMN) != K.UNKNOWN_CATEGORY)
    model = MO.train_binary(known, prep.selected)
    scored = model.transform(prep.test_rows).withColumn("y", MO.binary_label(K.LABEL_COLUMN))
    return ME.confusion_long(scored.select(F.col("y").alias("label"),
                                           F.col("prediction").alias("prediction")))


def q_training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 end to end (S2–S5, S10, A13): prepare, write processed tables, train,
    evaluate, persist model and report; the report's summary as it was written,
    with the counts of the scoring pass and without its times."""
    from flowlens.plans import train as TR
    out = scratch_path(spark, "training-run")
    TR.run_training_on_records(spark, sf_dir, out)
    return spark.read.json(f"{out}/report/summary").drop("train_sec", "infer_ms_per_row")


# -- E2: explanation ----------------------------------------------------------

def _explained_test(spark, sf_dir, with_values=False):
    prep, clf = _trained(spark, sf_dir)
    scored = clf.predict(prep.test_rows)   # read by one pass, the explainer's
    table = XP.build_leaf_table(spark, clf.forest, len(clf.features))
    keys = RC.ROW_KEY + [K.LABEL_COLUMN, "prediction", MO.PREDICTION]
    return prep, clf, scored, XP.shap_values(scored, clf.features, table, keep=keys,
                                             with_values=with_values)


def q_shap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test row, base value and Shapley value of every selected
    feature for every class."""
    return _explained_test(spark, sf_dir)[3]


def q_global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean |Shapley value| per class and feature over the test rows."""
    prep, clf, _, sv = _explained_test(spark, sf_dir)
    return XP.global_importance(sv, clf.features, clf.labels)


def q_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Shapley value, feature value) pairs of class index 0."""
    prep, clf, scored, sv = _explained_test(spark, sf_dir, with_values=True)
    return XP.direction_data(sv, RC.ROW_KEY, clf.features, 0)


def q_critical_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 + X3 + X6: the first critical true positive of the test rows and
    its waterfall (contributions by |impact| with running total)."""
    prep, clf = _trained(spark, sf_dir)
    scored = clf.predict(prep.test_rows)
    case = XP.critical_case(scored, [*RC.ROW_KEY, *clf.features]).drop("priority")
    case = write_scratch(case, "critical_case")
    table = XP.build_leaf_table(spark, clf.forest, len(clf.features))
    sv = XP.shap_values(case, clf.features, table,
                        keep=RC.ROW_KEY + [K.LABEL_COLUMN, "prediction", MO.PREDICTION])
    imp = XP.predicted_class_impacts(sv, clf.features, MO.PREDICTION)
    return XP.waterfall(imp, RC.ROW_KEY)


def _test_query(view: Callable[[DataFrame], DataFrame]) -> Builder:
    """A view over all test rows of the stand-in records."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(_split(spark, sf_dir).filter(F.col(PP.SPLIT_COL)))
    build.__doc__ = view.__doc__
    return build


def q_probability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6–M8, P17 of the trained forest: test rows per class, and how many of
    them have probabilities that sum to 1 and the largest as confidence."""
    prep, clf = _trained(spark, sf_dir)
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    holds = (F.abs(total - 1.0) < 1e-9) & (F.col("confidence") == F.array_max("probs"))
    return clf.predict(prep.test_rows).groupBy(K.LABEL_COLUMN).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(holds).alias("n_holds"))


def q_shapley_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1/X2 of the trained forest: test rows per class, and how many of them
    have base plus impacts equal to the probability, for every class."""
    prep, clf = _trained(spark, sf_dir)
    table = XP.build_leaf_table(spark, clf.forest, len(clf.features))
    sv = XP.shap_values(clf.predict(prep.test_rows), clf.features, table, keep=[K.LABEL_COLUMN, "probs"])
    gap = F.transform(F.arrays_zip("base", "shap", "probs"), lambda e: F.abs(
        F.aggregate(e["shap"], e["base"], lambda a, x: a + x) - e["probs"]))
    return sv.groupBy(K.LABEL_COLUMN).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_max(gap) < 1e-9).alias("n_holds"))


# -- E3: alerts -----------------------------------------------------------------

CLEARED_AT = "2024-01-15 00:00:00"   # a "clear" pressed mid-range (T7)
FILTER_CLASS, FILTER_IP = "MALICIOUS", "10.0.1.2"


def _rule_alerts(spark, sf_dir):
    return AP.rule_alerts(spark, sf_dir, BATCH_WINDOW)


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows of the rule-scored flow records (threats, and
    the first flow of each batch)."""
    return _rule_alerts(spark, sf_dir)


def q_alert_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 alerts kept by the service (rule-scored flows;
    ``alerts.replay`` orders them oldest-first for a new viewer, T6)."""
    return AL.newest(_rule_alerts(spark, sf_dir))


def q_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + P20–P24: newest 51 rows with severity, label and percent text
    (rule-scored flows)."""
    return AL.dashboard_rows(_rule_alerts(spark, sf_dir))


def q_dashboard_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class filter and IP substring filter over the dashboard rows
    (rule-scored flows)."""
    return AL.filter_rows(AL.dashboard_rows(_rule_alerts(spark, sf_dir)), FILTER_CLASS, FILTER_IP)


def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total alerts, threats and distinct nodes (rule-scored flows)."""
    return AL.kpis(_rule_alerts(spark, sf_dir))


def q_kpis_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 + A11: counters restarted at a clear time (rule-scored flows)."""
    return AL.kpis(_rule_alerts(spark, sf_dir), cleared_at=CLEARED_AT)


def q_node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-seen time and ONLINE/AWAY per node (rule-scored flows)."""
    return AL.node_status(_rule_alerts(spark, sf_dir))


def sensor_of(ip: str = "src_ip"):
    """The sensor of a flow in a network with one at every client address."""
    return F.concat(F.lit("192.0.2."), F.element_at(F.split(ip, r"\."), -1))


def _sensor_alerts(spark, sf_dir):
    rec = FL.flow_records(read_packets(spark, sf_dir), CAPTURE_WINDOW)
    return AL.alert_records(AL.gate(AP.score_records_by_rule(rec, CAPTURE_WINDOW, sensor_of())))


def q_sensor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 with several sensors: 4-second batches, one sensor for each last
    part of the client's address."""
    return AL.node_status(_sensor_alerts(spark, sf_dir))


def q_sensor_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 with several sensors."""
    return AL.kpis(_sensor_alerts(spark, sf_dir))


def q_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and threats per batch (rule-scored flows)."""
    return AL.batch_summary(AP.scored_by_rule(spark, sf_dir, BATCH_WINDOW))


def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict row of every rule-scored flow."""
    return AL.verdicts(AP.scored_by_rule(spark, sf_dir, BATCH_WINDOW))


def q_model_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 → P19 → X1/X3 → T2: flows scored by the trained forest, alert rows
    with the top-3 feature impacts."""
    prep, clf = _trained(spark, sf_dir)
    rec = AP.flow_records(spark, sf_dir, BATCH_WINDOW)
    scored = AP.scored_by_model(rec, prep.transformer, clf, BATCH_WINDOW)
    return AP.model_alerts(spark, scored, clf)


def q_forest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records scored by the fixed forest, alert
    rows with their three largest impacts."""
    return FF.alerts(spark, sf_dir, BATCH_WINDOW)


def q_forest_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, P20–P24 with the impact text, over the fixed forest's alerts."""
    rec = AP.flow_records(spark, sf_dir, BATCH_WINDOW)
    rows = AL.dashboard_rows(FF.explained_alerts(FF.score_records(rec, BATCH_WINDOW)))
    return rows.withColumn("confidence", FF.rounded("confidence"))


# -- streaming ------------------------------------------------------------------

STREAM_WATERMARK = "1 hour"


def q_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1–ST4 / S6 / S8: packets landed as time-ordered files, streamed through
    the stateful flow aggregation (daily windows, 1 hour watermark) and the
    foreachBatch step (counters, rule scorer, gate); a heartbeat after the last
    packet closes every window. Returns the alert rows written by the stream."""
    from flowlens.streaming import live as LV
    return _streamed_alerts(spark, sf_dir, lambda rec: AP.score_records_by_rule(rec, BATCH_WINDOW), LV.gated_alerts)


def q_stream_forest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1–ST4 with a model and impacts: as ``stream_alerts``, scored by the
    fixed forest; every alert carries its three largest impacts."""
    found = _streamed_alerts(spark, sf_dir, lambda rec: FF.score_records(rec, BATCH_WINDOW), FF.explained_alerts)
    return FF.flat_alerts(found)


def _stream(spark: SparkSession, sf_dir: str, score, alerts, window: str = BATCH_WINDOW, per_trigger: int | None = None, buffer=None) -> str:
    """The folder that the live path fills from the landed packets, all at once
    or a few time ranges at a time. A range is landed by many tasks, so the
    stream runs between landings, from its checkpoint, on whole ranges."""
    from flowlens.streaming import live as LV
    land, out, ckpt = (scratch_path(spark, x) for x in ("packets-landing", "live-out", "live-ckpt"))

    def run() -> None:
        LV.run_live(spark, land, out, score, window=window, watermark=STREAM_WATERMARK, alerts=alerts, buffer=buffer, checkpoint=ckpt).awaitTermination()

    if per_trigger is None:
        LV.land_packets(read_packets(spark, sf_dir), land)
    else:
        ranges = LV.time_ranges(write_scratch(read_packets(spark, sf_dir), "packets"))  # read once for each range
        for i, part in enumerate(ranges):
            if i and i % per_trigger == 0:
                run()
            LV.land_range(part, land)
    LV.land_heartbeat(spark, land, window, STREAM_WATERMARK)
    run()
    return out


def _streamed_alerts(spark: SparkSession, sf_dir: str, score, alerts) -> DataFrame:
    return spark.read.parquet(f"{_stream(spark, sf_dir, score, alerts)}/alerts").drop("epoch")


def q_stream_flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1–ST3: flows and host counters as chained stateful operators of one
    stream, records of every window."""
    from flowlens.streaming import live as LV
    land, out = scratch_path(spark, "packets-landing"), scratch_path(spark, "chained-out")
    LV.land_packets(read_packets(spark, sf_dir), land)
    LV.land_heartbeat(spark, land, BATCH_WINDOW, STREAM_WATERMARK)
    LV.run_chained(spark, land, out, BATCH_WINDOW, STREAM_WATERMARK).awaitTermination()
    return spark.read.parquet(f"{out}/records").drop("epoch")


def q_stream_alert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3/T6/S8 on the stream: the buffer of the newest alerts, compacted in
    every epoch, as a new viewer gets it."""
    from flowlens.streaming import live as LV
    from flowlens.streaming import nodes as NO
    buffer = NO.AlertBuffer(spark, scratch_path(spark, "alert-buffer"))
    _stream(spark, sf_dir, lambda rec: AP.score_records_by_rule(rec, BATCH_WINDOW), LV.gated_alerts, per_trigger=2, buffer=buffer)
    return buffer.replay()


def _watched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.streaming import live as LV
    from flowlens.streaming import nodes as NO
    out = _stream(spark, sf_dir, lambda rec: AP.score_records_by_rule(rec, CAPTURE_WINDOW, sensor_of()), LV.gated_alerts, CAPTURE_WINDOW, per_trigger=3)
    nodes = scratch_path(spark, "node-updates")
    NO.run_node_watch(spark, f"{out}/alerts", nodes).awaitTermination()
    return NO.current_nodes(spark, nodes)


def q_stream_sensor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5/A12 on the stream: last seen of each sensor in keyed state, AWAY by
    an event-time timer."""
    from flowlens.streaming import nodes as NO
    return NO.node_status_table(write_scratch(_watched_nodes(spark, sf_dir), "nodes"))


def q_stream_sensor_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5/A11 on the stream: totals and the exact number of sensors, from
    their states."""
    from flowlens.streaming import nodes as NO
    return NO.node_kpis(_watched_nodes(spark, sf_dir))


REGISTRY: dict[str, tuple[Builder, str | None]] = {
    "flows": (q_flows, O.flows_sql()),
    "flow_records": (q_flow_records, O.flow_records_sql()),
    "flow_records_4s": (q_flow_records_4s, O.flow_records_sql(CAPTURE_WINDOW)),
    "labelled_records": (q_labelled_records, OP.labelled_records_sql()),
    "label_counts": (q_label_counts, OP.label_counts_sql()),
    "stratified_split": (q_split, OP.split_sql()),
    "split_summary": (q_split_summary, OP.split_summary_sql()),
    "scaler_params": (q_scaler_params, OP.scaler_params_sql()),
    "onehot_vocabulary": (q_vocabulary, OP.vocabulary_sql()),
    "encoded_records": (q_encoded, OP.encoded_sql()),
    "mutual_information": (q_mutual_info, OP.mutual_info_sql()),
    "selected_features": (q_selected, OP.selected_sql(SELECT_K_QUERY)),
    "knn_information": (q_knn_information, OP.knn_info_sql()),
    "knn_selected_features": (q_knn_selected, OP.knn_selected_sql(SELECT_K_QUERY)),
    "class_weights": (q_class_weights, OP.class_weights_sql()),
    "confusion_matrix": (q_confusion, OP.confusion_sql()),
    "class_report": (q_class_report, OP.class_report_sql()),
    "summary_metrics": (q_summary_metrics, OP.summary_sql()),
    "model_predictions": (q_model_predictions, None),
    "model_summary": (q_model_summary, None),
    "boosted_summary": (q_boosted_summary, None),
    "boosted_first_round": (q_boosted_first_round, OB.first_round_sql()),
    "boosted_shapley_check": (q_boosted_shapley_check, OX.rows_per_class_sql()),
    "forest_importance": (q_forest_importance, None),
    "training_run": (q_training_run, None),
    "binary_detector": (q_binary_detector, None),
    "shap_values": (q_shap_values, None),
    "global_importance": (q_global_importance, None),
    "shap_direction": (q_direction, None),
    "critical_waterfall": (q_critical_waterfall, None),
    "alerts": (q_alerts, OA.alerts_sql()),
    "alert_buffer": (q_alert_buffer, OA.buffer_sql()),
    "dashboard_rows": (q_dashboard, OA.dashboard_sql()),
    "dashboard_filtered": (q_dashboard_filtered, OA.dashboard_filtered_sql(FILTER_CLASS, FILTER_IP)),
    "kpis": (q_kpis, OA.kpis_sql()),
    "kpis_after_clear": (q_kpis_cleared, OA.kpis_sql(CLEARED_AT)),
    "node_status": (q_node_status, OA.node_status_sql()),
    "batch_summary": (q_batch_summary, OA.batch_summary_sql()),
    "verdicts": (q_verdicts, OA.verdicts_sql()),
    "model_alerts": (q_model_alerts, None),
    "stream_alerts": (q_stream_alerts, OA.alerts_sql()),
    "flows_dense": (q_flows_dense, O.flows_sql(packets=O.DENSE_PACKETS_CTE)),
    "flow_records_dense": (q_flow_records_dense, O.flow_records_sql(packets=O.DENSE_PACKETS_CTE)),
    "sensor_status": (q_sensor_status, OA.sensor_status_sql()),
    "sensor_kpis": (q_sensor_kpis, OA.sensor_kpis_sql()),
    "fixed_forest_predictions": (_test_query(FF.predictions), OX.predictions_sql()),
    "fixed_forest_shap_values": (_test_query(FF.long_values), OX.long_values_sql()),
    "fixed_forest_base_values": (_test_query(FF.base_values), OX.base_values_sql()),
    "fixed_forest_class_impacts": (_test_query(FF.predicted_impacts), OX.predicted_impacts_sql()),
    "fixed_forest_top_impacts": (_test_query(FF.top_impacts), OX.top_impacts_sql()),
    "fixed_forest_importance": (_test_query(FF.importance), OX.importance_sql()),
    "fixed_forest_direction": (_test_query(FF.direction), OX.direction_sql()),
    "fixed_forest_waterfall": (_test_query(FF.waterfall), OX.waterfall_sql()),
    "fixed_forest_critical_case": (_test_query(FF.critical_case), OX.critical_case_sql()),
    "fixed_forest_alerts": (q_forest_alerts, OA.forest_alerts_sql()),
    "fixed_forest_dashboard": (q_forest_dashboard, OA.forest_dashboard_sql()),
    "stream_fixed_forest_alerts": (q_stream_forest_alerts, OA.forest_alerts_sql()),
    "stream_flow_records": (q_stream_flow_records, O.flow_records_sql()),
    "stream_alert_replay": (q_stream_alert_replay, OA.buffer_sql()),
    "stream_sensor_status": (q_stream_sensor_status, OA.sensor_status_sql()),
    "stream_sensor_kpis": (q_stream_sensor_kpis, OA.sensor_kpis_sql()),
    "csv_records": (ST.csv_records, OS.csv_records_sql()),
    "processed_table": (ST.processed_table, OS.processed_table_sql()),
    "saved_model_check": (ST.saved_model_check, OX.rows_per_class_sql()),
    "linear_attribution": (ST.linear_attribution, OS.linear_attribution_sql()),
    "linear_detector_check": (ST.linear_detector_check, OX.rows_per_class_sql()),
    "svm_detector_check": (ST.svm_detector_check, OX.rows_per_class_sql()),
    "stored_alerts": (ST.stored_alerts, OS.stored_alerts_sql()),
    "stored_report": (ST.stored_report, OP.class_report_sql()),
    "request_records": (ST.request_records, OS.request_records_sql()),
    "request_stream_check": (ST.request_stream_check, OS.request_stream_sql()),
    "capture_packets": (ST.capture_packets, OS.capture_packets_sql()),
    "normalized_packets": (ST.normalized_packets, OS.NORMALIZED_PACKETS),
    "model_probability_check": (q_probability_check, OX.rows_per_class_sql()),
    "model_shapley_check": (q_shapley_check, OX.rows_per_class_sql()),
}


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

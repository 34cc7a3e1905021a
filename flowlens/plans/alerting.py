"""E3 — the live path in batch form: packets → flow records → score → gate →
explain the gated rows → alert table → buffer, dashboard views, KPIs.

``scored_by_rule`` is the SQL-checkable stand-in for the scoring step (fixed
thresholds on three window counters; confidence = same_srv_rate) so every
view after scoring can be compared with DuckDB. ``scored_by_model`` runs the
trained forest and the Shapley job instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import alerts as AL
from flowlens.operators import explain as XP
from flowlens.operators import flows as FL
from flowlens.operators import model as MO
from flowlens.sources.packets import read_packets

DEFAULT_NODE_IP = "192.0.2.10"


def rule_prediction() -> Column:
    """Stand-in prediction: fixed thresholds on count, serror_rate and
    rerror_rate (integer arithmetic, so both engines agree)."""
    qn = F.col("count").cast("int")
    di = F.round(F.col("serror_rate") * 100).cast("int")
    tx = F.round(F.col("rerror_rate") * 100).cast("int")
    return (F.when(qn >= 45, "dos").when(di >= 9, "probe").when((tx >= 7) & (qn < 10), "r2l")
             .when((di <= 1) & (tx <= 1) & (qn < 15), "u2r").otherwise("normal"))


def batch_cols(rec: DataFrame, window: str, node_ip: str | Column) -> list:
    return [F.col("window_start").alias("batch"), F.col("flow_seq").alias("seq"),
            (F.col("window_start") + F.expr(f"INTERVAL {window}")).alias("alert_ts"),
            (F.lit(node_ip) if isinstance(node_ip, str) else node_ip).alias("node_ip"), "src_ip", "dst_ip"]


def flow_records(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    return FL.flow_records(read_packets(spark, sf_dir), window)


def score_records_by_rule(rec: DataFrame, window: str = "1 day",
                          node_ip: str | Column = DEFAULT_NODE_IP) -> DataFrame:
    """``node_ip``: the sensor's address, or a column with it."""
    return rec.select(*batch_cols(rec, window, node_ip),
                      rule_prediction().alias("prediction"),
                      F.col("same_srv_rate").alias("confidence"))


def scored_by_rule(spark: SparkSession, sf_dir: str, window: str = "1 day",
                   node_ip: str = DEFAULT_NODE_IP) -> DataFrame:
    return score_records_by_rule(flow_records(spark, sf_dir, window), window, node_ip)


def rule_alerts(spark: SparkSession, sf_dir: str, window: str = "1 day") -> DataFrame:
    return AL.alert_records(AL.gate(scored_by_rule(spark, sf_dir, window)))


def scored_by_model(rec: DataFrame, transformer, clf: MO.Classifier, window: str,
                    node_ip: str = DEFAULT_NODE_IP) -> DataFrame:
    """M9 on flow records: keeps batch/seq/IPs, the selected encoded features,
    prediction index and name, class probabilities and confidence."""
    base = rec.select(*batch_cols(rec, window, node_ip), *K.ATTRIBUTE_COLUMNS)
    return MO.score_records(base, transformer, clf,
                            keep=["batch", "seq", "alert_ts", "node_ip", "src_ip", "dst_ip"])


#: Scored columns that an alert row is made of, and the predicted class's index.
ALERT_INPUTS = ["batch", "seq", "alert_ts", "node_ip", "src_ip", "dst_ip", "prediction", "confidence", MO.PREDICTION]


def explained_alerts(gated: DataFrame, features: list[str], table: XP.LeafTable) -> DataFrame:
    """X1 (gated rows only) → X3 → T2 → alert rows with the top-3 feature →
    impact map (D9), for batch, stream and request files. The alert's columns
    pass through the explainer: no join, no shuffle after the gate."""
    sv = XP.shap_values(gated, features, table, keep=ALERT_INPUTS)
    return AL.alert_records(XP.with_top_impacts(sv, features, MO.PREDICTION, K.TOP_IMPACTS), features_col="features")


def model_alerts(spark: SparkSession, scored: DataFrame, clf: MO.Classifier) -> DataFrame:
    """P19 and the explained alerts of rows scored by the trained forest."""
    table = XP.build_leaf_table(spark, clf.forest, len(clf.features))
    return explained_alerts(AL.gate(scored), clf.features, table)

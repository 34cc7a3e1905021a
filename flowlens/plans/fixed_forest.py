"""A small forest with given nodes, so that scoring and explanation can be
compared with DuckDB: the trees are fixed, every row of the tables is scored
and explained through the library's own operators.

A tree is ``(feature, threshold, left, right)``; a leaf is the weighted count
of each class there. Rows with a null feature go right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import alerts as AL
from flowlens.operators import explain as XP
from flowlens.operators import model as MO
from flowlens.plans import alerting as AP
from flowlens.sources import records as RC

FEATURES = ["count", "serror_rate", "rerror_rate"]
LABELS = ["dos", "normal", "probe", "r2l", "u2r"]

TREES = [
    ("count", 39.5,
     ("serror_rate", 0.085, [3, 173, 2, 23, 151], [1, 29, 311, 5, 2]),
     ("rerror_rate", 0.045, [257, 13, 9, 1, 1], [219, 7, 17, 3, 2])),
    ("serror_rate", 0.015,
     ("rerror_rate", 0.015, [41, 67, 1, 2, 173], [59, 283, 3, 31, 11]),
     ("serror_rate", 0.085, [97, 389, 7, 19, 5], [71, 13, 353, 3, 1])),
    ("rerror_rate", 0.065,
     ("count", 19.5, [2, 203, 61, 7, 249], [181, 337, 73, 5, 3]),
     ("count", 9.5, [1, 31, 17, 227, 11], [103, 139, 37, 6, 4])),
]


def class_counts(tree) -> list[float]:
    """Weighted count of each class under a node."""
    if isinstance(tree, list):
        return [float(n) for n in tree]
    return [a + b for a, b in zip(class_counts(tree[2]), class_counts(tree[3]), strict=True)]


def _nodes(tree) -> dict[int, dict]:
    """The tree as rows of a saved forest (node id -> node data)."""
    nodes: dict[int, dict] = {}

    def add(t) -> int:
        nid = len(nodes)
        nodes[nid] = {"leftChild": -1, "rightChild": -1, "impurityStats": class_counts(t)}
        if not isinstance(t, list):
            nodes[nid]["split"] = {"featureIndex": FEATURES.index(t[0]), "numCategories": -1,
                                   "leftCategoriesOrThreshold": [t[1]]}
            nodes[nid]["leftChild"] = add(t[2])
            nodes[nid]["rightChild"] = add(t[3])
        return nid

    add(tree)
    return nodes


def leaf_table() -> XP.LeafTable:
    return XP.leaf_table({i: _nodes(t) for i, t in enumerate(TREES)}, len(FEATURES), len(LABELS))


def _tree_probs(tree) -> Column:
    if isinstance(tree, list):
        total = sum(tree)
        return F.array(*[F.lit(n / total) for n in tree])
    feature, threshold, left, right = tree
    return F.when(F.col(feature) <= threshold, _tree_probs(left)).otherwise(_tree_probs(right))


def predict(rows: DataFrame) -> DataFrame:
    """Adds probs, prediction_index, prediction and confidence."""
    out = rows
    for i, tree in enumerate(TREES):
        out = out.withColumn(f"_t{i}", _tree_probs(tree))
    probs = F.array(*[sum((F.col(f"_t{i}")[c] for i in range(1, len(TREES))), F.col("_t0")[c]) / F.lit(float(len(TREES)))
                      for c in range(len(LABELS))])
    out = out.withColumn("probs", probs).drop(*[f"_t{i}" for i in range(len(TREES))])
    index = F.array_position("probs", F.array_max("probs")) - 1
    return (out.withColumn(MO.PREDICTION, index.cast("double"))
               .withColumn(MO.PREDICTED, F.element_at(F.array(*[F.lit(x) for x in LABELS]), index.cast("int") + 1))
               .withColumn("confidence", F.array_max("probs")))


def score_records(rec: DataFrame, window: str = "1 day") -> DataFrame:
    """M9 on flow records: batch, seq, addresses, features, prediction, confidence."""
    return predict(rec.select(*AP.batch_cols(rec, window, AP.DEFAULT_NODE_IP), *[F.col(c).cast("double") for c in FEATURES]))


def explained_alerts(scored: DataFrame) -> DataFrame:
    """P19 → X1 → X3 → T2 → alert rows with their three largest impacts."""
    return AP.explained_alerts(AL.gate(scored), FEATURES, leaf_table())


# -- registered queries ---------------------------------------------------------

DIGITS = 10


def rounded(c: str | Column) -> Column:
    """To ten decimals, and never the negative zero."""
    r = F.round(F.col(c) if isinstance(c, str) else c, DIGITS)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def explained(test: DataFrame) -> DataFrame:
    """X1/X2 of the rows, with feature values."""
    return XP.shap_values(predict(test), FEATURES, leaf_table(), with_values=True,
                          keep=[*RC.ROW_KEY, K.LABEL_COLUMN, MO.PREDICTED, MO.PREDICTION])


def predictions(test: DataFrame) -> DataFrame:
    return predict(test).select(*RC.ROW_KEY, K.LABEL_COLUMN, MO.PREDICTED, rounded("confidence").alias("confidence"))


def long_values(test: DataFrame) -> DataFrame:
    """Every Shapley value of every class."""
    return (XP.shap_long(explained(test), RC.ROW_KEY, FEATURES, LABELS)
              .select(*RC.ROW_KEY, "class", "feature", rounded("phi").alias("phi"), "feature_value"))


def base_values(test: DataFrame) -> DataFrame:
    """Each row's base value for its predicted class, and base plus all
    impacts, which is its confidence."""
    i = F.col(MO.PREDICTION).cast("int") + 1
    total = F.aggregate(F.element_at("shap", i), F.element_at("base", i), lambda a, x: a + x)
    return explained(test).select(*RC.ROW_KEY, MO.PREDICTED, rounded(F.element_at("base", i)).alias("base_value"),
                                  rounded(total).alias("explained"))


def predicted_impacts(test: DataFrame) -> DataFrame:
    """Impacts on the predicted class."""
    return (XP.predicted_class_impacts(explained(test), FEATURES, MO.PREDICTION)
              .select(*RC.ROW_KEY, MO.PREDICTED, "position", "feature", rounded("impact").alias("impact")))


def top_impacts(test: DataFrame, k: int = 2) -> DataFrame:
    """The k largest impacts on the predicted class, in order."""
    top = XP.with_top_impacts(explained(test), FEATURES, MO.PREDICTION, k)
    return top.select(*RC.ROW_KEY, F.array_join("top_features", ",").alias("top_features"),
                      *[rounded(F.element_at("features", F.element_at("top_features", j + 1))).alias(f"impact_{j + 1}") for j in range(k)])


def importance(test: DataFrame) -> DataFrame:
    """Mean |Shapley value| per class and feature."""
    out = XP.global_importance(explained(test), FEATURES, LABELS)
    return out.withColumn("mean_abs_impact", rounded("mean_abs_impact"))


def direction(test: DataFrame) -> DataFrame:
    """(Shapley value, feature value) of the class dos."""
    out = XP.direction_data(explained(test), RC.ROW_KEY, FEATURES, LABELS.index("dos"))
    return out.withColumn("phi", rounded("phi"))


def waterfall(test: DataFrame) -> DataFrame:
    """Contributions by size with their running total, for every row."""
    out = XP.waterfall_rows(explained(test), RC.ROW_KEY, FEATURES, MO.PREDICTION)
    return out.select(*RC.ROW_KEY, "step", "feature", rounded("impact").alias("impact"),
                      rounded("running_total").alias("running_total"))


def critical_case(test: DataFrame) -> DataFrame:
    """T5: the first critical case; ties by the row's key and features."""
    case = XP.critical_case(predict(test), [*RC.ROW_KEY, *FEATURES])
    return case.select(*RC.ROW_KEY, K.LABEL_COLUMN, MO.PREDICTED, "priority", *FEATURES)


def alerts(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    """M9, P19, X1, X3, T2, D9 over the flow records."""
    return flat_alerts(explained_alerts(score_records(AP.flow_records(spark, sf_dir, window), window)))


def flat_alerts(found: DataFrame) -> DataFrame:
    """Alert rows with the impact map as text in the map's order."""
    text = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat(
        e["key"], F.lit(":"), F.round(e["value"], 6).cast("decimal(9,6)").cast("string"))), " ")
    return found.select(*[c for c in found.columns if c not in ("features", "confidence", "epoch")],
                        rounded("confidence").alias("confidence"), text.alias("features_text"))

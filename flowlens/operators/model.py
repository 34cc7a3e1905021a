"""Classifier training and scoring.

The source trains 5-class boosted trees. MLlib's ``GBTClassifier`` is binary
only and ``OneVsRest`` gives no ``probability`` column (needed for the
confidence), so the default here is a class-weighted
``RandomForestClassifier`` (same depth limit, minimum rows per leaf, row and
column subsampling, seed). It is a different model family; results are not
expected to be identical.

Training rows whose category is ``unknown`` have no class slot and are
filtered out (and counted) before training.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import encode as EN
from flowlens.operators.prepare import with_class_weight

FEATURES = "features"
LABEL_INDEX = "label_index"
PREDICTION = "prediction_index"
PREDICTED = "prediction"
PROBABILITY = "probability"


@dataclass
class TrainParams:
    num_trees: int = 50
    max_depth: int = 10
    min_instances_per_node: int = 20
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    max_bins: int = 32
    seed: int = K.SPLIT_SEED
    # more node statistics per pass over the data → fewer passes per level
    max_memory_mb: int = 1024
    # node ids of a row are as large as its bins and copied on each pass: they
    # push the rows out of memory, and finding a row's node anew is cheaper
    cache_node_ids: bool = False
    checkpoint_interval: int = 10
    # MLlib keeps about 500 bytes of a row in memory (bins, and a count for each
    # tree), however small its file is: a task holds this many rows at most
    rows_per_task: int = 1 << 19


@dataclass
class Classifier:
    """A fitted scoring model: encoded feature names, class labels (index order)
    and the MLlib pipeline (assembler → forest → label decoder)."""
    features: list[str]
    labels: list[str]
    pipeline: PipelineModel
    n_unknown_dropped: int = 0

    @property
    def forest(self) -> RandomForestClassificationModel:
        return self.pipeline.stages[1]

    def predict(self, encoded: DataFrame) -> DataFrame:
        """Adds prediction_index, prediction (class name),
        probability (vector), probs (array) and confidence."""
        out = self.pipeline.transform(encoded)
        probs = vector_to_array(F.col(PROBABILITY))
        return (out.withColumn("probs", probs)
                   .withColumn("confidence", F.element_at("probs", F.col(PREDICTION).cast("int") + 1))
                   .drop("rawPrediction", FEATURES))

    def save(self, path: str) -> None:
        """The MLlib pipeline plus a one-row JSON document with names."""
        spark = SparkSession.getActiveSession()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = json.dumps({"features": self.features, "labels": self.labels})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        return Classifier(meta["features"], meta["labels"], PipelineModel.load(f"{path}/pipeline"))


def train_classifier(train_encoded: DataFrame, features: list[str],
                     label_col: str = K.LABEL_COLUMN, params: TrainParams | None = None) -> Classifier:
    """M5 + A6 + M6. One aggregation gives the class counts; from them the
    alphabetical label index (an unseen label at transform is an error), the
    balanced weights n/(k·n_c) and the number of ``unknown`` rows dropped."""
    p = params or TrainParams()
    counts = {r[0]: r[1] for r in train_encoded.groupBy(label_col).count().collect()}  # one row per class
    n_unknown = counts.pop(K.UNKNOWN_CATEGORY, 0)
    labels = sorted(c for c in counts if c is not None)
    total, k = sum(counts[c] for c in labels), len(labels)
    weights = F.create_map(*[x for c in labels for x in (F.lit(c), F.lit(total / (k * counts[c])))])
    known = train_encoded.filter(F.col(label_col) != K.UNKNOWN_CATEGORY)
    indexer = StringIndexerModel.from_labels(labels, inputCol=label_col, outputCol=LABEL_INDEX,
                                             handleInvalid="error")
    rows = indexer.transform(known).withColumn("weight", F.element_at(weights, F.col(label_col)))
    assembler = VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL_INDEX, weightCol="weight",
                                predictionCol=PREDICTION, probabilityCol=PROBABILITY,
                                numTrees=p.num_trees, maxDepth=p.max_depth,
                                minInstancesPerNode=p.min_instances_per_node,
                                subsamplingRate=p.subsampling_rate,
                                featureSubsetStrategy=p.feature_subset, maxBins=p.max_bins,
                                seed=p.seed, maxMemoryInMB=p.max_memory_mb,
                                cacheNodeIds=p.cache_node_ids,
                                checkpointInterval=p.checkpoint_interval)
    assembled = assembler.transform(rows).select(FEATURES, LABEL_INDEX, "weight")
    tasks, cores = -(-total // p.rows_per_task), rows.sparkSession.sparkContext.defaultParallelism
    if tasks > cores:  # fewer: files are split by cores
        # whole rounds of all cores; kept, or MLlib's log and summary would encode and deal the rows once more each
        dealt = assembled.repartition(-(-tasks // cores) * cores).persist(StorageLevel.DISK_ONLY)
        forest = rf.fit(dealt)
        dealt.unpersist()
    else:
        forest = rf.fit(assembled)
    if k <= 2:
        forest = without_summary(rows.sparkSession, forest)
    decoder = IndexToString(inputCol=PREDICTION, outputCol=PREDICTED, labels=labels)
    pipe = PipelineModel(stages=[assembler, forest, decoder])
    return Classifier(list(features), labels, pipe, n_unknown)


def without_summary(spark: SparkSession, model):
    """The model saved and loaded. A fitted model of two classes holds its
    training summary, and with it the session, which can't be sent to tasks
    once the session has observed a query or run a stream."""
    from flowlens.session import drop_scratch, scratch_path
    path = scratch_path(spark, "fitted")
    model.write().save(path)
    loaded = type(model).load(path)
    drop_scratch(spark, path)
    return loaded


def count_unknown(train_encoded: DataFrame, label_col: str = K.LABEL_COLUMN) -> int:
    return train_encoded.filter(F.col(label_col) == K.UNKNOWN_CATEGORY).count()


# -- scoring raw records (M9) ---------------------------------------------------

def score_records(records: DataFrame, transformer: EN.ColumnTransformer, clf: Classifier,
                  keep: list[str]) -> DataFrame:
    """M9: raw 41-attribute records → encode (P16: selected features by name,
    absent ones 0.0) → predict. ``keep`` columns pass through."""
    enc = transformer.transform_selected(records, clf.features, keep=keep)
    return clf.predict(enc)


# -- persisted transformer state (S4/S5) ----------------------------------------

def save_transformer(spark: SparkSession, tr: EN.ColumnTransformer, selected: list[str], path: str) -> None:
    """Selected-feature list and fitted transformer state as JSON tables."""
    s = tr.scaler
    doc = {"numeric": s.columns, "q1": s.q1, "median": s.median, "q3": s.q3,
           "x_min": s.x_min, "x_max": s.x_max, "nominal": tr.vocab.columns,
           "values": tr.vocab.values}
    spark.createDataFrame([(json.dumps(doc),)], "state string").coalesce(1) \
         .write.mode("overwrite").json(f"{path}/transformer")
    spark.createDataFrame(list(enumerate(selected)), "position int, feature string") \
         .coalesce(1).write.mode("overwrite").json(f"{path}/selected_features")


def load_transformer(spark: SparkSession, path: str) -> tuple[EN.ColumnTransformer, list[str]]:
    doc = json.loads(spark.read.json(f"{path}/transformer").first()["state"])
    scaler = EN.ScalerParams(doc["numeric"], doc["q1"], doc["median"], doc["q3"],
                             doc["x_min"], doc["x_max"])
    vocab = EN.Vocabulary(doc["nominal"], doc["values"])
    sel = [r["feature"] for r in spark.read.json(f"{path}/selected_features")
           .orderBy("position").collect()]
    return EN.ColumnTransformer(scaler, vocab), sel


# -- M10 / M11 ----------------------------------------------------------------

def binary_label(label_col: str = K.LABEL_COLUMN):
    """The normal / anomaly view of a label or prediction (1.0 = anomaly)."""
    return (~F.lower(F.col(label_col)).isin(*K.NORMAL_PREDICTIONS)).cast("double")


def train_binary(train_encoded: DataFrame, features: list[str], label_col: str = K.LABEL_COLUMN,
                 kind: str = "logistic", max_iter: int = 50):
    """Binary normal/anomaly detector (logistic regression or linear SVM)
    over the encoded features, class-weighted like the multi-class model."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    rows = with_class_weight(train_encoded.withColumn("_y", binary_label(label_col)), "_y", "weight")
    assembler = VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="keep")
    est = (LogisticRegression(maxIter=max_iter) if kind == "logistic" else LinearSVC(maxIter=max_iter))
    est = est.setFeaturesCol(FEATURES).setLabelCol("_y").setWeightCol("weight")
    model = without_summary(rows.sparkSession, est.fit(assembler.transform(rows)))
    return PipelineModel(stages=[assembler, model])


def forest_importance(clf: Classifier, k: int = 9) -> DataFrame:
    """The forest's feature importances, top k (ties by feature order).
    One value per feature, held by the model."""
    spark = SparkSession.getActiveSession()
    imp = clf.forest.featureImportances.toArray().tolist()
    rows = [(i, f, float(v)) for i, (f, v) in enumerate(zip(clf.features, imp))]
    df = spark.createDataFrame(rows, "position int, feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("position")).limit(k)


# -- M6, boosted form: one-vs-rest gradient-boosted trees -----------------------

@dataclass
class BoostParams:
    # the source's n_estimators, max_depth and learning_rate
    rounds: int = 300
    max_depth: int = 10
    step_size: float = 0.03
    min_instances_per_node: int = 20
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    max_bins: int = 32
    seed: int = K.SPLIT_SEED
    max_memory_mb: int = 1024
    cache_node_ids: bool = True
    checkpoint_interval: int = 10


@dataclass
class BoostedClassifier:
    """One MLlib gradient-boosted tree model per class (class vs rest, logistic
    loss). Class c's raw margin m_c = Σ_t w_t·tree_t(x); its one-vs-rest
    probability 1/(1+e^(−2·m_c)); the class probabilities are those
    normalised to sum to 1. Not the softmax boosting of the source — MLlib
    has no multi-class boosting — but the same family, and its margins are
    what a tree explainer of boosted models explains."""
    features: list[str]
    labels: list[str]
    models: list
    n_unknown_dropped: int = 0

    def predict(self, encoded: DataFrame) -> DataFrame:
        """Adds margins, probs, prediction_index, prediction and confidence."""
        out = VectorAssembler(inputCols=self.features, outputCol=FEATURES,
                              handleInvalid="keep").transform(encoded)
        for c, m in enumerate(self.models):
            m = m.copy().setFeaturesCol(FEATURES).setRawPredictionCol(f"_raw{c}") \
                 .setProbabilityCol(f"_p{c}").setPredictionCol(f"_y{c}")
            out = (m.transform(out)
                    .withColumn(f"_m{c}", F.element_at(vector_to_array(F.col(f"_raw{c}")), 2))
                    .drop(f"_raw{c}", f"_p{c}", f"_y{c}"))
        k = len(self.models)
        margins = F.array(*[F.col(f"_m{c}") for c in range(k)])
        ovr = F.transform(margins, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
        out = (out.withColumn("margins", margins).withColumn("_ovr", ovr)
                  .withColumn("probs", F.transform("_ovr", lambda p: p / F.aggregate("_ovr", F.lit(0.0), lambda a, b: a + b))))
        idx = F.array_position("probs", F.array_max("probs")) - 1
        return (out.withColumn(PREDICTION, idx.cast("double"))
                   .withColumn(PREDICTED, F.element_at(F.array(*[F.lit(x) for x in self.labels]), idx.cast("int") + 1))
                   .withColumn("confidence", F.array_max("probs"))
                   .drop("_ovr", FEATURES, *[f"_m{c}" for c in range(k)]))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        for c, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/class_{c}")
        meta = json.dumps({"features": self.features, "labels": self.labels})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedClassifier:
        from pyspark.ml.classification import GBTClassificationModel
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        models = [GBTClassificationModel.load(f"{path}/class_{c}") for c in range(len(meta["labels"]))]
        return BoostedClassifier(meta["features"], meta["labels"], models)


def train_boosted(train_encoded: DataFrame, features: list[str], label_col: str = K.LABEL_COLUMN,
                  params: BoostParams | None = None) -> BoostedClassifier:
    """M6 (boosted): class counts → labels and balanced weights (one
    aggregation), the assembled rows written once, then one boosted model per
    class with the class as the positive label, the classes side by side."""
    from multiprocessing.pool import ThreadPool
    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import GBTClassifier
    from flowlens.session import write_scratch
    p = params or BoostParams()
    counts = {r[0]: r[1] for r in train_encoded.groupBy(label_col).count().collect()}  # one row per class
    n_unknown = counts.pop(K.UNKNOWN_CATEGORY, 0)
    labels = sorted(c for c in counts if c is not None)
    total, k = sum(counts[c] for c in labels), len(labels)
    weights = F.create_map(*[x for c in labels for x in (F.lit(c), F.lit(total / (k * counts[c])))])
    rows = (train_encoded.filter(F.col(label_col) != K.UNKNOWN_CATEGORY)
                         .withColumn("weight", F.element_at(weights, F.col(label_col))))
    rows = VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="keep").transform(rows)
    rows = write_scratch(rows.select(FEATURES, label_col, "weight"), "boost-train")   # read once per class

    def fit(lab):
        gbt = GBTClassifier(featuresCol=FEATURES, labelCol="_y", weightCol="weight",
                            maxIter=p.rounds, maxDepth=p.max_depth, stepSize=p.step_size,
                            minInstancesPerNode=p.min_instances_per_node,
                            subsamplingRate=p.subsampling_rate, featureSubsetStrategy=p.feature_subset,
                            maxBins=p.max_bins, seed=p.seed, maxMemoryInMB=p.max_memory_mb,
                            cacheNodeIds=p.cache_node_ids, checkpointInterval=p.checkpoint_interval)
        return gbt.fit(rows.withColumn("_y", (F.col(label_col) == lab).cast("double")))

    # the rounds of a class wait for each other, the classes do not
    with ThreadPool(max(1, k)) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), labels)
    return BoostedClassifier(list(features), labels, models, n_unknown)

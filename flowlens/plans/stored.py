"""What the library writes, read back: files, tables, models and alert tables
(S1–S5, S7, S8, S10), and the conforming of packets and requests (P7, P16).
Each function takes ``(spark, sf_dir)`` and works on the whole stand-in table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import encode as EN
from flowlens.operators import linear as LI
from flowlens.operators import metrics as ME
from flowlens.operators import model as MO
from flowlens.operators import prepare as PR
from flowlens.plans import alerting as AP
from flowlens.plans import prepare as PP
from flowlens.session import scratch_path, write_scratch
from flowlens.sources import packets as PK
from flowlens.sources import records as RC
from flowlens.sources import requests as RQ

#: Columns read back from a processed table: numeric, one-hot, and one that no training row has.
READ_BACK = ["src_bytes", "count", "serror_rate", "protocol_type_A", "protocol_type_N", "flag_F", "service_1-URGENT"]
ABSENT = "service_no_such_service"
#: Coefficients of the linear check, over raw attributes.
COEFFICIENTS = {"src_bytes": 0.00002, "count": -0.05, "serror_rate": 12.5, "rerror_rate": -7.0, "num_root": 0.3}
INTERCEPT = 0.25
CLEARED_AT = "2024-01-15 00:00:00"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PP.labelled_split(RC.read_records(spark, sf_dir), PP.record_split_key())


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1–P3: the records written as a headerless CSV of 43 columns, read
    back and labelled."""
    path = scratch_path(spark, "connection-csv")
    RC.write_connection_csv(RC.read_records(spark, sf_dir), path)
    return PR.label_records(RC.read_connection_csv(spark, path)).select(*K.ATTRIBUTE_COLUMNS, K.LABEL_COLUMN)


def processed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded test rows and the fitted state written, both read
    back; the features are those of the stored list, one of them absent."""
    split = _split(spark, sf_dir)
    tr = EN.fit_transformer(split.where(~F.col(PP.SPLIT_COL)), K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS)
    out = scratch_path(spark, "processed")
    MO.save_transformer(spark, tr, [*READ_BACK, ABSENT], f"{out}/model")
    again, selected = MO.load_transformer(spark, f"{out}/model")
    encoded = again.transform_selected(split.where(PP.SPLIT_COL), selected, keep=[K.LABEL_COLUMN])
    RC.write_processed(encoded, f"{out}/test")
    return RC.read_processed(spark, f"{out}/test", selected).toDF(*[f"f{i}" for i in range(len(selected))], "label")


def saved_model_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest saved and loaded: test rows per class, and how many
    get the same class and probabilities from both."""
    prep = PP.prepare_records(spark, sf_dir)
    clf = MO.train_classifier(prep.train_rows, prep.selected)
    path = scratch_path(spark, "saved-model")
    clf.save(path)
    first = clf.predict(prep.test_rows).withColumnsRenamed({"prediction": "first", "probs": "first_probs"}).drop(MO.PREDICTION, MO.PROBABILITY, "confidence")
    both = MO.Classifier.load(spark, path).predict(first)
    same = (F.col("first") == F.col("prediction")) & (F.col("first_probs") == F.col("probs"))
    return both.groupBy(K.LABEL_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_holds"))


def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 with given coefficients: the share of every feature in the margin of
    every test row, against the mean training row."""
    split = _split(spark, sf_dir)
    model = LI.linear_model(list(COEFFICIENTS), list(COEFFICIENTS.values()), INTERCEPT, split.where(~F.col(PP.SPLIT_COL)))
    got = LI.with_attribution(split.where(PP.SPLIT_COL), model)
    long = LI.long_impacts(got, [*RC.ROW_KEY, "base", "margin"], model.features)
    return long.select(*RC.ROW_KEY, "feature", *[F.round(c, 6).alias(c) for c in ("impact", "base", "margin")])


def linear_detector_check(spark: SparkSession, sf_dir: str, kind: str = "logistic") -> DataFrame:
    """M10 + X7: test rows per class, and how many have base plus shares equal
    to the margin of the trained detector, and the class that its sign says."""
    prep = PP.prepare_records(spark, sf_dir)
    detector = MO.train_binary(prep.train_rows.where(F.col(K.LABEL_COLUMN) != K.UNKNOWN_CATEGORY), prep.selected, kind=kind)
    scored = detector.transform(LI.with_attribution(prep.test_rows, LI.of_detector(detector, prep.selected, prep.train_rows)))
    from pyspark.ml.functions import vector_to_array
    raw = F.element_at(vector_to_array("rawPrediction"), 2)
    holds = (F.abs(raw - F.col("margin")) < 1e-6 * (1 + F.abs(raw))) & ((F.col("prediction") == 1) == (raw > 0))
    return scored.groupBy(K.LABEL_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.count_if(holds).alias("n_holds"))


def svm_detector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 with a linear support vector machine, as ``linear_detector_check``."""
    return linear_detector_check(spark, sf_dir, "svm")


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts appended in two batches, one of them twice, and those
    after a clear read from the day partitions."""
    rows = write_scratch(AP.rule_alerts(spark, sf_dir, "1 day"), "alerts")
    path = scratch_path(spark, "alert-table")
    for part in (0, 1, 1):
        RQ.append_alerts(rows.where(F.col("seq") % 2 == part), path, f"part-{part}")
    return RQ.read_alerts(spark, path, since=CLEARED_AT).drop("features", "alert_date")


def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records sent as JSON requests, read back by name."""
    path = scratch_path(spark, "requests")
    RQ.write_requests(RQ.requests_from_records(AP.flow_records(spark, sf_dir, "1 day"), AP.DEFAULT_NODE_IP), path)
    got = RQ.request_records(RQ.read_requests(spark, path))
    return got.select("node_ip", "src_ip", "dst_ip", "timestamp", *K.ATTRIBUTE_COLUMNS)


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class report of the rule's test predictions, written and
    read back."""
    test = _split(spark, sf_dir).where(PP.SPLIT_COL)
    conf = write_scratch(ME.confusion_long(test.select(K.LABEL_COLUMN, AP.rule_prediction().alias("prediction"))), "confusion")
    path = scratch_path(spark, "report")
    ME.write_report(spark, ME.class_report(conf), ME.summary(conf), path)
    report = spark.read.schema("class string, precision double, recall double, f1 double, support long").json(f"{path}/class_report")
    return report


def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets, and a frame without IP beside every seventh,
    written as capture files and read back by a stream."""
    from flowlens.sources import captures as CA
    packets = PK.read_packets(spark, sf_dir)
    noise = packets.where(F.col("event_id") % 7 == 0).withColumn("proto", F.lit(None).cast("string"))
    path, out = scratch_path(spark, "captures"), scratch_path(spark, "captured")
    CA.write_captures(packets.unionByName(noise), path).write.mode("overwrite").parquet(f"{out}-names")
    q = (CA.capture_stream(spark, path, max_files_per_trigger=3).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "captures-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(PK.PACKET_SCHEMA).parquet(out).drop("event_id")


def normalized_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded capture rows, one for each event and some without IP, into
    the packet schema."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    raw = e.select("event_id", "ts", (n % 7 != 0).alias("has_ip"), (n % 4 == 0).alias("has_tcp"), (n % 6 == 1).alias("has_udp"), (n % 3 == 2).alias("has_icmp"),
                   (n % 1500 + 40).alias("bytes"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip_src"), F.lit("10.0.1.1").alias("ip_dst"),
                   (n % 60000).cast("int").alias("port_src"), F.lit(80).alias("port_dst"), F.when(n % 8 != 0, "S").alias("tcp_flags"), F.col("event_type").cast("binary").alias("payload"))
    got = PK.normalize_packets(raw.select(*[F.col(f.name).cast(f.dataType) for f in PK.RAW_PACKET_SCHEMA.fields]))
    return got.withColumn("payload", F.col("payload").cast("string"))


def request_stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, M9, S8 as they arrive: every flow sent as a request and scored by a
    saved model in the stream; flows per day, and for how many the stream's
    alert is that of the same model in batch."""
    from flowlens.operators import flows as FL
    from flowlens.plans import serve as SV
    prep = PP.prepare_records(spark, sf_dir)
    clf = MO.train_classifier(prep.train_rows, prep.selected, params=MO.TrainParams(num_trees=10))
    model, out, land = (scratch_path(spark, x) for x in ("model", "served", "requests"))
    clf.save(model)
    MO.save_transformer(spark, prep.transformer, prep.selected, model)
    rec = write_scratch(FL.flow_records(PK.read_packets(spark, sf_dir), "1 day"), "records").withColumn("node", F.concat(F.lit("flow-"), F.col("flow_seq")))
    sent = RQ.requests_from_records(rec, "", node=F.col("node"))
    sent.repartition(4).write.json(land)
    SV.run_request_stream(spark, land, model, out, max_files_per_trigger=2).awaitTermination()
    mine = MO.score_records(rec, prep.transformer, clf, keep=["window_start", "node"]).select(
        "window_start", "node", F.col("prediction").alias("p"), F.col("confidence").alias("c"))
    got = RQ.read_alerts(spark, f"{out}/alerts").select(F.col("node_ip").alias("node"), "prediction", "confidence")
    both = mine.join(got, "node", "left")
    same = (F.col("p") == F.col("prediction")) & (F.abs(F.col("c") - F.col("confidence")) < 1e-12)
    # a row that is no threat has an alert only as the first of its batch
    holds = F.when(F.lower("p").isin(*K.NORMAL_PREDICTIONS), F.col("prediction").isNull() | same).otherwise(F.coalesce(same, F.lit(False)))
    return both.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.count_if(holds).alias("n_holds"))

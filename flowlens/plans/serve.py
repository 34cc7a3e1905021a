"""E3 — scoring of score requests with saved artifacts, in batch and as they
arrive.

The service's batch endpoint as a Spark job: read request files (S7), bind
the features by name (P16), score with the saved transformer and model (S4,
S5, M9), gate (P18, P19), explain only the gated rows (X1, X3), keep the top
three impacts (T2), append alert rows (S8) and publish every verdict (S9).
A request file is one batch; an empty file yields no rows.

``run_request_stream`` does the same with every file that lands: the model is
loaded once, each epoch's outputs lie in folders of its own, replaced when the
epoch is replayed, and the newest alerts go to a buffer (T3).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import alerts as AL
from flowlens.operators import encode as EN
from flowlens.operators import explain as XP
from flowlens.operators import model as MO
from flowlens.plans import alerting as AP
from flowlens.session import scratch_path, write_scratch
from flowlens.sources import requests as RQ
from flowlens.streaming.nodes import AlertBuffer

KEPT = ["batch", "seq", "alert_ts", "node_ip", "src_ip", "dst_ip"]


@dataclass(frozen=True)
class Service:
    """A saved model, loaded once for many batches."""
    transformer: EN.ColumnTransformer
    model: MO.Classifier
    leaves: XP.LeafTable

    @staticmethod
    def load(spark: SparkSession, model_dir: str) -> Service:
        tr, _ = MO.load_transformer(spark, model_dir)
        clf = MO.Classifier.load(spark, model_dir)
        return Service(tr, clf, XP.build_leaf_table(spark, clf.forest, len(clf.features)))

    def score(self, requests: DataFrame) -> DataFrame:
        """Scored rows of requests with ``_file``, one batch for each file."""
        # request order: increasing within a file (and across the splits of a file)
        req = requests.withColumn("_row", F.monotonically_increasing_id())
        rec = RQ.request_records(req, keep=["_file", "_row"])
        base = rec.select(F.col("_file").alias("batch"), F.col("_row").alias("seq"), F.col("request_ts").alias("alert_ts"),
                          "node_ip", "src_ip", "dst_ip", *K.ATTRIBUTE_COLUMNS)
        base = write_scratch(base, "requests")        # fixes row ids before they are reused
        return write_scratch(MO.score_records(base, self.transformer, self.model, keep=KEPT), "served-scored")

    def alerts(self, scored: DataFrame) -> DataFrame:
        return write_scratch(AP.explained_alerts(AL.gate(scored), self.model.features, self.leaves), "served-alerts")

    def publish(self, requests: DataFrame, out_dir: str, batch_id: str | None) -> DataFrame:
        """Scores a batch and writes its alerts, verdicts and rejected requests."""
        scored = self.score(requests)
        alerts = self.alerts(scored)
        RQ.append_alerts(alerts, f"{out_dir}/alerts", batch_id)
        RQ.publish_verdicts(AL.verdicts(scored), f"{out_dir}/verdicts", batch_id)
        rejected = RQ.rejected_requests(requests.drop("_file"))
        rejected.write.mode("overwrite").json(f"{out_dir}/rejected/write={batch_id or 'all'}")
        return alerts


def with_file(requests: DataFrame) -> DataFrame:
    return requests.select("*", F.col("_metadata.file_path").alias("_file"))


def score_request_files(spark: SparkSession, requests_path: str, model_dir: str,
                        out_dir: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Alert rows for the requests under ``requests_path`` (one file = one
    batch). Rows whose fields do not parse are scored with those fields absent
    and also written to ``rejected``; a rerun with the same ``batch_id``
    replaces its outputs."""
    service = Service.load(spark, model_dir)
    requests = with_file(RQ.read_requests(spark, requests_path))
    return service.publish(requests, out_dir, batch_id) if out_dir else service.alerts(service.score(requests))


def run_request_stream(spark: SparkSession, requests_path: str, model_dir: str, out_dir: str, checkpoint: str | None = None,
                       available_now: bool = True, max_files_per_trigger: int | None = None, buffer: AlertBuffer | None = None):
    """Start the query: request files as they land, scored by the saved model."""
    service = Service.load(spark, model_dir)

    def epoch(batch: DataFrame, number: int) -> None:
        requests = write_scratch(batch, "epoch-requests")  # read for the scores and for what is rejected
        alerts = service.publish(requests, out_dir, f"epoch-{number}")
        if buffer is not None:
            buffer.add(alerts, number)

    stream = with_file(RQ.read_request_stream(spark, requests_path, max_files_per_trigger))
    w = stream.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "requests-ckpt")).foreachBatch(epoch)
    return (w.trigger(availableNow=True) if available_now else w).start()

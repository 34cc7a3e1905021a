"""Score requests (D8) and alert sinks.

A request is ``{node_ip, src_ip="0.0.0.0", dst_ip="0.0.0.0", timestamp
(text), features: {attribute: value}}``. Requests are read as JSON lines
with an explicit schema; the features map is projected onto the 41 typed
attributes by name (an absent attribute becomes 0.0 / null), so the column
order of the request does not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import constants as K

REQUEST_SCHEMA = T.StructType([
    T.StructField("node_ip", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.StringType())),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("node_ip", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines requests with the fixed schema (no inference)."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def read_request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S7, streaming: request files as they land."""
    r = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def _request_time():
    """The agent's time format, or null."""
    t = F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.col("timestamp"))
    return t.try_cast("timestamp_ntz")


def rejected_requests(req: DataFrame) -> DataFrame:
    """Requests with a timestamp or numeric attribute that does not parse, and
    the names of those fields (``bad_fields``), for an error table."""
    bad = [F.when(F.col("timestamp").isNotNull() & _request_time().isNull(), F.lit("timestamp"))]
    for c in K.ATTRIBUTE_COLUMNS:
        if c not in K.NOMINAL_COLUMNS:
            v = F.element_at(F.col("features"), F.lit(c))
            bad.append(F.when(v.isNotNull() & v.try_cast("double").isNull(), F.lit(c)))
    return req.withColumn("bad_fields", F.array_compact(F.array(*bad))).where(F.size("bad_fields") > 0)


def request_records(req: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Requests → node/src/dst/timestamp + the 41 attributes, bound by name.
    IP defaults are applied here; ``keep`` columns pass through. The timestamp
    stays the text it is; ``request_ts`` is its value, null where it is not in
    the agent's format. Numbers that do not parse count as absent;
    ``rejected_requests`` returns those rows."""
    attrs = []
    for c in K.ATTRIBUTE_COLUMNS:
        v = F.element_at(F.col("features"), F.lit(c))
        if c in K.NOMINAL_COLUMNS:
            attrs.append(v.alias(c))
        else:
            attrs.append(F.coalesce(v.try_cast("double"), F.lit(0.0)).alias(c))
    return req.select(
        *(keep or []), "node_ip",
        F.coalesce(F.col("src_ip"), F.lit("0.0.0.0")).alias("src_ip"),
        F.coalesce(F.col("dst_ip"), F.lit("0.0.0.0")).alias("dst_ip"),
        "timestamp",
        _request_time().alias("request_ts"),
        *attrs)


def requests_from_records(rec: DataFrame, node_ip: str, ts_col: str = "window_start", node: Column | None = None) -> DataFrame:
    """The agent side: flow records → request documents (one JSON object per
    flow, features keyed by attribute name), from one sensor, or that which the
    column ``node`` names."""
    feats = F.create_map(*[x for c in K.ATTRIBUTE_COLUMNS
                           for x in (F.lit(c), F.col(c).cast("string"))])
    return rec.select((F.lit(node_ip) if node is None else node).alias("node_ip"), "src_ip", "dst_ip",
                      F.date_format(F.col(ts_col), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                      feats.alias("features"))


def write_requests(req: DataFrame, path: str) -> None:
    req.write.mode("overwrite").json(path)


ALERT_TABLE_SCHEMA = T.StructType(ALERT_SCHEMA.fields + [T.StructField("alert_date", T.DateType())])


def append_alerts(alerts: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Add a batch of alert rows to the alert table, partitioned by day so
    that time-bounded reads (after a clear, newest alerts) prune partitions.
    Each batch has a folder of its own; a rerun with the same ``batch_id``
    replaces its rows. Alerts without an impact map store a null one."""
    if "features" not in alerts.columns:
        alerts = alerts.withColumn("features", F.lit(None).cast("map<string,double>"))
    (alerts.withColumn("alert_date", F.to_date("ts"))
           .write.mode("overwrite").partitionBy("alert_date").parquet(f"{path}/write={batch_id or uuid.uuid4().hex}"))


def read_alerts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The alert table; ``since`` keeps alerts after that time, pruning the
    day partitions before it."""
    df = spark.read.schema(ALERT_TABLE_SCHEMA).parquet(path).drop("write")
    if since is not None:
        t = F.to_timestamp_ntz(F.lit(since))
        df = df.filter((F.col("alert_date") >= F.to_date(t)) & (F.col("ts") > t))
    return df


def publish_verdicts(verdicts: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Each scored batch's (src, dst, prediction) rows; a rerun with the
    same ``batch_id`` replaces them."""
    verdicts.write.mode("overwrite").parquet(f"{path}/write={batch_id or uuid.uuid4().hex}")

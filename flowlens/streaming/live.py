"""Structured Streaming form of the live path (ST1–ST5, S6–S9).

* ST1/ST2 — ``flow_stream``: packets arrive as files (S6); flows are a
  stateful aggregation by (tumbling event-time window, direction-free key)
  with a watermark. In append mode a window's flows are emitted together, in
  one micro-batch, once the watermark passes the window end — so the
  per-window host counters downstream see complete windows. The state holds
  one fixed-width row per open flow.
* ST3/ST4 — ``process_closed_flows`` (``foreachBatch``): host counters (A2),
  41-attribute records, scoring, the alert gate (P19), alert rows; written
  per epoch (``epoch=<id>`` folders, overwritten on retry, so a replayed
  micro-batch does not duplicate rows).
* Capture batches — ``run_capture_batches``: the source's own batching, each
  micro-batch of packets is one batch (processing-time trigger of the
  capture interval); flows never span batches.
* ST5 — ``kpi_stream``: running KPIs over the alert folder as a second
  streaming query (complete mode; distinct nodes approximated, as exact
  distinct counts are not available on streams).

Event time: packet ``ts`` is TIMESTAMP_NTZ, which ``withWatermark`` refuses,
so it becomes a TIMESTAMP with the same reading in UTC (not through the
session time zone, which would move windows and durations across DST), and
windows are turned back into TIMESTAMP_NTZ on output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalar as S
from flowlens.operators import alerts as AL
from flowlens.operators import flows as FL
from flowlens.session import scratch_path, write_scratch
from flowlens.sources.packets import PACKET_SCHEMA
from flowlens.streaming.nodes import AlertBuffer


#: Protocol tag of the row that ends a bounded input; never a packet's tag.
HEARTBEAT = "heartbeat"


def packet_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Packet files under ``path`` (parquet, packet schema) as a stream.
    A micro-batch takes all files that are there unless a number is given."""
    r = spark.readStream.schema(PACKET_SCHEMA)
    if max_files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def flow_stream(packets: DataFrame, window: str = "4 seconds", watermark: str = "10 seconds") -> DataFrame:
    """ST1 + ST2: closed flows per tumbling window (append mode)."""
    k = (FL.packet_indicators(packets.withColumn("ts", S.ntz_to_event_time("ts")))
           .withWatermark("ts", watermark))
    agg = k.groupBy(F.window("ts", window).alias("w"), *FL.KEY_NO_WINDOW).agg(*FL.flow_aggregates())
    agg = (agg.withColumn("window_start", S.event_time_to_ntz(F.col("w.start")))
              .withColumn("start_time", S.event_time_to_ntz("start_time"))
              .withColumn("end_time", S.event_time_to_ntz("end_time"))
              .drop("w"))
    return FL.finish_flows(agg)


def feature_stream(packets: DataFrame, window: str = "4 seconds", watermark: str = "10 seconds", salts: int = 8) -> DataFrame:
    """ST1–ST3 as one plan of chained stateful operators: flows, counts by
    (window, host, service) and by (window, host) as aggregations of the flows
    that a window's end emits, and flows joined with both on the window. Rows of
    a window come out together, as nothing is emitted before its end.

    The join's state has a row for each flow, never a list of a host's flows;
    flows are spread over ``salts`` by their sequence and the counts, one row
    for each host and service, repeated for each."""
    k = (FL.packet_indicators(packets.withColumn("ts", S.ntz_to_event_time("ts")))
           .withWatermark("ts", watermark))
    agg = k.groupBy(F.window("ts", window).alias("w"), *FL.KEY_NO_WINDOW).agg(*FL.flow_aggregates())
    agg = agg.withColumn("window_start", F.col("w"))  # finish_flows keeps the column of this name
    flows = FL.finish_flows(agg).withColumnRenamed("window_start", "w")
    srv = flows.groupBy("w", "ip_dst", "service").agg(
        F.count(F.lit(1)).alias("srv_count"), F.count_if(F.col("flag") == "S0").alias("srv_s0"), F.count_if(F.col("flag") == "REJ").alias("srv_rej"))
    host = srv.groupBy("w", "ip_dst").agg(F.sum("srv_count").alias("count"), F.sum("srv_s0").alias("s0_count"), F.sum("srv_rej").alias("rej_count"))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = flows.withColumn("salt", F.pmod("flow_seq", F.lit(salts).cast("long")))
    out = salted.join(spread(srv.select("w", "ip_dst", "service", "srv_count")), ["w", "ip_dst", "service", "salt"])
    out = out.join(spread(host), ["w", "ip_dst", "salt"]).drop("salt")
    return (out.withColumn("window_start", S.event_time_to_ntz(F.col("w.start"))).withColumn("start_time", S.event_time_to_ntz("start_time"))
            .withColumn("end_time", S.event_time_to_ntz("end_time")).drop("w"))


def run_chained(spark: SparkSession, packets_path: str, out_dir: str, window: str = "4 seconds", watermark: str = "10 seconds",
                checkpoint: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the live path with its counters in the stream's own plan: the
    41-attribute records of each epoch, in its own folder."""
    def save(batch: DataFrame, epoch: int) -> None:
        rows = FL.assemble_records(batch.where(F.col("protocol_type") != HEARTBEAT))
        rows.write.mode("overwrite").parquet(f"{out_dir}/records/epoch={epoch}")

    w = (feature_stream(packet_stream(spark, packets_path, max_files_per_trigger), window, watermark).writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "chained-ckpt")).foreachBatch(save))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=window)).start()


def records_from_flows(flows: DataFrame) -> DataFrame:
    """ST3 on a set of complete windows: A2 counters and P11–P15 assembly."""
    return FL.assemble_records(FL.host_features(flows))


Step = Callable[[DataFrame], DataFrame]


def gated_alerts(scored: DataFrame) -> DataFrame:
    """P19 and plain alert rows, without impacts."""
    return AL.alert_records(AL.gate(scored))


def _write_epoch(out_dir: str, epoch_id: int, flows: DataFrame, score: Step, alerts: Step,
                 buffer: AlertBuffer | None = None) -> None:
    """ST3/ST4 for the flows of an epoch: records, verdicts (S9), batch
    summaries (P27) and alerts (S8), each in the epoch's own folder. Records
    and scored rows are written first, as several outputs read them. The
    newest alerts go to ``buffer`` (T3)."""
    rec = write_scratch(records_from_flows(flows), f"stream-records-{epoch_id}")
    scored = write_scratch(score(rec), f"stream-scored-{epoch_id}")
    for name, rows in (("flows", flows), ("records", rec), ("verdicts", AL.verdicts(scored)),
                       ("summary", AL.batch_summary(scored)), ("alerts", alerts(scored))):
        rows.write.mode("overwrite").parquet(f"{out_dir}/{name}/epoch={epoch_id}")
    if buffer is not None:
        buffer.add(flows.sparkSession.read.parquet(f"{out_dir}/alerts/epoch={epoch_id}"), epoch_id)


def process_closed_flows(out_dir: str, window: str, score: Step, alerts: Step = gated_alerts,
                         buffer: AlertBuffer | None = None) -> Callable[[DataFrame, int], None]:
    """ST4: the ``foreachBatch`` body. ``score`` maps 41-attribute records to
    rows with batch, seq, alert_ts, node_ip, src_ip, dst_ip, prediction,
    confidence (and whatever ``alerts`` needs); ``alerts`` maps scored rows to
    alert rows, such as ``plans.alerting.model_alerts`` with impacts."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        # the heartbeat goes here, not in the stream's plan: a filter there would
        # move below the watermark, which must see it
        flows = write_scratch(batch.where(F.col("protocol_type") != HEARTBEAT), f"stream-flows-{epoch_id}")
        _write_epoch(out_dir, epoch_id, flows, score, alerts, buffer)

    return run


def run_live(spark: SparkSession, packets_path: str, out_dir: str, score: Step,
             window: str = "4 seconds", watermark: str = "10 seconds",
             checkpoint: str | None = None, available_now: bool = True,
             max_files_per_trigger: int | None = None, alerts: Step = gated_alerts, buffer: AlertBuffer | None = None):
    """Start the live query: file source → stateful flows → foreachBatch.
    With ``available_now`` it processes what is there and stops; windows that
    the watermark has not passed stay open in the state (``land_heartbeat``
    ends a bounded input)."""
    flows = flow_stream(packet_stream(spark, packets_path, max_files_per_trigger), window, watermark)
    w = (flows.writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "live-ckpt"))
              .foreachBatch(process_closed_flows(out_dir, window, score, alerts, buffer)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=window)
    return w.start()


def process_capture_batch(out_dir: str, score: Step, alerts: Step = gated_alerts
                          ) -> Callable[[DataFrame, int], None]:
    """Capture-batch mode (the source's own batching): every micro-batch of
    packets is one batch; flows never span batches. The batch is stamped with
    the earliest packet time of the micro-batch, so a replayed epoch gets the
    same stamp."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        packets = write_scratch(batch, f"capture-{epoch_id}")        # read twice below
        first = packets.agg(F.min("ts")).first()[0]
        if first is None:
            return
        flows = write_scratch(FL.aggregate_flows(packets, batch_start=F.lit(first)),
                              f"capture-flows-{epoch_id}")
        _write_epoch(out_dir, epoch_id, flows, score, alerts)

    return run


def run_capture_batches(spark: SparkSession, packets_path: str, out_dir: str,
                        score: Step, interval: str = "4 seconds",
                        checkpoint: str | None = None, available_now: bool = True,
                        max_files_per_trigger: int | None = None, alerts: Step = gated_alerts):
    """ST1 as the source batches: a processing-time trigger of ``interval``
    (or everything available), each micro-batch aggregated on its own;
    ``max_files_per_trigger=1`` makes every landed file a batch."""
    w = (packet_stream(spark, packets_path, max_files_per_trigger).writeStream
         .option("checkpointLocation", checkpoint or scratch_path(spark, "capture-ckpt"))
         .foreachBatch(process_capture_batch(out_dir, score, alerts)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def kpi_stream(spark: SparkSession, alerts_path: str, alert_schema) -> DataFrame:
    """ST5: running KPIs over the alert folder (complete mode)."""
    alerts = spark.readStream.schema(alert_schema).parquet(alerts_path)
    threat = ~F.lower(F.col("prediction")).isin("normal", "0")
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                      F.sum(F.when(threat, 1).otherwise(0)).alias("threats"),
                      F.approx_count_distinct("node_ip").alias("nodes"),
                      F.max("ts").alias("last_alert"))


def land_packets(packets: DataFrame, path: str, files: int = 8) -> None:
    """Write a packet table as about ``files`` files of consecutive time ranges,
    in parallel. Test and demo input for ``packet_stream``; packets without a
    time are in the first file."""
    (packets.repartitionByRange(files, "ts").sortWithinPartitions("ts", "event_id")
            .write.mode("append").parquet(path))


def time_ranges(packets: DataFrame, parts: int = 8) -> list[DataFrame]:
    """Consecutive time ranges of about as many packets each. Packets without a
    time are in the first."""
    at = F.unix_micros(S.ntz_to_event_time("ts"))
    shares = [i / parts for i in range(1, parts)]
    cuts = packets.agg(F.percentile_approx(at, shares, 1000)).first()[0] if shares else []
    edges = [None, *sorted(set(cuts or [])), None]
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = F.lit(True)
        if high is not None:
            inside = at < high
        if low is not None:
            inside = inside & (at >= low)
        out.append(packets.where(F.coalesce(inside, F.lit(low is None))))
    return out


def land_range(part: DataFrame, path: str) -> None:
    """Land a time range, a file for each task."""
    part.sortWithinPartitions("ts", "event_id").write.mode("append").parquet(path)


def land_in_order(packets: DataFrame, path: str, parts: int = 8) -> None:
    """Land consecutive time ranges one after another, as a capture does. The
    files of a range are in no order: a stream that takes few files at a time
    sees packets in order only if ``packets`` is one partition (``time_ranges``
    and ``land_range`` between runs of the stream need no such thing)."""
    for part in time_ranges(packets, parts):
        land_range(part, path)


def land_heartbeat(spark: SparkSession, path: str, window: str, watermark: str) -> None:
    """End a bounded input: land one row later than all packets under ``path``
    by a window and the watermark twice, so that every window with packets
    closes. Its own window stays open; it never becomes a flow."""
    last = spark.read.schema(PACKET_SCHEMA).parquet(path).agg(F.max("ts").alias("ts")).where("ts is not null")
    later = F.col("ts") + F.expr(f"interval {window}") * 2 + F.expr(f"interval {watermark}") * 2
    zero = F.lit("0.0.0.0")
    row = last.select(F.lit(-1).cast("long").alias("event_id"), later.alias("ts"), F.lit(HEARTBEAT).alias("proto"),
                      F.lit(0).cast("long").alias("bytes"), zero.alias("ip_src"), zero.alias("ip_dst"),
                      F.lit(0).alias("port_src"), F.lit(0).alias("port_dst"), F.lit("").alias("tcp_flags"), F.lit("").alias("payload"))
    row.write.mode("append").parquet(path)

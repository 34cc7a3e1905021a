"""Driver contract: entry() runs; every oracle query matches DuckDB at sf0.001;
the stream equals the batch for closed windows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from flowlens.plans import alerting as AP
from flowlens.plans import registry as R
from flowlens.session import scratch_path
from flowlens.sources.packets import read_packets
from flowlens.streaming import live as LV

from .conftest import SF_SMALL

TABLES = ["lineitem", "orders", "events"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "dst_host_srv_rerror_rate" in df.columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.12g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(R.oracle()))
def test_oracle_matches(spark, duck, name):
    df = R.queries()[name](spark, SF_SMALL)
    res = duck.execute(R.oracle()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order_s = [df.columns.index(c) for c in sorted(df.columns)]
    order_d = [dcols.index(c) for c in sorted(dcols)]
    s = sorted("|".join(_norm(r[i]) for i in order_s) for r in df.collect())
    d = sorted("|".join(_norm(r[i]) for i in order_d) for r in res.fetchall())
    assert s == d


def test_stream_equals_batch_for_closed_windows(spark):
    land = scratch_path(spark, "land-test")
    LV.land_packets(read_packets(spark, SF_SMALL), land, files=6)
    out = scratch_path(spark, "live-test")
    q = LV.run_live(spark, land, out, lambda rec: AP.score_records_by_rule(rec, R.BATCH_WINDOW),
                    window=R.BATCH_WINDOW, watermark="1 hour")
    q.awaitTermination()
    s = spark.read.parquet(f"{out}/records").drop("epoch")
    b = R.q_flow_records(spark, SF_SMALL)
    closed = s.select("window_start").distinct()
    bb = b.join(closed, "window_start").select(*s.columns)
    assert closed.count() >= b.select("window_start").distinct().count() - 1
    assert s.exceptAll(bb).count() == 0 and bb.exceptAll(s).count() == 0
    # ST5: running KPIs over the alert folder equal the batch KPIs of those alerts
    from flowlens.sources.requests import ALERT_SCHEMA
    kq = (LV.kpi_stream(spark, f"{out}/alerts", ALERT_SCHEMA).writeStream.outputMode("complete")
            .format("memory").queryName("kpi_test")
            .option("checkpointLocation", scratch_path(spark, "kpi-ckpt")).trigger(availableNow=True).start())
    kq.awaitTermination()
    got = spark.sql("select * from kpi_test").first()
    alerts = spark.read.parquet(f"{out}/alerts")
    assert got.total_alerts == alerts.count()
    assert got.threats == alerts.filter("lower(prediction) not in ('normal', '0')").count()
    assert got.nodes == 1


def test_capture_batch_mode(spark):
    land = scratch_path(spark, "land-capture")
    LV.land_packets(read_packets(spark, SF_SMALL), land, files=3)
    out = scratch_path(spark, "capture-out")
    q = LV.run_capture_batches(spark, land, out, lambda rec: AP.score_records_by_rule(rec, R.BATCH_WINDOW),
                               max_files_per_trigger=1)
    q.awaitTermination()
    rec = spark.read.parquet(f"{out}/records")
    # one batch per landed file, flows never span batches, every packet counted once
    assert rec.select("epoch").distinct().count() == 3
    assert rec.select("window_start").distinct().count() == 3
    pk = read_packets(spark, SF_SMALL).count()
    flows = spark.read.parquet(f"{out}/flows")
    assert flows.agg(F.sum("n_packets")).first()[0] == pk
    assert flows.count() == rec.count() == spark.read.parquet(f"{out}/verdicts").count()


def test_stream_restart_from_checkpoint(spark):
    """Stop after part of the capture, land the rest, restart on the same
    checkpoint: closed windows equal the batch result, nothing twice."""
    pk = read_packets(spark, SF_SMALL)
    land = scratch_path(spark, "land-restart")
    half = pk.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    first = pk.filter(F.unix_micros(F.col("ts").cast("timestamp")) < half)
    rest = pk.filter(F.unix_micros(F.col("ts").cast("timestamp")) >= half)
    LV.land_packets(first, land, files=3)
    out, ckpt = scratch_path(spark, "live-restart"), scratch_path(spark, "live-restart-ckpt")
    score = lambda rec: AP.score_records_by_rule(rec, R.BATCH_WINDOW)
    LV.run_live(spark, land, out, score, window=R.BATCH_WINDOW, watermark="1 hour", checkpoint=ckpt).awaitTermination()
    LV.land_packets(rest, land, files=3)
    LV.run_live(spark, land, out, score, window=R.BATCH_WINDOW, watermark="1 hour", checkpoint=ckpt).awaitTermination()
    s = spark.read.parquet(f"{out}/records").drop("epoch")
    b = R.q_flow_records(spark, SF_SMALL)
    closed = s.select("window_start").distinct()
    bb = b.join(closed, "window_start").select(*s.columns)
    assert s.count() == bb.count()
    assert s.exceptAll(bb).count() == 0 and bb.exceptAll(s).count() == 0


def test_chained_stream_restarts(spark):
    """Counters in the stream's own plan: half of the capture, a restart on the
    same checkpoint, the rest; every closed window once, equal to the batch."""
    pk = read_packets(spark, SF_SMALL)
    land, out, ckpt = (scratch_path(spark, x) for x in ("land-chained", "chained", "chained-ckpt"))
    half = pk.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) < half
    for part in (pk.where(early), pk.where(~early)):
        LV.land_in_order(part, land, 2)
        LV.run_chained(spark, land, out, R.BATCH_WINDOW, "1 hour", checkpoint=ckpt, max_files_per_trigger=2).awaitTermination()
    LV.land_heartbeat(spark, land, R.BATCH_WINDOW, "1 hour")
    LV.run_chained(spark, land, out, R.BATCH_WINDOW, "1 hour", checkpoint=ckpt).awaitTermination()
    b = R.q_flow_records(spark, SF_SMALL)
    s = spark.read.parquet(f"{out}/records").select(b.columns)
    assert s.count() == b.count() and s.exceptAll(b).count() == 0

"""Alert gate, buffer, dashboard, KPIs (FIXTURES.md §4) and sources/sinks."""

import datetime as dt

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import alerts as AL
from flowlens.plans import alerting as AP
from flowlens.plans import registry as R
from flowlens.session import scratch_path
from flowlens.sources import records as RC
from flowlens.sources import requests as RQ

from .conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def _scored(spark, rows):
    return spark.createDataFrame(
        [(T0, seq, T0 + dt.timedelta(seconds=4 + seq), node, "1.1.1.1", "2.2.2.2", pred, conf)
         for seq, node, pred, conf in rows],
        "batch timestamp_ntz, seq long, alert_ts timestamp_ntz, node_ip string, src_ip string, "
        "dst_ip string, prediction string, confidence double")


def test_gate_keeps_threats_and_first_row(spark):
    s = _scored(spark, [(3, "n", "normal", 0.9), (1, "n", "normal", 0.8), (2, "n", "dos", 0.95), (4, "n", "0", 0.7)])
    got = sorted((r.seq, r.is_threat, r.is_first) for r in AL.gate(s).collect())
    assert got == [(1, False, True), (2, True, False)]
    only_normal = _scored(spark, [(5, "n", "normal", 0.5), (6, "n", "normal", 0.5)])
    assert [r.seq for r in AL.gate(only_normal).collect()] == [5]


def test_buffer_and_table_sizes(spark):
    s = _scored(spark, [(i, "n", "dos", 0.99) for i in range(101)])
    alerts = AL.alert_records(AL.gate(s))
    buf = AL.newest(alerts).collect()
    assert len(buf) == 100 and min(r.seq for r in buf) == 1
    s2 = _scored(spark, [(i, "n", "dos", 0.99) for i in range(52)])
    rows = AL.dashboard_rows(AL.alert_records(AL.gate(s2))).collect()
    assert len(rows) == K.DASHBOARD_ROWS == 51
    assert [r.seq for r in AL.replay(AL.newest(alerts)).collect()][:2] == [1, 2]


def test_node_status_boundaries(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 0, 0, 0, 100000)), ("b", dt.datetime(2024, 1, 1, 0, 0, 0)),
         ("c", dt.datetime(2024, 1, 1, 0, 0, 10))],
        "node_ip string, ts timestamp_ntz")
    got = {r.node_ip: (r.age_seconds, r.status)
           for r in AL.node_status(df, now="2024-01-01 00:00:10").collect()}
    assert got == {"a": (9, "ONLINE"), "b": (10, "AWAY"), "c": (0, "ONLINE")}


def test_kpis_after_clear(spark):
    s = _scored(spark, [(1, "n1", "dos", 0.9), (2, "n2", "normal", 0.9), (3, "n1", "probe", 0.9)])
    alerts = AL.alert_records(AL.gate(s))
    k = AL.kpis(alerts).first()
    assert (k.total_alerts, k.threats, k.nodes) == (2, 2, 1)
    k2 = AL.kpis(alerts, cleared_at="2024-01-01 00:00:06").first()
    assert (k2.total_alerts, k2.threats) == (1, 1)


def test_connection_csv_round_trip(spark):
    recs = RC.read_records(spark, SF_SMALL, keep_key=False)
    path = scratch_path(spark, "kdd-csv")
    RC.write_connection_csv(recs, path)
    back = RC.read_connection_csv(spark, path)
    assert back.schema == RC.CONNECTION_SCHEMA
    assert back.exceptAll(recs.select(*K.KDD_COLUMNS)).count() == 0
    assert back.count() == recs.count()


def test_processed_table_projection(spark):
    recs = RC.read_records(spark, SF_SMALL, keep_key=False).drop("difficulty_level")
    path = scratch_path(spark, "processed")
    RC.write_processed(recs, path)
    df = RC.read_processed(spark, path, ["count", "serror_rate"])
    assert df.columns == ["count", "serror_rate", "label"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<count:double,serror_rate:double,label:string>" in plan


def test_requests_round_trip_and_defaults(spark):
    rec = AP.flow_records(spark, SF_SMALL, R.BATCH_WINDOW)
    path = scratch_path(spark, "requests")
    RQ.write_requests(RQ.requests_from_records(rec, "192.168.1.7"), path)
    back = RQ.request_records(RQ.read_requests(spark, path))
    assert back.count() == rec.count()
    cols = K.ATTRIBUTE_COLUMNS
    assert back.select(*cols).exceptAll(rec.select(*cols)).count() == 0
    one = spark.createDataFrame([("n", None, None, "2024-01-01 00:00:00", {"count": "3"})], RQ.REQUEST_SCHEMA)
    r = RQ.request_records(one).first()
    assert (r.src_ip, r.dst_ip, r["count"], r.duration, r.service) == ("0.0.0.0", "0.0.0.0", 3.0, 0.0, None)
    empty = spark.createDataFrame([], RQ.REQUEST_SCHEMA)
    assert RQ.request_records(empty).count() == 0


def test_alert_append_sink(spark):
    alerts = AP.rule_alerts(spark, SF_SMALL)
    path = scratch_path(spark, "alerts")
    RQ.append_alerts(alerts, path)
    RQ.append_alerts(alerts, path)
    assert RQ.read_alerts(spark, path).count() == 2 * alerts.count()
    assert alerts.filter(F.length("id") != 8).count() == 0
    since = "2024-01-20 00:00:00"
    recent = RQ.read_alerts(spark, path, since=since)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(alert_date" in plan
    assert recent.count() == 2 * alerts.filter(F.col("ts") > F.to_timestamp_ntz(F.lit(since))).count()


def test_alert_table_keeps_features_and_reruns_replace(spark):
    alerts = AP.rule_alerts(spark, SF_SMALL).withColumn("features", F.create_map(F.lit("count"), F.lit(0.5)))
    path = scratch_path(spark, "alerts-features")
    RQ.append_alerts(alerts, path, batch_id="a")
    RQ.append_alerts(alerts, path, batch_id="a")
    back = RQ.read_alerts(spark, path)
    assert back.count() == alerts.count()
    assert back.filter(F.col("features")["count"] == 0.5).count() == alerts.count()


def test_bad_request_fields_do_not_stop_the_batch(spark):
    rows = [("n", None, None, "2024-01-01T00:00:00", {"count": "abc", "duration": "2"}),
            ("n", None, None, "2024-01-01 00:00:00", {"count": "3"}), ("n", None, None, None, None)]
    req = spark.createDataFrame(rows, RQ.REQUEST_SCHEMA)
    got = RQ.request_records(req).collect()
    assert [r.timestamp for r in got] == ["2024-01-01T00:00:00", "2024-01-01 00:00:00", None]
    assert [r.request_ts is None for r in got] == [True, False, True]
    assert [(r["count"], r.duration) for r in got] == [(0.0, 2.0), (3.0, 0.0), (0.0, 0.0)]
    bad = RQ.rejected_requests(req).collect()
    assert [r.bad_fields for r in bad] == [["timestamp", "count"]]


def test_training_from_headerless_csv(spark):
    """The real-data path: 43-column CSV without a row key, default hash split key."""
    from flowlens.operators import model as MO
    from flowlens.plans import train as TR
    recs = RC.read_records(spark, SF_SMALL, keep_key=False)
    path = scratch_path(spark, "kdd-csv-train")
    RC.write_connection_csv(recs, path)
    out = scratch_path(spark, "csv-run")
    summ = TR.run_training(spark, RC.read_connection_csv(spark, path), out,
                           params=MO.TrainParams(num_trees=5))
    n_test = spark.read.parquet(f"{out}/processed/test").count()
    n_all = recs.count()
    assert summ["support"] == n_test and abs(n_test - 0.2 * n_all) <= 6
    assert 0.0 <= summ["accuracy"] <= 1.0


def test_large_tables_in_few_files_are_read_by_more_tasks(spark):
    from flowlens.session import spread
    path = scratch_path(spark, "one file")
    spark.range(20_000).withColumn("x", F.rand(1)).coalesce(1).write.parquet(path)
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    assert spread(table).rdd.getNumPartitions() == cores
    more = spread(table, task_bytes=10_000)
    assert more.rdd.getNumPartitions() > 2 * cores and more.agg(F.sum("id")).first()[0] == 199_990_000
    table.repartition(cores + 1).write.parquet(f"{path}-many")
    many = spark.read.parquet(f"{path}-many")
    assert spread(many, task_bytes=1) is many

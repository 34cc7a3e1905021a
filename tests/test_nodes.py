"""Keyed node state with timers and the compacted alert buffer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlens.operators import alerts as AL
from flowlens.session import scratch_path
from flowlens.sources.requests import ALERT_SCHEMA
from flowlens.streaming import nodes as NO

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def alert(seq, sec, node, prediction="dos"):
    return (f"a{seq}", node, "1.1.1.1", "2.2.2.2", "t", T0 + dt.timedelta(seconds=sec) if sec is not None else None, seq, prediction, 0.9, None)


def test_timers_turn_sensors_away(spark):
    folder, out, ckpt = (scratch_path(spark, x) for x in ("alerts", "nodes", "ckpt"))

    def land(rows):
        spark.createDataFrame(rows, ALERT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        NO.run_node_watch(spark, folder, out, checkpoint=ckpt).awaitTermination()  # a restart each time
        return {r.node_ip: r for r in NO.current_nodes(spark, out).collect()}

    got = land([alert(1, 0, "n1"), alert(2, 1, "n2", "normal"), alert(3, 1, "n2"), alert(4, 0, None), alert(5, None, "n3")])
    assert {k: (r.total_alerts, r.threats, r.status) for k, r in got.items()} == {"n1": (1, 1, "ONLINE"), "n2": (2, 1, "ONLINE")}
    got = land([alert(6, 10, "n2"), alert(7, 10, "n4")])  # n1 is ten seconds old now
    assert {k: r.status for k, r in got.items()} == {"n1": "AWAY", "n2": "ONLINE", "n4": "ONLINE"}
    got = land([alert(8, 19.999, "n1", None)])  # back again; the others are just not away
    assert {k: r.status for k, r in got.items()} == {"n1": "ONLINE", "n2": "ONLINE", "n4": "ONLINE"} and got["n1"].total_alerts == 2 and got["n1"].threats == 1
    land([alert(9, 300, "n5")])
    nodes = NO.current_nodes(spark, out)
    status = {r.node_ip: (r.age_seconds, r.status) for r in NO.node_status_table(nodes).collect()}
    rows = spark.read.schema(ALERT_SCHEMA).parquet(folder).where("node_ip is not null and ts is not null")
    assert status == {r.node_ip: (r.age_seconds, r.status) for r in AL.node_status(rows).collect()}
    assert NO.node_kpis(nodes).first() == AL.kpis(rows).first()


def test_buffer_is_compacted_and_replays(spark):
    buffer = NO.AlertBuffer(spark, scratch_path(spark, "buffer"), size=5, kept=2)
    with pytest.raises(ValueError):
        buffer.read()
    epochs = [spark.createDataFrame([alert(10 * e + i, (e * 7 + i * 3) % 11, "n") for i in range(4)], ALERT_SCHEMA) for e in range(6)]
    seen = epochs[0].limit(0)
    for e, rows in enumerate(epochs):
        buffer.add(rows, e)
        buffer.add(rows, e)  # a replayed epoch
        seen = seen.unionByName(rows)
        assert [r.id for r in buffer.replay().collect()] == [r.id for r in AL.replay(AL.newest(seen, 5)).collect()]
    assert [e for e, _ in buffer._manifests()] == [3, 4, 5]
    buffer.add(epochs[4], 4)  # the driver died after epoch 4 had ended and starts it anew
    buffer.add(epochs[5], 5)
    assert sorted(r.id for r in buffer.read().collect()) == sorted(r.id for r in AL.newest(seen, 5).collect())
    buffer.add(epochs[0].limit(0), 6)
    assert buffer.read().count() == 5 and buffer.read().where(F.col("ts").isNull()).count() == 0


def test_many_alerts_of_one_sensor_are_added_up_by_batch(spark):
    """Ranges landed by several tasks, the stream run between; a sensor's rows
    reach its state as tables, not one by one."""
    import pandas as pd

    seen, rows = [], pd.DataFrame({"last_us": [5, 9, 7], "n": [1, 1, 1], "n_threats": [1, 0, 1]})
    watch = NO.node_watch(10)

    class State:
        def exists(self):
            return False

        def update(self, state):
            seen.append(state)

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        def listTimers(self):  # noqa: N802
            return iter(())

        def registerTimer(self, at):  # noqa: N802
            seen.append(at)

    watch.init(Handle())
    (got,) = watch.handleInputRows(("n",), iter([rows, rows[:0], rows]), None)
    assert seen == [(1, 9, 6, 4), 10_001] and got.to_dict("records") == [
        {"node_ip": "n", "version": 1, "last_seen_us": 9, "total_alerts": 6, "threats": 4, "status": "ONLINE"}]


def test_ranges_are_landed_by_many_tasks(spark):
    """Each time range holds its packets whole, in several files."""
    from flowlens.sources.packets import PACKET_SCHEMA
    from flowlens.streaming import live as LV

    rows = [(i, T0 + dt.timedelta(seconds=i) if i else None, "tcp", 1, "a", "b", 1, 2, "", "") for i in range(64)]
    packets = spark.createDataFrame(rows, PACKET_SCHEMA).repartition(4)
    ranges, found = LV.time_ranges(packets, 4), []
    for part in ranges:
        land = scratch_path(spark, "range")
        LV.land_range(part, land)
        got = spark.read.parquet(land)
        assert len(got.inputFiles()) > 1
        found.append(sorted(r.event_id for r in got.collect()))
    assert len(ranges) == 4 and sum(found, []) == list(range(64))

"""Nodes and newest alerts as state of the live path (ST5, A11, A12, T3, T6, S8).

* ``node_updates`` keeps for each sensor, in keyed state, when it was last seen
  and how many alerts and threats it sent. Every change is a row, and an
  event-time timer turns a sensor from ONLINE to AWAY when the watermark
  passes its last alert by ``ONLINE_SECONDS``. As a sensor has one state,
  sensors are counted exactly. The state is a few numbers for each sensor, so
  a sensor with a third of all alerts holds no more than another; its alerts
  are added up by Arrow batch, not one by one.
* ``run_node_watch`` writes the changes, a folder for each epoch, replaced when
  an epoch is replayed; ``current_nodes`` is the last change of each sensor,
  ``node_status_table`` and ``node_kpis`` the dashboard's views of it.
* ``AlertBuffer`` keeps the newest alerts of a stream as a table: an epoch's
  buffer is the newest of the buffer before it and of its own alerts. A
  manifest for each epoch names the table, so a replayed epoch starts from the
  same one, and tables that no replay can need are deleted.

Watermarks have milliseconds, so a sensor turns AWAY up to a millisecond late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens import constants as K
from flowlens.functions import scalar as S
from flowlens.operators import alerts as AL
from flowlens.session import drop_scratch, scratch_path
from flowlens.sources.requests import ALERT_SCHEMA

if TYPE_CHECKING:
    import pandas as pd

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPDATE = "node_ip string, version long, last_seen_us long, total_alerts long, threats long, status string"


def node_watch(seconds: int) -> StatefulProcessor:
    """The state of one sensor, AWAY after ``seconds``. Defined here so that it
    travels by value: the stream's own Python processes need no package."""
    class NodeWatch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.node = handle.getValueState("node", "version long, last_us long, alerts long, threats long")

        def _row(self, ip: str, state: tuple, status: str) -> pd.DataFrame:
            import pandas as pd
            version, last, alerts, threats = state
            return pd.DataFrame({"node_ip": [ip], "version": [version], "last_seen_us": [last], "total_alerts": [alerts], "threats": [threats], "status": [status]})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            version, last, alerts, threats = tuple(self.node.get()) if self.node.exists() else (0, None, 0, 0)
            for part in rows:
                if len(part):
                    newest = int(part["last_us"].max())
                    last = newest if last is None else max(last, newest)
                    alerts, threats = alerts + int(part["n"].sum()), threats + int(part["n_threats"].sum())
            state = (version + 1, last, alerts, threats)
            self.node.update(state)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-last // 1000) + 1000 * seconds)
            yield self._row(key[0], state, "ONLINE")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            version, *rest = tuple(self.node.get())
            state = (version + 1, *rest)
            self.node.update(state)
            yield self._row(key[0], state, "AWAY")

    return NodeWatch()


def node_updates(alerts: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Changes of each sensor's state, from a stream of alert rows that come in
    the order of their windows, but for ``watermark``."""
    rows = (alerts.where(F.col("node_ip").isNotNull() & F.col("ts").isNotNull())
            .select("node_ip", S.ntz_to_event_time("ts").alias("at"), S.is_threat("prediction").cast("long").alias("threat"))
            .withWatermark("at", watermark))
    rows = rows.select("node_ip", "at", F.unix_micros("at").alias("last_us"), F.lit(1).cast("long").alias("n"), F.coalesce("threat", F.lit(0).cast("long")).alias("n_threats"))
    return rows.groupBy("node_ip").transformWithStateInPandas(statefulProcessor=node_watch(K.ONLINE_SECONDS), outputStructType=UPDATE, outputMode="Update", timeMode="EventTime")


def run_node_watch(spark: SparkSession, alerts_path: str, out_dir: str, watermark: str = "0 seconds", checkpoint: str | None = None,
                   available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the query on an alert folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    r = spark.readStream.schema(ALERT_SCHEMA)
    if max_files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    w = (node_updates(r.parquet(alerts_path), watermark).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "nodes-ckpt")).foreachBatch(save))
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_nodes(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last change of each sensor; a sensor has a row for each epoch in
    which it changed."""
    columns = [c.split()[0] for c in UPDATE.split(", ")][1:]
    changes = spark.read.schema(UPDATE).option("recursiveFileLookup", True).parquet(out_dir)
    return changes.groupBy("node_ip").agg(F.max_by(F.struct(*columns), "version").alias("last")).select("node_ip", "last.*")


def node_status_table(nodes: DataFrame) -> DataFrame:
    """A12 from the state: last seen, age at the newest alert, and status."""
    now = nodes.select(F.max("last_seen_us")).scalar()
    age = F.floor((now - F.col("last_seen_us")) / F.lit(1e6)).cast("long")
    last = S.event_time_to_ntz(F.timestamp_micros("last_seen_us"))
    return nodes.select("node_ip", last.alias("last_seen"), age.alias("age_seconds"), "status")


def node_kpis(nodes: DataFrame) -> DataFrame:
    """A11 from the state."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return nodes.agg(total("total_alerts"), total("threats"), F.count(F.lit(1)).alias("nodes"))


class AlertBuffer:
    """The newest ``size`` alerts of a stream, below ``path`` in the shared
    folder. ``add`` is the body of a ``foreachBatch``, or part of one."""

    def __init__(self, spark: SparkSession, path: str, size: int = K.ALERT_BUFFER_SIZE, kept: int = 2):
        self.spark, self.path, self.size, self.kept = spark, path, size, kept

    def _manifests(self) -> list[tuple[int, str]]:
        """(epoch, table) of the epochs that ended, oldest first; at most ``kept`` + 1."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted((int(n.removeprefix("epoch=")), f"{self.path}/buffer/{n}") for n in done)

    def add(self, alerts: DataFrame, epoch: int) -> None:
        before = [x for x in self._manifests() if x[0] < epoch]
        rows = AL.newest(alerts, self.size)
        if before:
            rows = AL.newest(rows.unionByName(self.spark.read.schema(alerts.schema).parquet(before[-1][1]), allowMissingColumns=True), self.size)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/buffer/epoch={epoch}")  # at most ``size`` rows
        listed = self.spark.createDataFrame([(epoch, before[-1][0] if before else None)], "epoch long, after long")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/epoch={epoch}")
        for old, table in before[: -self.kept]:
            drop_scratch(self.spark, f"{self.path}/manifest/epoch={old}")
            drop_scratch(self.spark, table)

    def read(self) -> DataFrame:
        """The buffer after the last epoch that ended."""
        done = self._manifests()
        if not done:
            raise ValueError(f"{self.path}: no epoch has ended")
        return self.spark.read.parquet(done[-1][1])

    def replay(self) -> DataFrame:
        """The buffer oldest first, as a new viewer gets it."""
        return AL.replay(self.read())

"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python workers run numpy per Arrow batch; one BLAS thread each, since
    # Spark already runs one worker per core.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def sized_conf(input_bytes: int, total_cores: int, partition_mb: int = 128) -> dict:
    """Shuffle and scan sizing for a given input volume: ~``partition_mb`` per
    scan split and per shuffle partition (a few per core), so tasks fit in
    executor memory and spill stays rare; AQE then coalesces small
    partitions and splits skewed ones. E.g. 100 TB on 1000 executors × 8
    cores → ~800k shuffle partitions of 128 MB."""
    part = partition_mb * 1024 * 1024
    shuffle = max(2 * total_cores, -(-input_bytes // part))
    return {
        "spark.sql.files.maxPartitionBytes": str(part),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(part),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * part),
    }


def get_spark(app: str = "flowlens", master: str | None = None,
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only in local mode
    (tests), where all tasks share the machine, a fresh scratch folder is taken
    when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="flowlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df, task_bytes: int = 16 << 20):
    """Round-robin a freshly read table when it is stored in fewer files than
    the default parallelism (a table in one file and row group is otherwise
    read by one task): over as many tasks as that, and over more where one
    would get above ``task_bytes`` of the files, so that a large table in few
    files makes more tasks, not larger ones. Decided from the file listing
    only; a table of more files than cores passes through untouched."""
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism
    files = df.inputFiles()
    if len(files) < want:
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]  # listed URL-encoded
        stored = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
        return df.repartition(max(want, -(-stored // task_bytes)))
    return df


def write_scratch(df, name: str):
    """Write ``df`` as a parquet table in the shared checkpoint folder and read
    it back: cuts lineage, survives executor loss, and later readers get
    column pruning and exact size statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more. Only paths below the
    shared checkpoint folder are deleted."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not path.startswith(f"{base}/"):
        raise ValueError(f"{path} is not a scratch table")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowlens`` importable in Python workers (``mapInArrow`` stages).

    On a cluster the package is shipped the usual way (``spark-submit
    --py-files flowlens.zip``) and nothing happens here. In local mode (tests,
    bench) the package is zipped into the checkpoint folder once per
    SparkContext and added with ``addPyFile``."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or not sc.master.startswith("local"):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    os.makedirs(base, exist_ok=True)
    zpath = os.path.join(base, f"flowlens-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)

"""Labelled connection records (D1): sources and sinks.

* ``CONNECTION_SCHEMA`` — the 43-column headerless layout (3 nominal strings,
  38 doubles, ``label`` string, ``difficulty_level`` int); no inference.
* ``read_connection_csv`` — S1.
* ``records_from_lineitem`` — builds rows of that layout from the
  ``lineitem``/``orders`` test tables (FIXTURES.md ``kdd_v``): it only maps
  columns; every later step runs on it unchanged.
* ``write_processed`` / ``read_processed`` — S2 / S3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import spread

from flowlens import constants as K


def _field(name: str) -> T.StructField:
    if name in K.NOMINAL_COLUMNS or name == K.LABEL_COLUMN:
        return T.StructField(name, T.StringType())
    if name == K.DIFFICULTY_COLUMN:
        return T.StructField(name, T.IntegerType())
    return T.StructField(name, T.DoubleType())


CONNECTION_SCHEMA = T.StructType([_field(c) for c in K.KDD_COLUMNS])

# Which test-table column stands in for which attribute (FIXTURES.md §3).
# Attributes not listed are the constant 0.0.
STAND_IN = {
    "protocol_type": "l_returnflag",
    "service": "o_orderpriority",
    "flag": "l_linestatus",
    "src_bytes": "l_extendedprice",
    "count": "l_quantity",
    "serror_rate": "l_discount",
    "rerror_rate": "l_tax",
    "num_root": "sparse_counter",
    "difficulty_level": "l_linenumber",
    "label": "raw_label",
}

# Columns that identify a stand-in row back to its source (kept beside the
# attributes; not features).
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def read_connection_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV with the 43 fixed column names, explicit types."""
    return spark.read.schema(CONNECTION_SCHEMA).csv(path, header=False)


def write_connection_csv(df: DataFrame, path: str) -> None:
    """Headerless CSV in the 43-column layout (round trip of S1)."""
    df.select(*K.KDD_COLUMNS).write.mode("overwrite").csv(path, header=False)


def raw_label_rule(li: DataFrame) -> DataFrame:
    """FIXTURES.md ``kdd_v`` label: raw attack names, some with dots, one unmapped."""
    qn = F.col("l_quantity").cast("int")
    di = F.round(F.col("l_discount") * 100).cast("int")
    tx = F.round(F.col("l_tax") * 100).cast("int")
    return li.withColumn(
        "raw_label",
        F.when(qn >= 40, "neptune.").when(di >= 9, "satan")
         .when((tx >= 7) & (qn < 10), "guess_passwd")
         .when((di <= 1) & (tx <= 1) & (qn < 20), "rootkit.")
         .when(F.col("l_partkey") % 97 == 0, "mystery").otherwise("normal"))


def records_from_lineitem(lineitem: DataFrame, orders: DataFrame,
                          keep_key: bool = True) -> DataFrame:
    """Connection records (43 columns, plus the row key) from lineitem ⋈ orders."""
    li = raw_label_rule(lineitem).withColumn(
        "sparse_counter",
        F.when(F.col("l_partkey") % 50 == 0, F.col("l_linenumber").cast("double")).otherwise(F.lit(0.0)))
    j = li.join(orders.select("o_orderkey", "o_orderpriority"),
                li["l_orderkey"] == orders["o_orderkey"], "inner")
    cols = []
    for c in K.KDD_COLUMNS:
        src = STAND_IN.get(c)
        t = CONNECTION_SCHEMA[c].dataType
        cols.append((F.col(src) if src else F.lit(0.0)).cast(t).alias(c))
    key = [F.col(k) for k in ROW_KEY] if keep_key else []
    return j.select(*key, *cols)


def read_records(spark: SparkSession, sf_dir: str, keep_key: bool = True) -> DataFrame:
    li = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    od = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return records_from_lineitem(li, od, keep_key=keep_key)


# -- S2 / S3 -----------------------------------------------------------------

def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a processed (encoded, labelled) table; CSV gets a header."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_processed(spark: SparkSession, path: str, features: list[str],
                   label: str = "label", fmt: str = "parquet") -> DataFrame:
    """S3: read a processed table and keep only the selected features + label.

    With parquet the projection reaches the scan (column pruning)."""
    r = spark.read
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", False)
    df = r.format(fmt).load(path)
    if fmt == "csv":
        df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features], label)
        return df
    return df.select(*[F.col(f"`{c}`") for c in features], label)

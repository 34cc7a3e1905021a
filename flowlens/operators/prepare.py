"""Label cleaning, category mapping and the exact stratified split.

* ``label_records`` — P1 (drop difficulty), P2 (strip dots), P3/J1 (attack
  name -> category with default ``unknown``). The 40-entry map is a literal
  map expression: no join, no shuffle.
* ``stratified_split`` — W3/T8: per class, exactly ``round(n_c × f)`` rows go
  to test, chosen by the smallest keys. Computed without sorting or
  windowing whole classes (the largest class can hold most of the rows):

  1. a ``bucket_bits``-bit bucket of the key (default 16);
     ``groupBy(class, bucket).count()`` with partial aggregation — at most
     classes × 2^bits rows;
  2. running counts over that small table find, per class, the boundary
     bucket and how many of its rows are still needed;
  3. rows outside their boundary bucket are decided by comparison; only the
     rows inside it (≈ n_c / 2^bits) are ranked, per class — after identical
     rows are collapsed to one row with a copy count, so a heavily copied row
     does not land in one task (see ``_split_boundary``).

  Both sizes grow as 2^bits and n/2^bits: 16 bits suits up to ~10^10 rows;
  raise it (≈ log2(n)/2) beyond that.

  The boundary table has one row per class (the category set is fixed, ≤ 6
  rows), so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import scalar as S


def label_records(df: DataFrame, label_col: str = K.LABEL_COLUMN) -> DataFrame:
    """P1 + P2 + P3: drop the difficulty level if present and replace the raw
    attack name by its category."""
    if K.DIFFICULTY_COLUMN in df.columns:
        df = df.drop(K.DIFFICULTY_COLUMN)
    return df.withColumn(label_col, S.label_category(label_col))


def default_split_key(df: DataFrame, seed: int = K.SPLIT_SEED) -> Column:
    """Seeded 62-bit hash of the whole row."""
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    return h.bitwiseAND(F.lit((1 << 62) - 1))


def stratified_split(df: DataFrame, label_col: str = K.LABEL_COLUMN,
                     test_fraction: float = K.TEST_FRACTION, key: Column | None = None,
                     key_bits: int = 62, bucket_bits: int = 16,
                     split_col: str = "is_test", copy_chunk: int = 1 << 20) -> DataFrame:
    """Add boolean ``split_col``: per class, the ``floor(n_c·f + 0.5)`` rows with
    the smallest (key, row values) are test rows, the rest train.

    ``key`` must be a non-negative long below ``2**key_bits``; by default a
    seeded hash of the row. Rows equal in key and every column are
    interchangeable, so ties cannot change the result.
    """
    cols = df.columns
    k = key if key is not None else default_split_key(df)
    d = df.withColumn("_k", k).withColumn("_b", F.shiftright("_k", key_bits - bucket_bits))

    stats = d.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(label_col)
    cum = (stats.withColumn("_cum", F.sum("_n").over(run))
                .withColumn("_quota", F.floor(F.sum("_n").over(whole) * F.lit(test_fraction) + F.lit(0.5))))
    boundary = cum.filter((F.col("_cum") - F.col("_n") < F.col("_quota")) & (F.col("_cum") >= F.col("_quota"))) \
                  .select(label_col, F.col("_b").alias("_bb"),
                          (F.col("_quota") - (F.col("_cum") - F.col("_n"))).alias("_need"))

    j = d.join(F.broadcast(boundary), label_col, "left")
    plain = (j.filter(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb")))
              .withColumn(split_col, F.coalesce(F.col("_b") < F.col("_bb"), F.lit(False))))
    edge = _split_boundary(j.filter(F.col("_b") == F.col("_bb")), cols, label_col, split_col, copy_chunk)
    out = plain.select(*[F.col(f"`{c}`") for c in cols], split_col).unionByName(edge)
    return out


def _split_boundary(edge: DataFrame, cols: list[str], label_col: str, split_col: str,
                    copy_chunk: int) -> DataFrame:
    """Rows of each class's boundary bucket. Identical rows (same key and
    values) are counted first — a row copied a billion times becomes one row
    with a count — then ranked by (key, values) with running copy counts; each
    distinct row's copies are re-emitted, the first ``need − below`` as test.
    Copies are interchangeable, so this is the same multiset as ranking every
    copy. Large copy groups are emitted in ``copy_chunk``-sized pieces spread
    over tasks."""
    q = [F.col(f"`{c}`") for c in cols]
    order = [F.col("_k")] + [F.col(f"`{c}`") for c in cols if c != label_col]
    distinct = edge.groupBy("_k", "_need", *q).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(label_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("_below", F.sum("_c").over(run) - F.col("_c"))
    ranked = ranked.withColumn("_t", F.least(F.col("_c"), F.greatest(F.lit(0), F.col("_need") - F.col("_below"))))
    pieces = ranked.select("*", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / F.lit(copy_chunk)).cast("long"))).alias("_p"))
    pieces = pieces.repartition("_k", "_p")
    lo = F.col("_p") * F.lit(copy_chunk)
    hi = F.least(F.col("_c"), lo + F.lit(copy_chunk)) - 1
    rows = pieces.select("*", F.explode(F.sequence(lo, hi)).alias("_i"))
    return rows.select(*q, (F.col("_i") < F.col("_t")).alias(split_col))


def split_train_test(df: DataFrame, split_col: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """The two disjoint halves from one split column (no set difference)."""
    return (df.filter(~F.col(split_col)).drop(split_col), df.filter(F.col(split_col)).drop(split_col))


def class_weights(train: DataFrame, label_col: str = K.LABEL_COLUMN) -> DataFrame:
    """Balanced weight n / (k · n_c) per class. One row per class."""
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()   # over the per-class table only (≤ #classes rows)
    return counts.select(
        label_col, "n_class",
        (F.sum("n_class").over(w).cast("double")
         / (F.count(F.lit(1)).over(w).cast("double") * F.col("n_class").cast("double"))).alias("weight"))


def with_class_weight(train: DataFrame, label_col: str = K.LABEL_COLUMN,
                      weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight to each training row (broadcast of a table
    with one row per class)."""
    w = class_weights(train, label_col).select(label_col, weight_col)
    return train.join(F.broadcast(w), label_col, "left")

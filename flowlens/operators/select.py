"""Mutual-information feature scoring (A3) and top-k selection.

MI is estimated from a contingency table of (feature, value bin, class):
one-hot columns have two exact bins; numeric columns use equal-frequency
bins — a value's bin is the number of cut points ≤ it, the cuts being the
exact order statistics at ranks floor(i·n/bins) (``frequency_cuts``), so a
column with few distinct values gets one bin per value and a heavy-tailed one
is not squeezed into one bin (without cuts, ``bins`` equal-width bins over
[0, 1] are used). Each task counts its rows by
(pos, bin, label) in numpy, an Arrow batch at a time, so the shuffle carries
at most features × bins × classes rows per map task. Everything after that works on that small table.

    MI(X; Y) = Σ_x Σ_y n_xy/N · ln(n_xy · N / (n_x · n_y))     (nats)

Scores are rounded to ``digits`` decimals so that ties and order do not
depend on the summation order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import constants as K
from flowlens.session import ship_package, write_scratch


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def bins_of(x: pa.Array, bins: int, cuts: list[float] | None) -> np.ndarray:
    """Bin of each value: with ``cuts`` the number of cut points ≤ it (NaN comes
    last), else of ``bins`` equal-width bins over [0, 1] (NaN in the first).
    Null is in bin 0."""
    v = x.to_numpy(zero_copy_only=False).astype(float, copy=False)
    if cuts is not None:
        out = np.searchsorted(np.array(cuts, dtype=float), v, "right")
    else:
        out = np.nan_to_num(np.clip(np.floor(v * bins), 0, bins - 1)).astype(np.int64)
    return np.where(np.asarray(x.is_null()), 0, out) if x.null_count else out


def _counter(numeric: list[tuple[int, list[float] | None]], nominal: list[dict[str, int]], totals: bool, bins: int):
    """Counts (pos, bin, label) over Arrow batches of label, numeric and nominal
    columns; a row for each combination that a task has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        kind = None
        for b in batches:
            kind = b.column(0).type
            coded = b.column(0).dictionary_encode(null_encoding="encode")
            labels, y = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            k = len(labels)

            def add(pos: int, at: np.ndarray, y: np.ndarray) -> None:
                n = np.bincount(at * k + y)
                seen.update({(pos, i // k, labels[i % k]): int(n[i]) for i in np.flatnonzero(n).tolist()})

            for j, (pos, cuts) in enumerate(numeric):
                add(pos, bins_of(b.column(1 + j), bins, cuts), y)
            for j, places in enumerate(nominal):
                v = b.column(1 + len(numeric) + j).dictionary_encode(null_encoding="encode")
                n = np.bincount(v.indices.to_numpy().astype(np.int64) * k + y, minlength=len(v.dictionary) * k).reshape(-1, k)
                for value, row in zip(v.dictionary.to_pylist(), n.tolist(), strict=True):
                    if value in places:
                        seen.update({(places[value], bins - 1, labels[i]): m for i, m in enumerate(row) if m})
            if totals:
                add(-1, np.zeros(len(y), np.int64), y)
        if seen:
            pos, at, label = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(at, pa.int32()), pa.array(label, kind),
                                              pa.array(seen.values(), pa.int64())], names=["pos", "bin", "label", "n"])

    return run


def contingency(encoded: DataFrame, feature_cols: list[str], label_col: str = K.LABEL_COLUMN,
                bins: int = 32, skip: set | None = None,
                onehot: dict[str, tuple[str, str]] | None = None,
                cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """(pos, bin, label, n_xy) over all rows of ``encoded``.

    Columns in ``skip`` are left out. One-hot columns listed in ``onehot``
    (feature -> (nominal column, value)) are counted from the nominal column
    itself — one entry per row per nominal column, not one per value: bin
    ``bins-1`` is n(c = v, y) and bin 0 is n_y − n(c = v, y), with n_y from a
    class-total entry."""
    skip = set(skip or ())
    onehot = {f: cv for f, cv in (onehot or {}).items() if f not in skip}
    pos = {c: i for i, c in enumerate(feature_cols)}
    cuts = cuts or {}
    numeric = [(i, c) for i, c in enumerate(feature_cols) if c not in skip and c not in onehot]
    by_col: dict[str, dict[str, int]] = {}
    for f, (c, v) in onehot.items():
        by_col.setdefault(c, {})[v] = pos[f]
    picked = encoded.select(_q(label_col).alias("label"), *[_q(c).cast("double").alias(f"x{i}") for i, c in numeric],
                            *[_q(c).cast("string").alias(f"v{j}") for j, c in enumerate(by_col)])
    label = T.StructField("label", picked.schema["label"].dataType)
    ship_package(encoded.sparkSession)
    counted = picked.mapInArrow(_counter([(i, cuts.get(c)) for i, c in numeric], list(by_col.values()), bool(onehot), bins),
                                T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("bin", T.IntegerType()),
                                              label, T.StructField("n", T.LongType())]))
    cont = counted.groupBy("pos", "bin", "label").agg(F.sum("n").alias("n_xy"))
    if not onehot:
        return cont
    cont = write_scratch(cont, "contingency")     # small; read three times below
    oh_pos = sorted(pos[f] for f in onehot)
    totals = cont.filter(F.col("pos") == -1).select("label", F.col("n_xy").alias("n_y"))
    # (one-hot position, class) pairs: the class-total rows (one per class)
    # each expanded by the literal list of one-hot positions
    pairs = totals.select("label", "n_y", F.explode(F.array(*[F.lit(p) for p in oh_pos])).alias("pos"))
    ones = cont.filter(F.col("bin") == bins - 1).select("pos", "label", F.col("n_xy").alias("n1"))
    zeros = (pairs.join(ones, ["pos", "label"], "left")
                  .select("pos", F.lit(0).alias("bin"), "label",
                          (F.col("n_y") - F.coalesce(F.col("n1"), F.lit(0))).alias("n_xy"))
                  .filter(F.col("n_xy") > 0))
    return cont.filter(F.col("pos") >= 0).unionByName(zeros)


def mutual_information(encoded: DataFrame, feature_cols: list[str],
                       label_col: str = K.LABEL_COLUMN, bins: int = 32,
                       digits: int = 10, constant: set | None = None,
                       onehot: dict[str, tuple[str, str]] | None = None,
                       cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """A3: (position, feature, mi) for every feature column.

    The marginals are window sums over the contingency table partitioned by
    feature (≤ bins × classes rows per partition), so the rows are
    counted once. Columns known to be ``constant`` on these rows have a
    single bin, hence MI exactly 0, and are not counted; one-hot columns
    can be counted from their nominal column (``onehot``)."""
    spark = encoded.sparkSession
    cont = contingency(encoded, feature_cols, label_col, bins, skip=constant, onehot=onehot, cuts=cuts)
    by_pos = Window.partitionBy("pos")
    t = (cont.withColumn("n_x", F.sum("n_xy").over(Window.partitionBy("pos", "bin")))
             .withColumn("n_y", F.sum("n_xy").over(Window.partitionBy("pos", "label")))
             .withColumn("n_all", F.sum("n_xy").over(by_pos)))
    nxy, nx, ny, n = (F.col(c).cast("double") for c in ("n_xy", "n_x", "n_y", "n_all"))
    term = (nxy / n) * F.log((nxy * n) / (nx * ny))
    mi = t.groupBy("pos").agg(F.sum(term).alias("mi"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(feature_cols)],
                                  "pos int, feature string")
    return (names.join(mi, "pos", "left")
                 .select(F.col("pos").alias("position"), "feature",
                         F.round(F.coalesce(F.col("mi"), F.lit(0.0)), digits).alias("mi")))


def select_k_best(scores: DataFrame, k: int = K.SELECT_K) -> DataFrame:
    """The k highest scores (ties: earlier column first), returned in
    original column order. ``scores`` has one row per feature."""
    w = Window.orderBy(F.col("mi").desc(), F.col("position").asc())
    return (scores.withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= k)
                  .select("position", "feature", "mi", "rank")
                  .orderBy("position"))


def selected_feature_list(selected: DataFrame) -> list[str]:
    """The selected names in column order (one name per feature; small)."""
    return [r["feature"] for r in selected.orderBy("position").select("feature").collect()]

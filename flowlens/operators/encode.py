"""Robust -> min-max scaling, one-hot encoding and the column transformer.

Written as column expressions, not MLlib scalers: MLlib's RobustScaler sends
zero-IQR columns to 0 and MinMaxScaler sends constants to 0.5, while the
behaviour to match uses a scale of 1 in both cases.

Fitting is one aggregation pass over the training rows; the fitted state
(a few numbers per column, and the category vocabulary) is small and
bounded by the number of columns, so it is brought to the driver and applied
as literals — the same way an MLlib model holds its parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# -- A4 / M1 -----------------------------------------------------------------

@dataclass
class ScalerParams:
    """Per numeric column: quartiles, median and the train min/max."""
    columns: list[str]
    q1: list[float]
    median: list[float]
    q3: list[float]
    x_min: list[float]
    x_max: list[float]

    def scale(self, i: int) -> float:
        s = self.q3[i] - self.q1[i]
        return s if s != 0 else 1.0

    def r_min(self, i: int) -> float:
        return (self.x_min[i] - self.median[i]) / self.scale(i)

    def r_max(self, i: int) -> float:
        return (self.x_max[i] - self.median[i]) / self.scale(i)

    def r_range(self, i: int) -> float:
        r = self.r_max(i) - self.r_min(i)
        return r if r != 0 else 1.0

    def scaled(self, i: int, x: float) -> float:
        """M1 of one value of column ``i``, as ``scaled_column`` has it."""
        return ((x - self.median[i]) / self.scale(i) - self.r_min(i)) / self.r_range(i)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, self.q1[i], self.median[i], self.q3[i], self.scale(i), self.x_min[i],
                 self.x_max[i], self.r_min(i), self.r_range(i)) for i, c in enumerate(self.columns)]
        schema = ("position int, feature string, q1 double, median double, q3 double, "
                  "scale double, x_min double, x_max double, r_min double, r_range double")
        return spark.createDataFrame(rows, schema)


QUARTILES = [0.25, 0.5, 0.75]


def _scaler_of(found: dict, numeric_cols: list[str]) -> ScalerParams:
    """The state of exact quartiles and ends; columns without values have zeros."""
    q1, med, q3, lo, hi = [], [], [], [], []
    for c in numeric_cols:
        qs, mn, mx, _ = found[c]
        qs = qs or [0.0, 0.0, 0.0]
        q1.append(float(qs[0])); med.append(float(qs[1])); q3.append(float(qs[2]))
        lo.append(float(mn if mn is not None else 0.0)); hi.append(float(mx if mx is not None else 0.0))
    return ScalerParams(list(numeric_cols), q1, med, q3, lo, hi)


def fit_scaler(train: DataFrame, numeric_cols: list[str], exact: bool = True,
               accuracy: int = 100000) -> ScalerParams:
    """A4: quartiles, median, min and max of each numeric column (train rows).

    ``exact`` finds the order statistics by sketches and exact counts
    (``operators.quantiles``: no task holds a column's distinct values) and
    interpolates linearly; ``exact=False`` merges bounded quantile sketches
    (``percentile_approx``) in one pass instead.
    """
    if exact:
        from flowlens.operators.quantiles import exact_percentiles
        return _scaler_of(exact_percentiles(train, list(numeric_cols), QUARTILES), numeric_cols)
    q1, med, q3, lo, hi = [], [], [], [], []
    aggs = []
    for i, c in enumerate(numeric_cols):
        x = _q(c).cast("double")
        aggs += [F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"q{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = train.agg(*aggs).first()
    for i in range(len(numeric_cols)):
        qs = row[f"q{i}"] or [0.0, 0.0, 0.0]
        q1.append(float(qs[0])); med.append(float(qs[1])); q3.append(float(qs[2]))
        lo.append(float(row[f"lo{i}"] if row[f"lo{i}"] is not None else 0.0))
        hi.append(float(row[f"hi{i}"] if row[f"hi{i}"] is not None else 0.0))
    return ScalerParams(list(numeric_cols), q1, med, q3, lo, hi)


def scaled_column(p: ScalerParams, i: int, src: Column | None = None) -> Column:
    """M1: ((x − median)/scale − r_min) / r_range, no clipping of unseen values."""
    x = (src if src is not None else _q(p.columns[i])).cast("double")
    r = (x - F.lit(p.median[i])) / F.lit(p.scale(i))
    return (r - F.lit(p.r_min(i))) / F.lit(p.r_range(i))


# -- A5 / M2 -----------------------------------------------------------------

@dataclass
class Vocabulary:
    """Sorted category values per nominal column (train rows only)."""
    columns: list[str]
    values: dict[str, list[str]] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.columns for v in self.values[c]]

    def to_df(self, spark: SparkSession, offset: int = 0) -> DataFrame:
        """(column, value_index, value, feature, position); ``position`` counts
        from ``offset`` (the number of numeric columns placed before)."""
        rows, pos = [], offset
        for c in self.columns:
            for j, v in enumerate(self.values[c]):
                rows.append((c, j, v, f"{c}_{v}", pos))
                pos += 1
        return spark.createDataFrame(rows, "column string, value_index int, value string, "
                                           "feature string, position int")


def fit_vocabulary(train: DataFrame, nominal_cols: list[str], max_values: int = 100_000) -> Vocabulary:
    """A5: distinct (column, value) pairs in one shuffle; the result is the
    width of the encoded matrix. More than ``max_values`` are an error: such a
    column can't be one-hot encoded."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value"))
                      for c in nominal_cols])
    got = (train.select(F.inline(pairs)).filter(F.col("value").isNotNull())
                .distinct().limit(max_values + 1).collect())
    if len(got) > max_values:
        raise ValueError(f"more than {max_values} values in the nominal columns {nominal_cols}: not a vocabulary")
    vals: dict[str, list[str]] = {c: [] for c in nominal_cols}
    for r in got:
        vals[r["column"]].append(r["value"])
    for c in vals:
        vals[c].sort()
    return Vocabulary(list(nominal_cols), vals)


def onehot_columns(vocab: Vocabulary) -> list[Column]:
    """M2: one 0/1 column per known value; unknown or null -> all zeros."""
    out = []
    for c in vocab.columns:
        for v in vocab.values[c]:
            out.append(F.when(_q(c).cast("string") == F.lit(v), F.lit(1.0))
                       .otherwise(F.lit(0.0)).alias(f"{c}_{v}"))
    return out


# -- M3 ----------------------------------------------------------------------

@dataclass
class ColumnTransformer:
    """M3: numeric columns first (scaled), then one-hot columns, named ``col_value``."""
    scaler: ScalerParams
    vocab: Vocabulary

    @property
    def feature_names(self) -> list[str]:
        return list(self.scaler.columns) + self.vocab.feature_names()

    def onehot_sources(self) -> dict[str, tuple[str, str]]:
        """One-hot feature name -> (nominal column, value)."""
        return {f"{c}_{v}": (c, v) for c in self.vocab.columns for v in self.vocab.values[c]}

    def constant_features(self) -> set:
        """Encoded columns that are constant on the fitting rows: numeric
        columns with min = max, one-hot columns of a single-valued nominal."""
        out = {c for i, c in enumerate(self.scaler.columns) if self.scaler.x_min[i] == self.scaler.x_max[i]}
        for c in self.vocab.columns:
            if len(self.vocab.values[c]) == 1:
                out.add(f"{c}_{self.vocab.values[c][0]}")
        return out

    def columns(self) -> list[Column]:
        num = [scaled_column(self.scaler, i).alias(c) for i, c in enumerate(self.scaler.columns)]
        return num + onehot_columns(self.vocab)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Encode ``df``; ``keep`` columns (keys, label, split flag) pass through."""
        keep = [k for k in (keep or []) if k in df.columns]
        return df.select(*[_q(k) for k in keep], *self.columns())

    def transform_selected(self, df: DataFrame, selected: list[str],
                           keep: list[str] | None = None) -> DataFrame:
        """Encode, add absent selected features as 0.0 and order by the
        selected list (bound by name). Only the selected columns are computed."""
        by_name = {}
        for i, c in enumerate(self.scaler.columns):
            by_name[c] = scaled_column(self.scaler, i)
        for c in self.vocab.columns:
            for v in self.vocab.values[c]:
                by_name[f"{c}_{v}"] = F.when(_q(c).cast("string") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
        keep = [k for k in (keep or []) if k in df.columns]
        cols = []
        for name in selected:
            src = by_name.get(name)
            base = name if name in df.columns else None
            if src is None:
                # not produced by the transformer: take the input column if the
                # caller supplies it already encoded, else 0.0
                src = _q(base).cast("double") if base else F.lit(0.0)
            cols.append(src.alias(name))
        return df.select(*[_q(k) for k in keep], *cols)


def fit_transformer(train: DataFrame, numeric_cols: list[str], nominal_cols: list[str],
                    exact: bool = True) -> ColumnTransformer:
    return ColumnTransformer(fit_scaler(train, numeric_cols, exact=exact),
                             fit_vocabulary(train, nominal_cols))


def fit_with_cuts(train: DataFrame, numeric_cols: list[str], nominal_cols: list[str], bins: int) -> tuple[ColumnTransformer, dict[str, list[float]]]:
    """The exact ``fit_transformer``, and the ``frequency_cuts`` of the encoded
    numeric columns that vary, from one search of raw values: scaling keeps the
    order of values, so a rank has the scaled value of the same rank."""
    from flowlens.operators.quantiles import percentiles_and_cuts
    found, raw = percentiles_and_cuts(train, list(numeric_cols), QUARTILES, bins)
    p = _scaler_of(found, numeric_cols)
    cuts = {}
    for i, c in enumerate(p.columns):
        if p.x_min[i] == p.x_max[i]:
            continue
        if math.isinf(p.scaled(i, p.x_min[i])) or math.isinf(p.scaled(i, p.x_max[i])):
            raise ValueError(f"column {c!r} holds an infinite value")
        cuts[c] = sorted({p.scaled(i, x) for x in raw[c]})
    return ColumnTransformer(p, fit_vocabulary(train, nominal_cols)), cuts


def conform_features(df: DataFrame, selected: list[str], keep: list[str] | None = None) -> DataFrame:
    """P16 for an already-encoded table: absent selected features become 0.0,
    columns are reordered to the selected list."""
    keep = [k for k in (keep or []) if k in df.columns]
    cols = [(_q(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in selected]
    return df.select(*[_q(k) for k in keep], *cols)


"""E1 — batch preparation: clean/map labels, split, fit the column
transformer on train rows, encode, score and select features.

Each step is a DataFrame function from ``flowlens.operators``; this module
wires them and materializes the split once (it feeds fitting, encoding and
scoring).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import encode as EN
from flowlens.operators import neighbours as NB
from flowlens.operators import prepare as PR
from flowlens.operators import select as SE
from flowlens.operators.quantiles import frequency_cuts
from flowlens.session import write_scratch
from flowlens.sources import records as RC

SPLIT_COL = "is_test"


def record_split_key() -> Column:
    """Split key of the stand-in rows: integer arithmetic on the row key, so the
    DuckDB oracle can reproduce it (engines hash differently)."""
    h = ((F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 7919
          + F.col("l_suppkey") * 131 + F.col("l_linenumber")) % 2147483647)
    return h * F.lit(2147483629)


RECORD_SPLIT_KEY_SQL = ("(((l_orderkey*1000003 + l_partkey*7919 + l_suppkey*131 + l_linenumber)"
                        " % 2147483647) * 2147483629)")


@dataclass
class Prepared:
    split: DataFrame                  # labelled rows + is_test
    transformer: EN.ColumnTransformer
    scores: DataFrame                 # (position, feature, mi)
    selected: list[str]
    rows: DataFrame                   # the encoded rows as a plan
    materialize: bool = True

    @cached_property
    def encoded(self) -> DataFrame:
        """Keys, label, is_test, encoded features; written when first used."""
        return write_scratch(self.rows, "encoded") if self.materialize else self.rows

    @property
    def train_rows(self) -> DataFrame:
        """The train rows as a plan over the split: a few reads of its
        expressions cost less than writing a table of their width."""
        return self.rows.filter(~F.col(SPLIT_COL))

    @property
    def test_rows(self) -> DataFrame:
        return self.rows.filter(F.col(SPLIT_COL))

    @property
    def train(self) -> DataFrame:
        return self.encoded.filter(~F.col(SPLIT_COL))

    @property
    def test(self) -> DataFrame:
        return self.encoded.filter(F.col(SPLIT_COL))


def labelled_split(records: DataFrame, key: Column | None = None,
                   materialize: bool = True, materialize_input: bool = True) -> DataFrame:
    """Labels, then the split. The split reads its input twice (counts, then
    decisions), so a derived input (e.g. a join) is written once first."""
    labelled = PR.label_records(records)
    if materialize_input:
        labelled = write_scratch(labelled, "labelled")
    split = PR.stratified_split(labelled, key=key, split_col=SPLIT_COL)
    return write_scratch(split, "split") if materialize else split


def prepare(records: DataFrame, key_cols: list[str], key: Column | None = None,
            k: int = K.SELECT_K, exact: bool = True, bins: int = 32,
            materialize: bool = True, estimate: str = "binned") -> Prepared:
    """``estimate``: of mutual information, ``binned`` or, as the source has it,
    by nearest ``neighbours``."""
    split = labelled_split(records, key, materialize)
    train = split.filter(~F.col(SPLIT_COL))
    cuts = None
    if exact and estimate == "binned":  # quartiles and bins by one search
        tr, cuts = EN.fit_with_cuts(train, K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS, bins)
    else:
        tr = EN.fit_transformer(train, K.NUMERIC_COLUMNS, K.NOMINAL_COLUMNS, exact=exact)
    encoded = tr.transform(split, keep=key_cols + [K.LABEL_COLUMN, SPLIT_COL] + K.NOMINAL_COLUMNS)
    # the scores read the split and encode the columns they need
    train_enc = encoded.filter(~F.col(SPLIT_COL))
    scores = neighbour_scores(train_enc, tr) if estimate == "neighbours" else binned_scores(train_enc, tr, bins, cuts)
    selected = SE.selected_feature_list(SE.select_k_best(scores, k))
    return Prepared(split, tr, scores, selected, encoded, materialize)


def binned_scores(train: DataFrame, tr: EN.ColumnTransformer, bins: int = 32, cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """A3 of the encoded training rows, numeric columns in equal-frequency bins
    (``cuts``: their cut points, when they are known)."""
    constant = tr.constant_features()
    if cuts is None:
        cuts = frequency_cuts(train, [c for c in tr.scaler.columns if c not in constant], bins)
    return SE.mutual_information(train, tr.feature_names, K.LABEL_COLUMN, bins=bins, constant=constant,
                                 onehot=tr.onehot_sources(), cuts=cuts)


def neighbour_scores(train: DataFrame, tr: EN.ColumnTransformer, k: int = 3) -> DataFrame:
    """A3 of the encoded training rows, numeric columns by nearest neighbours."""
    numeric = list(tr.scaler.columns)
    exact = SE.mutual_information(train, tr.feature_names, K.LABEL_COLUMN, constant=set(numeric), onehot=tr.onehot_sources(), digits=9)
    return NB.knn_information(train, numeric, K.LABEL_COLUMN, k).unionByName(exact.filter(F.col("position") >= len(numeric)))


def prepare_records(spark: SparkSession, sf_dir: str, **kw) -> Prepared:
    """E1 on the stand-in connection records of ``sf_dir``."""
    recs = RC.read_records(spark, sf_dir)
    return prepare(recs, RC.ROW_KEY, key=record_split_key(), **kw)


def onehot_active(tr: EN.ColumnTransformer) -> Column:
    """Names of the one-hot columns that are 1 in a row, comma separated,
    read back from the encoded 0/1 columns."""
    names = tr.vocab.feature_names()
    return F.concat_ws(",", *[F.when(F.col(f"`{n}`") == 1.0, F.lit(n)) for n in names])

"""Attribution of a linear model's margin to its features.

For a margin m(x) = b + sum of c_i x_i the share of a feature, with features
taken as independent, is c_i (x_i - mean_i); base = m(mean) is the margin of the
average training row, and base plus all shares is the margin. These are the
Shapley values of a linear model, so no row needs Python and nothing is shuffled:
one aggregation gives the means, and the shares are column expressions.

Edge cases: a null value counts as the mean (share 0) and the margin treats it
so; a feature whose mean is null (no training values) must not occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    coefficients: list[float]
    intercept: float
    means: list[float]

    @property
    def base(self) -> float:
        return self.intercept + sum(c * m for c, m in zip(self.coefficients, self.means, strict=True))


def feature_means(train: DataFrame, features: list[str]) -> list[float]:
    """One aggregation; a value for each feature."""
    row = train.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [0.0 if v is None else v for v in row]


def linear_model(features: list[str], coefficients: list[float], intercept: float, train: DataFrame) -> LinearModel:
    return LinearModel(list(features), [float(c) for c in coefficients], float(intercept), feature_means(train, features))


def of_detector(detector: PipelineModel, features: list[str], train: DataFrame) -> LinearModel:
    """The linear model of a fitted binary detector (M10), logistic or SVM."""
    fitted = detector.stages[-1]
    return linear_model(features, fitted.coefficients.toArray().tolist(), fitted.intercept, train)


def shares(model: LinearModel) -> Column:
    """array<double>: the share of each feature, in their order."""
    return F.array(*[F.coalesce(F.lit(c) * (F.col(f"`{f}`").cast("double") - F.lit(m)), F.lit(0.0))
                     for f, c, m in zip(model.features, model.coefficients, model.means, strict=True)])


def with_attribution(rows: DataFrame, model: LinearModel) -> DataFrame:
    """Adds base, impacts (by feature) and margin, their sum."""
    out = rows.withColumn("impacts", shares(model)).withColumn("base", F.lit(model.base))
    return out.withColumn("margin", F.aggregate("impacts", F.col("base"), lambda a, x: a + x))


def long_impacts(attributed: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, position, feature and impact: a row for each feature."""
    names = F.array(*[F.lit(f) for f in features])
    return attributed.select(*keys, F.posexplode("impacts").alias("position", "impact")).withColumn(
        "feature", F.element_at(names, F.col("position") + 1))

"""Mutual information of a number and a class by nearest neighbours (A3, M4).

The estimate for a continuous column (Ross 2014): with k' = min(k, n_y - 1),
r the distance of a row to its k'-th nearest row of its own class and m the
number of rows of any class nearer than r, itself included (at r = 0: at the
same value),

    I = psi(N) + <psi(k')> - <psi(n_y)> - <psi(m)>,   at least 0,

averaged over the rows whose class has more than one. Values are taken as
whole multiples of 10^-12, so distances and ties are exact.

All columns are worked at once, as rows (position, x, class, count): equal
values of a class are one row, however many copies there are. No task holds a
column: rows are ranged by (position, class, x) and written with the number of
their range; the k values on either side of a range's edge are handed to it
from the ranges next to it, so a window over (position, class, range) sees
every row's neighbours. The rows nearer than r are a difference of two
cumulative counts, for which the ends of the intervals are ranged among the
values, counted within their range, and shifted by the sums of the ranges
before. What is summed over whole columns has a row for each range.

Edge cases: null and NaN values of a column, and rows without a class, don't
count; a class of one row counts in no average; a column without rows to count
has 0, as have empty tables; infinite values, and values of over 9 * 10^6, are
an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.session import write_scratch

UNIT = 10**12
LARGEST = 9_000_000


def digamma(n: Column) -> Column:
    """psi of a whole number from 1: the asymptotic series at n + 8, and the recurrence down."""
    x = n.cast("double") + F.lit(8.0)
    i = F.lit(1.0) / (x * x)
    series = F.log(x) - F.lit(0.5) / x - i * (F.lit(1 / 12) - i * (F.lit(1 / 120) - i * (F.lit(1 / 252) - i * (F.lit(1 / 240) - i * F.lit(1 / 132)))))
    for j in range(8):
        series = series - F.lit(1.0) / (n.cast("double") + F.lit(float(j)))
    return series


def long_values(encoded: DataFrame, features: list[str], label_col: str) -> DataFrame:
    """position, x (multiples of 10^-12), label and the count n."""
    def entry(i: int, c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        whole = F.when(F.abs(x) <= LARGEST, F.round(x * F.lit(float(UNIT))).cast("long")).otherwise(
            F.raise_error(F.lit(f"{c}: a value is infinite or too large for nearest neighbours")).cast("long"))
        return F.when(x.isNotNull() & ~F.isnan(x), F.struct(F.lit(i).alias("position"), whole.alias("x")))

    entries = F.filter(F.array(*[entry(i, c) for i, c in enumerate(features)]), lambda e: e.isNotNull())
    rows = encoded.where(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{label_col}`").alias("label"), F.inline(entries))
    return rows.groupBy("position", "label", "x").agg(F.count(F.lit(1)).alias("n"))


def in_ranges(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` ranged by ``keys`` and written, with the number of their range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_scratch(rows.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()), name)


def with_distance(values: DataFrame, k: int) -> DataFrame:
    """position, label, x, n, and k' and r of each of these rows."""
    ranged = in_ranges(values, ["position", "label", "x"], "knn-ranges")
    group = ["position", "label"]
    inside = Window.partitionBy(*group, "range")
    edge = ranged.withColumn("a", F.row_number().over(inside.orderBy("x"))).withColumn("z", F.row_number().over(inside.orderBy(F.desc("x"))))
    edge = write_scratch(edge.where((F.col("a") <= k) | (F.col("z") <= k)).drop("a", "z"), "knn-edges")
    # for each range of a group: the k values before and after it, from all edges of the group
    every = Window.partitionBy(*group).orderBy("range", "x")
    back = [F.struct(F.lag("x", j).over(every).alias("x"), F.lag("n", j).over(every).alias("n")) for j in range(1, k + 1)]
    ahead = [F.struct(F.lead("x", j).over(every).alias("x"), F.lead("n", j).over(every).alias("n")) for j in range(1, k + 1)]
    seen = edge.select(*group, "range", "x", F.array(*back).alias("back"), F.array(*ahead).alias("ahead"))
    first = seen.groupBy(*group, "range").agg(F.min_by("back", "x").alias("back"), F.max_by("ahead", "x").alias("ahead"))
    handed = first.select(*group, "range", F.inline(F.concat("back", "ahead"))).where("x is not null")
    both = ranged.withColumn("own", F.lit(True)).unionByName(handed.withColumn("own", F.lit(False)))
    order = inside.orderBy("x")
    near = [F.when(f("x", j).over(order).isNotNull(), F.struct(F.abs(F.col("x") - f("x", j).over(order)).alias("d"), f("n", j).over(order).alias("n")))
            for f in (F.lag, F.lead) for j in range(1, k + 1)]
    near = F.array_sort(F.array_compact(F.array(F.struct(F.lit(0).cast("long").alias("d"), (F.col("n") - 1).alias("n")), *near)))
    of_class = values.groupBy(*group).agg(F.sum("n").alias("of_class"))
    rows = both.withColumn("near", near).where("own").join(of_class, group).where("of_class > 1")
    rows = rows.withColumn("k", F.least(F.lit(k).cast("long"), F.col("of_class") - 1))
    step = "aggregate(near, struct(0L as seen, 0L as r), (s, e) -> if(s.seen >= k, s, struct(s.seen + e.n as seen, e.d as r)), s -> s.r)"
    return rows.select(*group, "x", "n", "of_class", "k", F.expr(step).alias("r"))


def with_nearer(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Adds m: the rows of any class nearer than r."""
    reach = F.greatest(F.col("r") - 1, F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    end = lambda at, turn, sign: rows.select("position", at.alias("v"), F.lit(turn).alias("turn"), zero.alias("n"), "label", "x", F.lit(sign).alias("sign"))
    ends = end(F.col("x") - reach, 0, -1).unionByName(end(F.col("x") + reach, 2, 1))
    points = values.groupBy("position", F.col("x").alias("v")).agg(F.sum("n").alias("n")).select(
        "position", "v", F.lit(1).alias("turn"), "n", F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("int").alias("sign"))
    ranged = in_ranges(points.unionByName(ends), ["position", "v", "turn"], "knn-ends")
    sums = ranged.groupBy("position", "range").agg(F.sum("n").alias("n"))
    before = sums.select("position", "range", F.coalesce(F.sum("n").over(
        Window.partitionBy("position").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("position", "range").orderBy("v", "turn"))
    counted = ranged.withColumn("upto", upto).where("sign is not null").join(before, ["position", "range"])
    m = counted.groupBy("position", "label", "x").agg(F.sum(F.col("sign") * (F.col("before") + F.col("upto"))).alias("m"))
    return rows.join(m, ["position", "label", "x"])


def knn_information(encoded: DataFrame, features: list[str], label_col: str = K.LABEL_COLUMN, k: int = 3, digits: int = 9) -> DataFrame:
    """position, feature, mi for every feature, as numbers."""
    values = write_scratch(long_values(encoded, features, label_col), "knn-values")
    rows = with_nearer(write_scratch(with_distance(values, k), "knn-distances"), values)
    mean = lambda x: F.sum(x * F.col("n")) / F.sum("n")
    mi = rows.groupBy("position").agg((digamma(F.sum("n")) + mean(digamma(F.col("k"))) - mean(digamma(F.col("of_class"))) - mean(digamma(F.col("m")))).alias("mi"))
    names = encoded.sparkSession.createDataFrame(list(enumerate(features)), "position int, feature string")
    return names.join(mi, "position", "left").select("position", "feature", F.round(F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)), digits).alias("mi"))

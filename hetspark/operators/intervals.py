"""Joins of values with intervals, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetspark.operators.cluster import ERROR

#: Where no width of buckets is given: buckets as wide as the median interval.
MEDIAN = 0.5


def interval_join(df: DataFrame, value: str, intervals: DataFrame, width: float | None = None, low: str = "low", high: str = "high", on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of df with each of the intervals(low, high, ...) that hold their value: low < value < high, ends excluded.

    The line is cut into buckets. An interval is filed under every bucket that it touches, a value under its own; the
    two meet by bucket (and by the columns `on`), and the bounds are checked once more. A wider bucket files intervals
    less often and lets more of them meet a value in vain; without a width it is the median length of all intervals.
    Buckets with many rows are large partitions of a plain join, which Spark splits; few intervals are broadcast by
    Spark itself.

    Defined cases: null values and intervals with a null end hold nothing, nor do those that are empty or turned round.
    Rows that several intervals hold come several times. Other columns pass through; names of the two sides but `on`
    must differ.
    """
    span = F.col(high) - F.col(low)
    some = intervals.where(span > 0)
    if width is None:
        width = some.agg(F.percentile_approx(span, MEDIAN).cast("double").alias("w")).first().w or 1.0
    at = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    filed = some.withColumn("__bucket", F.explode(F.sequence(at(F.col(low)), at(F.col(high)))))
    met = df.where(F.col(value).isNotNull()).withColumn("__bucket", at(F.col(value))).join(filed, ["__bucket", *on])
    return met.where((F.col(value) > F.col(low)) & (F.col(value) < F.col(high))).drop("__bucket")


def net(df: DataFrame, covs: list[float], most: int) -> DataFrame:
    """(cov, n, low, high): the interval of n copies for every candidate coverage; that of one copy starts at 0. Made
    from df's session; candidates times copies rows."""
    rows = [(float(c), n, 0.0 if n == 1 else c * (n - 0.5), c * (n + 0.5)) for c in covs for n in range(1, most + 1)]
    return df.sparkSession.createDataFrame(rows, "cov double, n int, low double, high double")


def given_cells(labelled: DataFrame, cells: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """(name, size): pairs of bins(covB, covA, freq, smudge) that are no errors in each of the cells(name, low_b, high_b,
    low_a, high_a) that a user gives, with over `cutoff` of all such pairs. Cells may overlap; a pair counts in each."""
    rows = labelled.where(F.col("smudge") != ERROR)
    inside = interval_join(rows, "covB", cells, low="low_b", high="high_b")
    inside = inside.where((F.col("covA") > F.col("low_a")) & (F.col("covA") < F.col("high_a")))
    each = inside.groupBy("name").agg(F.sum("freq").alias("size"))
    whole = rows.agg(F.sum("freq").cast("double").alias("whole"))  # one row
    return each.join(F.broadcast(whole), F.col("size") > F.col("whole") * cutoff).select("name", "size")

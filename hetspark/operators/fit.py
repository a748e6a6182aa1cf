"""What coverage a histogram has: cells of a net, their centres, centrality over candidates, labels of peaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from hetspark.functions import sequences as S
from hetspark.operators.cluster import ERROR, NOISE
from hetspark.schema import MOST_COPIES, MOST_MINOR

#: Three grids of candidates (start, end, step); each but the first stands around the whole part of the best so far.
GRIDS = ((0.05, 0.05, 2), (-1.9, 1.9, 0.2), (-0.19, 0.19, 0.01))


def copies(value: Column, cov: Column, most: int) -> Column:
    """Number of copies whose open interval cov * (n - 1/2) to cov * (n + 1/2) holds the value; that of 1 starts at 0.
    Null on an edge and beyond `most`."""
    inside = lambda n: (value > (F.lit(0.0) if n == 1 else cov * (n - 0.5))) & (value < cov * (n + 0.5))
    return F.coalesce(*(F.when(inside(n), F.lit(n)) for n in range(1, most + 1)))


def in_cells(labelled: DataFrame, covs: list[float]) -> DataFrame:
    """Bins without errors with (cov, a, b) for every candidate coverage under which they lie in a cell of the net."""
    rows = labelled.where(F.col("smudge") != ERROR).select("covA", "covB", "freq", F.explode(F.array(*(F.lit(float(c)) for c in covs))).alias("cov"))
    rows = rows.withColumn("b", copies(F.col("covB"), F.col("cov"), MOST_MINOR)).withColumn("a", copies(F.col("covA"), F.col("cov"), MOST_COPIES - 1))
    return rows.where((F.col("a") >= F.col("b")) & (F.col("a") + F.col("b") <= MOST_COPIES))


def cells(labelled: DataFrame, covs: list[float], genomic: int, cutoff: float = 0.0) -> DataFrame:
    """cov, a, b, size, mode and mean centre and extent of each cell with over `cutoff` of all genomic pairs."""
    f, ca, cb = F.col("freq"), F.col("covA"), F.col("covB")
    top = F.max_by(F.struct("covA", "covB"), F.struct("freq", -ca, -cb))
    each = in_cells(labelled, covs).groupBy("cov", "a", "b").agg(
        F.sum("freq").alias("size"), top.alias("top"), F.sum(f * ca).alias("sum_a"), F.sum(f * cb).alias("sum_b"),
        F.min("covA").alias("min_a"), F.max("covA").alias("max_a"), F.min("covB").alias("min_b"), F.max("covB").alias("max_b"),
    )
    return each.where(F.col("size") / F.lit(float(genomic)) > cutoff).select(
        "cov", "a", "b", "size", F.col("top.covA").alias("mode_a"), F.col("top.covB").alias("mode_b"),
        (F.col("sum_a") / F.col("size")).alias("mean_a"), (F.col("sum_b") / F.col("size")).alias("mean_b"), "min_a", "max_a", "min_b", "max_b",
    )


def rounded_cells(labelled: DataFrame, cov: float, cutoff: float = 0.0) -> DataFrame:
    """(a, b, size): cells whose copies of A are covA / cov rounded half to even (0 as 1) and those of B lie in open
    intervals; each with over `cutoff` of all pairs that are no errors."""
    rows = labelled.where(F.col("smudge") != ERROR)
    a = F.greatest(F.rint(F.col("covA") / F.lit(float(cov))), F.lit(1.0)).cast("int")
    inside = rows.select("freq", a.alias("a"), copies(F.col("covB"), F.lit(float(cov)), MOST_MINOR).alias("b"))
    each = inside.where((F.col("a") >= F.col("b")) & (F.col("a") + F.col("b") <= MOST_COPIES)).groupBy("a", "b").agg(F.sum("freq").alias("size"))
    whole = rows.agg(F.sum("freq").cast("double").alias("whole"))  # one row
    return each.join(F.broadcast(whole), F.col("size") > F.col("whole") * cutoff).select("a", "b", "size")


def centrality(found: DataFrame, covs: list[float], centre: str = "mode", dist: str = "theoretical_center") -> DataFrame:
    """(cov, centrality): distances of cells' centres, weighted by size; 1 for a candidate without cells."""

    def away(x: str) -> Column:
        at, n, cov = F.col(f"{centre}_{x}"), F.col(x), F.col("cov")
        if dist == "theoretical_center":
            return F.abs((at - cov * n) / cov)
        if dist == "theoretical_edge":
            return F.least(F.abs(at - cov * (n - 0.5)), F.abs(cov * (n + 0.5) - at))
        if dist == "empirical_edge":
            return F.least(F.abs(F.col(f"max_{x}") - at), F.abs(at - F.col(f"min_{x}")))
        raise ValueError(dist)

    weighed = found.groupBy("cov").agg((F.sum((away("a") + away("b")) * F.col("size")) / F.sum("size")).alias("centrality"))
    grid = found.sparkSession.createDataFrame([(float(c),) for c in covs], "cov double")
    return grid.join(weighed, "cov", "left").select("cov", F.coalesce("centrality", F.lit(1.0)).alias("centrality"))


def grid(level: int, low: float, high: float) -> list[float]:
    start, end, step = GRIDS[level]
    first, n = int(low) + start, max(0, math.ceil((int(high) + end - (int(low) + start)) / step))
    return [first + i * step for i in range(n)]


def grid_search(labelled: DataFrame, genomic: int, low: float, high: float, cutoff: float = 0.0) -> tuple[float, DataFrame]:
    """(best coverage, (level, cov, centrality) of all candidates). One job for each grid, whatever its length.

    The best is the first of least centrality. The answer comes from the third grid and, to be sure, half its best.
    """
    spark, rows = labelled.sparkSession, []

    def tested(covs: list[float]) -> dict[float, float]:
        return {r.cov: r.centrality for r in centrality(cells(labelled, covs, genomic, cutoff), covs).collect()}

    for level in range(len(GRIDS)):
        covs = grid(level, low, high)
        got = tested(covs)
        best = min(covs, key=got.__getitem__)
        rows += [(level + 1, c, got[c]) for c in covs]
        low = high = best
    half = tested([best / 2])[best / 2]
    rows.append((len(GRIDS), best / 2, half))
    if half < got[best]:
        best /= 2
    return best, spark.createDataFrame(rows, "level int, cov double, centrality double")


def coverage_or_zero(best: float, error_fraction: float) -> float:
    """Where most pairs are errors, no coverage is given."""
    return best if error_fraction < 0.7 else 0.0


def label_peaks(labelled: DataFrame, cov: float, genomic: int, cutoff: float = 0.0) -> DataFrame:
    """(smudge, size, a, b, structure) of peaks with over `cutoff` of all genomic pairs: copies of the bin of largest
    freq, rounded half to even. Without a coverage there are none."""
    top = F.max_by(F.struct("covA", "covB"), F.struct("freq", -F.col("covA"), -F.col("covB")))
    each = labelled.where((F.col("smudge") > NOISE) & F.lit(cov > 0)).groupBy("smudge").agg(F.sum("freq").alias("size"), top.alias("top"))
    n = lambda x: F.rint(F.col(x) / F.lit(float(cov or 1))).cast("int")
    found = each.where(F.col("size") / F.lit(float(genomic or 1)) > cutoff).select("smudge", "size", n("top.covA").alias("a"), n("top.covB").alias("b"))
    return found.select("*", S.structure(F.col("a"), F.col("b")).alias("structure"))


def local_minimum(histogram: DataFrame) -> DataFrame:
    """(place): the first place, from 0, of a value not above the one before and below the one after. Ends are open."""
    order = W.Window.orderBy("value")
    n, last, after = F.col("n"), F.lag("n").over(order), F.lead("n").over(order)
    found = histogram.select(
        (F.row_number().over(order) - 1).alias("place"), (F.coalesce(last >= n, F.lit(True)) & F.coalesce(n < after, F.lit(True))).alias("low")
    )
    return found.where("low").agg(F.min("place").alias("place"))


def cutoff_lower(histogram: DataFrame) -> DataFrame:
    """(cutoff): 1.25 times the place of the first local minimum, rounded half to even, 10 at least."""
    return local_minimum(histogram).select(F.greatest(F.lit(10), F.rint(F.col("place") * 1.25)).cast("int").alias("cutoff"))


def cutoff_place(histogram: DataFrame, share: float = 0.998) -> DataFrame:
    """(place): first place, from 0 and without the first value, up to which over `share` of all lie."""
    order = W.Window.orderBy("value")
    rest = histogram.withColumn("place", F.row_number().over(order) - 2).where("place >= 0")
    whole = W.Window.partitionBy()
    upto = F.sum("n").over(W.Window.orderBy("value").rowsBetween(W.Window.unboundedPreceding, 0)) / F.sum("n").over(whole)
    return rest.select("place", upto.alias("share")).where(F.col("share") > share).agg(F.min("place").alias("place"))


def rounded_up(x: float) -> float:
    """The next number of two digits (one below ten) and zeros."""
    digits = math.ceil(math.log(x, 10))
    unit = 10 ** (digits - (1 if digits <= 1 else 2))
    return math.ceil(x / unit) * unit


def weighted_percentile(df: DataFrame, value: str, weight: str, q: float) -> DataFrame:
    """(value): the smallest one up to which q percent of the weight lies; no value between two is made up."""
    each = df.groupBy(F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(W.Window.orderBy("value").rowsBetween(W.Window.unboundedPreceding, 0))
    reached = each.select("value", upto.alias("upto"), F.sum("w").over(W.Window.partitionBy()).alias("whole"))
    return reached.where(F.col("upto") >= F.lit(q / 100) * F.col("whole")).agg(F.min("value").alias("value"))

"""Local aggregation: every bin of a coverage histogram joins the peak that its steepest ascent leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from hetspark.functions.checkpoints import settled

#: Labels of bins in the error band, and of bins below the noise filter.
ERROR, NOISE = -1, 0


def probes(bins: DataFrame, distance: int) -> DataFrame:
    """bins with (turn, at_a, at_b): the bins that each one looks at, in order.

    For each a from covA - d to covA + d, v runs from covB - r to covB + r with r = d - |covA - a|. The bin looked at is
    (a, v) up to v = a; beyond the diagonal it is (v, v - 1), or (v, a) where that is the first v.
    """
    a = F.explode(F.sequence(F.col("covA") - distance, F.col("covA") + distance))
    rows = bins.withColumn("a", a).withColumn("r", F.lit(distance) - F.abs(F.col("covA") - F.col("a")))
    rows = rows.withColumn("v", F.explode(F.sequence(F.col("covB") - F.col("r"), F.col("covB") + F.col("r"))))
    first, below = F.col("v") == F.col("covB") - F.col("r"), F.col("v") <= F.col("a")
    return rows.select(
        *bins.columns, (F.col("a") * 100_000 + F.col("v")).alias("turn"), F.when(below, F.col("a")).otherwise(F.col("v")).alias("at_a"),
        F.when(below, F.col("v")).when(first, F.col("a")).otherwise(F.col("v") - 1).alias("at_b"),
    )


def local_aggregation(bins: DataFrame, distance: int, noise_filter: int, mask_errors: bool) -> DataFrame:
    """bins(covB, covA, freq) with smudge: ERROR, NOISE or the number of a peak.

    Bins count in order of falling freq (then covA + covB, then covB). A bin's parent is, among the bins it looks at
    that come before it, the one of largest freq, the first of equals. Bins without a parent are peaks, numbered in
    order; with mask_errors bins of covB < least covB + distance are roots labelled ERROR, and what climbs to them is
    too. Roots are found by pointer jumping, each round settled: so many rounds as the longest ascent has bits.
    """
    bins = settled(bins.select("covB", "covA", "freq"))
    lowest = bins.agg(F.min("covB").alias("low"))
    rows = bins.join(lowest, F.col("covB") >= F.col("low")).withColumn("error", F.lit(mask_errors) & (F.col("covB") < F.col("low") + distance)).drop("low")
    active = rows.where(F.col("freq") >= noise_filter)
    before = lambda f, a, b: F.struct((-f).alias("f"), (a + b).alias("s"), b.alias("b"))
    seen = active.select(F.col("covA").alias("at_a"), F.col("covB").alias("at_b"), F.col("freq").alias("at_f"))
    met = probes(active.where(~F.col("error")), distance).join(seen, ["at_a", "at_b"])
    met = met.where(before(F.col("at_f"), F.col("at_a"), F.col("at_b")) < before(F.col("freq"), F.col("covA"), F.col("covB")))
    up = met.groupBy("covA", "covB").agg(F.max_by(F.struct("at_a", "at_b"), F.struct("at_f", -F.col("turn"))).alias("up"))
    here = F.struct(F.col("covA").alias("at_a"), F.col("covB").alias("at_b"))
    tree = settled(active.join(up, ["covA", "covB"], "left").select("covA", "covB", "freq", "error", F.coalesce("up", here).alias("up")))
    while True:
        over = tree.select(F.struct(F.col("covA").alias("at_a"), F.col("covB").alias("at_b")).alias("up"), F.col("up").alias("next"))
        jumped = settled(tree.join(over, "up").select("covA", "covB", "freq", "error", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        tree = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    roots = tree.where((F.col("up.at_a") == F.col("covA")) & (F.col("up.at_b") == F.col("covB")))
    numbered = W.Window.orderBy(F.desc("freq"), F.col("covA") + F.col("covB"), "covB")
    peaks = roots.where(~F.col("error")).select("up", F.row_number().over(numbered).alias("smudge")).unionByName(roots.where("error").select("up", F.lit(ERROR).alias("smudge")))
    labels = tree.join(peaks, "up").select("covB", "covA", "smudge")
    return settled(bins.join(labels, ["covB", "covA"], "left").select("covB", "covA", "freq", F.coalesce("smudge", F.lit(NOISE)).alias("smudge")))


def totals(labelled: DataFrame) -> DataFrame:
    """total_kmers, genomic, in_peaks, errors and error_fraction of a labelled histogram."""
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("freq"))), F.lit(0)).cast("bigint")
    label = F.col("smudge")
    sums = labelled.agg(F.sum("freq").cast("bigint").alias("total_kmers"), of(label != ERROR).alias("genomic"), of(label > NOISE).alias("in_peaks"), of(label == ERROR).alias("errors"))
    return sums.withColumn("error_fraction", F.col("errors") / F.col("total_kmers"))


def peak_summary(labelled: DataFrame) -> DataFrame:
    """smudge, n_bins, size, and the bin of largest freq (the first by covA, covB of equals) of each peak."""
    top = F.max_by(F.struct("covA", "covB", "freq"), F.struct("freq", -F.col("covA"), -F.col("covB")))
    each = labelled.where(F.col("smudge") > NOISE).groupBy("smudge").agg(F.count("*").alias("n_bins"), F.sum("freq").alias("size"), top.alias("top"))
    return each.select("smudge", "n_bins", "size", F.col("top.covA").alias("mode_a"), F.col("top.covB").alias("mode_b"), F.col("top.freq").alias("mode_freq"))

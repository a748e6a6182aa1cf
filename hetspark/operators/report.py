"""Tables of structures and their sizes, reports, and what plots show, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hetspark.functions import sequences as S
from hetspark.operators.cluster import ERROR
from hetspark.operators.fit import weighted_percentile


def structure_table(found: DataFrame, genomic: int) -> DataFrame:
    """(structure, size, rel_size) from rows of (structure, size): sizes of equal structures are added."""
    each = found.groupBy("structure").agg(F.sum("size").cast("bigint").alias("size"))
    return each.select("structure", "size", F.bround(F.col("size") / F.lit(float(genomic or 1)), 4).alias("rel_size"))


def annotated(labelled: DataFrame, peaks: DataFrame) -> DataFrame:
    """(covB, covA, freq, smudge): the bins of labelled peaks with short structures."""
    names = peaks.select("smudge", S.short_structure(F.col("a"), F.col("b")).alias("name"))
    return labelled.join(names, "smudge").select("covB", "covA", "freq", F.col("name").alias("smudge"))


def report_labels(max_ploidy: int = 16) -> list[str]:
    """The structures that a report has columns for, shortest first, then by name, in reduced form."""
    full = [(a, b) for b in range(1, max_ploidy + 1) for a in range(b, 2 * max_ploidy + 1 - b)]
    full.sort(key=lambda x: (x[0] + x[1], "A" * x[0] + "B" * x[1]))
    return [f"{a}A{b}B" if a + b > 4 else "A" * a + "B" * b for a, b in full]


def wide_report(table: DataFrame, totals: DataFrame, dataset: str) -> DataFrame:
    """One row: dataset, total_kmers, total_error_kmers and a size for each of report_labels(), 0 if absent."""
    names = report_labels()
    sizes = table.select(S.reduced_structure(F.col("structure")).alias("label"), "size")
    wide = sizes.groupBy(F.lit(1).alias("one")).pivot("label", names).agg(F.sum("size"))
    head = totals.select(F.lit(1).alias("one"), F.lit(dataset).alias("dataset"), "total_kmers", F.col("errors").alias("total_error_kmers"))
    return head.join(wide, "one", "left").select("dataset", "total_kmers", "total_error_kmers", *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(n) for n in names))


def pair_columns(bins: DataFrame) -> DataFrame:
    """bins with total_pair_cov and minor_variant_rel_cov."""
    return bins.withColumn("total_pair_cov", F.col("covA") + F.col("covB")).withColumn("minor_variant_rel_cov", F.col("covB") / (F.col("covA") + F.col("covB")))


def filtered(bins: DataFrame, floor: int | None = None, quantile: float | None = None) -> DataFrame:
    """Bins of both coverages from floor on, and of a total below the weighted quantile (of what the floor left)."""
    out = pair_columns(bins)
    if floor:
        out = out.where((F.col("covA") >= floor) & (F.col("covB") >= floor))
    if quantile:
        out = out.join(weighted_percentile(out, "total_pair_cov", "freq", quantile), F.col("total_pair_cov") < F.col("value")).drop("value")
    return out


def weighted_histogram(df: DataFrame, value: str, weight: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value, which the last bin includes. bins: None
    makes them one unit wide. Empty bins have no row."""
    ends = df.agg(F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"))
    rows = df.join(ends, F.col(value) >= F.col("least"))
    n = F.lit(bins) if bins else F.greatest(F.lit(1.0), F.col("most") - F.col("least")).cast("int")
    span = F.when(F.col("most") > F.col("least"), F.col("most") - F.col("least")).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col(value) - F.col("least")) / span * n).cast("int"), n - 1)
    each = rows.select(at.alias("bin"), (F.col("least") + at * span / n).alias("low"), (F.col("least") + (at + 1) * span / n).alias("high"), F.col(weight).alias("w"))
    return each.groupBy("bin", "low", "high").agg(F.sum("w").alias("n"))


def axis_limits(bins: DataFrame, cov: float, upper: int | None = None) -> DataFrame:
    """(x_low, x_high, y_low, y_high) of a plot. A coverage at the 95th weighted percentile gets the whole range."""
    pairs = pair_columns(bins)
    edge = weighted_percentile(pairs, "total_pair_cov", "freq", 95)
    ends = pairs.agg(F.min("total_pair_cov").alias("least"), F.max("total_pair_cov").alias("most")).join(edge, F.lit(True))
    whole = F.col("value") == F.lit(float(cov))
    top = F.when(whole, F.col("most")).otherwise(F.least(F.greatest(F.lit(100.0), F.lit(10.0 * cov)), F.col("most")))
    return ends.select(F.lit(0.0).alias("x_low"), F.lit(0.5).alias("x_high"), F.when(whole, F.col("least")).otherwise(F.col("least") - 1).cast("double").alias("y_low"), (F.lit(float(upper)) if upper else top).cast("double").alias("y_high"))


def boxes(bins: DataFrame, cov: float, log: bool = False, colours: int = 32, upper: int | None = None) -> DataFrame:
    """(covB, covA, left, right, low, high, colour): the rectangle of each bin and the number of its colour.

    Bins on the diagonal count twice. Boxes are 1 / total wide on either side of the relative minor coverage, up to 0.5.
    """
    pairs = pair_columns(bins).withColumn("weight", F.when(F.col("covA") == F.col("covB"), F.col("freq") * 2).otherwise(F.col("freq")).cast("double"))
    if log:
        pairs = pairs.withColumn("weight", F.log10("weight"))
    ends = pairs.agg(F.max("weight").alias("most"), F.min("total_pair_cov").alias("least")).join(axis_limits(bins, cov, upper), F.lit(True))
    rows = pairs.join(ends, (F.col("total_pair_cov") >= F.greatest("least", "y_low")) & (F.col("total_pair_cov") < F.col("y_high")))
    x, half = F.col("minor_variant_rel_cov"), F.lit(1.0) / (F.col("total_pair_cov") * 2)
    return rows.select("covB", "covA", (x - half).alias("left"), F.least(F.lit(0.5), x + half).alias("right"), (F.col("total_pair_cov") - 0.5).alias("low"), (F.col("total_pair_cov") + 0.5).alias("high"), F.rint(F.lit(float(colours - 1)) * F.col("weight") / F.col("most")).cast("int").alias("colour"))


def expected_structures(table: DataFrame, cov: float, least: float = 0.05) -> DataFrame:
    """(label, x, y, right_aligned): where the names of larger structures stand in a plot."""
    ploidy = F.length("structure")
    x = S.n_of("B", F.col("structure")) / ploidy
    return table.where(F.col("rel_size") > least).select(S.reduced_structure(F.col("structure")).alias("label"), x.alias("x"), (ploidy * F.lit(float(cov))).alias("y"), (x == 0.5).alias("right_aligned"))


def size_labels(table: DataFrame, least: float = 0.03) -> DataFrame:
    """(label, size, line): the list of sizes beside a plot; its order is size falling, then the table's own."""
    label, size = S.reduced_structure(F.col("structure")), F.bround("rel_size", 2)
    line = F.concat(F.format_string("%.2f", size), F.lit("   "), F.rpad(label, 6, " "))
    return table.select(label.alias("label"), size.alias("size"), line.alias("line")).where(F.col("size") >= least)


def legend_ticks(bins: DataFrame, log: bool = False) -> DataFrame:
    """(tick, value): seven rounded values along the colour ramp; with log, powers of ten from 1 on. The diagonal
    counts twice, as in boxes()."""
    weight = F.when(F.col("covA") == F.col("covB"), F.col("freq") * 2).otherwise(F.col("freq"))
    most = bins.agg(F.max(weight).cast("double").alias("most"))
    steps = F.array(*(F.lit(x) for x in ((0.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0) if log else map(float, range(7)))))
    x, top = F.col("x") / 6, F.col("most")
    raw = most.select(F.posexplode(steps).alias("tick", "x"), "most").select("tick", (F.pow(F.lit(10.0), F.log10(top) * x) if log else top * x).alias("raw"))
    unit = F.when(F.col("raw") > 1000, 1000).when(F.col("raw") > 100, 100).otherwise(10)
    return raw.select("tick", (F.rint(F.col("raw") / unit) * unit).cast("bigint").alias("value"))


#: Fixed values of the grid over a plot: half copies from 1/2 on have a line, 16 of A and 8 of B, of so many points.
LINES_A, LINES_B, POINTS = 16, 8, 500


def iso_lines(bins: DataFrame, cov: float, upper: float = 250, points: int = POINTS) -> DataFrame:
    """(kind, copies, step, x, y): the lines between cells of whole copies, half a copy from either: constant coverage of
    A from the least covB to that coverage, below `upper`; constant coverage of B from twice of it (less 2) to `upper`; and
    the error line of covB = least - 1 from its diagonal to the largest total."""
    ends = pair_columns(bins).agg(F.min("covB").cast("double").alias("least"), F.max("total_pair_cov").cast("double").alias("most"))
    steps = ends.select("least", "most", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    along = lambda low, high: low + (high - low) * F.col("step") / F.lit(float(points - 1))
    half = lambda n: F.explode(F.array(*(F.lit(i + 0.5) for i in range(n)))).alias("copies")
    at, top = F.col("copies") * F.lit(float(cov)), F.lit(float(upper))
    a = steps.select("step", "least", half(LINES_A)).select("copies", "step", along(F.col("least"), at).alias("b"), at.alias("a"))
    a = a.select(F.lit("A").alias("kind"), "copies", "step", (F.col("b") / (F.col("a") + F.col("b"))).alias("x"), (F.col("a") + F.col("b")).alias("y")).where(F.col("y") < top)
    b = steps.select("step", half(LINES_B)).select(F.lit("B").alias("kind"), "copies", "step", at.alias("b"), along(at * 2 - 2, top).alias("y"))
    b = b.select("kind", "copies", "step", (F.col("b") / F.col("y")).alias("x"), "y")
    error = steps.select("step", "least", along(F.col("least") * 2 - 2, F.col("most")).alias("y")).where("y <> 0")
    error = error.select(F.lit("error").alias("kind"), F.lit(0.0).alias("copies"), "step", ((F.col("least") - 1) / F.col("y")).alias("x"), "y")
    return a.unionByName(b).unionByName(error)


def grid_labels(bins: DataFrame, cov: float, upper: float, x_most: float = 0.49) -> DataFrame:
    """(label, x, y, side): where the names of structures stand over a plot up to `upper`: nAerr for n copies beside
    errors of the least covB, nAmB for every structure; equal copies stand left of the edge, the others below their
    place."""
    copies = int(upper // cov)
    least = bins.agg(F.min("covB").cast("double").alias("least"))
    n, c = F.col("n"), F.lit(float(cov))
    errors = least.select("least", F.explode(F.array(*(F.lit(i) for i in range(1, copies)))).alias("n")) if copies > 1 else least.select("least", F.lit(1).alias("n")).where("false")
    errors = errors.select(F.concat(n.cast("string"), F.lit("Aerr")).alias("label"), (F.col("least") / (n * c)).alias("x"), (n * c + F.col("least")).alias("y"), F.when(n == 1, "above").otherwise("right").alias("side"))
    rows = [(f"{p - b}A{b}B", (x_most + 0.49) / 2 if p == 2 * b else b / p, float(p * cov), "left" if p == 2 * b else "below") for p in range(2, copies + 1) for b in range(1, p // 2 + 1)]
    return errors.unionByName(bins.sparkSession.createDataFrame(rows, "label string, x double, y double, side string"))


def five_numbers(labelled: DataFrame) -> DataFrame:
    """(smudge, n_bins, least, lower, middle, upper, most): quartiles of freq over the bins of each label (bins of
    that rank, none made up)."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY freq)").cast("bigint")
    return labelled.where(F.col("smudge") != ERROR).groupBy("smudge").agg(F.count("*").alias("n_bins"), F.min("freq").alias("least"), q(0.25).alias("lower"), q(0.5).alias("middle"), q(0.75).alias("upper"), F.max("freq").alias("most"))


def peak_coverages(labelled: DataFrame) -> DataFrame:
    """(smudge, measure, least, lower, middle, mean, upper, most): total and relative minor coverage over the bins of
    each label; quantiles between two bins are interpolated."""
    measures = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in ("total_pair_cov", "minor_variant_rel_cov"))))
    rows = pair_columns(labelled.where(F.col("smudge") != ERROR)).select("smudge", measures.alias("m")).select("smudge", "m.*")
    q = lambda p: F.percentile("x", F.lit(p))
    return rows.groupBy("smudge", "measure").agg(F.min("x").alias("least"), q(0.25).alias("lower"), q(0.5).alias("middle"), F.avg("x").alias("mean"), q(0.75).alias("upper"), F.max("x").alias("most"))


def peak_map(labelled: DataFrame, colours: int = 8) -> DataFrame:
    """(x, y, smudge, colour): a point for each bin, coloured by its label, in turn."""
    rows = pair_columns(labelled.where(F.col("smudge") != ERROR))
    colour = F.when(F.col("smudge") > 0, F.pmod(F.col("smudge") - 1, F.lit(colours)) + 1).otherwise(F.lit(0))
    return rows.select(F.col("minor_variant_rel_cov").alias("x"), F.col("total_pair_cov").alias("y"), "smudge", colour.cast("int").alias("colour"))


def square_bins(bins: DataFrame, x: str = "covA", y: str = "covB", n: int = 40) -> DataFrame:
    """(bin_x, bin_y, freq): the histogram in n times n equal bins between the least and the largest values; the last
    bins include these. Empty bins have no row."""
    ends = bins.agg(*(f(c).cast("double").alias(f"{e}_{a}") for a, c in (("x", x), ("y", y)) for e, f in (("low", F.min), ("high", F.max))))

    def at(c: str, a: str) -> Column:
        span = F.when(F.col(f"high_{a}") > F.col(f"low_{a}"), F.col(f"high_{a}") - F.col(f"low_{a}")).otherwise(F.lit(1.0))
        return F.least(F.floor((F.col(c) - F.col(f"low_{a}")) / span * n).cast("int"), F.lit(n - 1)).alias(f"bin_{a}")

    rows = bins.join(F.broadcast(ends), F.col(x) >= F.col("low_x"))  # ends is one row
    return rows.groupBy(at(x, "x"), at(y, "y")).agg(F.sum("freq").alias("freq"))


#: Colours of the palettes at equal distances, from the least to the largest value.
PALETTES = {
    "viridis": ("440154", "472d7b", "3b528b", "2c728e", "21918c", "28ae80", "5ec962", "addc30", "fde725"),
    "magma": ("000004", "1c1044", "4f127b", "812581", "b5367a", "e55064", "fb8761", "fec287", "fcfdbf"),
    "mako": ("0b0405", "2e1e3c", "413d7b", "37659e", "348fa7", "40b7ad", "8bdab2", "def5e5"),
    "grey": ("000000", "ffffff"),
}


def palette_colours(palette: str, n: int, invert: bool = False) -> list[str]:
    """n colours as #rrggbb, at equal distances; between the fixed ones they are mixed evenly."""
    if palette not in PALETTES:
        raise ValueError(f"palettes are {', '.join(PALETTES)}")
    fixed = [[int(c[i : i + 2], 16) for i in (0, 2, 4)] for c in PALETTES[palette]]
    out = []
    for i in range(n):
        at = i * (len(fixed) - 1) / max(1, n - 1)
        k = min(int(at), len(fixed) - 2)
        out.append("#" + "".join(f"{round(a + (b - a) * (at - k)):02x}" for a, b in zip(fixed[k], fixed[k + 1], strict=True)))
    return out[::-1] if invert else out


def colour_ramp(spark: SparkSession, n: int = 32, delay: int = 0, palette: str = "viridis", invert: bool = False) -> DataFrame:
    """(step, colour, rgb): the ramp of n steps that boxes() number: n - delay colours of a palette, turned round if
    asked for, of which the first is repeated `delay` times before the others."""
    colours = palette_colours(palette, n - delay, invert)
    rows = [(i, max(0, i - delay), colours[max(0, i - delay)]) for i in range(n)]
    return spark.createDataFrame(rows, "step int, colour int, rgb string")


def titles(totals: DataFrame, stem: str, cov: float) -> DataFrame:
    """(title): name, coverage and error fraction of a plot of totals()."""
    return totals.select(F.format_string("%s\n1n = %.0f\nerr = %.2f%%", F.lit(stem), F.lit(float(cov)), F.col("error_fraction") * 100).alias("title"))


def json_report(table: list[tuple[str, int, float]], cov: float, error_fraction: float, parameters: dict, version: str, arguments: str = "", source: dict | None = None) -> dict:
    """What a JSON report of a fit holds (the names of its fields are fixed). table: (structure, size, rel_size)."""
    return {
        "version": version, "commandline_arguments": arguments, "input_parameters": parameters, "hetmers_input": source,
        "haploid_coverage": float(f"{cov:.3f}"), "error_fraction": error_fraction,
        "top_smudges": [{"structure": s, "fraction": r} for s, _, r in table if r > 0.03],
        "smudges": [{"structure": s, "count": n, "fraction": r} for s, n, r in table],
    }

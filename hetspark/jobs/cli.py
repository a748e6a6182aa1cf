"""Command line: cutoff, pairs, peaks, plot, all, extract. Run as python -m hetspark.jobs.cli TASK ... with spark-submit
or plain Python."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetspark.functions import sequences as S
from hetspark.operators import cluster, fit, kmers, pairs, report
from hetspark.sources import reads, tables

VERSION = "0.1.0"


def _kmers(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """A k-mer table from Parquet (kmer, count), or counted from sequence files."""
    if args.k:
        return kmers.count_kmers(reads.from_file(spark, args.infile), args.k)
    return spark.read.parquet(args.infile)


def _unique(spark: SparkSession, args: argparse.Namespace, least: int) -> tuple[DataFrame, int]:
    table = kmers.trim(_kmers(spark, args), least)
    first = None if args.k else table.select(F.length("kmer").alias("k")).first()
    k = args.k or (first.k if first else S.LONGEST)  # an empty table has no pairs, whatever k
    return pairs.unique_pairs(pairs.countable(pairs.one_away(kmers.symmetric(table), k))), k


def cutoff(spark: SparkSession, args: argparse.Namespace) -> None:
    histogram = tables.read_histogram(spark, args.infile)
    value = fit.cutoff_lower(histogram).first().cutoff if args.boundary == "L" else fit.rounded_up(fit.cutoff_place(histogram).first().place)
    sys.stdout.write(str(value))


def pair_table(spark: SparkSession, args: argparse.Namespace) -> None:
    found, _ = _unique(spark, args, args.L)
    tables.write_bins(pairs.histogram(found), f"{args.o}.smu", mode="overwrite")
    if args.json_report:
        tables.write_json(spark, {"version": VERSION, "commandline_arguments": " ".join(sys.argv[1:]), "input_parameters": {k: v for k, v in vars(args).items() if k != "run"}}, f"{args.o}_report.json")


def peaks(spark: SparkSession, args: argparse.Namespace) -> None:
    labelled = cluster.local_aggregation(tables.read_bins(spark, args.infile), args.distance, args.noise_filter, args.mask_errors)
    for r in labelled.orderBy("covA", "covB").toLocalIterator():
        sys.stdout.write(f"{r.covB}\t{r.covA}\t{r.freq}\t{r.smudge}\n")


def _plots(bins: DataFrame, table: DataFrame, cov: float, args: argparse.Namespace, totals: DataFrame | None = None) -> None:
    """What two plots show, as tables in the format that is asked for."""
    spark, title = bins.sparkSession, args.title or Path(args.infile).stem
    errors = totals if totals is not None else spark.createDataFrame([(0.0,)], "error_fraction double")
    ramp = lambda log: report.colour_ramp(spark, delay=16 if log else 0, palette=args.col_ramp, invert=args.invert_cols)
    for name, df in (
        ("boxes", report.boxes(bins, cov, upper=args.ylim)), ("boxes_log10", report.boxes(bins, cov, log=True, upper=args.ylim)), ("axes", report.axis_limits(bins, cov, args.ylim)),
        ("labels", report.expected_structures(table, cov)), ("sizes", report.size_labels(table)), ("legend", report.legend_ticks(bins)), ("legend_log10", report.legend_ticks(bins, log=True)),
        ("ramp", ramp(False)), ("ramp_log10", ramp(True)), ("title", report.titles(errors, title, cov)),
    ):
        df.coalesce(1).write.mode("overwrite").format(args.format).save(f"{args.o}_plot/{name}")


def plot(spark: SparkSession, args: argparse.Namespace) -> None:
    _plots(tables.read_bins(spark, args.infile), tables.read_sizes(spark, args.sizes), args.n, args)


def everything(spark: SparkSession, args: argparse.Namespace) -> None:
    """Clusters, fits the coverage, labels peaks, writes tables, report and plot data."""
    bins = tables.read_bins(spark, args.infile)
    labelled = cluster.local_aggregation(bins, args.distance, 1000, True).persist()
    total = cluster.totals(labelled).first()
    sys.stderr.write(f"\nTotal kmers: {total.total_kmers}\nGenomic kmers: {total.genomic}\nGenomic kmers in smudges: {total.in_peaks}\nSequencing errors: {total.errors}\nFraction of errors: {total.error_fraction:.3f}\n")
    if args.cov:
        cov = args.cov
        sys.stderr.write(f"\nUser defined coverage: {cov:.3f}\n")
    else:
        best, tested = fit.grid_search(labelled, total.genomic, args.cov_min, args.cov_max)
        tables.write_centralities(tested, f"{args.o}_centralities.txt", mode="overwrite")
        cov = fit.coverage_or_zero(best, total.error_fraction)
        sys.stderr.write(f"\nInferred coverage: {cov:.3f}\n")
    named = fit.label_peaks(labelled, cov, total.genomic)
    tables.write_annotated(report.annotated(labelled, named), f"{args.o}.sma", mode="overwrite")
    whole = report.structure_table(named, total.genomic)
    known = set(report.report_labels())
    for r in whole.select(S.reduced_structure(F.col("structure")).alias("label")).collect():  # a row a structure
        if r.label not in known:
            sys.stdout.write(f"Unexpected smudge label {r.label} excluded from smudge report\n")
    tables.write_report(report.wide_report(whole, cluster.totals(labelled), os.path.basename(args.infile)), f"{args.o}.report.tsv", mode="overwrite")
    net = fit.cells(labelled, [cov], total.genomic) if cov else None
    sizes = report.structure_table(net.select(S.structure(F.col("a"), F.col("b")).alias("structure"), "size"), total.genomic) if net else whole
    _plots(bins, sizes, cov, args, cluster.totals(labelled))
    if args.json_report:
        beside, slash, _ = args.infile.rpartition("/")  # pairs -o x writes x.smu and x_report.json side by side
        source = tables.read_json_if_newer(spark, f"{beside}{slash}{Path(args.infile).stem}_report.json", args.infile)
        rows = [(r.structure, r["size"], r.rel_size) for r in sizes.orderBy(F.desc("size")).collect()]
        tables.write_json(spark, report.json_report(rows, cov, total.error_fraction, {"infile": args.infile, "distance": args.distance}, VERSION, " ".join(sys.argv[1:]), source), f"{args.o}_report.json")


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    found, k = _unique(spark, args, 4)
    tables.write_pair_text(pairs.extract(found, tables.read_annotated(spark, args.annotated), k), args.o, mode="overwrite")


def _plot_options(t: argparse.ArgumentParser) -> None:
    t.add_argument("-t", "--title", help="name over the plots (default: the stem of infile)")
    t.add_argument("-ylim", type=int, help="upper limit of the coverage sum")
    t.add_argument("-col_ramp", default="viridis", choices=[*report.PALETTES])
    t.add_argument("--invert_cols", action="store_true")
    t.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"], help="of the tables that plots show")


def _left_to_spark(t: argparse.ArgumentParser) -> None:
    """Options that the session's master and folders decide; they are taken and have no effect."""
    t.add_argument("-t", type=int, default=4, help="threads: the master's cores are used")
    t.add_argument("-tmp", default=".", help="temporary folder: the session's folders are used")
    t.add_argument("--verbose", action="store_true")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hetspark")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    tasks = p.add_subparsers(dest="task", required=True)

    def task(name: str, run, out: str | None = None) -> argparse.ArgumentParser:
        t = tasks.add_parser(name)
        t.set_defaults(run=run)
        t.add_argument("infile")
        if out:
            t.add_argument("-o", default=out)
        return t

    task("cutoff", cutoff).add_argument("boundary")
    t = task("pairs", pair_table, "kmerpairs")
    t.add_argument("-L", type=int, required=True)
    t.add_argument("-k", type=int, default=0, help="count k-mers of sequences; without it infile holds (kmer, count)")
    t.add_argument("--json_report", action="store_true")
    _left_to_spark(t)
    t = task("peaks", peaks)
    t.add_argument("-nf", "--noise_filter", type=int, default=50)
    t.add_argument("-d", "--distance", type=int, default=5)
    t.add_argument("--mask_errors", action="store_true")
    t = task("plot", plot, "coverage")
    t.add_argument("sizes")
    t.add_argument("n", type=float)
    _plot_options(t)
    t = task("all", everything, "coverage")
    t.add_argument("-cov_min", type=float, default=6)
    t.add_argument("-cov_max", type=float, default=100)
    t.add_argument("-cov", type=float, default=0.0)
    t.add_argument("-d", "--distance", type=int, default=2)
    _plot_options(t)
    t.add_argument("--json_report", action="store_true")
    t = task("extract", extract, "kmerpairs")
    t.add_argument("annotated")
    t.add_argument("-k", type=int, default=0)
    _left_to_spark(t)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("hetspark").getOrCreate(), args)


if __name__ == "__main__":
    main()

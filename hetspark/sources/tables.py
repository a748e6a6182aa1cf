"""Readers and writers of tab-separated tables and JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetspark import schema
from hetspark.functions import files


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """covB, covA, freq without a header."""
    return spark.read.csv(path, sep="\t", schema=schema.BINS)


def write_bins(bins: DataFrame, path: str, mode: str = "error") -> None:
    """Bins below the bound of covB, sorted by covA + covB, then covB. mode: error, overwrite or ignore."""
    kept = bins.where((F.col("covB") < schema.MINOR_BOUND) & (F.col("freq") > 0)).select("covB", "covA", "freq")
    kept.repartition(1).sortWithinPartitions(F.col("covA") + F.col("covB"), "covB").write.csv(path, sep="\t", mode=mode)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """structure, size, rel_size without a header."""
    return spark.read.csv(path, sep="\t", schema=schema.SIZES)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Lines of value and number, between white space, as (value, n)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("bigint").alias("value"), parts[1].cast("bigint").alias("n"))


def write_annotated(annotated: DataFrame, path: str, mode: str = "error") -> None:
    """covB, covA, freq, smudge with a header, by structure."""
    annotated.select("covB", "covA", "freq", "smudge").repartition(1).sortWithinPartitions("smudge", "covA", "covB").write.csv(path, sep="\t", header=True, mode=mode)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """covB, covA, freq, smudge, checked: labels nAmB with n >= m > 0, 0 <= covB <= 500, covA >= covB, sum <= 1000.
    A row that breaks these is an error when it is read. The last structure of a bin given twice stays."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema.ANNOTATED)
    a, b = (F.regexp_extract("smudge", r"^(\d+)A(\d+)B$", i).cast("int") for i in (1, 2))
    right = (a >= b) & (b > 0) & (F.col("covB") >= 0) & (F.col("covB") <= schema.MINOR_BOUND) & (F.col("covA") >= F.col("covB")) & (F.col("covA") + F.col("covB") <= schema.MAX_SUM)
    wrong = F.raise_error(F.concat(F.lit("not a labelled bin: "), F.concat_ws(" ", "covB", "covA", "smudge"))).cast("string")
    checked = rows.withColumn("smudge", F.when(F.coalesce(right, F.lit(False)), F.col("smudge")).otherwise(wrong)).withColumn("place", F.monotonically_increasing_id())
    return checked.groupBy("covB", "covA").agg(F.max_by("freq", "place").alias("freq"), F.max_by("smudge", "place").alias("smudge")).select("covB", "covA", "freq", "smudge")


def write_centralities(found: DataFrame, path: str, mode: str = "error") -> None:
    """coverage and centrality with four digits, in the order of the search."""
    shown = [F.format_string("%.4f", F.round(c, 6)).alias(c) for c in ("cov", "centrality")]
    found.repartition(1).sortWithinPartitions("level", "cov").select(*shown).write.csv(path, sep="\t", mode=mode)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.repartition(1).write.csv(path, sep="\t", header=True, mode=mode)


def write_pair_text(extracted: DataFrame, path: str, mode: str = "error") -> None:
    """(smudge, line): a folder of lines for each structure."""
    extracted.write.partitionBy("smudge").mode(mode).text(path)


def read_pair_text(spark: SparkSession, path: str) -> DataFrame:
    """(smudge, line)."""
    return spark.read.schema("line string, smudge string").text(path).select("smudge", "line")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A wide report; all columns but dataset are numbers."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("dataset", *(F.col(f"`{c}`").cast("bigint").alias(c) for c in rows.columns[1:]))


def read_centralities(spark: SparkSession, path: str) -> DataFrame:
    """cov, centrality without a header."""
    return spark.read.csv(path, sep="\t", schema="cov double, centrality double")


def write_sizes(sizes: DataFrame, path: str, mode: str = "error") -> None:
    """structure, size, rel_size without a header, largest first."""
    sizes.select("structure", "size", "rel_size").repartition(1).sortWithinPartitions(F.desc("size"), "structure").write.csv(path, sep="\t", mode=mode)


def write_histogram(histogram: DataFrame, path: str, mode: str = "error") -> None:
    """(value, n) as lines of both, by value."""
    lines = histogram.repartition(1).sortWithinPartitions("value").select(F.concat_ws("\t", "value", "n").alias("value"))
    lines.write.mode(mode).text(path)


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    files.write_bytes(spark, path, (json.dumps(data, indent=2) + "\n").encode())


def read_json_if_newer(spark: SparkSession, path: str, than: str) -> dict | None:
    """A report, unless it is missing or older than the file it should describe."""
    when, other = files.modified(spark, path), files.modified(spark, than)
    if when is None or other is None or when < other:
        return None
    return json.loads(files.read_text(spark, path))

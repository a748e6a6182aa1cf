"""Sequences as (read_id, seq), from tables and from text files on any file system, plain or compressed."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from hetspark.functions import sequences as S
from hetspark.functions.checkpoints import settled

#: Endings of compressed files (those that the session's codecs know), and of files by their form.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
FORMS = {"fasta": (".fa", ".fasta", ".fna"), "fastq": (".fq", ".fastq"), "lines": (".txt", ".seq")}


def from_documents(docs: DataFrame) -> DataFrame:
    """(read_id, seq, most): the letters acgt of texts, as a stand-in for sequences; most, a text's length, is no less than
    its sequence's."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("read_id"), S.dna(text).alias("seq"), F.length(text).alias("most"))


def numbered_lines(spark: SparkSession, path: str, a_record: int = 1, separator: str | None = None) -> DataFrame:
    """(record, part, value): the lines of text files, with the number of the record that each one belongs to, over all
    files in the order of their names, and its place, from 0, among the record's `a_record` lines.

    Spark reads files in splits, wherever these begin. A first pass counts the lines of each split, so that a line is
    numbered by its place in the scan alone: no record start has to be guessed, nothing is shuffled, and the lines of a
    record may lie in two splits. What is broadcast is one row of 40 bytes for each split; 100 TB in splits of 128 MB
    are 0.8 million of them.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = settled(lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    lines_before = W.Window.partitionBy("file").orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1)
    in_file = splits.withColumn("before", F.coalesce(F.sum("n").over(lines_before), F.lit(0)))
    files = splits.groupBy("file").agg(F.ceil(F.sum("n") / a_record).alias("records"))
    by_name = W.Window.orderBy("file").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("records").over(by_name), F.lit(0)).alias("earlier"))
    known = in_file.join(files, "file").select(F.xxhash64("file").alias("name"), "start", "first", "before", "earlier")
    clash = files.groupBy(F.xxhash64("file")).count().where("count > 1")
    if not clash.isEmpty():
        raise ValueError("two file names have one hash")
    placed = lines.withColumn("name", F.xxhash64("file")).join(F.broadcast(known), ["name", "start"])
    at = F.col("before") + F.col("id") - F.col("first")
    return placed.select((F.col("earlier") + F.floor(at / a_record)).cast("bigint").alias("record"), (at % a_record).cast("int").alias("part"), "value")


def from_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq) of FASTA text: a line that starts with > and the lines up to the next one. Files split at
    records. read_id numbers the records, so that equal names stay apart."""
    records = numbered_lines(spark, path, separator="\n>")
    parts = records.select("record", F.split(F.regexp_replace("value", "^>", ""), "\n", 2).alias("p"))
    seq = F.lower(F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", ""))
    named = parts.select(F.col("record").alias("read_id"), F.regexp_extract(F.get("p", F.lit(0)), r"^\S*", 0).alias("name"), seq.alias("seq"))
    return named.where("name <> '' or seq <> ''")


def from_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq) of records of four lines: @name, sequence, +, qualities. Lines are told apart by their numbers,
    since qualities may start with @ or look like a sequence. A first line without @ or a third one without + is an
    error when it is read; empty lines at the end of a file are not."""
    lines = numbered_lines(spark, path, a_record=4)
    wrong = ((F.col("part") == 0) & ~F.col("value").startswith("@") & (F.trim("value") != "")) | ((F.col("part") == 2) & ~F.col("value").startswith("+") & (F.trim("value") != ""))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a record of four lines: "), F.col("value"))).cast("string")).otherwise(F.lower(F.trim("value")))
    # The check stands in the column that is read, so that it is made for lines of all parts before any is left out.
    rows = lines.select(F.col("record").alias("read_id"), "part", checked.alias("seq")).where((F.col("part") == 1) | F.col("seq").isNull())
    return rows.select("read_id", "seq")


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq): one sequence a line."""
    return numbered_lines(spark, path).select(F.col("record").alias("read_id"), F.lower(F.trim("value")).alias("seq"))


def form_of(path: str) -> str:
    """fasta, fastq or lines, by the ending before that of a compression; another ending is an error."""
    name = os.path.basename(path.rstrip("/")).lower()
    plain = re.sub("(" + "|".join(map(re.escape, COMPRESSED)) + ")$", "", name)
    for form, endings in FORMS.items():
        if plain.endswith(endings):
            return form
    raise ValueError(f"{name}: sequences are read from files that end in {', '.join(e for x in FORMS.values() for e in x)}, compressed or not")


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq) of files in the form that the ending tells."""
    return {"fasta": from_fasta, "fastq": from_fastq, "lines": from_lines}[form_of(path)](spark, path).select("read_id", "seq")

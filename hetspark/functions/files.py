"""Small files on whatever file system a path names, through the session's Hadoop configuration."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _open(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def modified(spark: SparkSession, path: str) -> int | None:
    """Time of the last change in milliseconds; None if there is no such file."""
    fs, where = _open(spark, path)
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None

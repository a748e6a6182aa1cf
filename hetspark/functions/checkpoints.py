"""Checkpoints in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Have checkpoint() write to spark.checkpoint.dir. Where that is unset, a local master (as in tests) gets a folder of
    its own; a cluster, whose machines would not share one, is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def unconstrained(spark: SparkSession) -> Iterator[None]:
    """Plans inside don't infer filters from what holds for their columns. A settled table carries these facts along; in
    loops that join the tables of earlier rounds they multiply until planning takes longer than the work."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)

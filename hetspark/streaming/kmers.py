"""k-mer counts over a stream of reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from hetspark.functions.checkpoints import use_checkpoints
from hetspark.operators.kmers import count_kmers, counted_runs, runs, spelled


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, count) so far, of a streaming (read_id, seq). Counts are sums, so late reads need no watermark."""
    return count_kmers(reads, k)


def count_available(reads: DataFrame, k: int, folder: str | None = None) -> DataFrame:
    """(kmer, count) of all that the stream holds now, read in micro-batches; each batch writes its k-mers as packed runs.

    Counts are sums, so no state is kept between batches: the runs of all batches are counted together in the end. A
    batch that is repeated after a failure overwrites its own folder, so nothing counts twice.
    """
    spark = reads.sparkSession
    if folder is None:
        use_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def put(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{folder}/runs/batch={batch}")

    packed = runs(reads, k)
    query = packed.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").foreachBatch(put).start()
    query.awaitTermination()
    held = spark.read.schema(f"{', '.join(f'{x.name} {x.dataType.simpleString()}' for x in packed.schema)}, batch int").parquet(f"{folder}/runs")
    return spelled(counted_runs(held.drop("batch"), k), k)

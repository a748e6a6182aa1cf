"""Columns of the tables that operators exchange, and the fixed limits of pair coverage."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the pair search: largest joint coverage of a pair, bound of the minor coverage that is written,
#: largest count of a k-mer.
MAX_SUM, MINOR_BOUND, MAX_COUNT = 1000, 500, 32767
#: Fixed values of the coverage fit: cells reach this minor and total number of copies.
MOST_MINOR, MOST_COPIES = 8, 16


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


READS = _struct(read_id=T.LongType(), seq=T.StringType())
KMERS = _struct(kmer=T.StringType(), count=T.LongType())
SPECTRUM = _struct(multiplicity=T.LongType(), n_unique=T.LongType(), n_instances=T.LongType())
TEXT_HISTOGRAM = _struct(value=T.LongType(), n=T.LongType())
BINS = _struct(covB=T.IntegerType(), covA=T.IntegerType(), freq=T.LongType())
PEAKS = _struct(covB=T.IntegerType(), covA=T.IntegerType(), freq=T.LongType(), peak=T.IntegerType())
ANNOTATED = _struct(covB=T.IntegerType(), covA=T.IntegerType(), freq=T.LongType(), smudge=T.StringType())
SIZES = _struct(structure=T.StringType(), size=T.LongType(), rel_size=T.DoubleType())

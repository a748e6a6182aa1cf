"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from hetspark.llm.common import WORD, columns_of, free_prefix, settled

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Expected copies are counted in whole units of 2 to the power -24, so that prefix sums are exact in any order.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources(source, source_size) with target: water filling up to cap times each source's size.

    The level w is the one at which the sum of least(cap * size, w * weight) is share times all sizes. Sorted by
    cap * size / weight, full sources come first: the first place where the level of the rest is at most the next
    source's own bound fixes it. One row per source, so this small table may sit in one task.
    """
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    by_bound = W.Window.orderBy("bound", F.col("source").asc_nulls_last())
    filled = by_bound.rowsBetween(W.Window.unboundedPreceding, -1)
    rest = by_bound.rowsBetween(0, W.Window.unboundedFollowing)
    whole = W.Window.partitionBy()
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
        .withColumn("room", F.col("source_size") * F.lit(float(cap)))
        .withColumn("bound", F.col("room") / F.col("weight"))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(filled), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("rank", F.row_number().over(by_bound))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("rank", "level"))).over(whole)["level"])
        .select("source", "source_size", F.coalesce(F.least("room", F.col("level") * F.col("weight")), F.col("room")).alias("target"))
    )


#: What mix() adds to a table.
OUT = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies: how often the mix takes each row.

    Every document of a source expects target / source_size copies. The prefix sum of these within the source, plus
    one random offset for the source, crosses mix_copies integers at the document. The order within a source is: size
    class (binary length of the size), bucket of the id's hash, size (up in even buckets, down in odd ones), id. Such
    an order stratifies the sample by size, so that its words come near the target as well as its documents.

    A source of any size is spread over blocks (class, bucket), the number of buckets growing with the square root of
    the rows: counts per block give each block its start, and the prefix sum runs within blocks. Rows are shuffled
    once, by (source, block); copies are whole numbers, so reruns agree.

    Defined cases: a null source is a source of its own, the last by name; null texts and texts without words have
    size 0 and are taken like others; a source without words gets target 0 and no copies. Very long texts are counted
    whole. Null ids come first. Rows equal in source, size and id tie and are ordered by a hash of the text. Other
    columns pass through, whatever their names; those called like the results (in any case) are replaced. An empty
    table gives an empty result.
    """
    p = free_prefix(docs)
    planned = _planned(docs, p, id_col, text_col, source_col, weights, share, cap, seed)
    return planned.select(*columns_of(docs, *OUT), *(F.col(p + name).alias(name) for name in OUT))


def _planned(docs: DataFrame, p: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with the columns of mix(), their names after the prefix p, which no column of docs has."""
    buckets = max(1, math.ceil(math.sqrt(docs.count()) / 10))
    size_col, block_col, order_col, tie_col, rank_col = (p + x for x in ("mix_size", "block", "order", "tie", "rank"))
    s, size, block = F.col(source_col), F.col(size_col), F.col(block_col)
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    bucket = F.pmod(hashed, F.lit(buckets))
    sized = docs.withColumn(size_col, n_words(F.col(text_col))).withColumn(tie_col, F.xxhash64(F.col(text_col)))
    sized = sized.withColumn(block_col, F.length(F.bin(size)) * F.lit(1 << 24) + bucket).withColumn(order_col, size * (1 - 2 * (bucket % 2)))

    blocks = settled(sized.groupBy(s.alias("source"), block.alias("block")).agg(F.count("*").alias("n"), F.sum(size_col).alias("words")))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("/"), F.col("source").cast("string")), F.lit("")))), 1, 6), 16, 10).cast("bigint")
    before = W.Window.partitionBy("source").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    start = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    plan = start.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select(
        F.col("source").alias(p + "source"), F.col("block").alias(p + "at"), F.col("start").alias(p + "start"), offset.alias(p + "offset"),
        F.col("source_size").alias(p + "mix_source_size"), F.col("target").alias(p + "mix_target"),
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0)).cast("bigint").alias(p + "step"),
    )
    inside = W.Window.partitionBy(s, block).orderBy(order_col, F.col(id_col), tie_col)
    crossed = lambda rank: F.shiftright((F.col(p + "start") + rank) * F.col(p + "step") + F.col(p + "offset"), UNIT_BITS)
    return (
        sized.join(plan, (block == F.col(p + "at")) & s.eqNullSafe(F.col(p + "source")))
        .withColumn(rank_col, F.row_number().over(inside).cast("bigint"))
        .withColumn(p + "mix_copies", (crossed(F.col(rank_col)) - crossed(F.col(rank_col) - 1)).cast("bigint"))
    )


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as many times as mix() says, with the columns of docs, whatever their names.
    Defined cases: as in mix(); a column called like one of its results stays as it is."""
    p = free_prefix(docs)
    copies = F.sequence(F.lit(1), F.col(p + "mix_copies"))
    return _planned(docs, p, **how).where(F.col(p + "mix_copies") > 0).withColumn(p + "copy", F.explode(copies)).select(*columns_of(docs))

"""Exact deduplication that no group of copies can skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from hetspark.llm.common import columns_of, free_prefix, salt_of, salts_for


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Three stages, each of which compares whole texts, never digests alone:

    1. rows combine inside each task by (digest, salt, text) before anything is shuffled;
    2. what is left of a (digest, salt) meets, again by (digest, salt, text): a text that a third of all rows share
       reaches this stage as a few rows per task and is dealt to `salts` tasks (as many as a shuffle has);
    3. the at most `salts` winners of a digest meet in one task and are compared by text once more.

    Rows then find their group by (digest, salt), so that a hot text is looked up in `salts` partitions as well. Two
    different texts of one SHA-256 digest would stop the job with an error; they are never merged.

    Defined cases: a null text counts as empty. Null ids lose against any other; a group of null ids alone has a null
    keep_id and keeps them. Rows of one id and text are one document: all are marked alike. Very long texts are compared
    whole like others. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    salts = salts or salts_for(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.sha2("text", 256).alias("digest"), salt_of(F.col("id"), salts=salts).alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    same = W.Window.partitionBy("digest", "text")
    clash = F.raise_error("two different texts have one SHA-256 digest").cast("bigint")
    winners = (
        salted.repartition("digest")
        .select("digest", "salt", "text", F.max("top").over(same).alias("keep_id"), F.sum("n").over(same).alias("group_size"))
        .withColumn("before", F.lag("text").over(W.Window.partitionBy("digest").orderBy("text")))
        .select("digest", "salt", "keep_id", F.when(F.col("before") != F.col("text"), clash).otherwise(F.col("group_size")).alias("group_size"))
    )
    return rows.select("id", "digest", "salt").join(winners, ["digest", "salt"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """docs without the rows whose text another row of a larger id has; all columns stay as they are, whatever their
    names.

    Defined cases: as in exact_groups(). Of rows that are equal in id and text one stays (which one is not defined if
    their other columns differ). Null ids lose against any other; of a text that only rows of null ids have one stays.
    """
    if not {id_col, text_col} <= set(docs.columns):
        raise ValueError(f"columns {id_col} and {text_col} are needed")
    p = free_prefix(docs)
    names, none = [f"{p}none", f"{p}id", f"{p}digest"], F.col(id_col).isNull()
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = exact_groups(docs, id_col, text_col, salts).where("kept")
    kept = found.select(none.alias(names[0]), name.alias(names[1]), F.col("text_sha256").alias(names[2])).distinct()
    keyed = docs.withColumns(dict(zip(names, (none, name, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), strict=True)))
    # Rows equal in id and text go first: each task sends one of them, whatever their number. The join moves nothing more.
    return keyed.dropDuplicates(names).join(kept, names, "left_semi").select(*columns_of(docs))

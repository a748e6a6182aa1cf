"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hetspark.functions.checkpoints import settled, use_checkpoints
from hetspark.operators.components import least_reachable

__all__ = ["WORD", "carried", "columns_of", "free_prefix", "named", "restored", "least_reachable", "salt_of", "salts_for", "settled", "use_checkpoints"]

#: A word: what stands between ASCII white space (a Java and Python pattern).
WORD = r"[^\x20\x09-\x0D]+"


def salt_of(*cols: Column, salts: int) -> Column:
    """A number below salts that depends on the values alone, so that recomputed tasks give the same."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salts_for(df: DataFrame) -> int:
    """Into how many parts a hot key is cut: as many as a shuffle has, so that it reaches all of a cluster's tasks."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df, whatever signs stand in their names, but those called so (in any case)."""
    less = {b.lower() for b in but}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in less]


def free_prefix(df: DataFrame, start: str = "__") -> str:
    """A prefix that no column of df has, so that names which begin with it can't clash."""
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def named(df: DataFrame, name: str) -> Column:
    """One column of df, whatever signs stand in its name."""
    return df[f"`{name.replace('`', '``')}`"]


def carried(df: DataFrame, col: str, *replaced: str) -> DataFrame:
    """(row, value): col, and all other columns but those called as in `replaced` (in any case) as one struct, so that
    no name can clash with what a task adds."""
    return df.select(F.struct(F.lit(0).alias("none"), *columns_of(df, col, *replaced)).alias("row"), named(df, col).alias("value"))


def restored(out: DataFrame, df: DataFrame, col: str | None, **made: str) -> DataFrame:
    """From out(row, ...), made of carried(df): the columns of df in their order, col (if it stays) from out's value, and
    those made, given as out's column = its new name."""
    rest = {f.lower(): f for f in out.schema["row"].dataType.names[1:]}
    new = {n.lower() for n in made.values()}
    kept = [F.col("row")[c].alias(c) if c.lower() in rest else F.col("value").alias(c) for c in df.columns if c.lower() in rest or (col is not None and c.lower() == col.lower() and c.lower() not in new)]
    return out.select(*kept, *(F.col(of).alias(n) for of, n in made.items()))

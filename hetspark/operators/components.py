"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetspark.functions.checkpoints import settled, unconstrained

#: Links that a task joins into a forest at a time, which bounds its memory only.
LINKS = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least) for every node of some links but the least of each component: stars that connect what they do."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def local_forests(links: DataFrame) -> DataFrame:
    """links(u, v) with fewer rows that connect the same: each task joins its own, LINKS at a time, into stars."""
    kind = links.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        typed = None

        def joined() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            node, least = forest(*(table.column(i).to_numpy() for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(node, typed), pa.array(least, typed)], ["u", "v"])

        for batch in batches:
            typed = batch.schema.field(0).type
            held.append(batch)
            if sum(map(len, held)) >= LINKS:
                held = [joined()]
                if len(held[0]) >= LINKS // 2:  # stars that fill the room leave it
                    yield held.pop()
        if held:
            yield joined()

    return links.select("u", "v").mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def least_reachable(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b): undirected, longs or strings. Returns (node, label): each linked node with the smallest node it reaches.

    Links are first joined inside tasks, which leaves a task one link for each node it knows. While more than LINKS are
    left, rounds contract them: every node names one among itself and its neighbours, by turns the smallest and the one
    of the least hash (stars go in a round of the first kind, chains lose a part of their nodes in one of the second);
    nodes that name the same become one, called like the smallest of them; links go on between these alone. So later
    rounds carry roots and not all links. The last LINKS links at most are joined in one task. Answers then go back
    round by round.

    Hubs and large components are keys that a part of all rows may have: where they are aggregated, tasks combine
    first; where they are joined, the joins are plain ones of settled tables, whose large partitions Spark splits. Each
    round is cut off by a checkpoint.
    """
    links = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    with unconstrained(links.sparkSession):
        edges, rounds = settled(local_forests(links).distinct()), []
        while edges.count() > LINKS:
            if len(rounds) == max_rounds:
                raise RuntimeError("the links did not settle")
            edges, became = _contracted(edges, len(rounds))
            rounds.append(became)
        last = settled(local_forests(edges.coalesce(1))).select(F.col("u").alias("node"), F.col("v").alias("label"))
        if not rounds:
            roots = last.select("label").distinct()
            return last.unionByName(roots.select(F.col("label").alias("node"), "label"))
        for became in reversed(rounds):
            known = last.withColumnRenamed("node", "name")
            last = settled(became.join(known, "name", "left").select(F.col("u").alias("node"), F.coalesce("label", "name").alias("label")))
        return last


def _contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(links between the nodes that are left, (u, name): what each node became)."""
    rank = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn % 2 else F.lit(0)).alias("h"), F.col(c).alias("x"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(rank("v")).alias("w"))
    chosen = settled(least.select("u", F.least("w", rank("u"))["x"].alias("m")))
    names = settled(chosen.groupBy("m").agg(F.min("u").alias("name")))
    became = settled(chosen.join(names, "m").select("u", "name"))
    left, right = became.select("u", F.col("name").alias("x")), became.select(F.col("u").alias("v"), F.col("name").alias("y"))
    after = edges.join(left, "u").join(right, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return settled(local_forests(after).distinct()), became

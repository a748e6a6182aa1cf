"""The trie of all prefixes of conversations, by range-partitioned shards and the skeleton of their splitters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from hetspark.llm.common import named, settled

#: Bytes that stand for a turn in a path: the first ones of its SHA-256.
ELEMENT = 16
#: Bytes of paths that a shard should hold, and characters of ids that a row carries to a skeleton node's digest.
SHARD, CHUNK = 16 << 20, 1 << 16
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PARTIAL = "id bigint, n_convs bigint, conv_id bigint, n_children bigint, n_leaves bigint, saved bigint, bytes bigint, first bigint, chunk string"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, element, bytes): turns in their order, from 0, each as its digest and the bytes of its text."""
    role, text = (F.coalesce(named(conversations, c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ELEMENT)
    rows = conversations.select(named(conversations, "conv_id").cast("bigint").alias("conv_id"), named(conversations, "turn").alias("turn"), digest.alias("element"), F.octet_length(text).alias("bytes"))
    rows = rows.where("conv_id is not null").withColumn("family", F.expr("conv_id - conv_id % 5"))
    # Conversations of a family are rebuilt from each other, so one shuffle by family serves ranks and rebuilding.
    order = W.Window.partitionBy("family", "conv_id").orderBy(F.asc_nulls_first("turn"), "element")
    return rows.withColumn("i", F.row_number().over(order) - 1).drop("turn")


def head(conv_id: object) -> object:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation with its first turns replaced by those of the first of its family, its
    elements as one binary and the bytes of its texts as an array."""
    own = F.struct(F.col("conv_id").alias("target"), F.lit(1).alias("part"), ((F.col("i") >= head(F.col("conv_id"))) | (F.col("conv_id") == F.col("family"))).alias("stays"))
    others = F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda j: F.struct((F.col("family") + j).alias("target"), F.lit(0).alias("part"), F.lit(True).alias("stays")))
    wanted = lambda t: (t["target"] != F.col("family")) & (t["target"] - t["target"] % 5 == F.col("family")) & (F.col("i") < head(t["target"]))
    given = F.when(F.col("conv_id") == F.col("family"), F.concat(F.array(own), F.filter(others, wanted))).otherwise(F.array(own))
    rows = turns.select("family", "i", "element", "bytes", F.explode(given).alias("t")).select("family", "t.*", "i", "element", "bytes")
    parts = F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("part", "i", "element", "bytes"))))
    each = rows.groupBy("family", "target").agg(F.max("part").alias("exists"), parts.alias("parts")).where("exists = 1")
    return each.select(F.col("target").alias("conv_id"), F.unhex(F.array_join(F.transform("parts", lambda x: x["element"]), "")).alias("path"), F.transform("parts", lambda x: x["bytes"]).alias("sizes"))


def sharded(paths: DataFrame) -> DataFrame:
    """paths dealt by range of (path, conv_id) and sorted, so that copies of one path are spread over shards as well."""
    paths = settled(paths)
    total = paths.agg(F.sum(F.length("path") + 4 * F.size("sizes") + 16).alias("n")).first().n or 0
    n = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    return settled(paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id"))


@dataclass
class Skeleton:
    """The trie of the splitters, nodes numbered from the root in the order of a walk. A node whose members lie in more
    than one shard is a prefix of the first path of each of these but the first, so it is a node of the skeleton."""

    child: dict[tuple[int, bytes], int]
    parent: list[int]

    @classmethod
    def of(cls, paths: list[bytes]) -> Skeleton:
        """paths are sorted."""
        child, parent = {}, [-1]
        for path in paths:
            node = 0
            for at in range(0, len(path), ELEMENT):
                key = (node, path[at : at + ELEMENT])
                if key not in child:
                    child[key] = len(parent)
                    parent.append(node)
                node = child[key]
        return cls(child, parent)

    def along(self, path: bytes) -> list[int]:
        """The nodes of a path's prefixes, from the root, as far as there are any."""
        out = [0]
        for at in range(0, len(path), ELEMENT):
            node = self.child.get((out[-1], path[at : at + ELEMENT]))
            if node is None:
                break
            out.append(node)
        return out


def splitters(shards: DataFrame) -> list[bytes]:
    """The first path of each shard but the first: one a partition, so as many as there are partitions."""
    rows = shards.groupBy(F.spark_partition_id().alias("shard")).agg(F.min("path").alias("path")).collect()
    return [bytes(r.path) for r in sorted(rows, key=lambda r: r.shard)][1:]


class Shard:
    """All nodes of one shard's rows, in the order of a walk. `own` arrays are by node."""

    def __init__(self, batches: list[pa.RecordBatch], skeleton: Skeleton):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.conv = conv = table.column("conv_id").to_numpy()
        path, sizes = (table.column(c).chunk(0) for c in ("path", "sizes"))
        raw = b"".join(path.to_pylist())
        n, length = len(conv), np.diff(np.frombuffer(path.buffers()[1], np.int32)[path.offset : path.offset + len(path) + 1]).astype(np.int64) // ELEMENT
        element, begin = np.frombuffer(raw, np.uint64).reshape(-1, 2), np.cumsum(length) - length
        # Elements that each row shares with the one before it.
        both = np.minimum(length[1:], length[:-1])
        j = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differ = (element[np.repeat(begin[1:], both) + j] != element[np.repeat(begin[:-1], both) + j]).any(1)
        shared = both.copy()
        np.minimum.at(shared, np.repeat(np.arange(n - 1), both)[differ], j[differ])
        shared = np.r_[-1, shared]  # the first row opens the root as well
        new = length - shared
        self.row = np.repeat(np.arange(n), new)
        self.depth = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new) + np.repeat(shared + 1, new)
        m = len(self.row)
        flat = sizes.flatten().to_numpy()
        self.bytes = np.where(self.depth > 0, np.r_[flat, 0][np.where(self.depth > 0, begin[self.row] + self.depth - 1, 0)], 0).astype(np.int64)
        order = np.argsort(self.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        self.parent, self.end = np.full(m, -1), np.full(m, m)
        for above, level in zip(levels, levels[1:], strict=False):
            self.parent[level] = above[np.searchsorted(above, level) - 1]
            self.end[level] = np.minimum(np.r_[level[1:], m], self.end[self.parent[level]])
        self.n = np.r_[self.row, n][self.end] - self.row
        self.ends = np.bincount(np.cumsum(new) - 1, minlength=m)  # rows whose path ends at the node; they come first
        self.least = np.where(self.ends > 0, conv[self.row], np.iinfo(np.int64).max)
        for level in levels[:0:-1]:
            np.minimum.at(self.least, self.parent[level], self.least[level])
        # Nodes of the skeleton lie on the path of the first row or of the last.
        self.bone = np.full(m, -1)
        first = skeleton.along(path[0].as_py())
        self.bone[: len(first)] = first
        for d, node in enumerate(skeleton.along(path[n - 1].as_py())):
            self.bone[levels[d][-1]] = node
        self.under = self.bone.copy()  # the lowest node of the skeleton at or above
        for level in levels[1:]:
            self.under[level] = np.where(self.bone[level] >= 0, self.bone[level], self.under[self.parent[level]])
        self.children = np.bincount(self.parent[1:], minlength=m)
        self.leaf = (self.children == 0).astype(np.int64)
        self.saved = (self.n - 1) * self.bytes

    def ids(self, node: int) -> list[int]:
        return self.conv[self.row[node] : self.row[node] + self.ends[node]].tolist()

    def partials(self) -> pa.Table:
        """PARTIAL: what the shard adds to nodes of the skeleton, and the ids that end at them in chunks."""
        bones, local = np.flatnonzero(self.bone >= 0), self.bone < 0
        size, of = int(self.under.max()) + 1, self.under[local]
        add = lambda owner, x: np.bincount(owner, weights=x, minlength=size).astype(np.int64)[self.bone[bones]]
        inner = local & np.isin(self.parent, bones)
        sums = [add(self.bone[self.parent[inner]], np.ones(int(inner.sum()))), add(of, self.leaf[local]), _sums(of, self.saved[local], size)[self.bone[bones]]]
        rows = [*zip(self.bone[bones].tolist(), self.n[bones].tolist(), self.least[bones].tolist(), *(s.tolist() for s in sums), self.bytes[bones].tolist(), [None] * len(bones), [None] * len(bones), strict=True)]
        for b in bones[self.ends[bones] > 0]:
            ids = self.ids(b)
            for at in range(0, len(ids), step := CHUNK // 20):
                part = ids[at : at + step]
                rows.append((int(self.bone[b]), 0, None, 0, 0, 0, 0, part[0], ",".join(map(str, part))))
        names = [f.split(" ")[0] for f in PARTIAL.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def nodes(self, least: np.ndarray) -> pa.Table:
        """NODE rows of all nodes but those of the skeleton, whose smallest members are `least`."""
        at = np.flatnonzero(self.bone < 0)
        above = self.parent[at]
        bone = self.bone[above]
        parents = np.where(bone >= 0, least[np.maximum(bone, 0)], self.least[above])
        under = lambda x: (c := np.r_[0, np.cumsum(x)])[self.end[at]] - c[at]
        digests = [hashlib.sha256(",".join(map(str, self.ids(k))).encode()).hexdigest() if e else EMPTY for k, e in zip(at, self.ends[at], strict=True)]
        columns = [self.least[at], self.depth[at], parents, self.n[at], self.children[at], under(self.leaf), under(self.saved)]
        return pa.table([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(digests, pa.string())], [f.split(" ")[0] for f in NODE.split(", ")])


def _sums(owner: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by owner."""
    out = np.zeros(size, np.int64)
    np.add.at(out, owner, x)
    return out


def _ends(partials: DataFrame) -> DataFrame:
    """(id, sha): digests of the chunks of each node of the skeleton, in order. Rows of a node stream through one task,
    one for each some thousand ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            for node, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if digest:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["id", "sha"])
                    now, digest = node, hashlib.sha256(chunk.encode())
                else:
                    digest.update(b"," + chunk.encode())
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["id", "sha"])

    rows = partials.where("chunk is not null").select("id", "chunk", "first").repartition("id").sortWithinPartitions("id", "first")
    return rows.select("id", "chunk").mapInArrow(run, "id bigint, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row (NODE) for each distinct sequence of the first d turns of rebuilt conversations (rebuilt()), the empty
    one included: its smallest member, depth, the smallest member of its parent (null at the root), members, children,
    childless nodes of its subtree, bytes of texts that its subtree saves where members share a turn, and the SHA-256 of
    the ids of members that end here.

    Conversations become paths of digests, which are dealt by range and sorted. The first paths of the shards, one a
    partition, make the skeleton, which is broadcast. Each shard finishes its other nodes on its own, with its rows in
    memory (SHARD sets the number of shards); for the skeleton's nodes shards give partial counts and sums, which are
    added up by node and then along the skeleton, whose size is the number of shards times the length of a path. Copies
    of one conversation are spread over shards by their ids.

    Defined cases: rows without a conv_id are left out. Null roles and texts are empty. Null turns come first, turns of
    equal number in the order of their digests; repeated rows are turns of their own. A conversation that keeps no turn
    is a member of the root alone. Very long texts count by their digest, very long conversations are rows of their own
    length. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = conversations.sparkSession
    shards = sharded(rebuilt(turns(conversations)))
    skeleton = Skeleton.of(splitters(shards))
    shared = spark.sparkContext.broadcast(skeleton)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [b for b in batches if len(b)]:
            yield from Shard(rows, shared.value).partials().to_batches(max_chunksize=1000)

    parts = settled(shards.mapInArrow(partials, PARTIAL))
    sums = parts.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"))
    bones = sums.join(_ends(parts), "id", "left").orderBy("id").collect()  # one row for each node of the skeleton
    if not bones:
        return spark.createDataFrame([], NODE)
    least = spark.sparkContext.broadcast(np.array([b.conv_id for b in bones], np.int64))
    size = len(bones)
    children, depth = [b.n_children for b in bones], [0] * size
    for k in range(1, size):
        children[skeleton.parent[k]] += 1
        depth[k] = depth[skeleton.parent[k]] + 1
    leaves = [b.n_leaves + (children[k] == 0) for k, b in enumerate(bones)]
    saved = [b.saved + (b.n_convs - 1) * b.bytes for b in bones]
    for k in range(size - 1, 0, -1):
        leaves[skeleton.parent[k]] += leaves[k]
        saved[skeleton.parent[k]] += saved[k]
    rows = [(b.conv_id, depth[k], bones[skeleton.parent[k]].conv_id if k else None, b.n_convs, children[k], leaves[k], saved[k], b.sha or EMPTY) for k, b in enumerate(bones)]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if len(b)]:
            yield from Shard(held, shared.value).nodes(least.value).to_batches(max_chunksize=10_000)

    return shards.mapInArrow(nodes, NODE).unionByName(spark.createDataFrame(rows, NODE))


def trie_sql() -> str:
    """prefix_trie() for DuckDB, over a table conversations."""
    return """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
                lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)
        ), parts AS (
            SELECT ids.conv_id, 0 AS part, i, role, text FROM ids JOIN turns t ON t.conv_id = ids.conv_id - ids.conv_id % 5 WHERE i < h
            UNION ALL
            SELECT conv_id, 1, i, role, text FROM ids JOIN turns USING (conv_id) WHERE i >= h
        ), paths AS (
            SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, i) FILTER (role IS NOT NULL), []) AS path FROM ids LEFT JOIN parts USING (conv_id) GROUP BY conv_id
        ), members AS (SELECT conv_id, path, unnest(generate_series(0, len(path))) AS depth FROM paths
        ), nodes AS (
            SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
            FROM members GROUP BY depth, prefix
        ), valued AS (
            SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.prefix[n.depth].text) ELSE 0 END AS saved
            FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
            LEFT JOIN (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c ON c.depth = n.depth AND c.prefix = n.prefix
        ), below AS (
            SELECT up AS depth, prefix[1:up] AS prefix, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(generate_series(0, depth)) AS up FROM valued) GROUP BY ALL
        )
        SELECT v.conv_id, v.depth::BIGINT AS depth, v.parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, sha256(v.ends) AS ends_sha256
        FROM valued v JOIN below b ON b.depth = v.depth AND b.prefix = v.prefix"""

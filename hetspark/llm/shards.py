"""Training-order materialisation: packed sequences, permuted by a keyed Feistel network, in fixed-stride shards."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetspark.llm import bpe
from hetspark.llm.common import use_checkpoints

ROUNDS = 6


def _mixed(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    x = (x + np.uint64((key + turn * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked until the
    value is below n (under four steps on average). It needs no table, so any task can place any sequence."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)

    def _once(self, x: np.ndarray, turns: range, forth: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for t in turns:
            if forth:
                left, right = right, left ^ (_mixed(right, self.key, t) & self.mask)
            else:
                left, right = right ^ (_mixed(left, self.key, t) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, turns: range, forth: bool) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64)
        if (x >= self.n).any():
            raise ValueError("outside the permutation")
        x = self._once(x, turns, forth)
        while len(far := np.flatnonzero(x >= self.n)):
            x[far] = self._once(x[far], turns, forth)
        return x.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, range(ROUNDS), True)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, range(ROUNDS - 1, -1, -1), False)


@dataclass
class Manifest:
    """What a reader needs: record r of shard s is slot s * rows_per_shard + r and starts at byte r * stride."""

    folder: str
    n: int
    tokens: int
    seq_len: int
    width: int
    stride: int
    rows_per_shard: int
    end: int
    pad: int
    key: int

    def place(self, slot: int) -> tuple[int, int]:
        return slot // self.rows_per_shard, slot % self.rows_per_shard * self.stride


def byte_ids(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tokens binary): each text as its UTF-8 bytes, ids below 256 of width 1. Bytes 0xFF and 0xFE are free there.

    Defined cases: null texts are null tokens, very long ones stay whole, repeated rows stay, other columns are ignored,
    an empty table gives an empty result."""
    return docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("tokens"))


def short_ids(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(tokens binary): arrays of ids below 65536 as little-endian numbers of width 2.

    Defined cases: null arrays are no tokens, arrays of any length stay whole, repeated rows stay, other columns are
    ignored, an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.asarray(x or [], np.int64) for x in b.column(0).to_pylist()]
            if any(len(x) and (x.min() < 0 or x.max() > 65535) for x in ids):
                raise ValueError("ids of width 2 lie between 0 and 65535")
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], ["tokens"])

    return encoded.select(ids_col).mapInArrow(run, "tokens binary")


def bpe_ids(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> tuple[DataFrame, int]:
    """(tokens binary, ids of the vocabulary): each text's BPE ids of width 2. Encoded once, in one pass, into a
    compressed table under the checkpoint folder, from which all later jobs read.

    Defined cases: null and empty texts have no tokens, very long ones are encoded whole, repeated rows stay, other
    columns are ignored, an empty table gives an empty result."""
    spark = docs.sparkSession
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ids-{uuid.uuid4().hex}"
    bpe.packed_ids(docs.select(F.col(text_col).alias("text")), ranks_path, pattern).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema("tokens binary").parquet(folder), bpe.vocabulary_size(ranks_path)


def materialise(tokens: DataFrame, folder: str | None = None, seq_len: int = 1024, width: int = 1, end: int = 0xFF, pad: int = 0xFE, key: int = 20, rows_per_shard: int = 16384) -> Manifest:
    """Packs tokens(tokens binary) into sequences, places them in training order, writes the shards; says what it wrote.

    Each document is followed by `end`; the documents of an input partition make one stream, cut every seq_len tokens,
    its last sequence filled with `pad`. As zipWithIndex() does, a first job counts the sequences of each partition, a
    second numbers them from there on. The slot of a number is its image under Permutation(n, key). Sequences are dealt
    to shards by slot range (shards are of one size, so no key is hot), sorted, and written by Spark's committer; a
    record is seq_len * width bytes and a line feed, which keeps the stride fixed. Records are compressed while they are
    shuffled and sorted. Only counts by partition come to the driver.

    The input has to be a stored table or follow from one row by row, so that both jobs and repeated tasks read the same
    partitions; if a partition's count changes between the jobs, the job fails rather than leave holes.

    Defined cases: null tokens are an empty document, which is `end` alone. Very long documents run over as many sequences
    as they need. Repeated rows are documents of their own. Columns but tokens are ignored, whatever their names. An
    empty table gives no shard and n = 0.
    """
    spark = tokens.sparkSession
    if folder is None:
        use_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    kind, size = np.dtype(f"<u{width}"), seq_len * width
    last, filler = np.array([end], kind).tobytes(), np.array([pad], kind).tobytes()
    source = tokens.select("tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(0)), 0)
            total += (pa.compute.sum(lengths).as_py() or 0) + width * len(b)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total // width], pa.int64())], ["part", "n"])

    counts = {r.part: r.n for r in source.mapInArrow(count, "part int, n bigint").collect()}
    starts, n = {}, 0
    for part in sorted(counts):
        starts[part] = n
        n += -(-counts[part] // seq_len)
    order = Permutation(n, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, to = starts.get(part, 0), starts.get(part, 0) + -(-counts.get(part, 0) // seq_len)
        rest, pack = b"", zstandard.ZstdCompressor(level=3).compress

        def rows(whole: bytes) -> pa.RecordBatch:
            nonlocal at
            here = len(whole) // size
            if at + here > to:
                raise RuntimeError(f"partition {part} has more tokens than when it was counted")
            slots = order.slots(np.arange(at, at + here))
            at += here
            data = pa.array([pack(whole[i : i + size]) for i in range(0, len(whole), size)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), data], ["slot", "packed"])

        for b in batches:
            for i in range(0, len(b), 512):
                rest += last.join([x or b"" for x in b.column(0).slice(i, 512).to_pylist()]) + last
                if whole := len(rest) // size * size:
                    yield rows(rest[:whole])
                    rest = rest[whole:]
        if rest:
            yield rows(rest + filler * ((size - len(rest)) // width))
        if at != to:
            raise RuntimeError(f"partition {part} has fewer tokens than when it was counted")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(0, len(b), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([get(x.as_buffer()) for x in b.column(0).slice(i, 1024)], pa.binary())], ["record"])

    placed = source.mapInArrow(cut, "slot bigint, packed binary")
    shards = max(1, -(-n // rows_per_shard))
    shard = F.expr(f"cast(slot div {rows_per_shard} as int)")
    ordered = placed.repartitionById(shards, shard).sortWithinPartitions("slot")
    ordered.select("packed").mapInArrow(unpack, "record binary").select(F.col("record").cast("string").alias("value")).write.text(f"{folder}/shards")
    out = Manifest(folder, n, sum(counts.values()), seq_len, width, size + 1, rows_per_shard, end, pad, key)
    spark.createDataFrame([(json.dumps(asdict(out)),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return out


def manifest(spark: SparkSession, folder: str) -> Manifest:
    return Manifest(**json.loads(spark.read.text(f"{folder}/manifest").first().value))


def _contents(spark: SparkSession, found: Manifest, first: int = 0) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{found.folder}/shards")
    numbered = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content", "length").where("length > 0")
    return numbered.where(F.col("shard") >= first // found.rows_per_shard).select("shard", "content")


def _read(found: Manifest, first: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size, stride, per = found.seq_len * found.width, found.stride, found.rows_per_shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                if len(data) % stride:
                    raise RuntimeError(f"shard {shard} is not whole")
                rows = data.reshape(-1, stride)
                skip = max(0, first - shard * per)
                for at in range(skip, len(rows), 1024):
                    part = np.ascontiguousarray(rows[at : at + 1024, :size])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + shard * per + at, pa.int64()), pa.array([r.tobytes() for r in part], pa.binary())], ["slot", "record"])

    return run


def records(spark: SparkSession, found: Manifest, first: int = 0) -> DataFrame:
    """(slot, record) of all slots from `first` on: where a reader resumes. Earlier shards are not opened."""
    return _contents(spark, found, first).mapInArrow(_read(found, first), "slot bigint, record binary")


def digests(spark: SparkSession, found: Manifest) -> DataFrame:
    """What lies in the shards: slot, shard, offset, sequence (its number before the permutation), n_tokens, sha256."""
    order, kind, read = Permutation(found.n, found.key), np.dtype(f"<u{found.width}"), _read(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            raw = b.column(1).to_pylist()
            used = [int((np.frombuffer(r, kind) != found.pad).sum()) for r in raw]
            numbers = order.indexes(b.column(0).to_numpy()) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), pa.array(used, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw])], ["slot", "sequence", "n_tokens", "sha256"])

    got = _contents(spark, found).mapInArrow(run, "slot bigint, sequence bigint, n_tokens bigint, sha256 string")
    return got.select("slot", F.expr(f"slot div {found.rows_per_shard}").alias("shard"), (F.col("slot") % found.rows_per_shard * found.stride).alias("offset"), "sequence", "n_tokens", "sha256")

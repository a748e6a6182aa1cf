"""SimHash near-duplicates by one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetspark.llm.common import columns_of, free_prefix, least_reachable, salt_of, salts_for, settled

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Groups up to this size are compared pair by pair in one vectorised pass; larger ones by covering balls.
SMALL = 16
#: Shingles hashed at a time, which bounds memory for texts of any length.
CHUNK = 1 << 17


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 hashes of the text's k-word shingles (repeats included).

    A-Z are lower-cased and words stand between ASCII white space. A text of fewer than k words is one shingle; a text
    without words, or null, has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    n, set_in, h = len(last), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([h(line[s:e], SEED) for s, e in pairs], ">u8")
        set_in += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """docs with the fingerprint, as a signed long, in place of the text; one row per input row."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(text_col)
            rest = [i for i in range(b.num_columns) if i != at]
            fp = np.fromiter(map(fingerprint, b.column(at).to_pylist()), np.uint64, len(b)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(fp)], [*(b.schema.names[i] for i in rest), out_col])

    return docs.mapInArrow(per_batch, docs.drop(text_col).schema.add(out_col, "long"))


@dataclass(frozen=True)
class Cut:
    """Fingerprints cut into `segments`; a key is `taken` of these, less one wildcard bit.

    If `distance` bits differ in all, some choice of `taken` segments differs by at most one bit: with one segment of
    distance // 2 + 1 because not all can differ by two; with distance + k segments, of which k + 1 are taken, because
    at least k don't differ, and if none besides then each other one differs by one bit.
    """

    segments: int
    taken: int

    def parts(self) -> list[tuple[int, int]]:
        """(shift, width) of each segment."""
        ends = [64 * i // self.segments for i in range(self.segments + 1)]
        return [(64 - b, b - a) for a, b in zip(ends, ends[1:], strict=False)]

    def choices(self) -> list[list[tuple[int, int, int]]]:
        """For each choice (shift, width, place in the key) of its segments."""
        out = []
        for some in combinations(self.parts(), self.taken):
            at = np.cumsum([0, *(w for _, w in some)]).tolist()
            out.append([(s, w, a) for (s, w), a in zip(some, at, strict=False)])
        return out


def cut_for(n: int, distance: int = DISTANCE, full: int = 64) -> Cut:
    """The fewest keys that leave no more than `full` of n random fingerprints to a bucket, if one of three cuts does;
    any of them is exact."""
    cuts = [Cut(distance // 2 + 1, 1), Cut(distance + 1, 2), Cut(distance + 2, 3)]
    return next((c for c in cuts if n <= full << (64 * c.taken // c.segments - 1)), cuts[-1])


def variants(fps: DataFrame, cut: Cut) -> DataFrame:
    """(bucket, fp) for every choice c of segments and every wildcard bit p of it: bucket names both and the other bits.

    Two fingerprints share a bucket exactly if some choice of theirs differs by at most one bit. Buckets hold a fixed
    share of all fingerprints, each of these once, so no bucket gets more rows than there are different fingerprints.
    """
    keys, which = [], 0
    for choice in cut.choices():
        key = F.lit(0).cast("bigint")
        for shift, width, at in choice:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)), at))
        bits = sum(w for _, w, _ in choice)
        for p in range(bits):
            keys.append(key.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << p))).bitwiseOR(F.lit(which << 48)))
            which += 1
    return fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def _wildcards(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """By number of the variant: its wildcard bit in the fingerprint, whether that bit is its choice's first."""
    at = [(s + p, a + p == 0) for choice in cut.choices() for s, w, a in choice for p in range(w)]
    return np.array([1 << b for b, _ in at], np.uint64), np.array([first for _, first in at])


def _small_links(fp: np.ndarray, bucket: np.ndarray, groups: np.ndarray, sizes: np.ndarray, distance: int, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """All links inside the groups (starts, sizes), each only in the first bucket that its two ends share."""
    left, right = [], []
    rows = np.repeat(groups, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    ends = np.repeat(groups + sizes, sizes)
    for gap in range(1, int(sizes.max(initial=1))):
        i = rows[rows + gap < ends]
        x = fp[i] ^ fp[i + gap]
        near = np.bitwise_count(x) <= distance
        i, x = i[near], x[near]
        first, which = np.full(len(i), -1, np.int64), 0
        for choice in cut.choices():
            d = np.zeros(len(x), np.uint64)
            for shift, width, at in choice:
                d |= (x >> np.uint64(shift) & np.uint64((1 << width) - 1)) << np.uint64(at)
            bit = np.where(d > 0, np.bitwise_count(d - np.uint64(1)), 0).astype(np.int64)
            first = np.where((first < 0) & (np.bitwise_count(d) <= 1), which + bit, first)
            which += sum(w for _, w, _ in choice)
        i = i[(bucket[i] >> 48) == first]
        left.append(fp[i])
        right.append(fp[i + gap])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def spanning_links(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links among different fingerprints that connect just what all pairs within the distance would connect.

    Fingerprints are first handed to pivots: each pivot takes all within the distance of it, linked to it as a star.
    Two fingerprints of one star need no comparison. What is then in different parts is compared in full, the smaller
    parts against all, so that no link between parts is lost. A dense group costs about one pass per pivot.
    """
    todo, part, left, right = np.ones(len(fp), bool), np.full(len(fp), -1), [], []
    parent: list[int] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    while todo.any():
        p = int(np.argmax(todo))
        near = np.bitwise_count(fp ^ fp[p]) <= distance
        star = len(parent)
        parent.append(star)
        for other in np.unique(part[near & ~todo]):  # they hang on the same pivot, by way of a shared member
            parent[root(int(other))] = root(star)
        near[p] = False
        left.append(np.full(int(near.sum()), fp[p]))
        right.append(fp[near])
        near[p] = True
        part[near & todo] = star
        todo &= ~near
    whole = np.array([root(a) for a in range(len(parent))])[part]
    names, counts = np.unique(whole, return_counts=True)
    for name in names[np.argsort(counts, kind="stable")][:-1]:
        for i in np.flatnonzero(whole == name):
            far = np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= distance) & (whole != name))
            left.append(np.full(len(far), fp[i]))
            right.append(fp[far])
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, distance: int = DISTANCE, cut: Cut | None = None) -> DataFrame:
    """fps(fp long, all different): (a, b) pairs within the distance that connect all that such pairs connect.

    Rows meet by equal bucket: they are dealt by it, sorted, and walked in runs. Small groups give each close pair
    once. In a large group (near copies by the thousand) only spanning links are made, so the output grows with the
    fingerprints and not with their square; where the wildcard is not its choice's first bit, pairs that agree in the
    wildcard too are left to the bucket of the first bit, which holds them as well. The cut follows from the number of
    fingerprints, so that buckets don't grow with them.
    """
    cut = cut or cut_for(fps.count(), distance)
    bits, firsts = _wildcards(cut)

    def large(fp: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        if not firsts[which]:
            side = (fp & bits[which]) > 0
            if side.all() or not side.any():
                return fp[:0], fp[:0]
        a, b = spanning_links(fp, distance)
        if not firsts[which]:
            across = ((a ^ b) & bits[which]) > 0
            a, b = a[across], b[across]
        return a, b

    def found(bucket: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        some = (sizes > 1) & (sizes <= SMALL)
        out = [_small_links(fp, bucket, starts[some], sizes[some], distance, cut)]
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            out.append(large(fp[at : at + n], int(bucket[at] >> 48)))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            bucket, fp = batch["bucket"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))  # this run may go on in the next batch
            if last:
                kept.append((bucket[:last], fp[:last]))
                yield found(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept = []
            kept.append((bucket[last:], fp[last:]))
        if kept:
            yield found(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    dealt = variants(fps, cut).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(walk, "a bigint, b bigint").distinct()


def _grouped(rows: DataFrame, distance: int, salts: int) -> DataFrame:
    """rows(id, fp, ...) with label (a fingerprint that all of a component share) and component_id (its least id).

    Copies share a fingerprint and meet once: ids are combined by (fingerprint, salt), then by fingerprint; only
    different fingerprints are compared. The answer goes back by (label, salt) and by (fingerprint, salt), so that
    neither a component nor a fingerprint with a third of all rows meets in one task.
    """
    rows = settled(rows).withColumn("salt", salt_of(F.col("id"), salts=salts))
    salted = rows.groupBy("fp", "salt").agg(F.min("id").alias("least"))
    fps = settled(salted.groupBy("fp").agg(F.min("least").alias("least")))
    labels = settled(least_reachable(links(fps.select("fp"), distance)))
    part = fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"), salt_of(F.col("fp"), salts=salts).alias("dealt"))
    spread = part.groupBy("label", "dealt").agg(F.min("least").alias("least"))
    whole = spread.groupBy("label").agg(F.min("least").alias("component_id"))
    best = spread.select("label", "dealt").join(whole, "label")
    answer = part.select("fp", "label", "dealt").join(best, ["label", "dealt"]).select("fp", "label", "component_id")
    return rows.join(salted.select("fp", "salt").join(answer, "fp"), ["fp", "salt"]).drop("salt")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, salts: int | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Defined cases: null and empty texts have fingerprint 0 and are linked like any other. Very long texts are hashed
    whole, CHUNK shingles at a time. Null ids take part, but a component's id is the smallest that is not null (null if
    there is none). Repeated rows give repeated rows. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    rows = fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = _grouped(rows, distance, salts or salts_for(docs))
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, salts: int | None = None) -> DataFrame:
    """docs with one row of each component: the one of the smallest id. Columns stay as they are, whatever their names.

    Defined cases: as in near_groups(). Null ids lose against any other. Of several rows with the smallest id the one
    of the least text hash stays, and of rows equal in id and text one (which one is not defined if their other columns
    differ).
    """
    p, key = free_prefix(docs), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = fingerprints(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text")))
    first = _grouped(rows, distance, salts or salts_for(docs)).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("label").agg(F.min("key").alias("key"), F.first("component_id").alias("id"))
    kept = kept.select(F.col("id").isNull().alias(f"{p}none"), F.col("id").alias(f"{p}id"), F.col("key").alias(f"{p}key"))
    names = [f"{p}none", f"{p}id", f"{p}key"]
    # Rows equal in id and text hash go first: each task sends one of them, whatever their number.
    keyed = docs.withColumns({names[0]: F.col(id_col).isNull(), names[1]: F.col(id_col), names[2]: key}).dropDuplicates(names)
    same = [keyed[n].eqNullSafe(kept[n]) if n == names[1] else keyed[n] == kept[n] for n in names]
    return keyed.join(kept, same, "left_semi").select(*columns_of(docs))

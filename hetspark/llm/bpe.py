"""Byte-level BPE encoding and decoding by numpy matrices, from a file of ranks."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetspark.llm.common import carried, restored

#: No merge: larger than any rank.
NONE = np.int32(2**31 - 1)
#: Longest piece, in bytes, that goes through a matrix; longer ones are merged one by one over a heap.
WIDEST = 256
#: Columns of the matrix for pieces of each length: steps of four up to 32 bytes, powers of two beyond.
WIDTHS = np.array([max(4, -(-n // 4) * 4) if n <= 32 else 1 << (n - 1).bit_length() for n in range(WIDEST + 1)], np.int64)
#: Pieces a worker remembers before it starts anew (and where they are kept from task to task), and characters taken at
#: a time: all bound memory only.
REMEMBERED, KEPT, AT_A_TIME = 200_000, 800_000, 2_000_000


class PairTable:
    """Pairs of numbers (left << 32 | right) and what they map to, in an open-addressing hash table of arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.slot(keys)
        while len(keys):  # of keys that want a free slot the first gets it; the others try the next one
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.setdiff1d(np.arange(len(keys)), won)
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair maps to, NONE where there is no such pair (padding is negative)."""
        key = (left.astype(np.int64) << 32 | right).ravel()
        at = self.slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], NONE)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return np.where((left.ravel() < 0) | (right.ravel() < 0), NONE, out).reshape(left.shape)


def assembled(done: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in order, number of ids of each of n pieces) from parts (piece numbers, padded ids, lengths)."""
    counts = np.zeros(n, np.int64)
    for who, _, sizes in done:
        counts[who] = sizes
    starts = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.int32)
    for who, ids, sizes in done:
        inside = np.arange(ids.shape[1]) < sizes[:, None]
        flat[(starts[who][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
    return flat, counts


class Ranks:
    """A vocabulary: bytes to rank, with every mergeable pair of ids in a table."""

    def __init__(self, raw: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pair = pairs
        self.table = PairTable(pairs)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.lookup(left, right)

    def merge_matrix(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of padded ids, all merged. In each round every row that still can merges its leftmost pair of least
        rank, closes the gap and looks up the two new pairs; the others leave the matrix. All rows that stay get
        shorter by one, so the matrix loses a column each round. Returns the padded ids and their lengths.

        Inside, a row stands in a column, and a pair is its rank and its place as one number, whose least one is both."""
        ids = np.ascontiguousarray(ids.T)
        bits = max(1, (len(ids) - 1).bit_length())
        kind = np.int32 if len(self.token) << bits < 1 << 29 else np.int64
        none = kind(1 << (30 if kind is np.int32 else 60))

        def keys_of(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            ranks = self.lookup(left, right)
            return np.where(ranks < NONE, ranks.astype(kind) << kind(bits) | at, none)

        places = np.arange(len(ids), dtype=kind)[:, None]
        out, sizes, alive = np.full_like(ids, -1), lengths.copy(), np.arange(ids.shape[1])
        keys = keys_of(ids[:-1], ids[1:], places[:-1])
        while len(keys) and len(alive):
            least = keys.min(0)
            live = least < none // 2  # what moves by a place loses one, so none does not stay exactly that
            if not live.all():
                out[: len(ids), alive[~live]] = ids[:, ~live]
                live = np.flatnonzero(live)
                alive, ids, keys, least = alive[live], ids.take(live, 1), keys.take(live, 1), least[live]
                if not len(alive):
                    return out.T, sizes
            at, least, width = least & kind((1 << bits) - 1), (least >> kind(bits)).astype(np.int32), len(ids) - 1
            ids = np.where(places[:width] <= at, ids[:-1], ids[1:])
            ids[at, np.arange(len(alive))] = least
            sizes[alive] -= 1
            keys = np.where(places[: width - 1] < at, keys[:-1], keys[1:] - kind(1))
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            here = at[left] - kind(1)
            keys[here, left] = keys_of(ids[here, left], least[left], here)
            here = at[right]
            keys[here, right] = keys_of(least[right], ids[here + 1, right], here)
        out[: len(ids), alive] = ids
        return out.T, sizes

    def merge_long(self, ids: list[int]) -> list[int]:
        """One long piece: a heap of (rank, place), and links to the neighbours that are left."""
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.pair.get
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (s := get(r << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each piece). A piece that is a token is that token."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece numbers, padded ids, lengths
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(lengths) - lengths
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int32, len(pieces))
        alone, rest = np.flatnonzero(whole >= 0), np.flatnonzero(whole < 0)
        if len(alone):
            done.append((alone, whole[alone, None], np.ones(len(alone), np.int64)))
        for i in rest[lengths[rest] > WIDEST]:
            ids = self.byte[text[begins[i] : begins[i] + lengths[i]]].tolist()
            merged = np.array(self.merge_long(ids), np.int32)
            done.append((np.array([i]), merged[None], np.array([len(merged)])))
        short = rest[lengths[rest] <= WIDEST]
        widths = WIDTHS[lengths[short]]
        for width in np.unique(widths):
            members, columns = short[widths == width], np.arange(width)
            for at in range(0, len(members), step := max(1, (1 << 18) // width)):
                part = members[at : at + step]
                inside = columns < lengths[part, None]
                raw = text[np.where(inside, begins[part, None] + columns, 0)]
                done.append((part, *self.merge_matrix(np.where(inside, self.byte[raw], np.int32(-1)), lengths[part])))
        return assembled(done, len(pieces))


def _below(kind: str, end: int = 0x100) -> str:
    """The characters below `end` that a class holds, as the inside of another class."""
    member = regex.compile(kind).match
    points = [c for c in range(end) if member(chr(c))]
    return "".join(f"\\x{c:02x}" for c in points)


def narrowed(pattern: str) -> Callable[[str], list[str]] | None:
    """findall() of a pattern for texts of characters below U+0100: its classes written out for the standard library's
    engine, which is over twice as fast. None if the pattern has more than letters, digits and spaces by class."""
    out, at, inside = [], 0, False
    if "(?i" in pattern:
        return None
    while at < len(pattern):
        kind = next((k for k in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(k, at)), None)
        if kind == r"\S":
            if inside:
                return None
            out.append(f"[^{_below(chr(92) + 's')}]")
        elif kind:
            out.append(_below(kind) if inside else f"[{_below(kind)}]")
        elif pattern[at] == "\\":
            if pattern[at + 1].isalnum():
                return None
            out.append(pattern[at : at + 2])
            at += 2
            continue
        else:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
            out.append(pattern[at])
        at += len(kind or "x")
    try:
        return re.compile("".join(out)).findall
    except re.error:
        return None


def finder(pattern: str) -> Callable[[str], list[str]]:
    """findall() of a pattern."""
    full, narrow = regex.compile(pattern).findall, narrowed(pattern)

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return narrow(text)

    return find if narrow else full


#: GPT-2's pattern, which most byte-level vocabularies cut by.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of the characters below U+0100 in it: space, letter, digit, other.
KINDS = np.array([next((k for k, c in enumerate((r"\s", r"\p{L}", r"\p{N}")) if regex.match(c, chr(i))), 3) for i in range(0x100)], np.uint8)


def gpt2_starts(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of GPT-2's pattern start in texts of characters below U+0100 that follow each other without a
    gap, each (none empty) from its begin on: pieces cover a text, so starts say all."""
    if not len(chars):
        return np.zeros(0, np.int64)
    kind, begin = KINDS[chars], np.zeros(len(chars), bool)
    begin[begins] = True
    last, blank = np.r_[begin[1:], True], kind == 0
    changed = np.r_[True, kind[1:] != kind[:-1]]
    # A run of one kind, with the space before it; of other blanks the one before a run stands alone.
    start = changed & ~blank & ~np.r_[False, chars[:-1] == 0x20]
    start |= blank & (changed | np.r_[~blank[1:], False] & ~last)
    start |= begin
    # Where a piece starts with an apostrophe, the ending after it is of that piece, and what follows is not.
    at = np.flatnonzero(start & (chars == ord("'")) & ~last)
    following = chars[at + 1]
    short = at[np.isin(following, np.frombuffer(b"stmd", np.uint8))]
    at = at[~last[at + 1]]
    pair = chars[at + 1].astype(int) << 8 | chars[at + 2]
    long = at[np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])]
    start[np.r_[short, long] + 1] = False
    after = np.r_[short + 2, long + 3]
    start[after[after < len(chars)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Texts to ids. Pieces that were met before are looked up; new ones are merged together, in matrices."""

    def __init__(self, ranks: Ranks, pattern: str, remembered: int | None = None):
        self.remembered = remembered or REMEMBERED
        self.ranks, self.find, self.in_numpy = ranks, finder(pattern), pattern == GPT2
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.starts, self.counts, self.met = pa.array([], pa.binary()), np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))

    def forget_rare(self) -> None:
        """Pieces met once go; all, if the others are too many to leave room."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.remembered // 2:
            return self.forget()
        self.known, self.flat = self.known.take(pa.array(kept)), self.flat[_runs(self.starts[kept], self.counts[kept])]
        self.counts, self.met = self.counts[kept], self.met[kept] // 2
        self.starts = np.cumsum(self.counts) - self.counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        if len(self.known) > self.remembered:
            self.forget_rare()
        pieces, sizes = self.all_pieces(texts)
        which = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new = pieces.take(pa.array(missing)).dictionary_encode()
            which[missing] = len(self.known) + new.indices.to_numpy()
            flat, counts = self.ranks.encode_pieces(new.dictionary.to_pylist())
            self.known = pa.concat_arrays([self.known, new.dictionary])
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
            self.flat, self.counts, self.met = np.r_[self.flat, flat], np.r_[self.counts, counts], np.r_[self.met, np.zeros(len(counts), np.int64)]
        self.met += np.bincount(which, minlength=len(self.met))
        counts = self.counts.take(which)
        ends = np.cumsum(counts)
        at = np.repeat(self.starts.take(which) - ends + counts, counts)
        at += np.arange(len(at))
        return self.flat.take(at), np.diff(np.r_[0, ends].take(np.r_[0, np.cumsum(sizes)]))

    def all_pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(all pieces in order as UTF-8, how many each text has)."""
        if not self.in_numpy:
            return self.found(texts)
        try:
            raw = "".join(texts).encode("latin-1")
        except UnicodeEncodeError:  # runs of texts that have further characters, and of texts that have none
            wide = np.array([not t.isascii() and max(t) > "\xff" for t in texts])
            bounds = [0, *(np.flatnonzero(np.diff(wide)) + 1).tolist(), len(texts)]
            parts = [(self.found if wide[a] else self.all_pieces)(texts[a:b]) for a, b in zip(bounds, bounds[1:])]
            return pa.concat_arrays([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        chars = np.frombuffer(raw, np.uint8)
        bounds = np.r_[0, np.cumsum([*map(len, texts)])].astype(np.int64)
        starts = gpt2_starts(chars, bounds[:-1][np.diff(bounds) > 0])
        ends = np.r_[starts, len(raw)]
        if not raw.isascii():  # characters from U+0080 on have two bytes
            ends, raw = ends + np.r_[0, np.cumsum(chars >= 0x80)][ends], "".join(texts).encode()
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
        return pieces, np.diff(np.searchsorted(starts, bounds))

    def found(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """all_pieces() by the pattern itself."""
        found = [self.find(t) for t in texts]
        return pa.array([w.encode() for f in found for w in f], pa.binary()), np.array([*map(len, found)], np.int64)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all runs of so many from these starts on, one run after the other."""
    upto = np.cumsum(counts)
    return np.arange(int(counts.sum())) + np.repeat(starts - (upto - counts), counts)


_LOADED: dict[str, Ranks] = {}


def loaded(raw: bytes) -> Ranks:
    """The vocabulary, built once in each worker process."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Ranks(raw)
    return _LOADED[name]


_KEPT: dict[tuple[int, str], Encoder] = {}


def kept(raw: bytes, pattern: str) -> Encoder:
    """An encoder that a worker process keeps from task to task, with the pieces it has met: ids don't depend on them."""
    ranks = loaded(raw)
    if (id(ranks), pattern) not in _KEPT:
        _KEPT[id(ranks), pattern] = Encoder(ranks, pattern, KEPT)
    return _KEPT[id(ranks), pattern]


def slices(texts: list[str], size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_A_TIME characters (or size), one text at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= (size or AT_A_TIME) or i == len(texts) - 1:
            yield at, i + 1
            at, held = i + 1, 0


def decoded(token: list[bytes], ids: list[int], counts: list[int]) -> list[bytes]:
    """The bytes that each run of ids stands for."""
    if ids and min(ids) < 0:
        raise ValueError("token ids are not negative")
    parts, out, at = [*map(token.__getitem__, ids)], [], 0
    for n in counts:
        out.append(b"".join(parts[at : at + n]))
        at += n
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """docs with ids_col: the token ids of the whole text, without special tokens, as an array of ints. With bytes_col
    the ids are decoded again in the same pass, which saves a second set of Python workers.

    The pattern cuts a text into pieces, each encoded on its own: starting from bytes, the leftmost pair of least rank
    merges until none can. The rank file is read by the driver and broadcast (a vocabulary's size is fixed).

    Defined cases: null and empty texts give an empty array. Very long texts are encoded whole; pieces of over WIDEST
    bytes leave the matrices for a heap, with the same ids, so that none costs the square of its length. Of pairs of
    equal rank the leftmost merges. Other columns pass through, whatever their names; those already called like a
    result (in any case) are replaced. Repeated rows stay repeated. An empty table gives an empty result.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = ["row", "value", "ids", *(["decoded"] if bytes_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(loaded(shared.value), pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, counts = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(a, b - a)
                again = [pa.array(decoded(encoder.ranks.token, ids.tolist(), counts.tolist()), pa.binary())] if bytes_col else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, *again], kinds)

    rows = carried(docs, text_col, ids_col, *([bytes_col] if bytes_col else []))
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.BinaryType())] if bytes_col else [])])
    return restored(rows.mapInArrow(run, schema), docs, text_col, ids=ids_col, **({"decoded": bytes_col} if bytes_col else {}))


def vocabulary_size(ranks_path: str) -> int:
    """One more than the largest id."""
    with open(ranks_path, "rb") as f:
        return 1 + max(int(line.split()[1]) for line in f)


def packed_ids(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "tokens", keep: bool = False) -> DataFrame:
    """docs with the binary out_col in place of the text: its ids, as encode() gives them, as little-endian numbers of
    width 2. Two ids are left for marks; a vocabulary that leaves none is an error. With keep, workers remember more pieces,
    and from task to task, and take more texts at a time, which takes memory and saves time.

    Defined cases: null and empty texts give no bytes. Very long texts are encoded whole. Of pairs of equal rank the
    leftmost merges. Other columns pass through, whatever their names; one already called out_col (in any case) is
    replaced. Repeated rows stay repeated. An empty table gives an empty result.
    """
    if vocabulary_size(ranks_path) > 65534:
        raise ValueError("ids of width 2 and two marks lie between 0 and 65535")
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(shared.value, pattern) if keep else Encoder(loaded(shared.value), pattern)
        step, size = (4096, 4 * AT_A_TIME) if keep else (1024, AT_A_TIME)
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.slice(at, step)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for a, b in slices(texts, size):
                    ids, counts = encoder.encode(texts[a:b])
                    ends = np.r_[0, np.cumsum(counts * 2)].astype(np.int32)
                    made = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(a, b - a), made], ["row", "ids"])

    rows = carried(docs, text_col, out_col)
    return restored(rows.mapInArrow(run, rows.select("row").schema.add("ids", "binary")), docs, None, ids=out_col)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col: the bytes that the ids stand for.

    Defined cases: null or no ids give no bytes; an unknown id is an error. Arrays of any length are decoded whole.
    Other columns pass through, whatever their names; one already called bytes_col (in any case) is replaced. Repeated
    rows stay repeated. An empty table gives an empty result.
    """
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = loaded(shared.value).token
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                ids = [x or [] for x in part.column(1).to_pylist()]
                texts = decoded(token, [i for x in ids for i in x], [*map(len, ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["row", "value", "decoded"])

    rows = carried(df, ids_col, bytes_col)
    return restored(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])), df, ids_col, decoded=bytes_col)


def digest_columns(ids_col: str = "ids", bytes_col: str = "decoded") -> list[Column]:
    """ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes)."""
    return [F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(bytes_col, 256).alias("decoded_sha256")]


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and digest_columns(): every text encoded, and decoded again."""
    encoded = encode(docs.select(F.col(id_col), F.col(text_col).alias("text")), ranks_path, pattern, bytes_col="decoded")
    return encoded.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), *digest_columns())

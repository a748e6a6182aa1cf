"""BPE encoding and decoding by a tokenization automaton, compiled from the merges of a tokenizer file."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetspark.llm import bpe
from hetspark.llm.common import carried, named, restored

#: Longest piece, in bytes, that is walked in a matrix with others; longer ones are walked alone.
WIDEST = 256
#: Pairs of labels that a worker remembers, in a table of 2^MEMO rows and for long pieces: both bound memory only.
MEMO, REMEMBERED = 20, 1_000_000
#: The pattern that byte-level pre-tokenizers cut texts by (a fixed value), from classes of letters, digits and others.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{}+| ?{}+| ?{}+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """How tokenizer files write bytes: printable ones of Latin-1 as themselves, the others from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """A deterministic automaton over tokens that accepts each text's one right tokenization, and tables to drive it.

    Labels number arcs: bytes from 0 to 255, the i-th merge 256 + i. Construction starts from one state with an arc
    back to itself for each byte, and puts one gadget in place for each merge l of u and v, in order: where an arc u
    leads to a state with an arc v, a copy of that state without the arc v takes its place behind u, and every state
    that has an arc u gets an arc l, to where v led. So u is never followed by v again, and l stands for them. All arcs
    of one label lead to one state, so a state is named by the label that leads to it and by the time (a number of
    merges): (x, time) is the state behind x before merge `time`. Its arcs are found by going back through the gadgets
    (follows()): `cut` holds by (u, v) the merge that took the arc v from behind u; `parts` has (u, v) by label.
    Merges whose u is never followed by v add no arc; their labels and all that is built on them are dead.

    Every prefix of a right tokenization is one too. So when bytes drive the automaton, exactly one token can end at
    each place: the one among the tokens that end there (`ends` by the place in a trie of all tokens with failure
    links, then `shorter`) which the state behind the token before it has an arc for. Texts are walked once from the
    left, and the tokens are read off from the right.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], special: dict[str, int]):
        self.text = [bytes([b]) for b in range(256)]
        self.parts = [(b, b) for b in range(256)]
        label, live = {t: b for b, t in enumerate(self.text)}, [True] * 256
        self.cut: dict[int, int] = {}
        for left, right in merges:
            made, now = left + right, len(self.text)
            if made in label:
                raise ValueError(f"two merges make {made!r}")
            u, v = label[left], label[right]
            live.append(live[u] and live[v] and self.follows(u, v))
            label[made] = now
            self.text.append(made)
            self.parts.append((u, v))
            if live[-1]:
                self.cut[u << 32 | v] = now
        self.id_of = np.array([ids[t] for t in self.text], np.int32)
        self.special = special
        self.token: dict[int, bytes] = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        self._tables(live)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._known: dict[int, bool] = {}

    def follows(self, u: int, v: int) -> bool:
        """Has the state behind u an arc v, after all gadgets so far?"""
        time = len(self.text)
        while True:
            if self.cut.get(u << 32 | v, time) < time:
                return False
            if u > v:  # the state behind u, as it was made, is the one behind u's right part
                time, u = u, self.parts[u][1]
            elif v < 256:
                return True
            else:  # the arc v came with the arc of v's left part; the gadget of v had then been put in place
                time, v = v + 1, self.parts[v][0]
            if u < 256 and v < 256:
                return self.cut.get(u << 32 | v, time) >= time

    def _tables(self, live: list[bool]) -> None:
        """The trie of live labels with failure links resolved; leaves share the row of the node they fail to."""
        step: dict[int, int] = {}
        levels: list[list[tuple[int, int, int]]] = []  # by depth: parent, byte, node
        own = [-1]
        for t, l in sorted((t, l) for l, t in enumerate(self.text) if live[l]):
            node = 0
            for depth, b in enumerate(t):
                after = step.get(node << 8 | b)
                if after is None:
                    step[node << 8 | b] = after = len(own)
                    own.append(-1)
                    if len(levels) == depth:
                        levels.append([])
                    levels[depth].append((node, b, after))
                node = after
            own[node] = l
        ends, fail = np.array(own, np.int32), np.zeros(len(own), np.int32)
        inner = np.unique(np.fromiter(step, np.int64, len(step)) >> 8)
        row = np.full(len(own), -1, np.int32)
        row[inner] = np.arange(len(inner))
        self.go = np.zeros((len(inner), 256), np.int32)
        self.shorter = np.full(len(self.text), -1, np.int32)
        for depth, level in enumerate(levels):
            parent, byte, node = np.array(level).T
            fail[node] = self.go[row[fail[parent]], byte] if depth else 0
            behind = fail[node]
            full = ends[node] >= 0
            self.shorter[ends[node[full]]] = ends[behind[full]]
            ends[node[~full]] = ends[behind[~full]]
            row[node] = np.where(row[node] >= 0, row[node], row[behind])
            self.go[row[parent], byte] = node
            # Rows of nodes that have children start as those of the node they fail to; children come with their level.
            grown = np.isin(node, inner)
            self.go[row[node[grown]]] = self.go[row[behind[grown]]]
        self.row, self.ends = row, ends
        self.size = np.array([len(t) for t in self.text], np.int32)
        self.left, self.right = (np.array(p, np.int32) for p in zip(*self.parts, strict=True))
        self.table = bpe.PairTable(self.cut)
        self.asked, self.answer = np.full(1 << MEMO, -(1 << 62), np.int64), np.zeros(1 << MEMO, bool)

    def follow(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """follows() for many pairs; u is -1 at the start of a piece, which any label may follow. A direct-mapped table
        remembers what was asked."""
        key = u.astype(np.int64) << 32 | v
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO)).view(np.int64)
        out = self.answer[at]
        miss = np.flatnonzero(self.asked[at] != key)
        if len(miss):
            out[miss] = self._followed(u[miss], v[miss])
            self.asked[at[miss]], self.answer[at[miss]] = key[miss], out[miss]
        return out

    def _followed(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.ones(len(u), bool)
        at = np.flatnonzero(u >= 0)
        u, v = u[at], v[at]
        time = np.full(len(at), len(self.text), np.int32)
        while len(at):
            alone = self.table.lookup(u, v) < time
            out[at[alone]] = False
            go = ~alone & ((u >= 256) | (v >= 256))
            at, u, v, time = at[go], u[go], v[go], time[go]
            back = u > v
            time = np.where(back, u, v + 1)
            u, v = np.where(back, self.right[u], u), np.where(back, v, self.left[v])
        return out

    def walk_matrix(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of pieces, given as rows of padded bytes: (padded labels, number of them)."""
        n, width = raw.shape
        order = np.argsort(-lengths, kind="stable")
        raw, sizes = raw[order], lengths[order]
        last = np.full((n, width + 1), -1, np.int32)
        node = np.zeros(n, np.int32)
        for i in range(width):
            m = int(np.searchsorted(-sizes, -i, "left"))  # rows longer than i stand first
            if not m:
                break
            node = self.go[self.row[node[:m]], raw[:m, i]]
            label = self.ends[node]
            todo = np.arange(m)
            while len(todo):
                before = last[todo, i + 1 - self.size[label[todo]]]
                todo = todo[~self.follow(before, label[todo])]
                label[todo] = self.shorter[label[todo]]
            last[:m, i + 1] = label
        back, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        rows, at = np.arange(n), sizes.astype(np.int64)
        rows, at = rows[at > 0], at[at > 0]
        for k in range(width):
            if not len(rows):
                break
            label = last[rows, at]
            back[rows, k], counts[rows] = label, k + 1
            at = at - self.size[label]
            rows, at = rows[at > 0], at[at > 0]
        columns = np.arange(int(counts.max()) if n else 0)
        turned = np.take_along_axis(back, np.maximum(counts[:, None] - 1 - columns, 0), 1)
        out, found = np.empty_like(turned), np.empty_like(counts)
        out[order], found[order] = turned, counts
        return out, found

    def walk(self, piece: bytes) -> list[int]:
        """Labels of one long piece, place by place."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        go, row, ends, known, size, shorter = self.go, self.row, self.ends, self._known, self.size, self.shorter
        last, node = [-1] * (len(piece) + 1), 0
        for i, b in enumerate(piece, 1):
            node = go[row[node], b]
            label = int(ends[node])
            while (u := last[i - int(size[label])]) >= 0:
                key = u << 32 | label
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = self.follows(u, label)
                if ok:
                    break
                label = int(shorter[label])
            last[i] = label
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.text[last[at]])
        return out[::-1]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each piece)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(lengths) - lengths
        marks = {s.encode(): i for s, i in self.special.items()}
        mark = np.fromiter((marks.get(p, -1) for p in pieces), np.int32, len(pieces))
        alone = np.flatnonzero(mark >= 0)
        done = [(alone, mark[alone, None], np.ones(len(alone), np.int64))] if len(alone) else []
        for i in np.flatnonzero((mark < 0) & (lengths > WIDEST)):
            labels = self.walk(pieces[i])
            done.append((np.array([i]), self.id_of[labels][None], np.array([len(labels)])))
        short = np.flatnonzero((mark < 0) & (lengths <= WIDEST))
        widths = bpe.WIDTHS[lengths[short]]
        for width in np.unique(widths):
            members, columns = short[widths == width], np.arange(width)
            for at in range(0, len(members), step := max(1, (1 << 18) // width)):
                part = members[at : at + step]
                inside = columns < lengths[part, None]
                labels, found = self.walk_matrix(np.where(inside, text[np.where(inside, begins[part, None] + columns, 0)], 0), lengths[part])
                done.append((part, self.id_of[labels], found))
        return bpe.assembled(done, len(pieces))


class Encoder(bpe.Encoder):
    """Texts to ids by an automaton. Special tokens are cut out of texts first, as the tokenizer file asks for."""

    def __init__(self, automaton: Automaton, strange: str = ""):
        """strange: what strangers() gives; texts without these are cut by the plain pattern."""
        super().__init__(automaton, PIECES.format(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
        self.plain, self.special, self.find = self.find, [*automaton.special], self.pieces
        self.marks = automaton.marks
        self.strange = regex.compile(f"[{strange}]").search if strange else None
        self.other = regex.compile(PIECES.format(rf"(?:(?![{strange}])\p{{L}})", rf"(?:(?![{strange}])\p{{N}})", rf"(?:[^\s\p{{L}}\p{{N}}]|[{strange}])")).findall if strange else None
        self.first = chr(int(strange[2:10], 16)) if strange else ""
        self.in_numpy = self.in_numpy and not (strange and self.first < "\u0100")

    def cut(self, text: str) -> list[str]:
        if self.strange is None:
            return self.plain(text)
        try:
            text.encode("latin-1")
            odd = self.first < "\u0100" and self.strange(text)
        except UnicodeEncodeError:
            odd = self.strange(text)
        return self.other(text) if odd else self.plain(text)

    def all_pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        marked = any(s in t for t in texts for s in self.special)
        return self.found(texts) if marked else super().all_pieces(texts)

    def pieces(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.cut(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.cut(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.cut(text[at:])


def compiled(raw: bytes) -> Automaton:
    """The automaton of a byte-level BPE tokenizer file. What the file asks for and this module has not is an error."""
    file = json.loads(raw)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = file.get("added_tokens") or []
    flags = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model.get("type") != "BPE" or not plain or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or flags:
        raise ValueError("not a plain byte-level BPE file")
    letters = byte_letters()
    as_bytes = lambda s: bytes(map(letters.__getitem__, s))
    special = {t["content"]: t["id"] for t in added}
    ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton([(as_bytes(a), as_bytes(b)) for a, b in merges], ids, special)


def strangers(path: str) -> str:
    """Code points that are letters or digits to this process's regex, but not to the file's own pre-tokenizer, as the
    inside of a class: libraries differ in the version of Unicode they know. A letter sticks to x and a digit to 1."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    known = regex.compile(r"\p{L}|(\p{N})")
    found = ((c, m) for c in (*range(0xD800), *range(0xE000, 0x110000)) if (m := known.match(chr(c))))
    points = np.array([c for c, m in found if len(cut(("1" if m[1] else "x") + chr(c))) > 1], np.int64)
    if not len(points):
        return ""
    starts = np.flatnonzero(np.r_[True, np.diff(points) > 1])
    return "".join(rf"\U{points[a]:08x}-\U{points[b - 1]:08x}" for a, b in zip(starts, np.r_[starts[1:], len(points)], strict=True))


_LOADED: dict[str, Automaton] = {}


def loaded(raw: bytes) -> Automaton:
    """The automaton, compiled once in each worker process."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = compiled(raw)
    return _LOADED[name]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", text_out: str | None = None) -> DataFrame:
    """docs with ids_col: the token ids of the whole text as an array of ints, as the tokenizer file at path gives them
    without added special tokens; a special token's string inside a text is that token. With text_out, the ids are
    decoded again in the same pass into this column, a string.

    The file is read by the driver and broadcast (a vocabulary's size is fixed); each worker compiles it once.

    Defined cases: null and empty texts give an empty array and an empty string. Very long texts are encoded whole, and
    long pieces in time in proportion to their length. Other columns pass through, whatever their names; those already
    called like a result (in any case) are replaced. Repeated rows stay repeated. An empty table gives an empty result.
    """
    out = _mapped(docs, path, text_col, [ids_col, *([text_out] if text_out else [])], packed=False)
    return restored(out, docs, text_col, ids=ids_col, **({"decoded": text_out} if text_out else {}))


def packed(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", text_out: str | None = None) -> DataFrame:
    """As encode(), with the ids as little-endian unsigned 32-bit numbers in a binary column, and without the text."""
    out = _mapped(docs, path, text_col, [ids_col, *([text_out] if text_out else [])], packed=True)
    return restored(out, docs, None, ids=ids_col, **({"decoded": text_out} if text_out else {}))


def _mapped(docs: DataFrame, path: str, text_col: str, made: list[str], packed: bool) -> DataFrame:
    """(row, value unless packed, ids, decoded if two columns are made)."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), strangers(path)))
    kinds = ["row", *([] if packed else ["value"]), "ids", *(["decoded"] if len(made) > 1 else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, strange = shared.value
        automaton = loaded(raw)
        encoder = Encoder(automaton, strange)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in bpe.slices(texts):
                ids, counts = encoder.encode(texts[a:b])
                part = batch.slice(a, b - a)
                ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                if packed:
                    columns = [part.column(0), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<u4"))])]
                else:
                    columns = [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]
                if "decoded" in kinds:
                    columns.append(pa.array(_texts(automaton, ids.tolist(), counts.tolist()), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, kinds)

    rows = carried(docs, text_col, *made)
    types = {"row": rows.schema["row"].dataType, "value": T.StringType(), "ids": T.BinaryType() if packed else T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return rows.mapInArrow(run, T.StructType([T.StructField(k, types[k]) for k in kinds]))


def _texts(automaton: Automaton, ids: list[int], counts: list[int]) -> list[str]:
    """What each run of ids stands for: the bytes of its arcs, and U+FFFD for what is not UTF-8 among them."""
    return [t.decode("utf-8", "replace") for t in bpe.decoded(automaton.token, ids, counts)]


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_out: str = "decoded") -> DataFrame:
    """df with text_out: what the ids (an array of ints, or packed() ones) stand for, special tokens included.

    Defined cases: null or no ids give an empty string, bytes that are no UTF-8 become U+FFFD, an id that the file has
    not is an error. Other columns pass through, whatever their names; one already called text_out is replaced. Repeated
    rows stay repeated. An empty table gives an empty result.
    """
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = loaded(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                ids = [np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x or [] for x in part.column(1).to_pylist()]
                made = _texts(automaton, [i for x in ids for i in x], [*map(len, ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string())], ["row", "value", "decoded"])

    rows = carried(df, ids_col, text_out)
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
    return restored(out, df, ids_col, decoded=text_out)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers) and decoded_sha256."""
    rows = packed(docs.select(named(docs, id_col).alias("id"), named(docs, text_col).alias("text")), path, text_out="decoded")
    return rows.select(F.col("id").alias(id_col), F.expr("length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

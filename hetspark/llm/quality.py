"""Quality rules: counts over whole texts, and a linear-chain conditional random field over their lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetspark.llm.common import carried, columns_of, free_prefix, named, restored

#: Least words, most percent of words in repeated 3-word windows, least share of words in content lines.
LEAST_WORDS, MOST_REPEATED, LEAST_CONTENT = 50, 50, 0.5
#: The bounded sample that fits the model: so many labelled documents of each class at most, those with the smallest
#: hashes of their ids, and of each of these so many runs of RUN lines at most, those with the smallest hashes over the
#: whole text. Judging has no such bound.
SAMPLE, RUNS, RUN = 1500, 8, 64
SYMBOLS = b"#*$%&|<>"
CHARS = 1_000_000

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE, SYMBOL, DIGIT, UPPER, STOP = map(_table, (b" \t\n\r\x0b\x0c", SYMBOLS, b"0123456789", bytes(range(65, 91)), b".!?:;\"')"))
FEATURES = ("bias", "symbols a word", "symbols a character", "digits a character", "capitals a character", "word length", "words", "ends a sentence", "seen before", "bar")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more (the first such window included)."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 2_000_000:  # three numbers would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


@dataclass
class Lines:
    """The counts of some texts, and the features of their lines that have a word."""

    counts: np.ndarray  # texts x (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    owner: np.ndarray  # text of each line
    words: np.ndarray  # words of each line
    features: np.ndarray  # lines x FEATURES


def read_lines(texts: list[str]) -> Lines:
    raws = [t.encode() for t in texts]
    a = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    space = SPACE[a]
    ends = np.flatnonzero(a == 10)
    starts = np.r_[0, ends[:-1] + 1]
    per_line = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    chars = per_line(~space & ((a & 0xC0) != 0x80))
    words = per_line(~space & np.r_[True, space[:-1]])
    symbols, digits, capitals, bars = (per_line(m[a]) for m in (SYMBOL, DIGIT, UPPER, _table(b"|")))
    place = np.where(space, 0, np.arange(len(a)))
    stops = STOP[a[np.maximum.reduceat(place, starts)]]
    owner = np.repeat(np.arange(len(texts)), [r.count(b"\n") + 1 for r in raws])

    seen, repeats = np.zeros(len(owner), bool), np.zeros(len(texts), np.int64)
    at = 0
    for i, r in enumerate(raws):
        met: set[bytes] = set()
        for line in r.split(b"\n"):
            if line in met:
                seen[at] = True
            else:
                met.add(line)
            at += 1
        repeats[i] = repeated_words(r.split())
    some = words > 0
    seen &= some
    total = lambda x: np.bincount(owner, weights=x, minlength=len(texts)).astype(np.int64)
    counts = np.stack([total(words), total(chars), total(symbols), total(seen), repeats], 1)
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    features = np.stack([np.ones(len(n)), np.minimum(symbols / n, 3), symbols / c, digits / c, capitals / c, np.minimum(chars / n / 10, 3), np.log1p(words) / 5, stops, seen, np.minimum(bars, 1)], 1)
    return Lines(counts, owner[some], words[some], features[some])


@dataclass
class LineModel:
    """emit: 2 x FEATURES, move: 2 x 2 (from, to). State 1 is content, 0 is boilerplate."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray) -> list[int]:
        """The most probable states of one text's lines."""
        (s00, s01), (s10, s11) = self.move.tolist()
        back, first = [], True
        a = b = 0.0
        for e0, e1 in (features @ self.emit.T).tolist():
            if first:
                a, b, first = e0, e1, False
                continue
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00) + e0, (b + s11 if from1 else a + s01) + e1
        state = int(b >= a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1] if len(features) else []


def line_odds(features: np.ndarray, state: np.ndarray, rounds: int = 12, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression of each line's state on its features, both states of equal weight in all
    (Newton steps)."""
    share = min(max(state.mean(), 1e-9), 1 - 1e-9)
    even = np.where(state == 1, 0.5 / share, 0.5 / (1 - share)) / len(state)
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (features * (even * p * (1 - p))[:, None]) + decay * np.eye(len(w))
        w -= np.linalg.solve(slope, features.T @ (even * (p - state)) + decay * w)
    return w


def imputed(states: np.ndarray, odds: np.ndarray, words: np.ndarray, good: int) -> np.ndarray:
    """States of the lines of one labelled document, as near to the given ones as its label allows.

    A good document is content throughout. In a bad one content has less than LEAST_CONTENT of the words: lines turn to
    boilerplate, those of the least odds of content first, until that holds.
    """
    if good:
        return np.ones(len(states), np.int64)
    out, held, most = states.copy(), (words * states).sum(), LEAST_CONTENT * words.sum()
    for i in np.argsort(odds, kind="stable"):
        if held < most:
            break
        if out[i]:
            out[i], held = 0, held - words[i]
    return out


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.logaddexp(a[..., 0], b[..., 0]), np.logaddexp(a[..., 1], b[..., 1])], -1)


def _gradient(x: np.ndarray, y: np.ndarray, here: np.ndarray, weight: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of -log p(y | x) by emit and move, summed over padded runs (runs x lines), by forward and backward sums."""
    longest, e = x.shape[1], x @ emit.T
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, longest):
        before = alpha[:, t - 1]
        alpha[:, t] = np.where(here[:, t, None], _both(before[:, :1] + move[0], before[:, 1:] + move[1]) + e[:, t], before)
    for t in range(longest - 2, -1, -1):
        after = e[:, t + 1] + beta[:, t + 1]
        beta[:, t] = np.where(here[:, t + 1, None], _both(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1]), 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    off = (np.exp(alpha + beta - z[:, None, None]) - np.eye(2)[y]) * here[..., None]
    steps = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    steps -= np.eye(2)[y[:, :-1]][..., None] * np.eye(2)[y[:, 1:]][:, :, None, :]
    return np.einsum("ntk,ntf,n->kf", off, x, weight), np.einsum("ntij,nt->ij", steps, here[:, 1:] * weight[:, None])


def fit_chain(runs: list[tuple[np.ndarray, np.ndarray, float]], start: LineModel, rounds: int = 60, decay: float = 1e-4, rate: float = 0.05) -> LineModel:
    """Maximum conditional likelihood of runs (features, states, weight of each run), by Adam steps from start. Runs of
    like length are padded and summed together."""
    width, groups = len(FEATURES), []
    whole = sum(w * len(s) for _, s, w in runs)
    for low, high in ((0, 4), (4, 12), (12, 28), (28, RUN)):
        part = [r for r in runs if low < len(r[1]) <= high]
        if part:
            n, longest = len(part), max(len(s) for _, s, _ in part)
            x, y, here = np.zeros((n, longest, width)), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
            for i, (f, s, _) in enumerate(part):
                x[i, : len(s)], y[i, : len(s)], here[i, : len(s)] = f, s, True
            groups.append((x, y, here, np.array([w for _, _, w in part]) / whole))
    v = np.r_[start.emit.ravel(), start.move.ravel()]
    first, second = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, rounds + 1):
        emit, move = v[: 2 * width].reshape(2, width), v[2 * width :].reshape(2, 2)
        got = [_gradient(*g, emit, move) for g in groups]
        g = np.r_[sum(a for a, _ in got).ravel(), sum(b for _, b in got).ravel()] + decay * v
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        v = v - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineModel(v[: 2 * width].reshape(2, width), v[2 * width :].reshape(2, 2))


def fit_lines(docs: list[tuple[np.ndarray, int]], turns: int = 2) -> LineModel:
    """A chain from documents (features of their lines, label of the document), whose lines' states are not known.

    Labels bound the states (imputed()): the first guess comes from each line alone; then a chain is fitted to the
    states and labels the lines anew, `turns` times. So a bad document's prose lines count as content and changes of
    state are seen, as far as its label leaves room. Documents of both labels weigh the same in all.
    """
    every, of = np.concatenate([f for f, _ in docs]), np.repeat([q for _, q in docs], [len(f) for f, _ in docs])
    w = line_odds(every, of)
    good = of.mean()
    model = LineModel(np.stack([np.zeros(len(w)), w]), np.zeros((2, 2)))
    for _ in range(turns):
        runs, steps = [], np.ones((2, 2))
        for f, q in docs:
            words = np.rint(np.expm1(f[:, FEATURES.index("words")] * 5))
            states = imputed(np.array(model.viterbi(f)), f @ (model.emit[1] - model.emit[0]), words, q)
            np.add.at(steps, (states[:-1], states[1:]), 1)
            runs += [(f[a : a + RUN], states[a : a + RUN], 0.5 / good if q else 0.5 / (1 - good)) for a in range(0, len(f), RUN)]
        if not model.move.any():
            model.move = np.log(steps / steps.sum(1, keepdims=True))
        model = fit_chain(runs, model)
    return model


def chosen_runs(text: str, got: Lines, runs: int) -> list[np.ndarray]:
    """The features of at most `runs` runs of RUN lines of a text: those with the smallest hashes of text and place, in
    the order of the text."""
    starts = range(0, len(got.features), RUN)
    if len(starts) > runs:
        seed = hashlib.blake2b(text.encode(), digest_size=8).digest()
        starts = sorted(sorted(starts, key=lambda a: hashlib.blake2b(a.to_bytes(8, "little"), key=seed, digest_size=8).digest())[:runs])
    return [got.features[a : a + RUN] for a in starts]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, runs: int = RUNS) -> LineModel | None:
    """A model of lines from documents labelled by quality (0 or 1); None if a class has no lines.

    Of each class the `sample` documents with the smallest hashes of their ids are used. Ids with contradicting or null
    labels are left out. Features are made on the executors from whole texts; those of at most `runs` runs of RUN lines
    of a document come to the driver (chosen_runs()), so 2 * sample * runs * RUN * 40 bytes at most: 61 MB.

    Defined cases: null texts have no lines; of rows that share an id the one whose text has the smallest hash counts;
    other columns are ignored, whatever their names; empty tables give None.
    """
    clear = labels.select(named(labels, id_col).alias("id"), F.col("quality").alias("q")).groupBy("id").agg(F.min("q").alias("q"), F.max("q").alias("r"), F.count_if(F.col("q").isNull()).alias("none")).where("id is not null and q = r and none = 0 and q in (0, 1)")
    parts = [clear.where(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "q") for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample rows, hence the broadcast
    found = docs.select(named(docs, id_col).alias("id"), F.coalesce(named(docs, text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    found = found.groupBy("id", "q").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = chosen_runs(text, read_lines([text]), runs)
                if parts:
                    raw = np.concatenate(parts).astype(np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([raw], pa.binary())], ["q", "f"])

    rows = found.select(F.col("q").cast("int"), "text").mapInArrow(features, "q int, f binary").collect()
    known = [(np.frombuffer(raw, np.float32).reshape(-1, len(FEATURES)).astype(float), q) for q, raw in sorted((r.q, bytes(r.f)) for r in rows)]
    return fit_lines(known) if {q for _, q in known} == {0, 1} else None


def judge_texts(texts: list[str], model: LineModel | None) -> list[np.ndarray]:
    """The columns of SCHEMA for some texts."""
    got = read_lines(texts)
    n_words, repeats = got.counts[:, 0], got.counts[:, 4]
    failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
    share = np.where(n_words > 0, 1.0, 0.0)
    if model:
        bounds = np.searchsorted(got.owner, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                share[i] = got.words[a:b][np.array(model.viterbi(got.features[a:b])) == 1].sum() / n_words[i]
    return [*got.counts.T, failed, share, ~failed & (share >= LEAST_CONTENT)]


def keep(docs: DataFrame, model: LineModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all columns as they are."""
    name = free_prefix(docs) + "quality"
    return judge(docs, model, text_col, name).where(F.col(name)["kept"]).select(*columns_of(docs))


def judge(docs: DataFrame, model: LineModel | None, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """docs with the struct column out_col (SCHEMA): five counts, base_failed, content_share and kept.

    Words stand between ASCII white space, lines between \\n. kept is false if the base rules fail (too few words, too
    many words in repeated windows) or if less than half of the words stand in lines that the model's best state
    sequence marks as content.

    Defined cases: null and empty texts have no words and fail. Very long texts are judged whole, one at a time. Without
    a model every line is content. Other columns pass through, whatever their names; a column already called out_col
    (in any case) is replaced. Repeated rows are judged alike. An empty table gives an empty result.
    """
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and held < CHARS:
                    held += len(texts[to])
                    to += 1
                columns = [pa.array(c, k) for c, k in zip(judge_texts(texts[at:to], model), kinds, strict=True)]
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.StructArray.from_arrays(columns, SCHEMA.names)], ["row", "value", "quality"])
                at = to

    rows = carried(docs, text_col, out_col)
    return restored(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("quality", SCHEMA)])), docs, text_col, quality=out_col)

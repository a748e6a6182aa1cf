"""LM scoring by masked pseudo-likelihood: a window network over BPE ids predicts every token from both of its sides."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetspark.llm import bpe
from hetspark.llm.common import columns_of, settled

#: Tokens on each side of the one that is predicted.
SIDE = 2
#: The softmax is factored: CLASSES classes of CLASSES places, ids by falling frequency. The last place of the last
#: class is shared by all further ids, which are told apart by their frequencies. One more number is a text's edge.
CLASSES = 64
OWN = CLASSES * CLASSES - 1
EDGE = OWN + 1
WIDTH = 16
#: The last round trains on every token of every text. The rounds before it only find where to begin: they take every
#: STRIDE-th piece (more of them where that makes fewer than WINDOWS tokens), in small corpora all. Rates are by round. A
#: replica of the network gets about WINDOWS tokens, and in the last round WHOLE times as many.
STRIDE, WINDOWS, WHOLE, RATES = 64, 500_000, 8, (0.3, 0.15, 0.1)
#: Tokens of a text that stay together when they are dealt to replicas.
PIECE = 256
#: Weights that are averaged together: what a task adds up at a time.
TOGETHER = 1 << 13
#: Tokens to a step, and in the last round; where a replica would take fewer than STEPS steps, fewer.
BATCH, LARGE, STEPS = 2048, 1 << 14, 150
#: Tokens scored at a time, and rows that stand in a matrix at a time: as many as OpenBLAS multiplies without copying them
#: first (960 by 16 by 64 is below a million). Both bear on time and memory only.
BLOCK, ROWS = 1 << 15, 960
AROUND = (*range(-SIDE, 0), *range(1, SIDE + 1))
#: Where the rows of a matrix of CLASSES columns begin.
BEGINS = np.arange(2 * ROWS) * CLASSES


@dataclass
class Network:
    """Embeddings by place in the window, one hidden layer, a softmax over classes and one inside each class."""

    embed: np.ndarray  # 2 * SIDE x (EDGE + 1) x WIDTH
    bias: np.ndarray  # WIDTH
    to_class: np.ndarray  # WIDTH x CLASSES
    class_bias: np.ndarray  # CLASSES
    to_place: np.ndarray  # CLASSES x WIDTH x CLASSES
    place_bias: np.ndarray  # CLASSES x CLASSES

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        """Of the places at each position of the window, one array a position."""
        h, more = (np.empty((len(around[0]), WIDTH), np.float32) for _ in range(2))
        _rows(self.embed[0], around[0], h)
        for p in range(1, 2 * SIDE):
            h += _rows(self.embed[p], around[p], more)
        h += self.bias
        return np.tanh(h, out=h)

    def small(self) -> bool:
        """Whether exp() of all that the softmaxes can meet is known to be finite, and stays so over exp() of a bias: hidden
        values lie between -1 and 1."""
        return max(np.abs(w).sum(-2).max() + 2 * np.abs(b).max() for w, b in ((self.to_class, self.class_bias), (self.to_place, self.place_bias))) < 80

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | around) of each row: log p(class) + log p(place | class)."""
        order, ends = _by_class(target)
        h, small = self.hidden([around[:, p].take(order) for p in range(2 * SIDE)]), self.small()
        of, place = _split(target.take(order))
        got = np.empty(len(target), np.float32)
        for r in _parts(0, len(target)):
            got[r] = _log_softmax(h[r], self.to_class, self.class_bias, of[r], small)
        for c, r, rows, inside in _groups(ends):
            at = r if rows is None else rows
            each = _log_softmax(h[r] if rows is None else h.take(rows, 0, mode="clip"), self.to_place[c], self.place_bias[c], place[at], small)
            got[r] += each if rows is None else each[inside]
        out = np.empty(len(target), np.float32)
        out[order] = got
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])


def _rows(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """table[at], written to out. All of at lie in the table: that they would be clipped only saves a second copy."""
    return table.take(at, 0, out=out, mode="clip")


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the rows by class, where each class starts in it)."""
    of = (target // CLASSES).astype(np.uint8)
    return np.argsort(of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=CLASSES))]


def _split(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place inside it) of each, as numbers that index."""
    of = (target // CLASSES).astype(np.intp)
    return of, target - of * CLASSES


def _parts(begin: int, end: int) -> Iterator[slice]:
    """The rows from begin to end, ROWS at a time."""
    return (slice(a, min(a + ROWS, end)) for a in range(begin, end, ROWS))


def _groups(ends: np.ndarray) -> Iterator[tuple[int | slice, slice, np.ndarray | None, np.ndarray | None]]:
    """The rows of each class, which starts at its end: (class, at most ROWS of its rows, None, None), or where classes
    have few rows (classes, their rows, the same one line a class, which of a line are the class's own)."""
    sizes, c = np.diff(ends).tolist(), 0
    while c < len(sizes):
        most = total = sizes[c]
        last = c + 1
        while most <= ROWS // 4 and last < len(sizes) and sizes[last] <= ROWS // 4:
            longest = max(most, sizes[last])
            if (wide := longest * (last + 1 - c)) > 2 * ROWS or wide > 1.25 * (total + sizes[last]) + 64:
                break
            most, total, last = longest, total + sizes[last], last + 1
        if last > c + 1 and most:
            columns = np.arange(most)
            inside = columns < np.array(sizes[c:last])[:, None]
            yield slice(c, last), slice(ends[c], ends[last]), np.minimum(ends[c:last, None] + columns, ends[-1] - 1), inside
        else:
            for r in _parts(ends[c], ends[c + 1]):
                yield c, r, None, None
        c = last


def _exp(z: np.ndarray, bias: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray | np.float32]:
    """Makes z such that z * lift is exp(z + bias), or where that is not known to be small exp(z + bias less the row's
    largest); returns lift, and what was taken off each row. So a bias costs no pass over the matrix."""
    top, lift = np.float32(0), np.exp(bias)
    if not small:
        z += bias[..., None, :]
        top, lift = z.max(-1), np.ones_like(bias)
        z -= top[..., None]
    np.exp(z, out=z)
    return lift, top


def _of_each(table: np.ndarray, which: np.ndarray) -> np.ndarray:
    """table[which], or of several tables and lines each line's from its own."""
    return table.take(which) if which.ndim == 1 else np.take_along_axis(table, which, 1)


def _log_softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, which: np.ndarray, small: bool) -> np.ndarray:
    """log softmax(h @ weights + bias)[which] of each row; or of lines of rows, each line with weights of its own."""
    z = h @ weights
    got = z.ravel().take(BEGINS[: which.size].reshape(which.shape) + which)
    got += _of_each(bias, which)
    lift, top = _exp(z, bias, small)
    got -= np.log((z @ lift[..., None])[..., 0]) + top
    return got


def _gradients(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, which: np.ndarray, scale: np.ndarray | np.float32, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradients by h, weights and bias of the sum of -log softmax(h @ weights + bias)[which] times scale over the
    rows; or over the rows of each line, each line with weights of its own."""
    z = h @ weights
    lift, _ = _exp(z, bias, small)
    total = (z @ lift[..., None])[..., 0]
    flat, at = z.reshape(-1), BEGINS[: which.size].reshape(which.shape) + which
    flat[at] -= total / _of_each(lift, which)
    total = scale / total  # z times this and lift is the gradient by the logits; the narrower factors are multiplied instead
    back = z @ (weights * lift[..., None, :]).swapaxes(-1, -2)
    back *= total[..., None]
    by_weights = (z.swapaxes(-1, -2) @ (h * total[..., None])).swapaxes(-1, -2)
    return back, by_weights * lift[..., None, :], (total[..., None, :] @ z)[..., 0, :] * lift


def network(weights: np.ndarray) -> Network:
    """The network whose weights() these are."""
    shapes = [(2 * SIDE, EDGE + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, CLASSES), (CLASSES, CLASSES)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return Network(*(x.reshape(s).copy() for x, s in zip(np.split(weights.astype(np.float32), cuts), shapes, strict=True)))


def untrained(counts: np.ndarray, seed: int = 1) -> Network:
    """Small random weights, and biases that give each place its frequency (counts: by place, CLASSES squared)."""
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.05, s).astype(np.float32)
    logs = np.log(counts + 1.0).reshape(CLASSES, CLASSES)
    by_class = np.log((counts + 1.0).reshape(CLASSES, CLASSES).sum(1))
    return Network(small(2 * SIDE, EDGE + 1, WIDTH), np.zeros(WIDTH, np.float32), small(WIDTH, CLASSES), (by_class - by_class.max()).astype(np.float32), small(CLASSES, WIDTH, CLASSES), (logs - logs.max(1, keepdims=True)).astype(np.float32))


class Trainer:
    """Adagrad steps on the mean of -log p(target | around); embeddings are touched where a batch has their token."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.seen = net, rate, {f.name: np.full_like(getattr(net, f.name), 0.1) for f in fields(net)}

    def _move(self, name: str, at: object, grad: np.ndarray) -> None:
        seen, weights = self.seen[name], getattr(self.net, name)
        if isinstance(at, tuple):  # rows of one of several tables
            table, at = at
            seen, weights = seen[table], weights[table]
            now, moved = (_rows(x, at, np.empty_like(grad)) for x in (seen, weights))
        else:
            now, moved = seen[at], weights[at]
        now += grad * grad
        by = np.sqrt(now)
        np.divide(grad, by, out=by)
        by *= self.rate
        moved -= by
        if now.base is None:
            seen[at], weights[at] = now, moved

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        """On windows that don't stand in a line: each one is a line of its own."""
        line = np.column_stack([around[:, :SIDE], target, around[:, SIDE:]]).astype(np.uint16)
        self.step_line(line.ravel(), np.arange(len(target)) * line.shape[1] + SIDE)

    def step_line(self, line: np.ndarray, at: np.ndarray) -> None:
        """On the tokens at these points of a line of places, each with its neighbours in the line."""
        net, scale, small = self.net, np.float32(BATCH / len(at)), self.net.small()  # the sum over BATCH tokens
        line = line.astype(np.intp)
        target = line.take(at)
        order, ends = _by_class(target)
        at, target = at.take(order), target.take(order)
        of, place = _split(target)
        h = net.hidden([line.take(at + d) for d in AROUND])
        sent = np.zeros((len(h) + 1, WIDTH), np.float32)  # the last row is that of points which are no targets
        back, by_class, by_bias = sent[:-1], 0, 0
        for r in _parts(0, len(h)):
            back[r], w, b = _gradients(h[r], net.to_class, net.class_bias, of[r], scale, small)
            by_class, by_bias = by_class + w, by_bias + b
        moves = [("to_class", ..., by_class), ("class_bias", ..., by_bias)]
        by_place, by_bias = np.zeros_like(net.to_place), np.zeros_like(net.place_bias)
        for c, r, rows, inside in _groups(ends):
            if rows is None:
                x, w, b = _gradients(h[r], net.to_place[c], net.place_bias[c], place[r], scale, small)
                back[r] += x
            else:
                x, w, b = _gradients(h.take(rows, 0, mode="clip"), net.to_place[c], net.place_bias[c], place.take(rows), scale * inside, small)
                back[r] += x[inside]
            by_place[c] += w
            by_bias[c] += b
        for c in np.flatnonzero(np.diff(ends)):
            moves += [("to_place", c, by_place[c]), ("place_bias", c, by_bias[c])]
        h *= h
        np.subtract(np.float32(1), h, out=h)
        back *= h
        moves.append(("bias", ..., back.sum(0)))
        # A token is a neighbour of the targets before and after it: what these send back, sorted by tokens once for all
        # positions, is added up.
        sender = np.full(len(line) + 2 * SIDE, len(h))
        sender[at + SIDE] = np.arange(len(h))
        order = np.argsort(line.astype(np.uint16), kind="stable")
        tokens = line.take(order)
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        tokens = tokens.take(starts)
        sent, taken = sent.view(np.complex64), np.empty((len(line), WIDTH // 2), np.complex64)  # half as many additions
        for p, d in enumerate(AROUND):
            sums = np.add.reduceat(_rows(sent, sender.take(order + (SIDE - d)), taken), starts, axis=0)
            moves.append(("embed", (p, tokens), sums.view(np.float32)))
        for m in moves:
            self._move(*m)


def windows(places: list[np.ndarray], every: int = 1, first: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(around, target) of every token of some texts, or of each `every`-th one of each text, from its `first` on: rows
    of 2 * SIDE places, places."""
    edge, sizes = np.full(SIDE, EDGE, np.uint16), np.array([len(x) for x in places], np.int64)
    line = np.concatenate([edge, *(part for x in places for part in (x, edge))])
    begin, first = np.cumsum(sizes) - sizes + SIDE * (1 + np.arange(len(sizes))), np.array(first or [0] * len(sizes), np.int64)
    taken = np.maximum(0, -(-(sizes - first) // every))
    at = (np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)) * every + np.repeat(begin + first, taken)
    return np.stack([line[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1), line[at]


@dataclass
class Model:
    """The network; place of every id of the vocabulary; log p(id | it has no place of its own)."""

    network: Network
    place: np.ndarray
    tail: np.ndarray

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum over all tokens of each text of log p(token | SIDE tokens on either side)."""
        around, target = windows([self.place.take(x) for x in texts])
        each = np.concatenate([np.zeros(0), *(self.network.log_probabilities(around[a : a + BLOCK], target[a : a + BLOCK]) for a in range(0, len(target), BLOCK))])
        if len(texts):
            each = each + self.tail.take(np.concatenate(texts))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        return np.bincount(owner, weights=each, minlength=len(texts))


def _texts(batch: pa.RecordBatch, column: str = "tokens") -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, ids of each text) of some rows of a batch at a time, about BLOCK tokens or one text."""
    raw = batch.column(batch.schema.names.index(column)).to_pylist()
    at, held = 0, 0
    for i, x in enumerate(raw):
        held += len(x)
        if held >= 2 * BLOCK or i == len(raw) - 1:
            yield at, i + 1, [np.frombuffer(r, "<u2") for r in raw[at : i + 1]]
            at, held = i + 1, 0


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id of the vocabulary stands in all texts. A task sends the ids it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch):
                total += np.bincount(np.concatenate(texts), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["id", "n"])

    out = np.zeros(size, np.int64)
    rows = tokens.select("tokens").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of every id, log p(id | no place of its own) or 0, count of every place)."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    place = np.empty(len(counts), np.uint16)
    place[order] = np.minimum(np.arange(len(counts)), OWN)
    rest = np.where(place == OWN, counts + 1.0, 0.0)
    tail = np.where(place == OWN, np.log(np.maximum(rest, 1) / max(rest.sum(), 1)), 0.0)
    return place, tail, np.bincount(place, weights=counts, minlength=OWN + 1)


def pieces(tokens: DataFrame, place: np.ndarray, stride: int = 1) -> DataFrame:
    """(line binary): the places of every PIECE tokens of each text, with the SIDE tokens or edges before and after them,
    as numbers of width 2. With a stride only those whose checksum it divides."""
    shared, edge = tokens.sparkSession.sparkContext.broadcast(place), np.full(SIDE, EDGE, "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.astype("<u2")
        for batch in batches:
            for _, _, texts in _texts(batch):
                lines = []
                for x in texts:
                    raw = np.concatenate([edge, place.take(x), edge]).tobytes()
                    lines += [raw[2 * a : 2 * (a + PIECE + 2 * SIDE)] for a in range(0, len(x), PIECE)]
                if stride > 1:
                    lines = [x for x in lines if zlib.crc32(x) % stride == 0]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    return tokens.select("tokens").mapInArrow(run, "line binary")


def dealt(pieces: DataFrame, replicas: int) -> DataFrame:
    """(replica, times, line): the pieces, one partition a replica, in an order of their own that mixes texts of all
    places. A piece's hash says where it goes; its copies, whose number alone counts, go to one replica after the other,
    so that many of them burden none, and beyond one for each replica they are sent once with their number."""
    counted = pieces.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("hash", F.xxhash64("line"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(replicas)).cast("int") - 1)))
    times = F.expr(f"cast(n div {replicas} as int)") + F.when(F.col("copy") < F.col("n") % replicas, 1).otherwise(0)
    replica = F.pmod(F.pmod("hash", F.lit(replicas)) + F.col("copy"), F.lit(replicas)).cast("int")
    rows = each.select(replica.alias("replica"), times.alias("times"), "line", F.xxhash64("hash", "copy").alias("order"))
    return rows.repartitionById(replicas, "replica").sortWithinPartitions("order", "line").select("replica", "times", "line")


def trained(given: DataFrame, net: Network, rate: float, batch: int = BATCH) -> Network:
    """The mean of replicas that start from net and take a step for each `batch` tokens of what dealt() gives them,
    weighted by the number of these. A replica streams its pieces, so that their number doesn't bear on its memory.
    Weights travel in blocks of TOGETHER, and the blocks of one place are added up in the order of replicas."""
    shared = given.sparkSession.sparkContext.broadcast(net.weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n, replica = Trainer(network(shared.value), rate), 0, 0
        held, waiting = [], 0

        def steps(last: bool = False) -> None:
            nonlocal held, n, waiting
            sizes = np.array([len(x) // 2 - 2 * SIDE for x in held], np.int64)
            line = np.frombuffer(b"".join(held), "<u2").astype(np.uint16)
            at = np.arange(waiting) + np.repeat(2 * SIDE * np.arange(len(held)) + SIDE, sizes)
            for a in range(0, waiting if last else waiting // batch * batch, batch):
                part = at[a : a + batch]
                low = part[0] - SIDE
                trainer.step_line(line[low : part[-1] + SIDE + 1], part - low)
                n += len(part)
            # What waits for the next step begins anew as a piece, with its neighbours before it.
            left = at[waiting // batch * batch :]
            if len(left) and not last:
                k = np.searchsorted(np.cumsum(sizes), waiting - len(left), "right")
                end = int(np.cumsum(sizes + 2 * SIDE)[k])
                held = [line[left[0] - SIDE : end].tobytes(), *held[k + 1 :]]
            else:
                held = []
            waiting = len(left) if not last else 0

        for b in batches:
            if len(b):
                replica = b.column(0)[0].as_py()
            for times, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for _ in range(times):
                    held.append(raw)
                    waiting += len(raw) // 2 - 2 * SIDE
                    if waiting >= batch:
                        steps()
        if held:
            steps(last=True)
        if n:
            w = trainer.net.weights()
            blocks = [w[a : a + TOGETHER].tobytes() for a in range(0, len(w), TOGETHER)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([replica] * len(blocks), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], ["block", "replica", "n", "weights"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, weighed = None, 0, 0.0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(weighed / total).astype(np.float32).tobytes()], pa.binary())], ["block", "weights"])
        for b in batches:
            for at, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != block:
                    if total:
                        yield done()
                    block, total, weighed = at, 0, 0.0
                total, weighed = total + n, weighed + n * np.frombuffer(raw, np.float32).astype(float)
        if total:
            yield done()

    each = given.mapInArrow(run, "block int, replica int, n bigint, weights binary")
    by_block = each.repartition("block").sortWithinPartitions("block", "replica").select("block", "n", "weights")
    rows = by_block.mapInArrow(mean, "block int, weights binary").collect()  # the weights of one network
    if not rows:
        return net
    return network(np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(rows, key=lambda r: r.block)]))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> tuple[DataFrame, int]:
    """((row, tokens), ids of the vocabulary): the columns of docs but the text as one struct, so that none of their
    names can clash, and BPE ids as numbers of width 2. Encoded once and kept in the checkpoint folder."""
    rows = docs.select(F.struct(F.lit(0).alias("none"), *columns_of(docs, text_col)).alias("row"), F.col(text_col).alias("text"))
    return settled(bpe.packed_ids(rows, ranks_path, pattern, keep=True)), bpe.vocabulary_size(ranks_path)


def fit(tokens: DataFrame, size: int, stride: int = STRIDE, rates: tuple[float, ...] = RATES) -> Model:
    """A model of tokens(tokens binary, as encoded() gives them), whatever their number.

    Counts of ids come from all texts, and every token of every text is trained on. The network is trained by replicas:
    in each round all of them start from the shared weights, take Adagrad steps on the pieces of text that are dealt to
    them, and are averaged. The first rounds, on some pieces (in small corpora on all), make a network to start from;
    the last one goes over all pieces of all texts, by as many replicas as there are WHOLE * WINDOWS tokens. Only the
    mean, some hundred thousand numbers, comes to the driver. What is trained on what, and in which order, follows from
    the texts alone: neither the table's partitions nor the cluster's cores bear on the model.
    """
    counts = id_counts(tokens, size)
    place, tail, by_place = places(counts)
    total = int(counts.sum())
    stride = max(1, min(stride, total // WINDOWS))
    net = untrained(by_place)
    some, n = total // stride, max(1, round(total / stride / WINDOWS))
    first = settled(dealt(pieces(tokens, place, stride), n))
    for rate in rates[:-1]:
        net = trained(first, net, rate, max(64, min(BATCH, some // (n * STEPS))))
    n = max(1, round(total / (WHOLE * WINDOWS)))
    net = trained(dealt(pieces(tokens, place), n), net, rates[-1], max(64, min(LARGE, total // (n * STEPS))))
    return Model(net, place, tail)


def score(tokens: DataFrame, model: Model, out_cols: tuple[str, str, str] = ("n_tokens", "log_prob", "mean_log_prob")) -> DataFrame:
    """The rows that encoded() kept, with the number of tokens, the sum over all tokens of log p(token | SIDE tokens on
    either side), and the mean of these.

    Defined cases: null and empty texts have no tokens, sum 0 and a null mean. Very long texts are scored whole, BLOCK
    tokens at a time. Columns that are already called like the results are replaced, whatever their case; all others
    stay. Repeated rows score alike. An empty table gives an empty result.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, texts in _texts(batch):
                n = np.array([len(x) for x in texts], np.int64)
                sums = model.score(texts)
                means = pa.array(sums / np.maximum(n, 1), pa.float64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums, pa.float64()), means], ["row", "n", "sum", "mean"])

    row = tokens.schema["row"].dataType
    schema = tokens.select("row").schema.add("n", "long").add("sum", "double").add("mean", "double")
    taken = {c.lower() for c in out_cols}
    rest = [F.col("row")[f.name].alias(f.name) for f in row.fields[1:] if f.name.lower() not in taken]
    return tokens.select("row", "tokens").mapInArrow(run, schema).select(*rest, *(F.col(a).alias(b) for a, b in zip(("n", "sum", "mean"), out_cols, strict=True)))

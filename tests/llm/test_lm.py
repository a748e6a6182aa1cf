import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from hetspark.llm import bpe, lm, queries

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def ids_of(texts):
    encoder = bpe.Encoder(bpe.loaded(open(RANKS, "rb").read()), P.PATTERN)
    ids, n = encoder.encode(texts)
    return np.split(ids, np.cumsum(n)[:-1])


def encoded(df):
    return lm.encoded(df, RANKS, P.PATTERN)


def noisy(seed):
    rng = np.random.default_rng(seed)
    net = lm.untrained(rng.integers(0, 50, lm.OWN + 1))
    return lm.network(net.weights() + rng.normal(0, 0.3, len(net.weights())))


def slow_log_p(net, around, target):
    h = np.tanh(sum(net.embed[p][around[p]].astype(float) for p in range(2 * lm.SIDE)) + net.bias)
    soft = lambda z: z - np.log(np.exp(z).sum())
    c, place = divmod(int(target), lm.CLASSES)
    return soft(h @ net.to_class + net.class_bias)[c] + soft(h @ net.to_place[c] + net.place_bias[c])[place]


def slow_windows(texts):
    for x in texts:
        line = [lm.EDGE] * lm.SIDE + list(x) + [lm.EDGE] * lm.SIDE
        for i in range(len(x)):
            yield line[i : i + lm.SIDE] + line[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1], x[i]


def test_windows():
    texts = [np.array(x, np.uint16) for x in ([5, 6, 7, 8], [], [9], [1, 2])]
    around, target = lm.windows(texts)
    assert [(a, t) for a, t in zip(around.tolist(), target.tolist())] == [(list(map(int, a)), int(t)) for a, t in slow_windows(texts)]
    assert lm.windows(texts, 3, [1, 0, 0, 2])[1].tolist() == [6, 9] and lm.windows(texts, 2, [0, 1, 0, 1])[1].tolist() == [5, 7, 9, 2]
    assert lm.windows([], 4)[1].tolist() == []


def test_log_probabilities_are_those_of_one_softmax_over_all_places():
    net, rng = noisy(0), np.random.default_rng(1)
    around, target = rng.integers(0, lm.EDGE + 1, (300, 2 * lm.SIDE)), rng.integers(0, lm.OWN + 1, 300)
    got = net.log_probabilities(around, target)
    assert np.allclose(got, [slow_log_p(net, a, t) for a, t in zip(around, target)], atol=1e-4)
    everything = np.arange(lm.OWN + 1)
    assert abs(np.exp(net.log_probabilities(np.repeat(around[:1], len(everything), 0), everything).astype(float)).sum() - 1) < 1e-4


def test_steps_follow_the_gradient():
    net, rng = noisy(2), np.random.default_rng(3)
    around, target = rng.integers(0, 40, (lm.BATCH, 2 * lm.SIDE)), rng.integers(0, 200, lm.BATCH)
    before = net.weights().astype(float)
    trainer = lm.Trainer(lm.network(before), 0.1)
    trainer._move = lambda name, at, grad: got.__setitem__((name, str(at)), grad)
    got = {}
    trainer.step(around, target)

    def loss(n):
        return -sum(slow_log_p(n, a, t) for a, t in zip(around, target))

    for name, at, where in (("bias", "Ellipsis", (3,)), ("class_bias", "Ellipsis", (1,)), ("to_class", "Ellipsis", (2, 1)), ("to_place", "1", (4, 7)), ("place_bias", "2", (9,))):
        pair = []
        for d in (-1e-2, 1e-2):
            other = lm.network(before)
            array = getattr(other, name)
            array[(int(at), *where) if at != "Ellipsis" else where] += d
            pair.append(loss(other))
        assert abs((pair[1] - pair[0]) / 2e-2 - got[name, at][where]) < 0.02 * max(1, abs(got[name, at][where]))


def test_neighbours_on_both_sides_are_used():
    """The middle of x ? y follows from both sides together: a network that sees one side can't reach this loss."""
    rows = [((1, 50 + a, 60 + b, 1), 70 + (a ^ b)) for a in (0, 1) for b in (0, 1)] * 512
    around, target = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    trainer = lm.Trainer(lm.untrained(np.bincount(target, minlength=lm.OWN + 1)), 0.3)
    for _ in range(150):
        trainer.step(around, target)
    assert trainer.net.log_probabilities(around[:4], target[:4]).min() > -0.1


def test_places_and_frequencies():
    counts = np.zeros(lm.OWN + 500, np.int64)
    counts[[7, 3, 900]] = 5, 9, 5
    place, tail, by_place = lm.places(counts)
    assert place[[3, 7, 900]].tolist() == [0, 1, 2] and by_place[:3].tolist() == [9, 5, 5]
    rest = place == lm.OWN
    assert rest.sum() == 500 and abs(np.exp(tail[rest]).sum() - 1) < 1e-9 and not tail[~rest].any()


@pytest.mark.parametrize("per_replica", [lm.WINDOWS, 8000])
def test_held_out_loss(spark, monkeypatch, per_replica):
    """One replica or several: well below what the frequencies of tokens alone reach on other documents."""
    monkeypatch.setattr(lm, "WINDOWS", per_replica)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tokens, size = encoded(docs.where("doc_id % 4 > 0").repartition(3))
    counts = lm.id_counts(tokens, size)
    brute = Counter(i for x in ids_of([r.text or "" for r in docs.where("doc_id % 4 > 0").collect()]) for i in x.tolist())
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == brute
    model = lm.fit(tokens, size)
    held = ids_of([r.text or "" for r in docs.where("doc_id % 4 = 0").collect()])
    n = sum(map(len, held))
    unigram = -np.log((counts + 1.0) / (counts + 1.0).sum())[np.concatenate(held)].mean()
    assert -model.score(held).sum() / n < unigram - 0.8


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("n_chars < 3000")
    tokens, size = encoded(docs)
    model = lm.Model(noisy(5), np.minimum(np.arange(size), lm.OWN).astype(np.uint16), -np.arange(size) / 1e5 * (np.arange(size) >= lm.OWN))
    got = {r.doc_id: r for r in lm.score(tokens, model).collect()}
    for r in docs.where("doc_id < 8").collect():
        x = ids_of([r.text or ""])[0]
        want = sum(slow_log_p(model.network, a, t) for a, t in slow_windows([model.place[x]])) + model.tail[x].sum()
        assert got[r.doc_id].n_tokens == len(x) and abs(got[r.doc_id].log_prob - want) < 1e-3 * max(1, abs(want))


def test_order_and_unusual_words_show(make):
    r = random.Random(4)
    nouns, verbs = ["cat", "dog", "fox", "hen", "owl"], ["sees", "hears", "likes", "follows"]
    text = lambda: " ".join(f"the {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)}." for _ in range(20))
    model = lm.fit(*encoded(make([(i, text(), "s") for i in range(200)])))
    held = [text() for _ in range(20)]
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in held]
    other = [t.replace("cat", "car").replace("fox", "fig") for t in held]  # of the same length and shape
    good, bad, odd = (model.score(ids_of(x)) / [len(i) for i in ids_of(x)] for x in (held, mixed, other))
    assert good.min() > bad.max() and good.min() > odd.max()


def test_odd_rows(make):
    rows = [(1, None, "s"), (2, "", None), (None, " \n", "s"), (4, "w", "s"), (5, "the x# " * 40_000, "s"), (4, "w", "s")]
    df = make(rows).withColumnRenamed("digest", "row").withColumnRenamed("salt", "tokens").withColumnRenamed("n", "LOG_prob")
    tokens, size = encoded(df)
    out = lm.score(tokens, lm.fit(tokens, size))
    assert out.columns == [c for c in df.columns if c not in ("text", "LOG_prob")] + ["n_tokens", "log_prob", "mean_log_prob"]
    got = {x.doc_id: x for x in out.collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].mean_log_prob is None and got[1].row == "x" and got[1].tokens == 1
    assert got[5].n_tokens > 80_000 and got[4].mean_log_prob < 0 and out.count() == 6
    empty, size = encoded(make([]))
    assert lm.score(empty, lm.fit(empty, size)).count() == 0


def test_the_query(spark):
    got = queries.op3_lm_score(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and all(r.n_tokens == len(x) for r, x in zip(rows, ids_of([docs[r.doc_id] or "" for r in rows])))


@pytest.mark.parametrize("per_replica", [lm.WINDOWS, 8000])
def test_partitions_and_cores_do_not_bear_on_the_model(spark, monkeypatch, per_replica):
    monkeypatch.setattr(lm, "WINDOWS", per_replica)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0")
    held = ids_of([r.text or "" for r in docs.limit(40).collect()])
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, shuffle in ((2, "4"), (7, "4"), (64, "11")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            tokens, size = encoded(docs.repartition(parts))
            scores.append(lm.fit(tokens, size).score(held))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(scores[0], scores[1], rtol=1e-6) and np.allclose(scores[0], scores[2], rtol=1e-6)


def trained_on(rows):
    """Replica, and window, of everything that the pieces dealt to replicas make them train on."""
    for r in rows:
        line = np.frombuffer(r.line, "<u2").tolist()
        for i in range(lm.SIDE, len(line) - lm.SIDE):
            for _ in range(r.times):
                yield r.replica, (*line[i - lm.SIDE : i], *line[i + 1 : i + 1 + lm.SIDE], line[i])


def test_every_token_of_every_text_is_trained_on(make, monkeypatch):
    monkeypatch.setattr(lm, "WINDOWS", 300)
    r, rounds, plain = random.Random(6), [], lm.trained
    texts = [" ".join(r.choice(["the", "cat", "sees", "a", "dog."]) for _ in range(r.randrange(600))) for _ in range(30)]
    texts += ["the same text. " * 9] * 40 + [None, "", "one", "word " * 3000]
    monkeypatch.setattr(lm, "trained", lambda given, *a: rounds.append(given.collect()) or plain(given, *a))
    tokens, size = encoded(make([(i, t, "s") for i, t in enumerate(texts)]).repartition(3))
    model = lm.fit(tokens, size)
    want = Counter((*map(int, a), int(t)) for a, t in slow_windows([model.place[x] for x in ids_of([t or "" for t in texts])]))
    got = [*trained_on(rounds[-1])]
    assert Counter(w for _, w in got) == want and len(rounds) == len(lm.RATES)
    by_replica = Counter(n for n, _ in got)
    assert len(by_replica) > 3 and max(by_replica.values()) < 3 * sum(want.values()) / len(by_replica)


def test_many_copies_burden_no_replica(make):
    tokens, size = encoded(make([(i, "a text that stands in the corpus often.", "s") for i in range(103)] + [(200, "another one", "s")]))
    rows = lm.dealt(lm.pieces(tokens, np.minimum(np.arange(size), lm.OWN).astype(np.uint16)), 4).collect()
    often = Counter()
    for x in rows:
        often[x.line, x.replica] += x.times
    assert sorted(often.values()) == [1, 25, 26, 26, 26] and len(rows) == 5


@pytest.mark.parametrize("batch", [7, 300])
def test_steps_are_of_one_size_wherever_pieces_end(spark, batch):
    """What a replica trains on, step by step, are its pieces' windows in their order."""
    rng = np.random.default_rng(8)
    lines = [rng.integers(0, 90, n + 2 * lm.SIDE).astype("<u2").tobytes() for n in (1, 5, 256, 40, 7, 3, 256)]
    df = spark.createDataFrame([(0, t, bytearray(x)) for t, x in zip((1, 1, 2, 1, 3, 1, 1), lines)], "replica int, times int, line binary").coalesce(1)
    net, rate = noisy(9), 0.05
    got = lm.trained(df, net, rate, batch)
    rows = [w for _, w in trained_on([type("Row", (), {"replica": 0, "times": 1, "line": x}) for t, x in zip((1, 1, 2, 1, 3, 1, 1), lines) for _ in range(t)])]
    trainer = lm.Trainer(lm.network(net.weights()), rate)
    for a in range(0, len(rows), batch):
        part = np.array(rows[a : a + batch])
        trainer.step(part[:, :-1], part[:, -1])
    assert np.allclose(got.weights(), trainer.net.weights(), atol=1e-4)


@pytest.mark.parametrize("scale", [1, 40])
def test_no_class_fills_a_matrix_of_its_own_size(monkeypatch, scale):
    """However many tokens one class has, matrices have a bounded number of rows; few tokens of many classes share one.
    Weights of any size give the same as one by one."""
    net, rng, sizes = noisy(10), np.random.default_rng(11), []
    net = lm.network(net.weights() * scale)
    assert net.small() == (scale == 1)
    target = np.r_[rng.integers(0, lm.CLASSES, 5 * lm.ROWS), rng.integers(0, lm.OWN + 1, lm.CLASSES * 20), [lm.OWN]]
    around = rng.integers(0, lm.EDGE + 1, (len(target), 2 * lm.SIDE))
    for name in ("_log_softmax", "_gradients"):
        monkeypatch.setattr(lm, name, lambda h, *a, plain=getattr(lm, name): sizes.append(h[..., 0].size) or plain(h, *a))
    got = net.log_probabilities(around, target)
    some = [*range(0, len(target), 97), len(target) - 1]
    assert np.allclose(got[some], [slow_log_p(net, around[i], target[i]) for i in some], atol=1e-3, rtol=1e-4)
    lm.Trainer(net, 0.1).step(around, target)
    assert max(sizes) <= 2 * lm.ROWS and len(sizes) < 2 * lm.CLASSES


def test_rows_of_all_classes_are_taken_once():
    rng = np.random.default_rng(12)
    for top in (0, 1, 3, 400, 5000):
        sizes = rng.integers(0, top + 1, lm.CLASSES) * (rng.random(lm.CLASSES) < 0.7)
        ends, seen = np.r_[0, np.cumsum(sizes)], []
        for c, r, rows, inside in lm._groups(ends):
            at = np.arange(r.start, r.stop) if rows is None else rows[inside]
            of = np.full(len(at), c) if rows is None else np.broadcast_to(np.arange(c.start, c.stop)[:, None], rows.shape)[inside]
            assert at.tolist() == [*range(r.start, r.stop)] and (ends[of] <= at).all() and (at < ends[of + 1]).all()
            seen += at.tolist()
        assert seen == [*range(ends[-1])]

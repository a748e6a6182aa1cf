import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hetspark.llm import quality

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#|\x1c\x85", max_size=60), min_size=1, max_size=5))
def test_counts(texts):
    assert quality.read_lines(texts).counts.tolist() == [slow_counts(t) for t in texts]


def test_viterbi_is_the_best_of_all_sequences():
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        model = quality.LineModel(r.normal(size=(2, len(quality.FEATURES))), r.normal(size=(2, 2)))
        f = r.normal(size=(n, len(quality.FEATURES)))
        e = f @ model.emit.T

        def worth(s):
            return sum(e[i, k] for i, k in enumerate(s)) + sum(model.move[a, b] for a, b in zip(s, s[1:]))

        assert model.viterbi(f) == list(max(itertools.product((0, 1), repeat=n), key=worth))
    assert model.viterbi(np.zeros((0, len(quality.FEATURES)))) == []


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    emit, move = r.normal(size=(2, len(quality.FEATURES))), r.normal(size=(2, 2))
    runs = [(r.normal(size=(n, len(quality.FEATURES))), r.integers(0, 2, n)) for n in (1, 3, 5)]
    x, y, here = np.zeros((3, 5, len(quality.FEATURES))), np.zeros((3, 5), int), np.zeros((3, 5), bool)
    for i, (f, s) in enumerate(runs):
        x[i, : len(s)], y[i, : len(s)], here[i, : len(s)] = f, s, True
    weight = np.array([1.0, 2.0, 0.5])

    def loss(emit, move):
        def worth(f, s):
            return (f @ emit.T)[np.arange(len(s)), s].sum() + sum(move[a, b] for a, b in zip(s, s[1:]))

        return sum(w * (np.log(sum(np.exp(worth(f, np.array(t))) for t in itertools.product((0, 1), repeat=len(s)))) - worth(f, s)) for (f, s), w in zip(runs, weight))

    g_emit, g_move = quality._gradient(x, y, here, weight, emit, move)
    for array, grad in ((emit, g_emit), (move, g_move)):
        for at in np.ndindex(array.shape):
            old = array[at]
            both = []
            for d in (-1e-5, 1e-5):
                array[at] = old + d
                both.append(loss(emit, move))
            array[at] = old
            assert abs((both[1] - both[0]) / 2e-5 - grad[at]) < 1e-4


def test_labels_bound_states():
    given, odds, words = np.array([1, 1, 0, 1]), np.array([3.0, 1.0, -2.0, 2.0]), np.array([10, 10, 10, 10])
    assert quality.imputed(given, odds, words, 1).tolist() == [1, 1, 1, 1]
    assert quality.imputed(given, odds, words, 0).tolist() == [1, 0, 0, 0]
    assert quality.imputed(np.array([1, 0, 0, 0]), odds, words, 0).tolist() == [1, 0, 0, 0]


def chain(seed=2, n=40):
    """Documents of which only labels are known: bad ones have prose too."""
    r = random.Random(seed)
    good = lambda: " ".join(r.choices(["the", "of", "house", "river"], k=r.randint(6, 14))) + "."
    bad = lambda: " | ".join(r.choices(["home", "login", "cart"], k=r.randint(6, 14)))
    whole = [([good() for _ in range(5)], [1] * 5, 1) for _ in range(n)]
    mixed = [([good(), *(bad() for _ in range(6)), good()], [1, 0, 0, 0, 0, 0, 0, 1], 0) for _ in range(n)]
    return good, bad, whole + mixed


def test_lines_of_mixed_documents():
    good, bad, docs = chain()
    model = quality.fit_lines([(quality.read_lines(["\n".join(lines)]).features, q) for lines, _, q in docs])
    for lines, states, _ in docs:
        assert model.viterbi(quality.read_lines(["\n".join(lines)]).features) == states
    mostly, hardly = "\n".join([*(good() for _ in range(9)), bad()]), "\n".join([good(), *(bad() for _ in range(9))])
    shares = [float(quality.judge_texts([t], model)[6][0]) for t in (mostly, hardly)]
    assert 0.5 < shares[0] < 1 and 0 < shares[1] < 0.5


def test_lines_of_stored_documents(spark):
    """Held-out lines whose kind is plain from their looks, mixed: nine in ten and more are told right, with shares
    between the ends; and the share decides about documents of the table."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    held = docs.where("doc_id % 2 = 1").join(labels.select("doc_id", "quality"), "doc_id").collect()
    clean = [x for d in held if d.quality == 1 for x in d.text.split("\n") if len(x.split()) > 5]
    junk = [x for d in held if d.quality == 0 for x in d.text.split("\n") if x.count(" | ") > 4 or len(re.findall(r"[#*$%&]{3}", x)) > 5]
    r, right, n, shares = random.Random(3), 0, 0, []
    for _ in range(100):
        states = [s for s in r.sample([0, 1, 0, 1], 4) for _ in range(r.randint(1, 3))]
        lines = [r.choice((junk, clean)[s]) for s in states]
        got = quality.read_lines(["\n".join(lines)])
        found = model.viterbi(got.features)
        right, n = right + sum(a == b for a, b in zip(found, states, strict=True)), n + len(states)
        shares.append((got.words * found).sum() / got.words.sum())
    assert right / n > 0.95 and sum(0 < s < 1 for s in shares) > 90
    kept = [x.quality.content_share for x in quality.judge(docs, model).select("quality").collect()]
    assert sum(0 < x < 1 for x in kept) > 20


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    out = quality.judge(docs.where("doc_id % 2 = 1").join(labels.select("doc_id"), "doc_id"), model).select("doc_id", "quality").collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(truth[r.doc_id], r.quality) for r in out]
    assert all(q.kept for t, q in rows if t == 1 and not q.base_failed)
    assert not any(q.kept for t, q in rows if t == 0)


def test_odd_rows(make):
    rows = [(1, None, "s"), (2, "", "s"), (3, "\n \n", None), (None, "w " * 60_000, "s"), (5, " ".join(f"w{i}" for i in range(60)), "s"), (5, " ".join(f"w{i}" for i in range(60)), "s")]
    out = quality.judge(make(rows), None)
    assert out.columns == [*make([]).columns, "quality"]
    got = {r.doc_id: r.quality for r in out.collect()}
    assert not got[1].kept and not got[2].kept and not got[3].kept and got[5].kept
    assert got[None].n_words == got[None].n_repeat_words == 60_000 and not got[None].kept
    assert quality.judge(make([]), None).count() == 0
    odd = make(rows).withColumnRenamed("salt", "__quality").withColumnRenamed("n", "Quality")
    assert quality.judge(odd, None).columns == [c for c in odd.columns if c != "Quality"] + ["quality"]
    out = quality.keep(odd, None)
    assert out.columns == odd.columns and [(r.doc_id, r["__quality"], r.Quality) for r in out.collect()] == [(5, 1, 2)] * 2


@pytest.mark.parametrize("labels", [[], [(5, 1, 0)], [(5, 1, 0), (5, 0, 0)], [(None, 0, 0), (5, 1, 0)]])
def test_without_labels_of_both_kinds(spark, make, labels):
    assert quality.fit(make([(5, "a b", "s")]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")) is None


def test_any_names_of_other_columns(spark):
    df = spark.createDataFrame([(1, "one two\nthree", 2, "x", 3.0), (2, None, 1, "y", None)], "doc_id int, text string, `a.b` int, QUALITY string, `q``r` double")
    out = quality.judge(df, None)
    assert out.columns == ["doc_id", "text", "a.b", "q`r", "quality"] and sorted(r.quality.n_words for r in out.collect()) == [0, 3]
    assert quality.keep(df, None).columns == df.columns and quality.keep(df, None).count() == 0
    assert quality.fit(df, spark.createDataFrame([(1, 1)], "doc_id int, quality int")) is None


def test_runs_come_from_the_whole_text():
    text = "\n".join(f"line {i} of it" for i in range(100 * quality.RUN))
    got = quality.read_lines([text])
    parts = quality.chosen_runs(text, got, 8)
    assert len(parts) == 8 and all(len(p) == quality.RUN for p in parts)
    short = quality.read_lines(["a\nb"])
    assert [p.tolist() for p in quality.chosen_runs("a\nb", short, 8)] == [short.features.tolist()]


def test_rows_that_share_an_id_count_once(spark):
    rows = [(i % 2, f"word{j} and more words here\n" * 5) for i in range(2) for j in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id int, quality int")
    first, again = (quality.fit(d, labels, runs=1) for d in (docs, docs.repartition(7).orderBy("text")))
    assert (first.emit == again.emit).all() and (first.move == again.move).all()

"""Ranked search against scoring every document for every item, in plain Python."""

import math
import random
import re

import numpy as np
import pytest

from hetspark.llm import search

CUT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return CUT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    """docs: (doc_id, text) rows; items likewise. Rows (item_id, rank, doc_id, score)."""
    bags = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, b in bags:
            if not b:
                continue
            m = 75 + (25 * len(b) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 12 * m)) for t in words(text) if t in df)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:20], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(rng, n, vocabulary="alpha beta Gamma GAMMA été 42 x-y naïve über z Ω".split()):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


@pytest.fixture
def tables(spark):
    rng = random.Random(4)
    docs = [*enumerate(make(rng, 200)), *((500 + i, "Alpha beta, alpha") for i in range(300)), (7, "alpha"), (7, "alpha"), (None, "alpha beta alpha"), (None, None), (900, None), (901, ""), (902, "... --"), (903, "beta " * 60_000 + "\x7f\xa0été")]
    rng.shuffle(docs)
    items = [*enumerate(make(rng, 30)), (30, None), (31, "nothing-of-the-kind"), (3, "z Ω"), (None, "beta alpha beta")]
    return docs, items


def test_like_brute_force(spark, tables):
    docs, items = tables
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, `a.b` string, Score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, RANK int")
    want = brute(docs, items)
    assert rows(search.search(frame, asked)) == want


def test_blocks_give_the_same(spark, tables, monkeypatch):
    docs, items = tables
    frame, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(search, "ITEMS", 9)
    assert len([*search.item_blocks(asked, "item_id", "text")]) == 4
    assert rows(search.search(frame, asked)) == brute(docs, items)


def test_whole_numbers_where_doubles_would_round(tables):
    rng = np.random.default_rng(1)
    many = 2_000_000
    items = search.Items.of([(0, [b"a"] * many + [b"b"]), (1, [b"b"])])
    scorer = search.Scorer(items, search.Totals(100, 1000, np.array([20_000, 19_999])))
    assert not scorer.exact
    bags = [search.packed(np.array([0, 1]), rng.integers(1, 400, 2)) for _ in range(50)]
    scorer.add(bags, np.full(50, 77), [[i] for i in range(50)])
    got = scorer.rows().to_pylist()
    for r in got:
        n = search.unpacked([bags[r["doc_id"]]])[2].tolist()
        a, b = ((10**9 * k) // (1000 * k + 12 * 77) for k in n)
        assert r["score"] == (20_000 * a * many + 19_999 * b if r["item"] == 0 else 19_999 * b)
    assert len(got) == 40


def test_bags_come_back_whole():
    rng = np.random.default_rng(2)
    for k in (0, 1, 5, 300):
        term, times = np.sort(rng.permutation(100_000)[:k]), rng.integers(1, 1000, k)
        of, t, n = search.unpacked([search.packed(term, times), search.packed(term, times)])
        assert t.tolist() == term.tolist() * 2 and n.tolist() == times.tolist() * 2 and of.tolist() == [0] * k + [1] * k


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert search.search(docs, items.where("false")).collect() == [] == search.search(docs.where("false"), items).collect()
    assert rows(search.search(docs, items)) == [("q", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]

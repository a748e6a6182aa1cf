"""The prefix trie against sets of prefixes in plain Python."""

import hashlib
import random
import zlib

import pytest

from hetspark.llm import trie


def brute(rows):
    """rows: (conv_id, turn, role, text), without turns of equal number in a conversation."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = (*own.get(c - c % 5, [])[:h], *turns[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}

    def under(p):
        yield p
        for q in children[p]:
            yield from under(q)

    out = []
    for p, members in nodes.items():
        below = [*under(p)]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def of(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(rng, n, texts=("hi", "", "öä\n", "ok then", None)):
    rows = [(c, t, rng.choice(("user", "assistant", None)), rng.choice(texts)) for c in range(n) if rng.random() < 0.9 for t in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = table(rng, 120, ("hi", "öä", None) if seed else ("a", "b", "c", "d", "e", "f"))
    rows += [(7, None, "user", "first of all"), (1000, 1, "user", "x" * 100_000), (1001, 1, None, None), (10**12, 3, "user", "hi")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, `a.b` string, Depth int").repartition(3)
    assert of(trie.prefix_trie(df)) == brute(rows)


def test_many_shards_and_copies_of_one_conversation(spark, monkeypatch):
    """Copies of one conversation fill several shards; long ones reach deep into the skeleton."""
    rng = random.Random(9)
    rows = table(rng, 200)
    rows += [(c, t, "user", "the very same") for c in range(1000, 1400) for t in range(9)]
    rows += [(c, t, "user", f"turn {min(t, 40 + c % 3)}") for c in range(2000, 2006) for t in range(60)]
    monkeypatch.setattr(trie, "SHARD", 4000)
    monkeypatch.setattr(trie, "CHUNK", 100)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    shards = trie.sharded(trie.rebuilt(trie.turns(df)))
    assert shards.rdd.getNumPartitions() > 10
    cuts = trie.splitters(shards)
    assert len(cuts) > len(set(cuts)) > 5, "some path reaches over several shards"
    assert of(trie.prefix_trie(df)) == brute(rows)


def test_turns_of_equal_number_and_repeated_rows(spark):
    rows = [(6, 1, "user", "b"), (6, 1, "user", "a"), (6, 1, "user", "a"), (6, 1, "user", "b"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    first = of(trie.prefix_trie(df))
    assert of(trie.prefix_trie(df.repartition(4, "text"))) == first
    h = zlib.crc32(b"6") % 9
    assert len(first) == 1 + max(0, 4 - h)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []

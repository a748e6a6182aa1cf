import random

import numpy as np
import pytest
import xxhash

from hetspark.llm import simhash
from hetspark.llm.common import least_reachable


def components(n, pairs):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(a) for a in range(n)]


def brute(fps, distance=4):
    return components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).split()]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clustered(seed, n, spread):
    """Random fingerprints, dense clusters around some of them, and chains of small steps."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n // 4)}
    for centre in r.sample(sorted(out), 3):
        for _ in range(n // 6):
            out.add(centre ^ sum(1 << b for b in set(r.choices(range(64), k=r.randint(1, spread)))))
    at = r.getrandbits(64)
    for _ in range(n // 4):
        at ^= sum(1 << b for b in r.sample(range(64), 4))
        out.add(at)
    return sorted(out)


@pytest.mark.parametrize("cut", [None, simhash.Cut(5, 2), simhash.Cut(6, 3)])
@pytest.mark.parametrize("spread", [2, 4, 8])
def test_links_connect_what_all_pairs_connect(spark, spread, cut):
    fps = clustered(spread, 900, spread)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    at = {f: i for i, f in enumerate(fps)}
    pairs = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, cut=cut).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert components(len(fps), [(at[a], at[b]) for a, b in pairs]) == brute(fps)


def test_cuts_follow_the_number_of_fingerprints():
    found = [simhash.cut_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)]
    assert found == [simhash.Cut(3, 1)] * 2 + [simhash.Cut(5, 2)] + [simhash.Cut(6, 3)] * 2
    r = random.Random(0)
    for cut in set(found):
        for _ in range(500):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(sum((x >> s & ((1 << w) - 1)).bit_count() for s, w, _ in choice) <= 1 for choice in cut.choices())


def test_spanning_links_of_dense_groups():
    fps = clustered(9, 600, 6)
    a, b = simhash.spanning_links(np.array(fps, np.uint64))
    at = {f: i for i, f in enumerate(fps)}
    assert components(len(fps), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == brute(fps)


def test_whole_operator(make):
    r = random.Random(5)
    words = ["".join(r.choices("abcdeé", k=4)) for _ in range(500)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([3, 60, 200]))), "s") for i in range(150)]
    rows += [(1000 + i, " ".join(rows[i][1].split()[:-1]), "s") for i in range(60)]
    rows += [(2000, None, None), (2001, "", "s"), (2002, " \n", "s"), (2003, "ABC  d\te f g", "s"), (2004, "abc d e f g", "s"), (2005, "abc d e f g", "s"), (2005, "abc d e f g", "s")]
    got = simhash.near_groups(make(rows)).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    label = dict(zip((i for i, _, _ in rows), brute(fps), strict=True))
    least = {}
    for i, _, _ in rows:
        least[label[i]] = min(i, least.get(label[i], i))
    want = {i: (f"{f:016x}", least[label[i]]) for (i, _, _), f in zip(rows, fps, strict=True)}
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == want
    kept = simhash.drop_near_copies(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted({x.doc_id for x in kept.collect()}) == sorted(set(least.values()))


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


def test_odd_tables(make):
    assert simhash.near_groups(make([])).count() == 0 and simhash.drop_near_copies(make([])).count() == 0
    out = simhash.near_groups(make([(None, "a", "s"), (None, None, "s"), (4, "a", "s")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in out) == [(-1, -1), (-1, 4), (4, 4)]


def test_one_row_of_each_component_stays(make):
    rows = [(None, "a b", "s"), (None, "A b", "s"), (7, "a B", "s"), (7, "a b", "t"), (None, "only null", "s"), (None, "only null", "s"), (3, "x y z w v", "s"), (3, "x y z w v", "s"), (3, "other words here", "s")]
    df = make(rows)
    for name in ("__kept", "__id", "__key", "fp", "label", "key"):
        df = df.withColumnRenamed(df.columns[-1], name) if name == "__kept" else df.withColumn(name, df["doc_id"] * 0 + 9)
    out = simhash.drop_near_copies(df)
    got = [(r.doc_id, r.text.lower()) for r in out.collect()]
    assert out.columns == df.columns and sorted(got, key=str) == sorted([(7, "a b"), (None, "only null"), (3, "x y z w v"), (3, "other words here")], key=str)
    assert {r["__id"] for r in out.where("doc_id is not null").collect()} == {9}


def test_reachable_on_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 4000), (5000, 4500)]
    got = {r.node: r.label for r in least_reachable(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 5000: 4000, 4500: 4000, 4000: 4000}
    assert least_reachable(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

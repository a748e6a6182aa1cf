from collections import Counter, defaultdict

from hetspark.llm import mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share by weight; cut what is above; share the excess among the others; again."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        base = sum(w[s] for s in w if s not in full)
        above = {s for s in w if s not in full and rest * w[s] / base > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else rest * w[s] / base for s in w}
        full |= above


def corpus():
    import random

    r = random.Random(3)
    names = ["a", "b", "c", "é", None, "zz"]
    return [(i, " ".join(["w"] * r.choice([1, 5, 9, 40])), names[min(5, int(r.expovariate(0.7)))]) for i in range(3000)] + [(3000, None, "only-null"), (3001, "", "only-null")]


def test_targets_and_sample(make):
    rows = corpus()
    out = mixing.mix(make(rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes)
    taken = Counter()
    for r in out:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 80, (s, taken[s], t)
    again = {r.doc_id: r.mix_copies for r in mixing.mix(make(rows[::-1])).collect()}
    assert again == {r.doc_id: r.mix_copies for r in out}


def test_rows_repeat(make):
    rows = corpus()[:200]
    planned = {r.doc_id: r.mix_copies for r in mixing.mix(make(rows)).collect()}
    out = mixing.repeated(make(rows))
    assert out.columns == make(rows).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in planned.items() if v})


def test_odd_rows(make):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, "a", None), (1, "a", None), (2, "x " * 50_000, "s"), (3, None, None)]
    out = mixing.mix(make(rows)).collect()
    assert len(out) == 6 and max(r.mix_size for r in out) == 50_000
    assert mixing.mix(make([])).count() == 0 and mixing.repeated(make([])).count() == 0


def test_native(make):
    plan = mixing.mix(make(corpus()[:10]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names(make):
    rows = corpus()[:300]
    df = make(rows)
    plain = {r.doc_id: r.mix_copies for r in mixing.mix(df).collect()}
    for name in ("mix_target", "__mix_block", "__mix_rank", "__copy", "__block", "__mix_size", "block", "start", "words"):
        df = df.withColumn(name, df["doc_id"] + 5)
    df = df.withColumn("MIX_SIZE", df["doc_id"] + 6)
    out = mixing.mix(df)
    assert out.columns == [c for c in df.columns if c.lower() not in mixing.OUT] + list(mixing.OUT)
    assert {r.doc_id: r.mix_copies for r in out.collect()} == plain and all(r["__mix_rank"] == r.doc_id + 5 for r in out.collect())
    again = mixing.repeated(df)
    assert again.columns == df.columns and all(r.MIX_SIZE == r.doc_id + 6 and r["__copy"] == r.mix_target == r.doc_id + 5 for r in again.collect())
    assert Counter(r.doc_id for r in again.collect()) == Counter({k: v for k, v in plain.items() if v})

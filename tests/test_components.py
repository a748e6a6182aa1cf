"""Components by contraction against a walk over all links."""

import random

import numpy as np
import pytest

from hetspark.operators import components


def walked(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {}
    for start in sorted(near):
        todo = [] if start in label else [start]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo += near[x]
    return label


def graphs():
    rng = random.Random(2)
    yield "random", [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    yield "chain", [(i, i + 1) for i in range(1500)]
    yield "hub", [(10**12, i) for i in range(2000)] + [(-5, -6)]
    yield "grid", [(x * 60 + y, x * 60 + y + d) for x in range(40) for y in range(59) for d in (1, 60)]
    yield "repeats", [(1, 2)] * 500 + [(2, 1)] * 500 + [(3, 3), (7, 9)]


@pytest.mark.parametrize(("name", "links"), [*graphs()], ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("room", [60, components.LINKS])
def test_like_a_walk(spark, monkeypatch, name, links, room):
    """With little room most of the work is done in rounds, otherwise in one task."""
    monkeypatch.setattr(components, "LINKS", room)
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    rows = components.least_reachable(df).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.label for r in rows} == walked(links)


def test_strings_and_none(spark):
    links = [("b", "a"), ("b", "c"), ("é", "z"), ("q", "q")]
    assert {r.node: r.label for r in components.least_reachable(spark.createDataFrame(links, "a string, b string")).collect()} == walked(links)
    assert components.least_reachable(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_forests_in_little_room(spark, monkeypatch):
    monkeypatch.setattr(components, "LINKS", 50)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(2000)]
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(2)
    assert walked([tuple(r) for r in components.local_forests(df).collect()]) == walked(links)


def test_forest_has_a_link_less_than_nodes():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 500, 3000), rng.integers(0, 500, 3000)
    node, least = components.forest(u, v)
    label = walked(list(zip(u.tolist(), v.tolist())))
    assert dict(zip(node.tolist(), least.tolist())) == {a: b for a, b in label.items() if a != b}

import random

import pytest

from tavla.llm import grouping
from tavla.llm.grouping import connected_groups, smallest_labels


@pytest.fixture(params=[0, grouping.LAST_EDGES], autouse=True)
def last_edges(request, monkeypatch):
    """Every case with small rests finished in one task, and without."""
    monkeypatch.setattr(grouping, "LAST_EDGES", request.param)


def model(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((x, root(x)) for x in parent)


def run(spark, links):
    df = spark.createDataFrame([(a, b, "clash", "u") for a, b in links], "a string, b string, node string, u string")
    return sorted((r["node"], r["group"]) for r in connected_groups(df, "a", "b").collect())


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(None, "a"), ("a", None), ("a", "a"), (None, None)],
        [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("a", None)],
        [(f"{i:04}", f"{i + 1:04}") for i in range(300)],
        [("hub", f"{i:04}") for i in range(300)] + [("0001", "x"), ("y", "z")],
    ],
)
def test_cases(spark, links):
    assert run(spark, links) == model(links)


def test_random(spark):
    rng = random.Random(2)
    names = [f"n{rng.randrange(10**6)}" for _ in range(400)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(300)]
    assert run(spark, links) == model(links)


def test_shuffled_chain(spark):
    rng = random.Random(3)
    order = [f"{i:04}" for i in range(200)]
    rng.shuffle(order)
    links = list(zip(order, order[1:], strict=False))
    assert run(spark, links) == model(links)


@pytest.mark.parametrize("kind", ["bigint", "date", "struct<x: int>"])
def test_other_types(spark, kind):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    number = {"bigint": "cast({0} as bigint)", "date": "date_add(date'2000-01-01', cast({0} as int))", "struct<x: int>": "named_struct('x', cast({0} as int))"}[kind]
    df = spark.createDataFrame(links, "p long, q long").selectExpr(number.format("p") + " as a", number.format("q") + " as b")
    back = {"bigint": "{0}", "date": "datediff({0}, date'2000-01-01')", "struct<x: int>": "{0}.x"}[kind]
    got = connected_groups(df, "a", "b").selectExpr(f"{back.format('node')} as n", f"{back.format('group')} as g")
    assert sorted((r["n"], r["g"]) for r in got.collect()) == model(links)


def test_labels_on_arrays():
    import numpy as np

    rng = random.Random(5)
    for _ in range(30):
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 70))]
        got = smallest_labels(np.array([a for a, _ in links]), np.array([b for _, b in links]), 60)
        assert {x: int(got[x]) for x, _ in model(links)} == dict(model(links))

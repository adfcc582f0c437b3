import random
from itertools import combinations

import pytest

from tavla.llm import setjoin
from tavla.llm.setjoin import merge_skip, similar_links, similar_pairs


def model(sets, threshold, least=1):
    out = set()
    merged = {}
    for k, s in sets:
        if k is not None:
            merged.setdefault(k, set()).update(x for x in s or [] if x is not None)
    for (a, x), (b, y) in combinations(sorted(merged.items()), 2):
        if x and y and len(x) >= least and len(y) >= least and len(x & y) >= threshold * len(x | y) - 1e-9:
            out.add((a, b))
    return sorted(out)


def run(spark, sets, threshold, **more):
    df = spark.createDataFrame([(k, s, 1, "clash") for k, s in sets], "k string, s array<string>, rep int, item string")
    return sorted((r["a"], r["b"]) for r in similar_pairs(df, "k", "s", threshold, **more).collect())


@pytest.mark.parametrize(("threshold", "block"), [(0.75, 4_000), (0.75, 7), (0.5, 11), (1.0, 4_000), (0.2, 5)])
def test_random(spark, threshold, block):
    rng = random.Random(int(threshold * 100) + block)
    base = [rng.sample(range(40), rng.randrange(1, 16)) for _ in range(12)]
    sets = []
    for i in range(120):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(3)):
            s ^= {rng.randrange(40)}
        sets.append((f"d{i:03}", [f"c{x}" for x in s] + ([None] if i % 9 == 0 else [])))
    assert run(spark, sets, threshold, block_rows=block) == model(sets, threshold)


def test_edges(spark):
    sets = [("a", ["x", "y"]), ("a", ["x", "y"]), ("b", ["y", "x", "x"]), ("c", []), ("d", None), (None, ["x", "y"]), ("e", [None]), ("f", ["x"])]
    assert run(spark, sets, 0.75) == [("a", "b")]
    assert run(spark, sets, 0.75, min_size=3) == []
    assert run(spark, [], 0.75) == []


def test_large_classes_are_written_out(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "MEMBER_ROWS", 3)
    sets = [(f"{i:02}", ["x", "y", "z", "w"]) for i in range(14)] + [(f"a{i}", ["x", "y", "z"]) for i in range(7)]
    assert run(spark, sets, 0.75) == model(sets, 0.75)


def test_copies_of_a_hot_set(spark):
    df = spark.range(1200).selectExpr("cast(id as string) as k", "array('x', 'y', 'z') as s")
    assert similar_pairs(df, "k", "s", 0.75).count() == 1200 * 1199 // 2
    links = similar_links(df, "k", "s", 0.75).collect()
    assert {(r["class_id"], r["copies"], r["links"]) for r in links} == {("0", 1200, 1199)} and len(links) == 1200


def test_links(spark):
    rng = random.Random(5)
    sets = [(f"d{i:02}", [f"c{x}" for x in rng.sample(range(9), 6)]) for i in range(60)]
    df = spark.createDataFrame([(k, s, 1) for k, s in sets], "k string, s array<string>, links int")
    pairs = model(sets, 0.7)
    want = [(k, min(o for o, t in sets if set(t) == set(s)), sum(set(t) == set(s) for _, t in sets), sum(k in p for p in pairs)) for k, s in sets]
    assert sorted(tuple(r) for r in similar_links(df, "k", "s", 0.7, block_rows=6).collect()) == sorted(want)


@pytest.mark.parametrize("threshold", [0.75, 0.3])
def test_lists_hot_at_every_depth(spark, threshold):
    """All sets share their rarest items, so that lists are parted as far as they can be and then cut by size."""
    rng = random.Random(3)
    sets = [(f"{i:03}", ["a", "b", "c", "d", *{f"r{rng.randrange(12)}" for _ in range(rng.randrange(9))}]) for i in range(150)]
    sets += [(f"s{i}", [f"r{k}" for k in range(12) if k != i]) for i in range(12)] * 3
    sets += [(f"t{i}{k}", [f"r{k}", "e"]) for i in range(40) for k in range(12)]
    assert run(spark, sets, threshold, block_rows=9) == model(sets, threshold)


def test_split_lists():
    assert setjoin.split_lists([[1]] * 3, 1) == 3
    assert setjoin.split_lists([[1], [1, 2], list(range(10_000))], 2) == 2


def test_hot_item_is_joined_in_blocks(spark):
    sets = [(f"{i:03}", ["hot", f"a{i}", f"b{i}"]) for i in range(60)] + [("x", ["hot"]), ("y", ["hot"])]
    assert run(spark, sets, 0.75, block_rows=5) == [("x", "y")]


def test_merge_skip():
    rng = random.Random(0)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 7))]
        need = rng.randrange(1, len(lists) + 1)
        got = list(merge_skip(lists, [0] * len(lists), 50, need))
        want = [(x, n) for x in range(50) if (n := sum(x in s for s in lists)) >= need]
        assert got == want


def test_bad_threshold(spark):
    with pytest.raises(ValueError, match="threshold"):
        run(spark, [("a", ["x"])], 0)

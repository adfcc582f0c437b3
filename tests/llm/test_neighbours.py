import numpy as np
import pytest

from tavla.llm.neighbours import Router, Search, build, most_similar, unit


def frame(spark, items):
    return spark.createDataFrame([(k, None if v is None else [float(x) if x is not None else None for x in v], "x", 1) for k, v in items], "key string, vec array<float>, other string, cell int").withColumnRenamed("key", "id").withColumn("key", __import__("pyspark").sql.functions.lit("clash"))


def brute(items, k, dim):
    x = {}
    for key, v in items:
        if key is not None and v is not None and len(v) == dim and all(a is not None and np.isfinite(a) for a in v) and any(v):
            x[key] = np.asarray(v, np.float32).astype(float)
    keys = sorted(x)
    m = np.stack([x[q] / np.linalg.norm(x[q]) for q in keys])
    out = {}
    for i, q in enumerate(keys):
        s = m @ m[i]
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-round(s[j], 9), keys[j]))[:k]
        out[q] = [keys[j] for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("key", __import__("pyspark").sql.functions.desc("cosine"), "other").collect():
        out.setdefault(r["key"], []).append(r["other"])
    return out


def clusters(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return [(f"v{i:04}", (centres[i % len(centres)] + spread * rng.normal(size=dim)) * rng.uniform(0.5, 3)) for i in range(n)]


@pytest.mark.parametrize(("shard", "sample", "block"), [(4_000, 16_384, 9_999), (60, 640, 9_999), (12, 640, 25)])
def test_factor_one_is_exact(spark, shard, sample, block):
    items = clusters(600, 8, 1)
    got = found(most_similar(frame(spark, items), "id", "vec", k=5, dim=8, factor=1.0, shard_rows=shard, sample_rows=sample, block_rows=block))
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in brute(items, 5, 8).items()}


def test_recall_of_the_default_factor(spark):
    items = clusters(1500, 32, 2)
    got = found(most_similar(frame(spark, items), "id", "vec", k=5, dim=32, shard_rows=150, sample_rows=1_000))
    want = brute(items, 5, 32)
    assert sum(len(set(got[k]) & set(v)) for k, v in want.items()) / sum(map(len, want.values())) >= 0.97


def test_edges(spark):
    items = [("a", [1, 0]), ("b", [2, 0.1]), ("c", [0, 1]), ("d", None), ("e", [0, 0]), ("f", [1]), ("g", [1, None]), ("h", [float("nan"), 1]), ("i", [float("inf"), 1]), (None, [1, 1]), ("b", [2, 0.1])]
    got = found(most_similar(frame(spark, items), "id", "vec", k=5, dim=2))
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}
    assert most_similar(frame(spark, []), "id", "vec", k=5, dim=2).count() == 0
    assert most_similar(frame(spark, items[:1]), "id", "vec", k=5, dim=2).count() == 0


def test_copies(spark):
    """A hot group of copies: every copy gets k neighbours, those with the smallest keys, and nobody loses any."""
    items = [(f"c{i:03}", [1, 2, 3]) for i in range(200)] + [("z", [1, 2, 3.5]), ("y", [3, 1, 0])]
    got = found(most_similar(frame(spark, items), "id", "vec", k=3, dim=3, shard_rows=20, sample_rows=640))
    assert got["c150"] == ["c000", "c001", "c002"]
    assert got["c001"] == ["c000", "c002", "c003"]
    assert got["z"] == ["c000", "c001", "c002"]
    assert got["y"][0] == "c000"
    assert all(len(v) == 3 for v in got.values())
    assert len(got) == 202


def test_router():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(500, 6)))
    router = Router(x[:300], 20, rng)
    at = router.home(x)
    assert len(router) == 20
    rows, shard = router.reachable(x, np.full(len(x), 0.4))
    pairs = set(zip(rows.tolist(), shard.tolist(), strict=True))
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    assert all((i, at[j]) in pairs for i in range(500) for j in np.flatnonzero(d[i] < 0.399))
    assert len(router.reachable(x, np.full(len(x), -1.0))[0]) == 0


def test_tree():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(500, 6)))
    tree, leaves = build(x, 20, rng)
    assert leaves >= 500 / 20
    s = Search(x, tree, x, 4, 1.0, own=np.arange(len(x))).run()
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    assert np.allclose(s.score, -np.sort(-cos, axis=1)[:, :4])


def test_homes_of_few(spark):
    """A vector alone in its shard still gets its k neighbours."""
    items = [(f"a{i}", [1, 0.01 * i, 0]) for i in range(40)] + [("z", [0, 0, 1])]
    got = found(most_similar(frame(spark, items), "id", "vec", k=3, dim=3, shard_rows=20, sample_rows=64))
    assert all(len(v) == 3 for v in got.values())
    assert len(got) == 41

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavla.operators import clustering as L
from tavla.operators import codes as C
from tavla.operators import matching as O
from tavla.operators import ranking as K
from tavla.operators import relational as R

SCHEMA = "id string, company string, domain string, vector array<double>, active boolean, words array<string>, scope array<string>"


def entity(i, company, v, domain="life", active=True, words=("a",), scope=None):
    return (i, company, domain, None if v is None else [float(x) for x in v], active, None if words is None else list(words), scope)


def test_best_corroborated_cases(spark, rows):
    one, other = (1.0, 0.0), (0.0, 1.0)
    def best(*es):
        return rows(O.best_corroborated(spark.createDataFrame(list(es), SCHEMA)), "source", "company", "candidate", "status")

    both = best(entity("1", "A", one), entity("2", "B", one))
    assert both == [("1", "B", "2", "auto_confirmed"), ("2", "A", "1", "auto_confirmed")]
    assert best(entity("1", "A", one), entity("2", "A", one)) == []
    assert best(entity("1", "A", one), entity("2", "B", one, domain="mixed")) == []
    assert best(entity("1", "A", one), entity("2", "B", other))[0][3] == "pending_review"
    assert best(entity("1", "A", one), entity("2", "B", one, words=["zz"])) == []
    assert len(best(entity("1", "A", one, words=None), entity("2", "B", one, words=["zz"]))) == 2
    assert best(entity("1", "A", one, scope=["x"]), entity("2", "B", one)) == []
    assert best(entity("1", "A", one, scope=[]), entity("2", "B", one, scope=[])) == []
    assert best(entity("1", "A", one, active=False), entity("2", "B", one)) == [("1", "B", "2", "auto_confirmed")]
    fallback = best(entity("1", "A", one), entity("2", "B", one, words=["zz"]), entity("3", "B", (0.6, 0.8)))
    assert ("1", "B", "3", "pending_review") in fallback
    assert [r for r in best(entity("1", "A", one), entity("2", "B", other), entity("3", "B", (0.99, 0.14))) if r[0] == "1"][0][2] == "3"
    assert len([r for r in best(entity("1", "A", one), entity("2", "B", one), entity("3", "C", one)) if r[0] == "1"]) == 2


def test_ranking_matches_brute_force_in_small_blocks(spark, rows):
    rng = np.random.default_rng(3)
    es = []
    for i in range(120):
        v = rng.normal(size=4)
        v /= np.linalg.norm(v)
        es.append(entity(f"{i:03}", str(rng.choice(["A", "B", "C"])), v, domain=str(rng.choice(["life", "health"])), active=bool(rng.random() < 0.8)))
    es.append((None, "A", "life", [1.0] * 4, True, [], None))
    es.append(("x", None, "life", [1.0] * 4, True, [], None))
    es.append(("y", "A", "life", None, True, [], None))
    got = rows(O.rank_candidates(spark.createDataFrame(es, SCHEMA), k=2, min_score=0.5, block_rows=17), "source", "company", "candidate", "rank")
    want = []
    for a in es[:120]:
        per = {}
        for b in es[:120]:
            if b[1] != a[1] and b[2] == a[2] and b[4]:
                s = float(np.dot(a[3], b[3]))
                if s >= 0.5:
                    per.setdefault(b[1], []).append((-s, b[0]))
        want += [(a[0], c, i, n) for c, x in per.items() for n, (_, i) in enumerate(sorted(x)[:2], 1)]
    assert got == sorted(want, key=repr)


def test_overlaps_of_bags_follow_the_rule():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    a, b = ([[word() for _ in range(rng.randrange(4))] for _ in range(40)] for _ in range(2))

    def rule(x, y):
        return any(p == q or (len(p) >= 3 and len(q) >= 3 and (p.startswith(q) or p.endswith(q) or q.startswith(p) or q.endswith(p))) for p in x for q in y)

    assert O.Bags(b).overlaps(a).tolist() == [[rule(x, y) for y in b] for x in a]


def test_blocks_of_one_domain_are_dealt_to_many_tasks(spark):
    rows = spark.range(600).selectExpr("cast(id as string) as id", "'life' as domain", "4 as dim")
    dealt = O._dealt(rows, 100).select("id", "i", "j", F.spark_partition_id().alias("p"))
    assert dealt.select("i", "j").distinct().count() == 21
    assert dealt.groupBy("i", "j").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    assert dealt.select("p").distinct().count() > 8
    assert {r["count"] for r in dealt.groupBy("id").count().collect()} == {6}


def test_overlaps_of_many_words_stay_small():
    import tracemalloc

    bags = [[f"{i:06}{c}" for c in "abcde"] + ["many"] * (i % 2) for i in range(3_000)]
    asked = O.Bags(bags)
    tracemalloc.start()
    got = asked.overlaps(bags[:512])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    odd = np.arange(3_000) % 2 == 1
    assert (got == (np.eye(512, 3_000, dtype=bool) | (odd[:512, None] & odd[None, :]))).all()
    assert peak < 20_000_000


def test_long_vectors_with_ties_match_brute_force(spark, rows):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(150, 64))
    near = kinds[rng.integers(0, 150, 500)] + rng.normal(size=(500, 64)) * 0.3
    vectors = np.concatenate([near, near[:250]])  # each of the latter ties with one of the former
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    words = [None if i % 50 == 0 else [f"w{x}" for x in rng.integers(0, 12, 3)] for i in range(750)]
    es = [entity(f"{i:03}", str(rng.choice(["A", "B", "C"])), v, active=bool(rng.random() < 0.8), words=words[i]) for i, v in enumerate(vectors)]
    es.append(entity("nan", "A", [float("nan")] * 64))
    df = spark.createDataFrame(es, SCHEMA)
    score = {(i, j): round(float(x), 9) for i, row in enumerate(vectors @ vectors.T) for j, x in enumerate(row)}

    def want(k, least, gated):
        out = []
        for i, a in enumerate(es[:750]):
            per = {}
            for j, b in enumerate(es[:750]):
                if a[1] != b[1] and b[4] and score[i, j] >= least and (not gated or words[i] is None or words[j] is None or set(words[i]) & set(words[j])):
                    per.setdefault(b[1], []).append((-score[i, j], b[0]))
            out += [(a[0], c, j, n) for c, x in per.items() for n, (_, j) in enumerate(sorted(x)[:k], 1)]
        return sorted(out, key=repr)

    for least in (0.75, -0.2):
        assert rows(O.rank_candidates(df, k=3, min_score=least, block_rows=400), "source", "company", "candidate", "rank") == want(3, least, False)
    got = O.best_corroborated(df, block_rows=400).withColumn("rank", F.lit(1))
    assert rows(got, "source", "company", "candidate", "rank") == want(1, -2, True)


def test_empty_matching(spark):
    assert O.rank_candidates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert O.best_corroborated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_verdicts_and_protection(spark, rows):
    cands = spark.createDataFrame([("s", "B", "1", 0.9, "k1"), ("s", "B", "2", 0.8, "k2"), ("s", "B", "3", 0.7, "k3"), ("s", "C", "4", 0.9, "k4")], "source string, company string, candidate string, score double, key string")
    verdicts = spark.createDataFrame([("k1", "uncertain"), ("k2", "different_coverage"), ("k3", "same_coverage"), ("k4", None)], "key string, verdict string")
    assert rows(O.pick_by_verdict(cands, verdicts), "company", "candidate") == [("B", "3")]
    old = spark.createDataFrame([("a", "confirmed", 0.1), ("b", "pending_review", 0.2)], "id string, status string, score double")
    new = spark.createDataFrame([("a", "auto_confirmed", 0.9), ("c", "auto_confirmed", 0.8)], "id string, status string, score double")
    assert rows(O.rebuild_protected(old, new), "id", "status") == [("a", "confirmed"), ("c", "auto_confirmed")]


def test_validity_windows(spark, rows):
    d1, d2 = date(2024, 1, 1), date(2026, 5, 1)
    df = spark.createDataFrame([("1", "n", d1), ("2", "n", d2), ("3", "n", d2), ("4", "m", d1), ("5", None, d1), ("6", "n", None)], "id string, number string, edition date")
    got = {r["id"]: (r["valid_from"], r["valid_to"]) for r in K.next_edition_windows(df, ["number"], "edition").collect()}
    assert got == {"1": (d1, date(2026, 4, 30)), "2": (d2, None), "3": (d2, None), "4": (d1, None), "5": (None, None), "6": (None, None)}


def test_is_active(value):
    f = lambda c: R.is_active(c, "2020-01-01")
    assert value(f, None, types=["date"]) is True
    assert value(f, date(2020, 1, 1), types=["date"]) is True
    assert value(f, date(2019, 12, 31), types=["date"]) is False


def test_chunks_count_through(spark):
    df = spark.range(1003).select((F.col("id") * 7919 % 1003).alias("k"))
    got = {r["k"]: r["chunk"] for r in K.chunked(df, ["k"], 100).collect()}
    assert got == {k: k // 100 for k in range(1003)}


def test_content_once(spark, rows):
    df = spark.createDataFrame([(2, "x"), (1, "x"), (3, None), (4, "y")], "id int, text string")
    known = df.where("id = 4").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    assert rows(K.content_once(df, "text", ["id"], known), "id") == [(1,)]


def test_rewrites(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(R.upserted(old, new, ["k"])) == [("a", 1), ("b", 3), ("c", 4)]
    again = R.replaced_per_group(R.replaced_per_group(old, new, "k"), new, "k")
    assert rows(again) == [("a", 1), ("b", 3), ("c", 4)]
    filled = R.backfilled(spark.createDataFrame([("a", "", [])], "k string, t string, l array<string>"), spark.createDataFrame([("a", "x", ["y"])], "k string, t string, l array<string>"), "k", ["t"], ["l"])
    assert rows(filled, "t", "l") == [("x", ["y"])]


def test_stages(spark, rows):
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    ledger = spark.createDataFrame([("a", 1, "v1", 1), ("b", 1, None, 1), ("c", None, "v1", 1)], "id string, x_at int, x_version string, w_at int")
    assert rows(R.pending(docs, ledger, "id", stage="x", version="v1")) == [("b",), ("c",), ("d",)]
    assert rows(R.pending(docs, ledger, "id", stage="x", version="v1", after="w")) == [("b",), ("c",)]
    assert rows(R.settled(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "id string"), docs, "id")) == [("b",), ("c",), ("d",)]


def test_lookups(spark, rows):
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "name string")
    listing = spark.createDataFrame([("a.pdf", "old", 1), ("a.pdf", "new", 2)], "name string, title string, at int")
    assert rows(R.ingested(files, listing, "name", "at"), "name", "title", "listed") == [("a.pdf", "new", True), ("b.pdf", None, False)]
    dim = spark.createDataFrame([("x", "X")], "code string, label string")
    assert rows(R.labelled_by(spark.createDataFrame([("x",), ("y",)], "code string"), dim, "code", "label")) == [("x", "X"), ("y", "y")]
    assert R.required(spark.createDataFrame([("x",), (None,)], "code string"), dim, "code").count() == 1
    with pytest.raises(ValueError, match="unknown code: y"):
        R.required(spark.createDataFrame([("y",)], "code string"), dim, "code")
    wide = R.with_columns_of(files, [("name", "string"), ("added", "int")])
    assert wide.columns == ["name", "added"]


def test_codes(spark, rows):
    phrases = spark.createDataFrame([("c", " שבץ מוחי "), ("c", "סרטן השד"), ("c", "אחר"), ("e", "שבץ")], "category string, phrase string")
    codes = spark.createDataFrame([("STROKE", "c", "שבץ מוחי", ["שבץ"]), ("CANCER", "c", "סרטן", None)], "code string, category string, name string, syn array<string>")
    got = rows(C.normalised_phrases(phrases, C.code_phrases(codes, "code", "category", "name", "syn")), "phrase", "code")
    assert got == sorted([(" שבץ מוחי ", "STROKE"), ("סרטן השד", "CANCER"), ("אחר", None), ("שבץ", None)], key=repr)


@pytest.mark.parametrize("broadcast", [0, 5_000])
def test_codes_in_either_way(spark, broadcast):
    """Small and large dictionaries give what comparing all phrases gives, phrases of one or two letters included."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip() or "a"
    known = [(f"K{i:02}", rng.choice("xy"), text(rng.choice([1, 2, 3, 4, 5, 9]))) for i in range(60)]
    typed = [(rng.choice("xy"), text(rng.randrange(1, 14))) for _ in range(150)] + [("x", ""), ("x", None), (None, "abc"), ("z", "abc")]
    d = spark.createDataFrame(known, "code string, category string, known string")
    p = spark.createDataFrame(typed, "category string, phrase string")

    def want(c, t):
        fits = [(-len(n), n, k) for k, kc, n in known if t and t.strip() and kc == c and (n in t.strip() or t.strip() in n)]
        return min(fits)[2] if fits else None

    got = C.normalised_phrases(p, d, broadcast_phrases=broadcast).collect()
    assert sorted(((r["category"], r["phrase"], r["code"]) for r in got), key=repr) == sorted(((c, t, want(c, t)) for c, t in typed), key=repr)


def leader_model(vectors, threshold):
    seeds, out = [], []
    for i, v in enumerate(vectors):
        best = max(seeds, key=lambda s: (float(np.dot(vectors[s], v)), -s), default=None)
        if best is not None and np.dot(vectors[best], v) >= threshold:
            out.append(best)
        else:
            seeds.append(i)
            out.append(i)
    return out


def test_leaders():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert L.leaders(v, 0.8) == leader_model(v, 0.8)


def lines_model(words, tolerance):
    lines = []
    for x, y, w in sorted(words, key=lambda t: (t[1], t[0], t[2])):
        if lines and abs(y - lines[-1][0]) <= tolerance:
            lines[-1][1].append((x, w))
        else:
            lines.append((y, [(x, w)]))
    return "\n".join(" ".join(w for _, w in sorted(ws, reverse=True)) for _, ws in lines)


@pytest.mark.parametrize("tolerance", [0.0, 10.0])
def test_reading_order(spark, rows, tolerance):
    rng = random.Random(5)
    pages = {p: [(float(rng.randrange(100)), float(rng.randrange(60)), f"w{k}") for k in range(n)] for p, n in enumerate([1, 2, 30, 80])}
    df = spark.createDataFrame([(p, x, y, w) for p, ws in pages.items() for x, y, w in ws], "p int, x double, y double, w string")
    assert dict(rows(L.rtl_lines(df, "p", "x", "y", "w", tolerance))) == {p: lines_model(ws, tolerance) for p, ws in pages.items()}

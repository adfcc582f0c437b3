import random

import numpy as np
import pytest

from tavla.llm.canonical import UNMATCHED, BKTree, Matcher, Words, bag_distance, damerau, finished_forms, levenshtein, map_to_canonical, own_words

ENTRIES = [
    ("ACINF_LIV", "c", "דלקת חריפה של הכבד", ["acute inflammation of the liver"]),
    ("ACINF_KID", "c", "דלקת חריפה של הכליה", None),
    ("ACINF_LUNG", "c", "דלקת חריפה של הריאה", ["acute inflammation of the lung", None]),
    ("ACINF_EYE", "c", "דלקת חריפה של העין", ["acute inflammation of the eye"]),
    ("SCAR_LIV", "c", "צלקת נרחבת של הכבד", ["extensive scarring of the liver"]),
    ("SCAR_KID", "c", "צלקת נרחבת של הכליה", ["extensive scarring of the kidney"]),
    ("SCAR_LUNG", "c", "צלקת נרחבת של הריאה", ["extensive scarring of the lung"]),
    ("SCAR_EYE", "c", "צלקת נרחבת של העין", []),
    ("BURN_LIV", "c", "כוויה עמוקה של הכבד", ["deep burn of the liver"]),
    ("BURN_KID", "c", "כוויה עמוקה של הכליה", ["deep burn of the kidney"]),
    ("BURN_LUNG", "c", "כוויה עמוקה של הריאה", ["deep burn of the lung"]),
    ("ONE", "e", "גיל פרישה", []),
    (None, "e", "לא קוד", []),
]
SCHEMA = "code string, cat string, name string, syn array<string>"


def run(spark, items, entries=ENTRIES, **more):
    ref = spark.createDataFrame(entries, SCHEMA)
    df = spark.createDataFrame([(i, c, v, "clash") for i, (c, v) in enumerate(items)], "i int, c string, v string, code string")
    got = map_to_canonical(df, "v", "c", ref, code="code", code_category="cat", name="name", synonyms="syn", out="out", own_word_share=0.2, **CARRIERS, **more)
    assert got.columns == ["i", "c", "v", "code", "out"]
    return [r["out"] for r in got.orderBy("i").collect()]


CARRIERS = {"openers": ("מקרה של", "תביעה הנובעת מ"), "closers": ("וסיבוכיו", "ראה סעיף 4"), "rewrites": ((" של ה", " ב"), (" של ", " ב"))}


@pytest.fixture(scope="module")
def matcher(spark):
    ref = spark.createDataFrame([(c, k, [n, *(s or [])]) for k, c, n, s in ENTRIES if k and c == "c"], "c string, k string, t array<string>")
    codes = {r["form"]: r["k"] for r in finished_forms(ref, CARRIERS["rewrites"], support=2).collect()}
    return Matcher(codes, {w for f in codes for w in f.split()}, set(), CARRIERS["openers"], CARRIERS["closers"])


@pytest.mark.parametrize(
    ("value", "code"),
    [
        ("דלקת חריפה של הכבד", "ACINF_LIV"), ("דַלֶקת  חריפה־של הכבד‏.", "ACINF_LIV"), ("דלקת חריפה בכבד", "ACINF_LIV"), ("הכבד: דלקת חריפה של", "ACINF_LIV"), ("הכבד - דלקת חריפהשל", "ACINF_LIV"),
        ("• (3) תביעה הנובעת מדלקת חריפה של הכבד וסיבוכיו", "ACINF_LIV"), ("א. דלקצ חריפה של הכבד (ראה סעיף 4)", "ACINF_LIV"), ("מקרה של דקלת חריפה של הכבד [2]", "ACINF_LIV"),
        ("ACUTE inflamation of the liver", "ACINF_LIV"), ("acute inflammation of the kidney", "ACINF_KID"), ("deep burn of the liver", "BURN_LIV"), ("דלקת חריפה של הלשון", UNMATCHED),
        ("שבר מורכב של הכבד", UNMATCHED), ("אין", UNMATCHED), ("", UNMATCHED), (" ‏ ", UNMATCHED), (None, UNMATCHED), ("-", UNMATCHED), ("דלקת חריפה של הכבד " * 3000, UNMATCHED),
    ],
)
def test_values(matcher, value, code):
    if value is not None:
        got = matcher.match([value])[0]
        assert (got[3] if got else UNMATCHED) == code


def test_rows(spark):
    items = [("c", "דלקת חריפה של הכבד"), ("c", "דלקת חריפהה של הכבד"), ("c", None), ("c", " "), (None, "x"), ("zz", "דלקת חריפה של הכבד"), ("e", "גיל פרישה"), ("c", "גיל פרישה"), ("c", "דלקת חריפה של הכבד")]
    want = ["ACINF_LIV", "ACINF_LIV", UNMATCHED, UNMATCHED, UNMATCHED, UNMATCHED, "ONE", UNMATCHED, "ACINF_LIV"]
    assert run(spark, items) == want
    assert run(spark, items, shard_forms=16) == want  # the winners of several shards are merged
    assert run(spark, items, entries=[]) == [UNMATCHED] * 9
    assert run(spark, []) == []


def test_words_in_their_own_right(spark):
    """A word typed again and again is no misspelling of one that lies two letters away."""
    items = [("c", "צלקע נרחבק של הכבד")] + [("c", "צקלב נרחבת של הכבד" + "." * k) for k in range(30)]
    assert run(spark, items[:1] + [("c", "דלקת חריפה של העין")] * 30)[0] == "SCAR_LIV"
    assert set(run(spark, items)[1:]) == {UNMATCHED}
    assert own_words(["השקדימ", "הכבדד", "דלקתחריפה"], {"הכבדד"}, {"הכבד", "דלקת", "חריפה"}, (), ()) == {"השקדימ"}


def test_tree_finds_every_form_within_reach():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("אבגדה ") for _ in range(rng.randrange(1, 14)))
    forms = sorted({word() for _ in range(300)})
    queries = [word() for _ in range(60)] + ["", "zzz"]
    tree = BKTree(forms)
    for r in (0, 1, 2, 4):
        q, node, d = tree.within(queries, np.full(len(queries), r))
        got = sorted(zip(q.tolist(), node.tolist(), d.tolist(), strict=True))
        want = sorted((i, j, x) for i, a in enumerate(queries) for j, b in enumerate(forms) if (x := levenshtein(a, b)) <= r)
        assert got == want


def test_long_forms_take_the_plain_recurrence():
    forms = ["x" * 70 + "a", "x" * 70 + "bc", "y"]
    q, node, d = BKTree(forms).within(["x" * 70 + "ab"], np.array([1]))
    assert sorted(zip(node.tolist(), d.tolist(), strict=True)) == [(0, 1)]


def test_distances():
    assert damerau("ab", "ba") == 1
    assert damerau("ca", "abc") == 2
    assert levenshtein("ab", "ba") == 2
    rng = random.Random(2)
    s = ["".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(40)]
    for a in s[:12]:
        for b in s[12:24]:
            assert damerau(a, b) == damerau(b, a) <= levenshtein(a, b)
            assert all(damerau(a, c) <= damerau(a, b) + damerau(b, c) for c in s[24:])


def swap(s, *at):
    return "".join(s[k - 1] if k - 1 in at else s[k + 1] if k in at else c for k, c in enumerate(s))


def test_transpositions_are_found_beyond_four_edits():
    m = Matcher({"abcdefghijklmnop": "A", "qrstuvwxyzabcdefghijkl": "B", "qwerty": "C"}, set(), set(), (), ())
    three, four = swap("abcdefghijklmnop", 1, 5, 9), swap("qrstuvwxyzabcdefghijkl", 1, 5, 9, 13)
    assert (levenshtein(three, "abcdefghijklmnop"), levenshtein(four, "qrstuvwxyzabcdefghijkl")) == (6, 8)
    got = m.match([three, four, "qewrt", swap("abcdefghijklmnop", 1, 3, 5, 9)])
    assert [s and (s[3], s[0]) for s in got] == [("A", 3), ("B", 4), ("C", 2), None]


def test_every_form_within_the_threshold_is_weighed():
    """Against a plain search: of all forms within a sixth of the length plus one, transpositions counting as one, the best is taken."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrst"
    forms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(5, 30))) for _ in range(150)})
    m = Matcher({f: f"K{i:03}" for i, f in enumerate(forms)}, set(), set(), (), ())
    queries = []
    for _ in range(250):
        f = rng.choice(forms)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(f) - 1)
            f = rng.choice([swap(f, k), f[:k] + f[k + 1 :], f[:k] + rng.choice(letters) + f[k:], f[:k] + rng.choice(letters) + f[k + 1 :]])
        queries.append(f)
    fits = lambda q, f, d: d <= (min(4, len(f) // 6 + 1) if len(f) > 4 else 1) and not (d and m._strange(q, f))
    want = [min(((d, levenshtein(q, f), -len(q), f"K{i:03}") for i, f in enumerate(forms) if fits(q, f, d := damerau(q, f))), default=None) for q in queries]
    got = m.match(queries)
    # The reading as typed is the only one here, but for a letter alone at the beginning.
    assert got == want
    assert all(bag_distance(q, f) <= damerau(q, f) for q in queries[:40] for f in forms[:40])


def test_words_by_hash(spark):
    from pyspark.sql import functions as F

    words = ["דלקת", "liver", "", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    h = np.sort(df.select(F.xxhash64("w").alias("h")).toArrow()["h"].to_numpy())
    known = Words(h)
    assert all(w in known for w in words)
    assert "other" not in known
    assert "liver" in Words(np.sort(df.select(F.xxhash64(F.concat(F.lit("c\0"), "w")).alias("h")).toArrow()["h"].to_numpy()), "c")


def test_common_values_take_the_other_join(spark):
    """Answers come by broadcast or by shuffle; extra columns of any type stay."""
    ref = spark.createDataFrame(ENTRIES, SCHEMA)
    items = spark.createDataFrame([("c", "דלקת חריפהה של הכבד")], "c string, v string").crossJoin(spark.range(4_000)).unionByName(
        spark.createDataFrame([("c", "דלקת חריפה של העינ", 1), ("c", None, 2)], "c string, v string, id bigint")
    ).selectExpr("*", "map('a', id) as m", "'x' as n", "'old' as out")
    got = map_to_canonical(items, "v", "c", ref, code="code", code_category="cat", name="name", synonyms="syn", out="out")
    assert got.columns == ["c", "v", "id", "m", "n", "out"]
    assert {(r["out"], r["count"]) for r in got.groupBy("out").count().collect()} == {("ACINF_LIV", 4_000), ("ACINF_EYE", 1), (UNMATCHED, 1)}

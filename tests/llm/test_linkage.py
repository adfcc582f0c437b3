import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavla.llm import linkage
from tavla.llm.linkage import Comparison, Model, candidate_pairs, link_records
from tavla.llm.listings import PASSES, Reader, company_reader, document_features, document_keys, listing_features, listing_keys, read_date, shortened, spelt


def make(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, name string, year int, kind string, by_name array<string>, by_year array<string>")


def comparisons():
    name = F.when(F.col("l.name").isNull() | F.col("r.name").isNull(), 1).when(F.col("l.name") == F.col("r.name"), 3).when(F.levenshtein("l.name", "r.name") <= 2, 2).otherwise(0)
    year = F.when(F.col("l.year").isNull() | F.col("r.year").isNull(), 1).when(F.col("l.year") == F.col("r.year"), 2).otherwise(0)
    kind = F.when(F.col("l.kind").isNull() | F.col("r.kind").isNull(), 1).when(F.col("l.kind") == F.col("r.kind"), 2).otherwise(0)
    return [Comparison("name", name, (0.05, 0.1, 0.25, 0.6), (0.8, 0.1, 0.05, 0.05)), Comparison("year", year, (0.1, 0.2, 0.7), (0.7, 0.2, 0.1)), Comparison("kind", kind, (0.1, 0.2, 0.7), (0.6, 0.2, 0.2))]


def keys(name, year):
    return ([name[:3], name[-3:]] if name else [], [str(year)] if year else [])


def test_linkage_beats_its_noise(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    right, left, truth = [], [], {}
    for i in range(300):
        name, kind = word(), rng.choice("pqr")
        for s in range(rng.choice([1, 1, 3])):  # siblings differ in the year alone
            year = 2000 + (7 * i + 5 * s) % 21
            right.append((f"r{i}_{s}", name, year, kind, *keys(name, year)))
            if rng.random() < 0.4:
                n = name if rng.random() < 0.7 else name[:4] + "z" + name[5:]
                y = year if rng.random() < 0.8 else None
                left.append((f"l{len(left)}", n, y, kind if rng.random() < 0.8 else None, *keys(n, y)))
                if y:
                    truth[left[-1][0]] = f"r{i}_{s}"
    absent = set()
    for _ in range(60):
        n = word()
        left.append((f"l{len(left)}", n, 2000 + rng.randrange(21), rng.choice("pqr"), *keys(n, 2001)))
        absent.add(left[-1][0])
    got = {r["lid"]: r for r in link_records(make(spark, left, "lid"), make(spark, right, "rid"), ["by_name"], comparisons()).collect()}
    hits = sum(got[k]["rid"] == v for k, v in truth.items() if k in got)
    assert hits / len(truth) > 0.93
    assert sum(k in got for k in absent) <= 6
    assert all(0 <= r["confidence"] <= r["any_match"] + 1e-9 <= 1 + 1e-6 for r in got.values())


def test_edges(spark):
    left = [("a", "xxxxxx", 2000, None, ["xxx"], []), ("b", None, None, None, [], []), ("c", "xxxxxx", 2000, None, None, ["2000"])]
    right = [("2", "xxxxxx", 2000, None, ["xxx"], ["2000"]), ("1", "xxxxxx", 2000, None, ["xxx"], ["2000"])]
    got = {r["lid"]: r["rid"] for r in link_records(make(spark, left, "lid"), make(spark, right, "rid"), ["by_name"], comparisons(), least=0.0).collect()}
    assert got == {"a": "1"}  # equal posteriors: the smaller id; no candidate: no row
    assert link_records(make(spark, [], "lid"), make(spark, right, "rid"), ["by_name"], comparisons()).count() == 0
    assert link_records(make(spark, left, "lid"), make(spark, [], "rid"), ["by_name"], comparisons()).count() == 0


@pytest.mark.parametrize("few", [0, 500_000])
def test_busy_blocks_lose_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(linkage, "BROADCAST_KEYS", few)
    left = [(f"l{i:02}", "n", 1, "k", ["hot", f"k{i}"], []) for i in range(30)]
    right = [(f"r{i:02}", "n", 1, "k", ["hot", f"k{i}"], []) for i in range(40)]
    got = candidate_pairs(make(spark, left, "lid"), make(spark, right, "rid"), ["by_name"], pairs_per_part=50)
    assert got.count() == got.distinct().count() == 1200


def test_model_codes_levels():
    m = Model([Comparison("a", F.lit(0), (1, 1), (1, 1)), Comparison("b", F.lit(0), (1, 1, 1), (1, 1, 1))], 0.5)
    assert [x.tolist() for x in m.levels(np.arange(6))] == [[0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2]]


def test_reading():
    assert spelt("לשכירים GOLD‏ ש\"ח_a") == ["lshkirim", "gold", "shch", "a"]
    assert spelt(None) == []
    own, tier, audience, product = Reader(["sioad", "mmoshk"]).read("תוכנית סיעוד ממושך זואדפון לגמל' ELITE")
    assert (own, tier, audience, product) == (["toknit", "zoadpon"], ["ailit"], [], ["mmoshk", "sioad"]) or audience == ["lgmlaim"]
    read = company_reader([("nirvad", "נירווד"), ("keshtov", "קשתוב")])
    assert [read(x) for x in ("נרווד ביטוח", "NIRVAD", "Keshtov Insurance Ltd", "אחר", None)] == ["nirvad", "nirvad", "keshtov", None, None]
    assert read_date("2005-11-30") == ("2005-11-30", "2005-11")
    assert read_date("8.2005") == (None, "2005-08")
    assert read_date("20140521") == ("2014-05-21", "2014-05")
    assert read_date("29.01.08") == ("2008-01-29", "2008-01")
    assert read_date("שנה שעברה") == read_date(None) == (None, None)
    assert set(shortened("abcdefgh")) & set(shortened("abxdefgh"))


def test_one_wrong_hebrew_letter_keeps_a_key():
    rng = random.Random(3)
    letters = "אבגדחיכלמנספצקרשת"
    for _ in range(300):
        name = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
        k, new = rng.randrange(4), rng.choice("חצש" + letters)
        for wrong in (name[:k] + new + name[k + 1 :], name[:k] + new + name[k:], name[:k] + name[k + 1 :], name[:k] + name[k + 1] + name[k] + name[k + 2 :]):
            assert set(shortened(*spelt(name))) & set(shortened(*spelt(wrong))), (name, wrong)


def test_misspelt_listings_are_candidates(spark):
    listings = [(1, None, "זובדפונים"), (2, "נירווד", "קשתרונים"), (3, "נירווד", "זואדפונים"), (4, None, "גלמידרון"), (5, None, None)]
    ls = spark.createDataFrame([(i, c, t, None, None, None) for i, c, t in listings], "listing_id long, company_label string, listed_title string, cover_kind string, cover_title string, sold_from string")
    docs = [("a", "nirvad", "זואדפונים"), ("b", "nirvad", "קבתרונים")]
    ds = spark.createDataFrame([(i, c, t, None, None, None) for i, c, t in docs], "id string, company_id string, appendix_name string, start date, coverage_name string, coverage_type string")
    left, right = listing_keys(listing_features(ls, [("nirvad", "נירווד"), ("keshtov", "קשתוב")], [])), document_keys(document_features(ds, []))
    got = {(r["lid"], r["rid"]) for r in candidate_pairs(left, right, PASSES).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "a")}


def test_keys_meet_at_any_place_of_their_pass_only(spark):
    left = make(spark, [("l", "n", 1, "k", ["a", "b"], ["c"])], "lid")
    right = make(spark, [("r", "n", 1, "k", ["x", "y", "a"], []), ("s", "n", 1, "k", ["c"], [])], "rid")
    assert [(r["lid"], r["rid"]) for r in candidate_pairs(left, right, ["by_name", "by_year"]).collect()] == [("l", "r")]


def test_busy_keys_are_dealt_on_both_sides(spark):
    """Few rows against many: the many are dealt to parts as well."""
    left = make(spark, [(f"l{i}", "n", 1, "k", ["hot"], []) for i in range(3)], "lid")
    right = make(spark, [(f"r{i:03}", "n", 1, "k", ["hot"], []) for i in range(400)], "rid")
    got = candidate_pairs(left, right, ["by_name"], pairs_per_part=60)
    assert got.count() == got.distinct().count() == 1200
    plan = got._jdf.queryExecution().toString()
    assert "down" in plan and "across" in plan


def test_listings_made_from_documents_are_found(spark):
    """Labelled by construction: names misspelt, words dropped, companies and dates written otherwise; half of the products are absent."""
    rng = random.Random(11)
    syllables = ["קא", "צו", "רי", "מא", "טו", "לון", "שי", "בר", "נט", "פו"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(4))
    products, tiers = ["ניתוחים בארץ", "תרופות", "ריסק", "סיעוד ממושך"], ["זהב", "כסף", "בסיס", "מורחב"]
    companies = [("nirvad", "נירווד"), ("keshtov", "קשתוב"), ("malgaz", "מלגז")]
    docs, listings, truth = [], [], {}
    for i in range(400):
        c, n, p, t = rng.choice(companies), name(), rng.choice(products), rng.choice(tiers)
        there = rng.random() < 0.6
        if there:
            docs.append((f"d{i}", c[0], f"נספח {n} {p} {t}", f"20{rng.randrange(10, 20)}-0{rng.randrange(1, 9)}-11"))
        if rng.random() < 0.7:
            k = rng.randrange(1, len(n) - 1)
            wrong = rng.choice([n, n[:k] + n[k + 1 :], n[:k] + "ד" + n[k + 1 :]])
            words = [wrong, *p.split(), t]
            rng.shuffle(words)
            listings.append((i, rng.choice([c[1] + " ביטוח", c[0].upper(), None]), " ".join(words), None, None, docs[-1][3] if there and rng.random() < 0.5 else None))
            if there:
                truth[i] = f"d{i}"
    ls = spark.createDataFrame(listings, "listing_id long, company_label string, listed_title string, cover_kind string, cover_title string, sold_from string")
    ds = spark.createDataFrame([(*d[:3], d[3], None, None) for d in docs], "id string, company_id string, appendix_name string, start string, coverage_name string, coverage_type string")
    common = sorted({w for p in [*products, *tiers, "נספח"] for w in spelt(p)})
    from tavla.llm.listings import listing_comparisons

    links = link_records(listing_features(ls, companies, common), document_features(ds, common), PASSES, listing_comparisons(), keys=(listing_keys, document_keys))
    got = {r["lid"]: r["rid"] for r in links.collect()}
    hits = sum(truth.get(k) == v for k, v in got.items())
    assert hits / len(truth) >= 0.9
    assert hits / len(got) >= 0.9

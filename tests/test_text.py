from datetime import date

import pytest
from pyspark.sql import functions as F

from tavla.functions import measures as M
from tavla.functions import text as X
from tavla.functions.positions import nearest_number, title_edition, title_number


@pytest.mark.parametrize(
    ("text", "days"),
    [
        ("90 יום", 90), ("לאחר 3 חודשים מלאים", 90), ("2 שנים רצופות", 730), ("6 שבועות.", 42), ("תרדמת - 96 שעות", 4), ("2 שעות", 1), ("60 שעות", 2), ("36 שעות", 2),
        ("90 יום; 365 ימים; 5 שנים", 90), ("1 שנתיים", 730), ("אין.", None), ("", None), (None, None),
    ],
)
def test_period_days(value, text, days):
    assert value(X.period_days, text) == days


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("₪25,000 לאירוע", (25000.0, "ILS")), ('עד 15,000 ש"ח', (15000.0, "ILS")), ("עד 100,000 דולר", (100000.0, "USD")), ("$ 1,250.5", (1250.5, "USD")), ("600 יחידות סכום ביטוח", None),
        ("100 דולר או 50 ₪", (50.0, "ILS")), (",, ₪", None), ("", None), (None, None),
    ],
)
def test_amount(value, text, want):
    got = value(X.amount, text)
    assert (tuple(got) if got else None) == want


def test_percentage(value):
    assert value(X.percentage, "השתתפות 20% ולא 30%") == 20.0
    assert value(X.percentage, "12.5 %") == 12.5
    assert value(X.percentage, None) is None


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("נספחים 101, 102", ["101", "102"]), ("נספחים 101 ו-102", ["101", "102"]), ("נספח 7 ... נספח 7", ["7"]), ("נטפח 970-971", ["970", "971"]), ("נספח מס'-801-806/91", ["801", "806"]),
        ("(1598 ,1597) נספח ניתוחים", ["1598", "1597"]), ("נספח בלי מספר", []), ("", []), (None, []),
    ],
)
def test_appendix_numbers(value, text, numbers):
    assert value(X.appendix_numbers, text) == numbers


def test_labelled_appendix_numbers(value):
    assert value(X.labelled_appendix_numbers, "נספח מספר 531 ו נספח מס' 662") == ["531", "662"]


def test_clean_text(value):
    assert value(X.clean_text, "  a \t b  \n\n\n\n c \n") == "a b\n\nc"
    assert value(X.clean_text, None) is None


def test_tokens(value):
    assert value(X.tokens, "ביטוח חיים") == []
    assert value(X.tokens, "לביטוח וחיים") == []
    assert value(X.tokens, "תרופות מותאמות תרופות א") == ["תרופות", "מותאמות"]
    assert value(X.tokens, None) == []
    assert value(lambda a, b: X.combined_tokens(a, b), "תרופות", "השתלות") == ["תרופות", "השתלות"]


def test_scope(value):
    assert value(X.scope_signature, "אובדן כושר עבודה") is None
    assert value(X.scope_signature, "לעובדי בנק הפועלים") == ["הפועלים"]
    assert value(X.scope_signature, None) is None


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(["לתרופות"], ["תרופות"], True), (["גן"], ["מגן"], False), (["ניתוח"], ["ניתוחים"], True), ([], [], False), (["א"], ["א"], True)],
)
def test_lexical_overlap(value, a, b, want):
    assert value(X.lexical_overlap, a, b, types=["array<string>"] * 2) is want


def test_dates(value):
    assert value(X.version_date, "גרסה10/2014") == date(2014, 10, 1)
    assert value(X.version_date, "10.2023 גרסה") == date(2023, 10, 1)
    assert value(X.version_date, "13.2023 גרסה") is None
    assert value(X.edition_date, " 05/26 ") == date(2026, 5, 1)
    assert value(X.edition_date, "מאי") is None
    assert value(X.edition_date, "") is None
    assert value(X.dotted_date, "1.2.2020") == date(2020, 2, 1)
    assert value(X.slashed_date, "31/12/2020") == date(2020, 12, 31)
    assert value(X.slashed_date, "32/12/2020") is None
    assert value(lambda c: X.iso_date(c, far_year=2090), "2099-01-01T00:00:00Z") is None
    assert value(lambda c: X.iso_date(c, unset="0001-01-01T00:00:00"), "0001-01-01T00:00:00") is None
    assert value(X.iso_date, "2020-03-01T23:30:00-05:00") == date(2020, 3, 1)
    assert value(X.title_date, "1.4.17") == date(2017, 4, 1)
    assert value(X.title_date, "4.2017") == date(2017, 4, 1)
    assert value(X.title_date, "31.2.2017") is None
    assert value(lambda c: X.title_dates(c)[1], "בתוקף מ-1.1.2015 עד 31.12.2016") == date(2016, 12, 31)


def test_file_names(value):
    assert value(X.filename_hint, "3bdgqiqd_1765214414_נספח_531_גילוי_נאות_102023.pdf") == "531"
    assert value(X.filename_hint, "x_לנספח_730.pdf") == "730"
    assert value(X.filename_hint, "a_המס_12.pdf") is None
    assert value(X.prefixed_number, "abc_970.pdf") == "970"
    assert value(X.prefixed_number, "abc.pdf") is None
    assert value(X.url_name, "https://x/a%20b+c.pdf") == "a b+c.pdf"
    long = value(X.capped_name, "x" * 200 + ".pdf")
    assert len(long) == 150
    assert long.endswith(".pdf")
    assert value(X.capped_name, "short.pdf") == "short.pdf"


def test_small_ones(value):
    assert value(X.without_nul, "a\0b") == "ab"
    assert value(X.estimated_tokens, "x" * 10) == 303
    assert value(X.list_text, None, types=["array<string>"]) == ""
    assert value(X.largest_number, ["1,000 או 20", "999", None], types=["array<string>"]) == 1000
    assert value(X.short_duration_days, "2 שבועות") == 14
    assert value(X.short_duration_days, "96 שעות") is None
    assert value(lambda a, b: X.pair_key(a, b), "b", "a") == "a|||b"
    assert value(lambda a, b: X.joined([a, b]), "", "x") == "x"
    assert value(lambda a: X.json_cell(F.struct(a.alias("k"))), None) == '{"k":null}'


def test_measures(value):
    arrays = ["array<string>"] * 2
    assert value(M.jaccard, [], [], types=arrays) is None
    assert value(M.jaccard, ["a", "b"], ["b", "c"], types=arrays) == pytest.approx(1 / 3)
    assert value(M.jaccard, None, ["b"], types=arrays) == 0.0
    assert value(M.same_text, "", "a") is None
    assert value(M.same_text, "a", "a") is True
    assert value(lambda a, b: M.winner(a, b, True), 3, 2, types=["int", "int"]) == "A"
    assert value(lambda a, b: M.winner(a, b, False), 3, None, types=["int", "int"]) is None
    assert value(M.share_of, ["A", "tie", None, "B"], types=["array<string>"]) == 50.0
    assert value(M.share_of, [None], types=["array<string>"]) is None
    assert value(M.unit, [0.0, 0.0], types=["array<double>"]) is None
    assert value(M.dot, [0.6, 0.8], [0.6, 0.8], types=["array<double>"] * 2) == pytest.approx(1)
    assert value(M.item_at, ["a"], 1, types=["array<string>", "int"]) is None
    assert value(M.item_at, ["a"], -1, types=["array<string>", "int"]) is None


def test_positions(value):
    assert value(title_number, "נספח מספר 123") == "123"
    assert value(title_number, "99 נספח xx 77") == "99"
    assert value(title_number, "נספח 000") is None
    assert value(title_number, None) is None
    assert value(lambda c: title_number(c, ["45"]), "נספח מס' 45") is None
    assert value(lambda c: nearest_number(c, "מילה", 1), "12 מילה") is None
    assert value(lambda c: nearest_number(c, "מילה", 9), "12/3 מילה 4.5 678") == "678"
    assert value(title_edition, "מהדורה: 05/2015") == date(2015, 5, 1)
    assert value(title_edition, "מהדורה: 15/2015") is None
    assert value(title_edition, "") is None


def test_places_and_nearest_numbers_match_a_plain_search(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from tavla.functions.positions import places

    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", " ", "12", "345", "7", "/", ".", "x", "67890"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", places(F.col("t"), "ab").alias("p"), nearest_number(F.col("t"), "ab", 8).alias("n")).collect()
    lone = re.compile(r"(?<![\d/.])(\d{2,4})(?![\d/.])")
    for r in rows:
        t, found = texts[r["i"]], []
        words = [m.start() for m in re.finditer("ab", t)]
        assert [p["at"] for p in r["p"]] == words
        for k, w in enumerate(words):
            lo = max(0, w - 8)
            found += [(min(abs(lo + m.start() - w), abs(lo + m.start() - w - 2)), k, m.start(), m[1]) for m in lone.finditer(t[lo : w + 10])]
        assert r["n"] == (min(found)[3] if found else None)


def test_chosen_numbers(spark, rows):
    cases = [(["1", "2"], "2"), (["1"], "9"), (["1"], None), ([], "9"), (None, "9"), ([], None), (["1"], "")]
    df = spark.createDataFrame(cases, "found array<string>, hint string")
    got = df.select(X.chosen_numbers(F.col("found"), F.col("hint"), hint_wins=True).alias("a"), X.chosen_numbers(F.col("found"), F.col("hint"), hint_wins=False).alias("b")).collect()
    assert [r["a"] for r in got] == [["1", "2"], ["9"], ["1"], ["9"], ["9"], [], ["1"]]
    assert [r["b"] for r in got] == [["1", "2"], ["1"], ["1"], ["9"], ["9"], [], ["1"]]
    first = spark.createDataFrame([([], ["x"]), (None, []), (["y"], ["x"])], "p array<string>, q array<string>").select(X.first_found([F.col("p"), F.col("q")]).alias("f"))
    assert sorted(r["f"] for r in first.collect()) == [[], ["x"], ["y"]]


def test_sections(spark):
    df = spark.createDataFrame([(["a", None, ""], [])], "p array<string>, q array<string>")
    assert df.select(X.sections(("# one", F.col("p")), ("", F.col("q")), ("# two", F.col("q"))).alias("t")).first()["t"] == "# one\na\n# two"

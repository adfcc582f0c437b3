import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tavla.operators.history import comparable_text, versions

SCHEMA = "snapshot_id bigint, e string, ts timestamp_ntz, ing timestamp_ntz, name string, start date, state string, valid_from string"
T0 = datetime(2020, 1, 1)


def run(df, **more):
    return versions(
        df, "e", "ts", "ing", ["name", "start"], present=F.col("state") == "listed", observed=F.col("state").isin("listed", "withdrawn"), text_attributes=["name"], tie=["snapshot_id"], **more
    )


def model(data):
    """The definition, one row at a time."""
    last = {}
    for i, e, ts, ing, name, start, state, _ in data:
        if e is None or ts is None:
            continue
        k = (e, ts)
        v = ((ing is not None, ing or T0), i)
        if k not in last or v > last[k][0]:
            last[k] = (v, state, " ".join(name.replace("‏", "").split()) if name is not None else None, start)
    out = []
    for e in {k[0] for k in last}:
        seen = [(ts, s, (n, st)) for (x, ts), (_, s, n, st) in sorted(last.items(), key=lambda kv: kv[0][1]) if x == e and s in ("listed", "withdrawn")]
        runs = []
        for ts, s, v in seen:
            v = v if s == "listed" else None
            if not runs or runs[-1][1] != v:
                runs.append([ts, v])
        for k, (ts, v) in enumerate(runs):
            if v is not None:
                out.append((e, v[0], v[1], ts, runs[k + 1][0] if k + 1 < len(runs) else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [3, 50, 2_000])
def test_random_histories_match_the_definition(spark, rows, chunk):
    rng = random.Random(chunk)
    data = [
        (
            i,
            rng.choice(["hot"] * 6 + ["a", "b", "c", None]),
            None if rng.random() < 0.02 else T0 + timedelta(days=rng.randrange(120)),
            None if rng.random() < 0.05 else T0 + timedelta(days=rng.randrange(200)),
            rng.choice([None, "x", " x ", "x‏", "y  z", "y z", ""]),
            rng.choice([None, date(2020, 5, 1)]),
            rng.choice(["listed"] * 6 + ["withdrawn", "failed", None]),
            "clash",
        )
        for i in range(600)
    ]
    df = spark.createDataFrame(data + data[:40], SCHEMA)
    assert rows(run(df, chunk_rows=chunk)) == model(data)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_instant_a_thousand_times(spark, rows):
    data = [(i, "hot", T0, T0 + timedelta(seconds=i), f"n{i}", None, "listed", "") for i in range(1000)]
    assert rows(run(spark.createDataFrame(data, SCHEMA), chunk_rows=10)) == [("hot", "n999", None, T0, None)]


def test_long_names_stay_whole(spark, rows):
    long = "ש" * 100_000
    data = [(1, "a", T0, T0, long, None, "listed", ""), (2, "a", T0 + timedelta(days=1), T0, long + "x", None, "listed", "")]
    assert [len(r[1]) for r in rows(run(spark.createDataFrame(data, SCHEMA)))] == [100_000, 100_001]


def test_comparable_text(value):
    assert value(comparable_text, "‏ a \t b ‎") == "a b"
    assert value(comparable_text, None) is None
    assert value(comparable_text, " ‏ ") == ""

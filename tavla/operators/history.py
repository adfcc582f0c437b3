"""Versions of slowly changing entity attributes, from irregular snapshots.

The history of one entity is a fold over its observations in time order: a version is appended
only when the observed state differs from the last one. A busy entity is first cut into runs of
time that hold a bounded number of observations; each run is folded on its own, and of each run only its
first and last state meet those of the runs before and after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavla.session import cut, seen

#: Observations of one entity that one fold may hold. More are split by time.
CHUNK_ROWS = 2_000

DIRECTION_MARKS = "[\\u200e\\u200f\\u061c\\u202a-\\u202e\\u2066-\\u2069]"
BLANKS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

#: Busy entities (2 kB each) that may be broadcast; more are joined by shuffle.
BROADCAST_ENTITIES = 2_000

#: Quantiles kept of a busy entity's instants. Pieces above chunk_rows are divided evenly in time.
GRID = 256


def comparable_text(c: Column) -> Column:
    """Text without direction marks, each run of blanks as one and none at the ends; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, DIRECTION_MARKS, ""), BLANKS, " "))


def _busy_entities(instants: DataFrame, chunk_rows: int) -> DataFrame:
    """``__e, __cuts, __sub`` of every entity with more than ``chunk_rows`` rows; quiet entities have no row.

    ``__cuts`` are quantiles of its instants (microseconds), ``__sub`` the even divisions of each
    piece between two cuts. Counts are combined map-side; at most rows / chunk_rows entities are busy.
    """
    busy = instants.groupBy("__e").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk_rows)
    grid = instants.join(busy, "__e", "left_semi").groupBy("__e").agg(
        F.count(F.lit(1)).alias("__n"), F.percentile_approx("__us", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("__grid")
    )
    pieces = F.ceil(F.col("__n") / chunk_rows)
    step = F.greatest(F.lit(1), F.floor(GRID / pieces)).cast("int")
    return grid.select(
        "__e",
        F.array_distinct(F.filter("__grid", lambda x, i: (i % step == 0))).alias("__cuts"),
        F.greatest(F.lit(1), F.ceil(pieces / GRID)).cast("int").alias("__sub"),
    )


def _chunk(us: Column) -> Column:
    """The number of the piece in which an instant lies; 0 for entities that are not busy."""
    at = F.col("__at")
    lo, hi = F.try_element_at("__cuts", at), F.try_element_at("__cuts", at + 1)
    part = F.floor((us - lo) / (hi - lo + 1) * F.col("__sub"))
    return F.when(F.col("__cuts").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.when(at == 0, 0).otherwise(at) * F.col("__sub").cast("bigint") + F.coalesce(F.when(at > 0, part), F.lit(0).cast("bigint"))
    )


def versions(
    df: DataFrame,
    entity: str,
    ts: str,
    ingested: str,
    attributes: Sequence[str],
    present: Column,
    observed: Column,
    *,
    text_attributes: Sequence[str] = (),
    tie: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Full version history: ``entity, <attributes>, valid_from, valid_to`` (null while open).

    Of several rows of one entity and instant the one ingested last holds (ties: greatest ``tie``
    columns, then greatest attribute values). Rows where ``observed`` is not true say nothing.
    ``present`` false closes the version. ``text_attributes`` are compared by
    :func:`comparable_text`; the value returned is the comparable form.

    Defined results: rows with a null entity or instant are no observation; a null ``ingested`` is
    older than any other; null attributes are values of their own (null equals null only); repeated rows count once;
    an empty table gives an empty history; further columns of ``df`` are ignored, whatever their names.
    """
    clean = {a: comparable_text(F.col(a)) if a in text_attributes else F.col(a) for a in attributes}
    rows = df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(entity).alias("__e"),
        F.col(ts).alias("__t"),
        F.struct(
            F.col(ingested).alias("i"),
            *[F.col(c).alias(f"k{j}") for j, c in enumerate(tie)],
            F.struct(*[c.alias(a) for a, c in clean.items()]).alias("s"),
            F.coalesce(present, F.lit(False)).alias("p"),
            F.coalesce(observed, F.lit(False)).alias("o"),
        ).alias("__r"),
    )
    us = F.unix_micros(F.col("__t").cast("timestamp"))
    busy = cut(_busy_entities(rows.select("__e", us.alias("__us")), chunk_rows), n=F.count(F.lit(1)))
    # A quiet entity is one run; it is finished where it was folded.
    last = F.lit(None).cast(df.schema[ts].dataType)
    if not seen(busy, "n"):
        found = _folded(rows, "__e").select("__e", _closed(F.col("__p"), last).alias("__v"))
    else:
        known = F.broadcast(busy) if seen(busy, "n") <= BROADCAST_ENTITIES else busy
        quiet = _folded(rows.join(known, "__e", "left_anti"), "__e").select("__e", _closed(F.col("__p"), last).alias("__v"))
        at = F.size(F.filter("__cuts", lambda x: x <= us))
        placed = rows.join(known, "__e").withColumn("__at", at).select("__e", _chunk(us).alias("__c"), "__t", "__r")
        found = quiet.unionByName(_joined_runs(cut(_folded(placed, "__e", "__c")), last))
    out = found.select("__e", F.inline("__v").alias("s", "t", "until"))
    return out.select(F.col("__e").alias(entity), *[F.col("s")[a].alias(a) for a in attributes], F.col("t").alias("valid_from"), F.col("until").alias("valid_to"))


def _folded(rows: DataFrame, *run: str) -> DataFrame:
    """``<run>, __p``: the changes of every run in time order, an array of (t, s); s is null where the entity isn't present."""
    # One shuffle serves both aggregations: rows of a run share a partition, so do those of an instant.
    held = rows.repartition(*run).groupBy(*run, "__t").agg(F.max("__r").alias("__r"))
    points = F.struct(F.col("__t").alias("t"), F.when(F.col("__r.p"), F.col("__r.s")).alias("s"))
    runs = held.where("__r.o").groupBy(*run).agg(F.array_sort(F.collect_list(points)).alias("__a"))
    fold = F.aggregate(
        F.slice("__a", 2, F.greatest(F.size("__a") - 1, F.lit(0))),
        F.slice("__a", 1, 1),
        lambda acc, x: F.when(F.element_at(acc, -1)["s"].eqNullSafe(x["s"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return runs.select(*run, fold.alias("__p"))


def _closed(points: Column, end: Column) -> Column:
    """The versions (s, t, until) of a run's changes; the last one lasts until ``end``. Changes to absence only close."""
    each = F.transform(points, lambda p, i: F.struct(p["s"].alias("s"), p["t"].alias("t"), F.coalesce(F.get(points, i + 1)["t"], end).alias("until")))
    return F.filter(each, lambda v: v["s"].isNotNull())


def _joined_runs(runs: DataFrame, never: Column) -> DataFrame:
    """``__e, __v``: the versions of busy entities from their runs ``__e, __c, __p``.

    A run's first change is none if the run before ended in the same state, and its last version ends with the first change
    after it. A window over a row per run, with its two states, tells both; the changes stay where they are.
    """
    edges = runs.select("__e", "__c", F.col("__p")[0].alias("first"), F.get("__p", F.lit(1))["t"].alias("second"), F.element_at("__p", -1)["s"].alias("last"))
    w = Window.partitionBy("__e").orderBy("__c")
    fresh = (F.row_number().over(w) == 1) | ~F.lag("last").over(w).eqNullSafe(F.col("first.s"))
    starts = edges.select("__e", "__c", fresh.alias("fresh"), F.when(fresh, F.col("first.t")).otherwise(F.col("second")).alias("start"))
    back = Window.partitionBy("__e").orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)
    after = starts.select("__e", "__c", "fresh", F.last("start", ignorenulls=True).over(back).alias("end"))
    kept = runs.join(after, ["__e", "__c"]).withColumn("__p", F.when(F.col("fresh"), F.col("__p")).otherwise(F.slice("__p", F.lit(2), F.size("__p"))))
    return kept.select("__e", _closed(F.col("__p"), F.coalesce("end", never)).alias("__v"))

"""Measures of vectors, sets and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; of unit vectors it is the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; null where its length is zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # A list of one binds the norm, which would otherwise be computed again for every item.
    return F.get(F.filter(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))), lambda u: u.isNotNull()), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared items over all items; null for two empty sets. A null set is empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def same_text(a: Column, b: Column) -> Column:
    """Equality that is null where either side is null or empty."""
    return F.nullif(a, F.lit("")) == F.nullif(b, F.lit(""))


def status_of(score: Column, auto: float = 0.90) -> Column:
    return F.when(score >= auto, "auto_confirmed").otherwise("pending_review")


def size_of(c: Column) -> Column:
    """Items of a list; none of a null one."""
    return F.coalesce(F.size(c), F.lit(0))


def winner(a: Column, b: Column, higher_is_better: bool) -> Column:
    """A, B or tie; null where either side has no value."""
    ahead = a > b if higher_is_better else a < b
    return F.when(a.isNull() | b.isNull(), None).when(a == b, "tie").when(ahead, "A").otherwise("B")


def share_of(winners: Column, side: str = "A") -> Column:
    """Percentage of the criteria that a side wins, a tie being half; null without criteria. Null entries don't count."""
    held = F.filter(winners, lambda x: x.isNotNull())
    points = F.size(F.filter(held, lambda x: x == side)) + F.size(F.filter(held, lambda x: x == "tie")) / 2
    return points * 100 / F.nullif(F.size(held), F.lit(0))


def item_at(items: Column, zero_based: Column) -> Column:
    """The item of a list at a place counted from zero; null outside."""
    return F.when(zero_based >= 0, F.get(items, zero_based))

"""Row choice and validity windows by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` columns. The maximum is combined before the shuffle, so a busy key costs no more."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col("__row")[c].alias(c) for c in rest])


def content_once(df: DataFrame, content: str, order: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """The first row of each content, by its SHA-256 ``digest``, without contents whose digest is known already; null contents are left out.

    Only digests are shuffled for the choice.
    """
    hashed = df.where(F.col(content).isNotNull()).withColumn("digest", F.sha2(F.encode(content, "UTF-8"), 256))
    if known is not None:
        hashed = hashed.join(known.select("digest"), "digest", "left_anti")
    return latest_first(hashed, ["digest"], order)


def latest_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col("__row")[c].alias(c) for c in rest])


def next_edition_windows(df: DataFrame, key: Sequence[str], edition: str) -> DataFrame:
    """``df`` with ``valid_from`` and ``valid_to``: an edition ends the day before the next distinct edition of its key; the newest is open.

    Rows with a null key part or edition have no window. Rows of one edition share it.
    """
    known = F.col(edition).isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*key).orderBy(edition)
    steps = df.where(known).select(*key, edition).distinct().withColumn("valid_to", F.date_sub(F.lead(edition).over(w), 1))
    return df.join(steps, [*key, edition], "left").withColumn("valid_from", F.when(known, F.col(edition)))


def chunked(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``df`` with the number of the chunk of ``size`` rows that each row falls into, in the given order.

    The order is global: rows are range-partitioned and counted per partition, so no task sees them all.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    from tavla.session import cut

    ranged = cut(ranged)
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))  # one row a partition
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return ranged.join(F.broadcast(before), "__p").withColumn("chunk", F.floor((F.col("__before") + F.col("__i") - 1) / size).cast("bigint")).drop("__p", "__i", "__before")


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of a total order; Spark keeps n rows a task."""
    return df.orderBy(*order).limit(n)

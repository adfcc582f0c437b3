"""Filters, joins, set operations and rewrites that the batch stages and the query API are made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; a null or empty wanted value filters nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, wanted.items(), df)


def is_active(end: Column, asof: str | Column) -> Column:
    """Open, or ending on the day itself or later."""
    return end.isNull() | (end >= (F.lit(asof).cast("date") if isinstance(asof, str) else asof))


def flagged(df: DataFrame, other: DataFrame, key: str, flag: str, *, other_key: str | None = None) -> DataFrame:
    """``df`` with a boolean: has the key a row in ``other``?"""
    keys = other.select(F.col(other_key or key).alias(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def pending(df: DataFrame, ledger: DataFrame, key: str, *, stage: str, version: str, after: str | None = None) -> DataFrame:
    """Rows that a stage has still to do: those whose ledger entry isn't of the current version, and, with ``after``, only where that stage is done."""
    current = ledger.where((F.col(f"{stage}_version") == version) & F.col(f"{stage}_at").isNotNull()).select(key)
    todo = df.join(current, key, "left_anti")
    return todo if after is None else todo.join(ledger.where(F.col(f"{after}_at").isNotNull()).select(key), key, "left_semi")


def missing_from(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(*key), list(key), "left_anti")


def with_fallback(df: DataFrame, options: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``df`` with the option of its key, else that of the default key."""
    specific = options.select(F.col("option").alias(key), F.col(value).alias("__own"))
    general = options.where(F.col("option") == default).select(F.col(value).alias("__default")).limit(1)
    # One row at most, which is why it may be broadcast.
    return df.join(specific, key, "left").join(F.broadcast(general), F.lit(True), "left").withColumn(value, F.coalesce("__own", "__default")).drop("__own", "__default")


#: Base rows that every entity gets.
MOST_BASE_ROWS = 10_000


def expected_rows(entities: DataFrame, base: DataFrame, special: DataFrame, category: str) -> DataFrame:
    """Every base row for every entity, and the rows of the entity's category; base rows first.

    Base rows are held as one array that every entity unfolds, so they are bounded: more of them are an error.
    """
    head = [c for c in base.columns]
    held = base.limit(MOST_BASE_ROWS + 1).collect()
    if len(held) > MOST_BASE_ROWS:
        raise ValueError(f"more than {MOST_BASE_ROWS} base rows")
    one = [F.struct(*[F.lit(r[c]).cast(base.schema[c].dataType).alias(c) for c in head]) for r in held]
    for_all = entities.select("*", F.explode(F.array(*one)).alias("__b")).select(*entities.columns, *[F.col("__b")[c].alias(c) for c in head]) if one else None
    own = entities.join(special, category).select(*entities.columns, *head)
    return own if for_all is None else for_all.unionByName(own)


def filled_up(expected: DataFrame, given: DataFrame, key: Sequence[str], **defaults: Column) -> DataFrame:
    """The given rows, and a placeholder for every expected key without one."""
    gaps = expected.select(*key).join(given.select(*key), list(key), "left_anti").select(*key, *[v.alias(k) for k, v in defaults.items()])
    return given.unionByName(gaps, allowMissingColumns=True)


def backfilled(df: DataFrame, source: DataFrame, key: str, texts: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Empty or null fields of ``df`` are taken from ``source``, each on its own; filled ones stay."""
    s = source.select(key, *[F.col(c).alias(f"__{c}") for c in (*texts, *lists)])
    out = df.join(s, key, "left")
    for c in texts:
        out = out.withColumn(c, F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"__{c}")))
    for c in lists:
        out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"__{c}", c)))
    return out.drop(*[f"__{c}" for c in (*texts, *lists)])


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key as a whole."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_per_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All old rows of the groups in ``new`` are deleted, then ``new`` is inserted. Running it twice changes nothing."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new, allowMissingColumns=True)


def marked_done(ledger: DataFrame, done: DataFrame, key: str, *, stage: str, version: str, at: Column) -> DataFrame:
    """The ledger with one stage's time and version set for the done keys, other stages kept, new keys added."""
    t, v = f"{stage}_at", f"{stage}_version"
    keys = done.select(key).distinct().withColumn("__done", F.lit(True))
    out = ledger.join(keys, key, "full_outer")
    return out.withColumn(t, F.when(F.col("__done"), at).otherwise(F.col(t))).withColumn(v, F.when(F.col("__done"), F.lit(version)).otherwise(F.col(v))).drop("__done")


def settled(unmatched: DataFrame, results: DataFrame, docs: DataFrame, key: str, *, skip_fallback: bool = False) -> DataFrame:
    """Documents of which nothing is left unmatched, or whose fallback result is there; all of them if the fallback is skipped."""
    if skip_fallback:
        return docs.select(key)
    waiting = unmatched.select(key).distinct().join(results.select(key).distinct(), key, "left_anti")
    return docs.select(key).join(waiting, key, "left_anti")


def reviewed(matches: DataFrame, decisions: DataFrame, *, key: str = "id", allowed: Sequence[str] = ("confirmed", "rejected")) -> DataFrame:
    """Matches with the status of a decision about them; decisions of another kind change nothing."""
    fine = decisions.where(F.col("decision").isin(*allowed)).select(key, "decision")
    return matches.join(fine, key, "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")


def union_once(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of listings; of rows with one key the first listing's wins."""
    from tavla.operators.ranking import latest_first

    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rest = [c for c in parts[0].columns if c != key]
    return latest_first(reduce(lambda a, b: a.unionByName(b), tagged), [key], ["__part", *rest]).drop("__part")


def known_only(items: Column, allowed: Sequence[str]) -> Column:
    """The items of a list that are allowed, order and repetitions kept."""
    return F.filter(items, lambda x: x.isin(*allowed))


def with_columns_of(df: DataFrame, target: Sequence[tuple[str, str]]) -> DataFrame:
    """``df`` with every target column: missing ones are added as null, none is dropped or retyped."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in target if c not in df.columns])


def ingested(files: DataFrame, listing: DataFrame, name: str, order: str) -> DataFrame:
    """Files with the listing's entry of their name, of several entries the last; ``listed`` tells whether there is one."""
    from tavla.operators.ranking import latest

    return files.join(latest(listing, [name], [order]).withColumn("listed", F.lit(True)), name, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def labelled_by(df: DataFrame, labels: DataFrame, code: str, label: str) -> DataFrame:
    """``df`` with the label of its code, or the code itself where it has none."""
    return df.join(labels.select(F.col("code").alias(code), F.col("label").alias(label)), code, "left").withColumn(label, F.coalesce(label, code))


def required(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``df`` joined with a dimension that must know every key; an unknown key is an error."""
    unknown = df.select(key).where(F.col(key).isNotNull()).join(dimension.select(key), key, "left_anti").first()
    if unknown is not None:
        raise ValueError(f"unknown {key}: {unknown[0]}")
    return df.join(dimension, key)

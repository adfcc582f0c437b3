"""Matching entities across sources without keys: probabilistic record linkage.

Candidate pairs come from several blocking passes. A pair is reduced to the pattern of its agreement levels, one a
comparison. Expectation-maximisation estimates how often each level occurs among matches and among other pairs; since
a left record matches one right record at most, its candidates compete with each other and with having
no match, which keeps apart records that agree in all but a detail. The posterior is the confidence.

Each left record keeps the counts of its patterns only, whose number is bounded by the levels, so an iteration is one pass
over small rows and a sum per pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavla.session import cut, discard, seen

#: Patterns that the levels of all comparisons may make; they are collected and broadcast.
MOST_PATTERNS = 200_000
#: Pairs that one key of a pass may make in one task; larger blocks are joined in parts.
PAIRS_PER_PART = 2_000_000
#: Keys of the left side (8 bytes each) that may be broadcast to leave out the right side's others; more are joined by shuffle.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Comparison:
    """``level`` is an expression over columns of l and r giving 0 .. len(match) - 1; ``match`` and ``other`` are the
    first guesses of how often matches and other pairs show each level."""

    name: str
    level: Column
    match: tuple[float, ...]
    other: tuple[float, ...]


def candidate_pairs(left: DataFrame, right: DataFrame, passes: Sequence[str], *, pairs_per_part: int = PAIRS_PER_PART) -> DataFrame:
    """``lid, rid``: distinct pairs that share a key of a pass. A pass is an array<string> column of both sides.

    Only keys of both sides are kept. The rows of a busy key are dealt to a grid of parts, left rows along one
    side and right rows along the other, so that no task has more than about ``pairs_per_part`` pairs of one key nor all
    rows of either side; none is left out.
    """

    def hashed(n: int, p: str) -> Column:
        return F.transform(p, lambda x: F.xxhash64(F.lit(n), x))  # a second parameter would be the place in the array

    def keys(df: DataFrame, key: str) -> DataFrame:
        each = [F.coalesce(hashed(n, p), F.array().cast("array<bigint>")) for n, p in enumerate(passes)]
        return df.select(key, F.explode(F.array_distinct(F.concat(*each))).alias("k"))

    lk = cut(keys(left, "lid"), n=F.count(F.lit(1)))
    known = lk.select("k").distinct()
    rk = cut(keys(right, "rid").join(F.broadcast(known) if seen(lk, "n") <= BROADCAST_KEYS else known, "k", "left_semi"))
    busy = lk.groupBy("k").agg(F.count(F.lit(1)).alias("nl")).join(rk.groupBy("k").agg(F.count(F.lit(1)).alias("nr")), "k")
    # As near to a square as the sides allow.
    side = F.least(F.col("nr"), F.greatest(F.lit(1.0), F.sqrt(F.lit(float(pairs_per_part))), pairs_per_part / F.col("nl")))
    grid = busy.where(F.col("nl") * F.col("nr") > pairs_per_part).select("k", F.ceil(F.col("nr") / side).cast("bigint").alias("down"), F.ceil(F.col("nl") * side / pairs_per_part).cast("bigint").alias("across"))
    grid = cut(grid)
    if grid.isEmpty():
        pairs = lk.join(rk, "k").select("lid", "rid")
    else:
        one = F.lit(1).cast("bigint")
        every = lambda n: F.explode(F.sequence(one, F.coalesce(n, one)))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, one)) + 1
        lp = lk.join(grid, "k", "left").select("k", "lid", dealt("lid", "across").alias("i"), every("down").alias("j"))
        rp = rk.join(grid, "k", "left").select("k", "rid", every("across").alias("i"), dealt("rid", "down").alias("j"))
        pairs = lp.join(rp, ["k", "i", "j"]).select("lid", "rid")
    out = pairs.distinct()
    out._tavla_read = (lk, rk, grid)
    return out


class Model:
    """Level frequencies of matches (m) and other pairs (u), and the share of left records with a match."""

    def __init__(self, comparisons: Sequence[Comparison], share: float):
        self.sizes = [len(c.match) for c in comparisons]
        self.m = [np.array(c.match, float) / sum(c.match) for c in comparisons]
        self.u = [np.array(c.other, float) / sum(c.other) for c in comparisons]
        self.share = share

    def levels(self, patterns: np.ndarray) -> list[np.ndarray]:
        out, rest = [], patterns.copy()
        for n in reversed(self.sizes):
            out.append(rest % n)
            rest = rest // n
        return out[::-1]

    def ratios(self, patterns: np.ndarray) -> np.ndarray:
        """Likelihood ratios of the patterns."""
        total = np.zeros(len(patterns))
        for m, u, level in zip(self.m, self.u, self.levels(patterns), strict=True):
            total += np.log(m[level]) - np.log(u[level])
        return np.exp(total.clip(-60, 60))

    def update(self, patterns: np.ndarray, matched: np.ndarray, counts: np.ndarray, records: int) -> float:
        """New frequencies from the expected matches of each pattern; the largest change."""
        change = 0.0
        for k, level in enumerate(self.levels(patterns)):
            for table, weight in ((self.m, matched), (self.u, counts - matched)):
                new = np.bincount(level, weights=weight, minlength=self.sizes[k]) + 0.5  # no level is impossible
                new /= new.sum()
                change = max(change, float(np.abs(new - table[k]).max()))
                table[k] = new
        share = min(0.999, max(0.001, float(matched.sum()) / max(1, records)))
        change, self.share = max(change, abs(share - self.share)), share
        return change


def link_records(
    left: DataFrame,
    right: DataFrame,
    passes: Sequence[str],
    comparisons: Sequence[Comparison],
    *,
    keys: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
    share: float = 0.5,
    rounds: int = 15,
    tolerance: float = 1e-3,
    least: float = 0.5,
) -> DataFrame:
    """``lid, rid, confidence, any_match``: the best right record of every left one that has more likely than ``least`` a match.

    ``left`` has ``lid`` and ``right`` has ``rid``, each unique; the other columns are those that the passes and comparisons
    name; ``keys`` may add the passes to either side later, so that they needn't be stored. A pass on one field alone makes that field agree among most other pairs, so it should be rare beside the
    passes on identifying names. ``confidence`` is the posterior of the pair, ``any_match`` that of some candidate being a match. Equal posteriors go to
    the smaller ``rid``. Left records without candidates and empty tables give no rows; nulls must have a level in the comparisons.
    """
    spark = left.sparkSession
    size = 1
    for c in comparisons:
        size *= len(c.match)
    if size > MOST_PATTERNS:
        raise ValueError(f"the comparisons make {size} patterns, more than {MOST_PATTERNS}; use fewer levels")
    held = [c for c in left.columns if c not in passes]
    # Short numbers stand for the records until a match is known.
    left = cut(left.withColumn("__l", F.monotonically_increasing_id()))
    right = cut(right.withColumn("__r", F.monotonically_increasing_id()))
    add = keys or (lambda df: df, lambda df: df)
    pairs = candidate_pairs(add[0](left).select(F.col("__l").alias("lid"), *passes), add[1](right).select(F.col("__r").alias("rid"), *passes), passes)
    pattern = F.lit(0).cast("bigint")
    for c in comparisons:
        pattern = pattern * len(c.match) + c.level.cast("bigint")
    sides = left.select("__l", *held).alias("l"), right.select("__r", *[c for c in right.columns if c not in passes and c != "__r"]).alias("r")
    compared = pairs.withColumnsRenamed({"lid": "__l", "rid": "__r"}).join(sides[0], "__l").join(sides[1], "__r")
    scored = cut(compared.select(F.col("l.lid").alias("lid"), F.col("r.rid").alias("rid"), pattern.alias("pattern")))
    records = left.count()
    for read in (*pairs._tavla_read, left, right):
        discard(read)
    counted = scored.groupBy("lid", "pattern").agg(F.count(F.lit(1)).alias("n"))
    profiles = cut(counted.groupBy("lid").agg(F.collect_list("pattern").alias("p"), F.collect_list("n").alias("n")))
    table = profiles.select(F.explode(F.arrays_zip("p", "n")).alias("x")).groupBy("x.p").agg(F.sum("x.n").alias("n")).toPandas()
    patterns, counts = table["p"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    model = Model(comparisons, share)
    for _ in range(rounds if len(patterns) else 0):
        sent = spark.sparkContext.broadcast((patterns, model.ratios(patterns), model.share))

        def expect(batches, sent=sent):
            patterns, ratios, share = sent.value
            total = np.zeros(len(patterns))
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column(0)
                at = np.searchsorted(patterns, lists.flatten().to_numpy())
                n = batch.column(1).flatten().to_numpy().astype(float)
                starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                size = np.diff(lists.offsets.to_numpy())
                weight = n * ratios[at] * np.repeat(share / np.add.reduceat(n, starts), size)
                total += np.bincount(at, weight / np.repeat(np.add.reduceat(weight, starts) + 1 - share, size), len(patterns))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(patterns[seen]), pa.array(total[seen])], names=["pattern", "matched"])

        got = profiles.select("p", "n").mapInArrow(expect, "pattern bigint, matched double").groupBy("pattern").agg(F.sum("matched").alias("matched")).toPandas()
        sent.destroy()
        matched = np.zeros(len(patterns))
        matched[np.searchsorted(patterns, got["pattern"].to_numpy(np.int64))] = got["matched"].to_numpy()
        if model.update(patterns, matched, counts, records) < tolerance:
            break
    discard(profiles)
    weights = spark.createDataFrame(pd.DataFrame({"pattern": patterns, "ratio": model.ratios(patterns)}), "pattern bigint, ratio double")
    top = scored.join(F.broadcast(weights), "pattern").groupBy("lid").agg(
        F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("ratio")).alias("x"), "rid")).alias("best")
    )
    prior = F.lit(model.share) / F.col("n")
    none = F.lit(1 - model.share)
    links = cut(
        top.select(
            "lid", "best.rid", (-F.col("best.x") * prior / (F.col("sum") * prior + none)).alias("confidence"), (F.col("sum") * prior / (F.col("sum") * prior + none)).alias("any_match")
        ).where(F.col("any_match") >= least)
    )
    discard(scored)
    return links

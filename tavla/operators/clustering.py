"""Order-dependent operators: leader clustering and the reading order of word boxes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaders(vectors: np.ndarray, threshold: float) -> list[int]:
    """The seed of each vector, in order: the most similar earlier seed from the threshold on (the first of equals), else itself."""
    seeds: list[int] = []
    matrix = np.empty((16, vectors.shape[1] if vectors.ndim == 2 else 0))
    out = []
    for i, v in enumerate(vectors):
        if seeds:
            score = matrix[: len(seeds)] @ v
            best = int(np.argmax(score))
            if score[best] >= threshold:
                out.append(seeds[best])
                continue
        if len(seeds) == len(matrix):
            matrix = np.resize(matrix, (2 * len(matrix), matrix.shape[1]))
        matrix[len(seeds)] = v
        seeds.append(i)
        out.append(i)
    return out


def leader_clusters(df: DataFrame, group: Sequence[str], key: str, vector: str, order: Sequence[str], threshold: float = 0.87) -> DataFrame:
    """``<group>, <key>, seed``: leader clustering of the distinct vectors of each group, in the given order of their first rows.

    Equal vectors are one, so that copies cost no more; each row takes its vector's seed, the key of a first row. The result depends on the
    order, so the distinct vectors of a group are one task; the caller groups by something bounded, such as the
    distinct values of one field of one company. Rows with a null group are a group of their own.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group), f"`{vector}` {df.schema[vector].dataType.simpleString()}", f"seed {key_type}"])
    rows = df.where(F.col(vector).isNotNull())
    first = rows.groupBy(*group, vector).agg(F.min(F.struct(*[F.col(c) for c in order], F.col(key).alias("__key"))).alias("__first"))
    first = first.select(*group, vector, *[F.col("__first")[c].alias(c) for c in order if c not in group], F.col("__first.__key").alias("__key"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, "__key"], kind="stable")
        found = leaders(np.stack([np.asarray(v, float) for v in pdf[vector]]), threshold)
        return pd.DataFrame({**{g: pdf[g].to_numpy() for g in group}, vector: pdf[vector].to_numpy(), "seed": pdf["__key"].to_numpy()[found]})

    seeds = first.groupBy(*group).applyInPandas(run, schema)
    same = [rows[c].eqNullSafe(seeds[c]) for c in (*group, vector)]
    return rows.join(seeds, same).select(*[rows[g] for g in group], rows[key], "seed")


def cluster_totals(clusters: DataFrame, seed: str, value: str, frequency: str) -> DataFrame:
    """``seed, total_frequency, member_count, members``: members by frequency, most frequent first."""
    members = F.array_sort(F.collect_list(F.struct((-F.col(frequency)).alias("n"), F.col(value).alias("v"))))
    return clusters.groupBy(seed).agg(
        F.sum(frequency).alias("total_frequency"), F.count(F.lit(1)).alias("member_count"), F.transform(members, lambda m: m["v"]).alias("members")
    )


def rtl_lines(df: DataFrame, page: str, x: str, y: str, word: str, tolerance: float = 10.0) -> DataFrame:
    """``<page>, text``: words of a page from top to bottom and right to left.

    A word belongs to the current line while its height differs from that of the line's first word by the tolerance at most.
    Only the distinct heights of a page are folded, into the first heights of its lines; a word's line is the last one that
    begins no lower than it. Lines and pages are grouped by one shuffle.
    """
    words = df.select(F.col(page).alias("__p"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(word).alias("__w")).repartition("__p")
    starts = F.aggregate(
        F.array_sort(F.collect_set("__y")),
        F.array().cast("array<double>"),
        lambda acc, h: F.when((F.size(acc) > 0) & (F.abs(h - F.element_at(acc, -1)) <= tolerance), acc).otherwise(F.concat(acc, F.array(h.cast("double")))),
    )
    pages = words.groupBy("__p").agg(starts.alias("__s"))
    placed = words.join(pages, "__p").withColumn("__l", F.array_max(F.filter("__s", lambda s: s <= F.col("__y"))))
    of_line = F.sort_array(F.collect_list(F.struct("__x", "__w")), asc=False)
    lines = placed.groupBy("__p", "__l").agg(F.array_join(F.transform(of_line, lambda t: t["__w"]), " ").alias("t"))
    whole = F.array_sort(F.collect_list(F.struct("__l", "t")))
    return lines.groupBy("__p").agg(F.array_join(F.transform(whole, lambda r: r["t"]), "\n").alias("text")).select(F.col("__p").alias(page), "text")

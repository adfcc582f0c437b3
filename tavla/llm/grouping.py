"""Consolidating pairwise matches into groups.

Minimum labels are propagated across the edges and pointer jumping collapses the label trees.
After every round the edges are rewritten to the labels of their ends, so a round works only on
what the rounds before left open: long chains halve, a busy centre disappears in one round. What a round leaves is finished in
one task, by the same steps on arrays, once it is small; else the last few edges would cost as many jobs as the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavla.session import cut, discard, seen

#: Edges left by a round that one task may finish (some megabytes), where the nodes are of a type that Python orders as Spark does.
LAST_EDGES = 50_000
PLAIN_TYPES = (T.StringType, T.IntegralType, T.DateType)


def _hook(edges: DataFrame) -> DataFrame:
    """node -> smallest of itself and its neighbours. The minimum is combined map-side, so a busy node costs no more than another."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    return both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))


def _step(parents: DataFrame) -> DataFrame:
    """Every node's label becomes its label's label; ``moved`` tells whether that is another."""
    moves = parents.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("further"))  # roots move nobody
    return parents.join(moves, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved"))


def _roots(edges: DataFrame) -> DataFrame:
    """Every node's label is the root of its tree of minimum labels: labels jump until none moves, written to the
    checkpoint folder after every two jumps, and counted while they are written."""
    table = cut(_hook(edges))
    while True:
        last, table = table, cut(_step(_step(table.select("node", "label")).select("node", "label")), moved=F.count_if("moved"))
        discard(last)
        if not seen(table, "moved"):
            return table.select("node", "label")


def _finish(edges: DataFrame) -> DataFrame:
    """Every node with the smallest node of its component, in one task."""
    schema = T.StructType([T.StructField("node", edges.schema["u"].dataType), T.StructField("label", edges.schema["u"].dataType)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        whole = pd.concat(parts)
        nodes, at = np.unique(np.concatenate([whole["u"].to_numpy(), whole["v"].to_numpy()]), return_inverse=True)
        yield pd.DataFrame({"node": nodes, "label": nodes[smallest_labels(at[: len(whole)], at[len(whole) :], len(nodes))]})

    return edges.coalesce(1).mapInPandas(run, schema)


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in the component of each of n nodes, from edges (a, b): minimum labels and pointer jumping."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def connected_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, group``: every node that has a link to another one, with the smallest node it reaches.

    Links hold in both directions. Defined results: links with a null end and links of a node with
    itself are none; repeated links count once; an empty table gives an empty result; further
    columns are ignored, whatever their names. Nodes may be of any orderable type.
    """
    count = F.count(F.lit(1))
    edges = cut(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct(),
        n=count,
    )
    rounds: list[DataFrame] = []
    plain = isinstance(edges.schema["u"].dataType, PLAIN_TYPES)
    while seen(edges, "n"):
        if rounds and plain and seen(edges, "n") <= LAST_EDGES:
            rounds.append(cut(_finish(edges)))
            break
        parents = _roots(edges)
        rounds.append(parents)
        left = parents.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        right = parents.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        done, edges = edges, cut(
            edges.join(left, "u").join(right, "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), n=count
        )
        discard(done)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    # Later rounds know fewer nodes; composing from the last keeps every join as small as its round.
    labels = rounds[-1]
    for parents in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("group"))
        labels = parents.join(later, "label", "left").select("node", F.coalesce("group", "label").alias("label"))
    return labels.withColumnRenamed("label", "group")

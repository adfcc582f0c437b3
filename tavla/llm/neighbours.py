"""The k most similar vectors of every vector, by vantage-point trees.

A router sends every vector to the shard of its nearest centre; the centres are fitted on a bounded sample so that vectors lying close
together seldom part. Each shard has its own vantage-point tree. A vector is first searched in its home shard, which bounds how far its k-th
neighbour can be; then it visits just those shards that the triangle inequality can't exclude. Distances
are Euclidean between unit vectors, a metric in which the nearest has the highest cosine. ``factor`` relaxes the pruning,
of trees and of shards: one excludes nothing that could matter (exact search), less than one excludes more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavla.llm.bpe import spread
from tavla.session import cut, discard

#: Vectors on which the router is fitted, those with the smallest hashes of their keys; a centre for every 32 of them at most.
SAMPLE_ROWS = 32_768
#: Vectors a shard holds on average, as long as there are centres enough; beyond that shards grow with the vectors.
SHARD_ROWS = 8_000
#: Vectors that one task may index (at 64 dimensions 64 MB in a worker). A larger shard is cut in blocks, each with a tree of its own.
BLOCK_ROWS = 128_000
#: Visits that one task answers at a time.
VISITS_PER_TASK = 50_000
#: Classes of exact copies whose hashes (8 bytes each) may be broadcast.
BROADCAST_COPIES = 200_000
LEAF_ROWS = 256
#: Below this distance two vectors count as equal; no further shard is searched.
SAME = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def far(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of unit vectors q from the unit vector p."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q @ p)))


@dataclass
class Node:
    """A leaf has rows; an inner node a vantage point and the median distance that parts its two sides."""

    rows: np.ndarray | None = None
    leaf: int = -1
    point: np.ndarray | None = None
    median: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def build(x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple[Node, int]:
    """A vantage-point tree over the rows of x, and the number of its leaves.

    Of a few candidates the vantage point with the widest spread of distances is taken. Rows that no
    point parts (copies) stay together in one leaf.
    """
    leaves = 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        if len(rows) > leaf_rows:
            candidates = rng.choice(rows, min(8, len(rows)), replace=False)
            probe = x[rng.choice(rows, min(256, len(rows)), replace=False)]
            point = x[max(candidates, key=lambda c: far(probe, x[c]).std())]
            d = far(x[rows], point)
            median = float(np.median(d))
            inside = d < median
            if inside.any():
                return Node(point=point, median=median, inner=grow(rows[inside]), outer=grow(rows[~inside]))
        leaves += 1
        return Node(rows=rows, leaf=leaves - 1)

    return grow(np.arange(len(x))), leaves


class Router:
    """Centres of the shards. A vector's home is the shard of its nearest centre."""

    def __init__(self, sample: np.ndarray, shards: int, rng: np.random.Generator, rounds: int = 5):
        """Centres start at random members of the sample and move to the mean direction of what is nearest to them."""
        self.centres = sample[rng.choice(len(sample), shards, replace=False)] if len(sample) else np.zeros((1, sample.shape[1]))
        for _ in range(rounds if len(sample) else 0):
            total = np.zeros_like(self.centres)
            np.add.at(total, self.home(sample), sample)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            self.centres = np.where(length > 0, total / np.where(length > 0, length, 1.0), self.centres)

    def __len__(self) -> int:
        return len(self.centres)

    def home(self, q: np.ndarray) -> np.ndarray:
        parts = [np.argmax(q[lo : lo + 4096] @ self.centres.T, axis=1) for lo in range(0, len(q), 4096)]
        return np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)

    def reachable(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard that may hold something within a row's radius.

        What lies in a shard is no farther from its centre than from the row's nearest centre, so by the triangle inequality it lies
        at least half the difference of the row's distances to the two away.
        """
        rows, shards = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for lo in range(0, len(q), 4096):
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q[lo : lo + 4096] @ self.centres.T)))
            near, shard = np.nonzero((d - d.min(axis=1, keepdims=True)) / 2 < radius[lo : lo + 4096, None])
            rows.append(near + lo)
            shards.append(shard.astype(np.int32))
        return np.concatenate(rows), np.concatenate(shards)


class Search:
    """Batched search of many queries in one tree. ``score`` holds the k best cosines of each query, descending."""

    def __init__(self, x: np.ndarray, tree: Node, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None, own: np.ndarray | None = None):
        self.x, self.tree, self.q, self.k, self.factor, self.own = x, tree, q, k, factor, own
        self.score = np.full((len(q), k), -2.0)
        self.row = np.full((len(q), k), -1, np.int64)
        self.floor = np.full(len(q), -2.0) if floor is None else floor  # only better cosines matter

    def radius(self, at: np.ndarray) -> np.ndarray:
        return self.factor * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(self.score[at, -1], self.floor[at])))

    def run(self) -> Search:
        self._walk(self.tree, np.arange(len(self.q)))
        return self

    def _walk(self, node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            self._leaf(node.rows, at)
            return
        gap = far(self.q[at], node.point) - node.median
        inside = gap < 0
        self._walk(node.inner, at[inside])
        self._walk(node.outer, at[~inside])
        # The near side has shrunk the radius; only now the far side is asked.
        radius = self.radius(at)
        self._walk(node.inner, at[~inside & (gap < radius)])
        self._walk(node.outer, at[inside & (-gap <= radius)])

    def _leaf(self, rows: np.ndarray, at: np.ndarray) -> None:
        for lo in range(0, len(at), 4096):
            part = at[lo : lo + 4096]
            cos = self.q[part] @ self.x[rows].T
            better = np.flatnonzero(cos.max(axis=1) > np.maximum(self.score[part, -1], self.floor[part]))
            if not len(better):
                continue
            part, cos = part[better], cos[better]
            if self.own is not None:
                cos[rows[None, :] == self.own[part][:, None]] = -2.0
            cos[cos <= self.floor[part][:, None]] = -2.0
            score = np.concatenate([self.score[part], cos], axis=1)
            row = np.concatenate([self.row[part], np.broadcast_to(rows, cos.shape)], axis=1)
            best = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k] if score.shape[1] > self.k else np.broadcast_to(np.arange(self.k), (len(part), self.k))
            score, row = np.take_along_axis(score, best, 1), np.take_along_axis(row, best, 1)
            order = np.argsort(-score, axis=1, kind="stable")
            self.score[part], self.row[part] = np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _pairs(keys: pa.Array, nearest: pa.Array, s: Search) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(query, neighbour, cosine) of all that a search found."""
    hit = s.score > -2.0
    rows, _ = np.nonzero(hit)
    return keys.take(pa.array(rows)), nearest.take(pa.array(s.row[hit])), s.score[hit]


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key, v`` of the rows whose vector can be compared: ``dim`` finite numbers, not all zero."""
    v = F.col(vector).cast("array<float>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).alias("key"), v.alias("v"))


def _search_distinct(vectors: DataFrame, k: int, dim: int, factor: float, shard_rows: int, sample_rows: int, block_rows: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """``key, other, cosine``: the k nearest others of every key, none of whose vectors are equal; and the tables that this reads."""
    spark = vectors.sparkSession
    count = vectors.count()
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(sample_rows).select("v").toArrow()
    shards = max(1, min(-(-count // shard_rows), sample.num_rows // 32))
    fitted = Router(_matrix(sample["v"], dim) if sample.num_rows else np.empty((0, dim)), shards, np.random.default_rng(seed))
    router = spark.sparkContext.broadcast(fitted)  # at most sample_rows / 32 centres
    key_type = vectors.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = router.value.home(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["key", "v", "leaf"])

    routed_schema = T.StructType([*vectors.schema.fields, T.StructField("leaf", T.IntegerType())])
    routed = cut(spread(vectors).mapInArrow(route, routed_schema))
    # One row a shard, at most sample_rows / 32 of them.
    sizes = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = np.array([max(1, -(-sizes.get(i, 0) // block_rows)) for i in range(len(fitted))], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    of_leaf = F.array(*[F.lit(int(b)) for b in first]) if blocks.max(initial=1) > 1 else None
    if of_leaf is None:
        cells = routed.select("key", "v", "leaf", F.col("leaf").alias("cell"))
    else:
        size = F.get(of_leaf, F.col("leaf") + 1) - F.get(of_leaf, F.col("leaf"))
        cells = routed.select("key", "v", "leaf", (F.get(of_leaf, F.col("leaf")) + F.pmod(F.xxhash64("key"), size)).cast("int").alias("cell"))
    out_schema = T.StructType(
        [T.StructField("key", key_type), T.StructField("other", key_type), T.StructField("cosine", T.DoubleType())]
        + [T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType())]
    )
    arrow = to_arrow_schema(out_schema)
    spec = spark.sparkContext.broadcast((blocks, first))

    def at_home(table: pa.Table) -> pa.Table:
        """The k best of the home cell, and a visit for every further cell that may hold a better one."""
        table = table.combine_chunks().sort_by("key")
        x, keys = _matrix(table["v"], dim), table["key"].combine_chunks()
        own, _ = build(x, LEAF_ROWS, np.random.default_rng(seed))
        s = Search(x, own, x, k, factor, own=np.arange(len(x))).run()
        q, other, cosine = _pairs(keys, keys, s)
        found = pa.Table.from_arrays([q, other, pa.array(cosine), pa.nulls(len(q), arrow.field("v").type), pa.nulls(len(q), pa.int32())], schema=arrow)
        worst = s.score[:, -1]
        radius = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst))
        radius = np.where(worst > -2.0, np.where(radius > SAME, factor * radius + SAME, -1.0), np.inf)  # fewer than k at home: any shard may help
        rows, leaf = router.value.reachable(x, radius)
        blocks, first = spec.value
        cell = np.concatenate([first[leaf] + b for b in range(int(blocks.max(initial=1)))]) if len(leaf) else np.empty(0, np.int64)
        rows, leaf = np.tile(rows, int(blocks.max(initial=1))), np.tile(leaf, int(blocks.max(initial=1)))
        keep = (cell < first[leaf + 1]) & (cell != table["cell"][0].as_py())
        rows, cell = rows[keep], cell[keep]
        at = pa.array(rows)
        visits = pa.Table.from_arrays(
            [keys.take(at), pa.nulls(len(rows), arrow.field("other").type), pa.array(worst[rows]), table["v"].combine_chunks().take(at), pa.array(cell, pa.int32())], schema=arrow
        )
        return pa.concat_tables([found, visits])

    first_pass = cut(cells.groupBy("cell").applyInArrow(at_home, out_schema))
    near = first_pass.where("cell is null").select("key", "other", "cosine")
    visits = first_pass.where("cell is not null").select("key", "cosine", "v", "cell")
    # One row a cell. Busy cells are visited in several tasks, each with its own copy of the cell.
    busy = {r["cell"]: -(-r["n"] // VISITS_PER_TASK) for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not busy:
        return near, [routed, first_pass]
    parts = spark.createDataFrame(list(busy.items()), "cell int, parts bigint")
    visitors = visits.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    hosts = cells.select("key", "v", "cell").join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    near_schema = T.StructType(out_schema.fields[:3])
    near_arrow = pa.schema([arrow.field(i) for i in range(3)])

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return near_arrow.empty_table()
        right = right.combine_chunks().sort_by("key")
        x = _matrix(right["v"], dim)
        own, _ = build(x, LEAF_ROWS, np.random.default_rng(seed))
        s = Search(x, own, _matrix(left["v"], dim), k, factor, floor=left["cosine"].to_numpy()).run()
        q, other, cosine = _pairs(left["key"].combine_chunks(), right["key"].combine_chunks(), s)
        return pa.Table.from_arrays([q, other, pa.array(cosine)], schema=near_arrow)

    further = visitors.select("key", "cosine", "v", "cell", "part").groupBy("cell", "part").cogroup(hosts.select("key", "v", "cell", "part").groupBy("cell", "part")).applyInArrow(visit, near_schema)
    best = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return near.unionByName(further).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), [routed, first_pass]


def most_similar(
    df: DataFrame,
    key: str,
    vector: str,
    *,
    k: int,
    dim: int,
    factor: float = 0.25,
    shard_rows: int = SHARD_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 7,
) -> DataFrame:
    """``key, other, cosine``: for every vector its k most similar others by cosine.

    Exact copies are searched once: of the copies of a vector, the k + 1 smallest keys can be neighbours, and every copy gets
    its k. With ``factor`` one the result is exact, less relaxes it; equal cosines go to the smaller key.

    Defined results: null keys and vectors, vectors of another length, with null, NaN or infinite items, and all-zero
    vectors take no part; a key with several rows counts by its greatest vector; with fewer than k others all are given; an
    empty table gives an empty result; further columns are ignored, whatever their names.
    """
    vectors = cut(usable(df, key, vector, dim).groupBy("key").agg(F.max("v").alias("v")))
    h = F.xxhash64("v")
    shared = cut(vectors.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    n_shared = shared.count()
    if not n_shared:
        return _search_distinct(vectors, k, dim, factor, shard_rows, sample_rows, block_rows, seed)[0]
    mark = F.broadcast(shared) if n_shared <= BROADCAST_COPIES else shared
    tagged = vectors.withColumn("h", h)
    single = tagged.join(mark, "h", "left_anti").select("key", "v")
    copied = cut(tagged.join(mark, "h", "left_semi").select("key", "v"))
    reps = copied.groupBy("v").agg(F.min("key").alias("rep"))
    members = cut(copied.join(reps, "v").select("key", "rep"))
    # The limit of the window is applied before its shuffle, so a large class sends k + 1 rows a task.
    firsts = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("r") <= k + 1).select("rep", F.col("key").alias("cand"))
    distinct = cut(single.unionByName(reps.select(F.col("rep").alias("key"), "v")))
    found, read_by_it = _search_distinct(distinct, k, dim, factor, shard_rows, sample_rows, block_rows, seed)
    found = cut(found)
    for read in (vectors, shared, copied, distinct, *read_by_it):
        discard(read)
    own = firsts.select(F.col("rep").alias("key"), F.col("rep").alias("other"), F.lit(1.0).alias("cosine")).distinct()
    wide = (
        found.unionByName(own)
        .join(firsts.withColumnRenamed("rep", "other"), "other", "left")
        .select("key", F.coalesce("cand", "other").alias("other"), "cosine")
    )
    each = wide.join(members.select(F.col("rep").alias("key"), F.col("key").alias("member")), "key", "left").select(F.coalesce("member", "key").alias("key"), "other", "cosine")
    best = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return each.where("key <> other").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

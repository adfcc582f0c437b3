"""All pairs of records whose sets overlap above a Jaccard threshold.

The inverted lists are partitioned by item. A record goes to the partitions of its rarest items
only (its prefix), since two similar sets share one of those. A list that is too long for a task is parted by
the second rarest common item, then by the third; what is still too long is cut by size into blocks that are joined
where their sizes allow similar sets. Inside a partition every record
probes the lists of its further items by T-occurrence merging: the short lists are merged by a
heap that skips ahead, the longest are only binary-searched, and what reaches the required overlap
is emitted. A pair appears in one partition only: that of its rarest common items.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavla.session import cut

#: Records of one list that one task may hold; longer lists are parted.
BLOCK_ROWS = 4_000
#: Items by which a long list may be parted.
DEEPEST = 3
#: Distinct items whose ranks (about 40 bytes each) may be broadcast; more are joined by shuffle.
BROADCAST_ITEMS = 200_000
#: Long lists (about 100 bytes each) and blocks of them that may be broadcast.
BROADCAST_LISTS = 50_000
#: Copies of one set whose pairs one task writes; larger classes are written out block by block.
MEMBER_ROWS = 2_000


def least_overlap(x: float) -> int:
    """The smallest whole overlap that is at least x."""
    return math.ceil(x - 1e-9)


def merge_skip(lists: list[list[int]], start: list[int], stop: int, need: int) -> Iterator[tuple[int, int]]:
    """(record, occurrences) of all records below ``stop`` in at least ``need`` of the sorted lists.

    The heap holds each list's next record. If the smallest occurs too rarely, the need - 1 smallest
    heads can't all belong to one answer before the next head; they skip to it by binary search.
    """
    heap = [(x[i], k, i) for k, (x, i) in enumerate(zip(lists, start, strict=True)) if i < len(x) and x[i] < stop]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield top, len(popped)
            target = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, k, i in popped:
            x = lists[k]
            j = bisect_left(x, target, i)
            if j < len(x) and x[j] < stop:
                heapq.heappush(heap, (x[j], k, j))


def split_lists(lists: list[list[int]], need: int) -> int:
    """How many of the lists, sorted by length, are merged; the rest, fewer than ``need``, are only searched.

    The estimate weighs the merge of the short lists, in which a record must occur need - n_long times, against a binary search in every long list for each such record.
    """
    best, cut_at = math.inf, len(lists)
    below = [0]
    for x in lists:
        below.append(below[-1] + len(x))
    for n_long in range(min(need, len(lists))):
        short = len(lists) - n_long
        merged = below[short] * math.log2(short + 1)
        found = below[short] / (need - n_long)
        cost = merged + found * sum(math.log2(len(x) + 1) for x in lists[short:]) / 2
        if cost < best:
            best, cut_at = cost, short
    return cut_at


def join_block(path: list[int], sizes: list[int], ids: list[int], sets: list[list[int]], sides: list[int], threshold: float, same: bool) -> list[tuple[int, int, int]]:
    """Similar pairs among records sorted by size whose rarest common items are those of ``path``.

    ``sides`` tells the two blocks apart; in one block (``same``) all pairs count, else those across.
    """
    after = [[t for t in s if t > path[-1]] for s in sets]
    whole = [frozenset(s) for s in sets]
    lists: dict[int, list[int]] = defaultdict(list)
    for r, tokens in enumerate(after):
        for t in tokens:
            lists[t].append(r)
    out = []
    for r, tokens in enumerate(after):
        n = sizes[r]
        lowest = least_overlap(threshold * n)  # no smaller set can share less and be similar
        need = lowest - len(path)
        if len(tokens) < need:
            continue
        first = bisect_left(sizes, lowest)
        if first >= r:
            continue
        if need <= 0:
            found = range(first, r)
        else:
            own = sorted((lists[t] for t in tokens), key=len)
            n_short = split_lists(own, need)
            short, long = own[:n_short], own[n_short:]
            in_short = need - len(long)
            found = []
            for s, k in merge_skip(short, [bisect_left(x, first) for x in short], r, in_short):
                missing = least_overlap(threshold / (1 + threshold) * (n + sizes[s])) - len(path) - k
                for rest, x in enumerate(long):
                    if missing <= 0 or missing > len(long) - rest:
                        break
                    j = bisect_left(x, s)
                    missing -= j < len(x) and x[j] == s
                if missing <= 0:
                    found.append(s)
        for s in found:
            if not same and sides[s] == sides[r]:
                continue
            common = whole[r] & whole[s]
            if len(common) >= least_overlap(threshold / (1 + threshold) * (n + sizes[s])) and heapq.nsmallest(len(path), common) == path:
                out.append((ids[r], ids[s], len(common)))
    return out


def set_classes(df: DataFrame, record: str, items: str) -> DataFrame:
    """``record, rep, copies, items``: records with equal sets share the smallest record as ``rep``.

    Null items are none; null sets are empty sets; repeated records are merged into the union of their sets.
    """
    flat = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.explode(items).alias("item")).where("item is not null")
    sets = flat.groupBy("record").agg(F.sort_array(F.collect_set("item")).alias("items"))
    heads = sets.groupBy("items").agg(F.min("record").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return sets.join(heads, "items").select("record", "rep", "copies", "items")


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _blocked(rows: DataFrame, block_rows: int, threshold: float) -> DataFrame:
    """``rows`` of long lists in the tasks (bi, bj) that join their block ``b`` with another.

    The blocks of a list follow each other by set size, so a block meets only those whose sizes allow similar sets.
    They are computed from the counts of the sizes; no list is sorted.
    """
    counts = rows.groupBy("path", "n").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))))
    placed = rows.join(_bounded(cells, BROADCAST_LISTS), ["path", "n"]).withColumn("b", F.floor((F.col("before") + F.pmod(F.xxhash64("cid"), "c")) / block_rows).cast("int"))
    spans = F.sequence(F.floor(F.col("before") / block_rows).cast("int"), F.floor((F.col("before") + F.col("c") - 1) / block_rows).cast("int"))
    ranges = cells.select("path", "n", F.explode(spans).alias("b")).groupBy("path", "b").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    low, high = ranges.select("path", F.col("b").alias("bi"), F.col("most_n").alias("most")), ranges.select("path", F.col("b").alias("bj"), F.col("least_n").alias("fewest"))
    meet = low.join(high, "path").where((F.col("bi") <= F.col("bj")) & (F.ceil(F.col("fewest") * threshold - 1e-9) <= F.col("most"))).select("path", "bi", "bj")
    tasks = cut(meet.select("path", "bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("b")))
    return placed.join(_bounded(tasks, BROADCAST_LISTS), ["path", "b"]).select("path", "cid", "n", "toks", "least", "at", "bi", "bj", "b")


def similar_classes(classes: DataFrame, threshold: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rep_a, rep_b, overlap, copies_a, copies_b``: all pairs of different sets with a Jaccard coefficient of at least ``threshold``.

    ``classes`` as from :func:`set_classes`. Empty sets are similar to none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    heads = cut(classes.where("record = rep").select("rep", "copies", "items", F.monotonically_increasing_id().alias("cid")))
    flat = heads.select("cid", F.explode("items").alias("item"))
    counts = flat.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # Ranks by frequency, rarest first, increasing though not dense; the sort is of distinct items, not of records.
    ranks = cut(counts.orderBy("n", "item").select("item", F.monotonically_increasing_id().alias("rank")))
    lowest = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    records = cut(
        flat.join(_bounded(ranks, BROADCAST_ITEMS), "item")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list("rank")).alias("toks"))
        .withColumn("n", F.size("toks"))
        .withColumn("least", lowest)
    )
    columns = ["path", "cid", "n", "toks", "least", "at"]
    open_rows = records.select("cid", "n", "toks", "least", F.posexplode(F.slice("toks", F.lit(1), F.col("n") - F.col("least") + 1)).alias("at", "t")).select(
        F.col("t").cast("string").alias("path"), *columns[1:]
    )
    single = [F.lit(0).alias(c) for c in ("bi", "bj", "b")]
    tasks: list[DataFrame] = []
    for depth in range(1, DEEPEST + 1):
        sizes = open_rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("least").alias("fewest"))
        long = cut(sizes.where(F.col("rows") > block_rows).select("path", "fewest"))
        if long.isEmpty():
            tasks.append(open_rows.select(*columns, *single))
            open_rows = None
            break
        hot = _bounded(long, BROADCAST_LISTS)
        tasks.append(open_rows.join(hot, "path", "left_anti").select(*columns, *single))
        held = open_rows.join(hot, "path")
        # Similar sets that share ``depth`` items but needn't share more can't be parted further.
        parted = (F.col("fewest") > depth) & F.lit(depth < DEEPEST)
        tasks.append(_blocked(cut(held.where(~parted).select(columns)), block_rows, threshold))
        rest = F.slice("toks", F.col("at") + 2, F.greatest(F.col("n") - F.col("least") + depth - F.col("at"), F.lit(0)))
        deeper = held.where(parted).select("path", "cid", "n", "toks", "least", "at", F.posexplode(rest).alias("further", "t"))
        open_rows = deeper.select(F.concat_ws(",", "path", "t").alias("path"), "cid", "n", "toks", "least", (F.col("at") + 1 + F.col("further")).alias("at"))
        if depth < DEEPEST:
            open_rows = cut(open_rows)
    if open_rows is not None:
        tasks.append(open_rows.select(*columns, *single))  # empty: the deepest lists went to blocks

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "cid"], kind="stable")
        path = [int(t) for t in key[0].split(",")]
        found = join_block(path, pdf["n"].tolist(), pdf["cid"].tolist(), [x.tolist() for x in pdf["toks"]], pdf["b"].tolist(), threshold, key[1] == key[2])
        return pd.DataFrame(found, columns=["x", "y", "overlap"]).astype("int64")

    together = reduce(DataFrame.unionByName, tasks).select("path", "bi", "bj", "b", "cid", "n", "toks")
    pairs = together.groupBy("path", "bi", "bj").applyInPandas(join, "x bigint, y bigint, overlap bigint")
    x = heads.select(F.col("cid").alias("x"), F.struct("rep", "copies").alias("rx"))
    y = heads.select(F.col("cid").alias("y"), F.struct("rep", "copies").alias("ry"))
    ordered = pairs.join(x, "x").join(y, "y").select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), "overlap")
    return ordered.select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"), "overlap", F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"))


def _members(classes: DataFrame) -> DataFrame:
    """``record, rep, parts, part``: the records of a class, dealt to parts of about ``MEMBER_ROWS``."""
    parts = _parts(F.col("copies"))
    return classes.select("record", "rep", parts.alias("parts"), F.pmod(F.xxhash64("record"), parts).alias("part"))


def _parts(copies: Column) -> Column:
    return F.ceil(copies / MEMBER_ROWS).cast("bigint")


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))


def similar_pairs(df: DataFrame, record: str, items: str, threshold: float, *, min_size: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b`` (a < b): all pairs of records, each with at least ``min_size`` distinct items, with a Jaccard
    coefficient of at least ``threshold``.

    Records with equal sets are compared with others once, as a class, and written out pair by pair; the members of
    large classes meet in parts, so that no task writes more than some millions of pairs of one class.

    Defined results: null records and items are ignored, null and empty sets are similar to none, repeated
    records count once, an empty table gives no pairs, further columns are ignored, whatever their names.
    """
    classes = cut(set_classes(df, record, items).where(F.size("items") >= min_size))
    members = _members(classes)
    a = members.select(F.col("record").alias("ra"), F.col("rep").alias("rep_a"), F.col("part").alias("pa"))
    b = members.select(F.col("record").alias("rb"), F.col("rep").alias("rep_b"), F.col("part").alias("pb"))
    linked = similar_classes(classes, threshold, block_rows=block_rows)
    linked = linked.select("rep_a", "rep_b", "copies_b", _every(_parts(F.col("copies_a"))).alias("pa")).select("rep_a", "rep_b", "pa", _every(_parts(F.col("copies_b"))).alias("pb"))
    between = linked.join(a, ["rep_a", "pa"]).join(b, ["rep_b", "pb"]).select("ra", "rb")
    several = _members(classes.where("copies > 1"))
    left = several.select(F.col("record").alias("ra"), "rep", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    right = several.select(F.col("record").alias("rb"), "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), "part")).alias("i"), F.col("part").alias("j"))
    within = left.join(right, ["rep", "i", "j"]).where("i < j or ra < rb").select("ra", "rb")
    return between.unionByName(within).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def similar_links(df: DataFrame, record: str, items: str, threshold: float, *, min_size: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``record, class_id, copies, links``: one row per record, with the smallest record of equal set, the number of records
    of its class and that of all other records it is similar to. No pair of copies is written out.

    Defined results as of :func:`similar_pairs`; records below ``min_size`` have no row.
    """
    classes = cut(set_classes(df, record, items).where(F.size("items") >= min_size))
    linked = similar_classes(classes, threshold, block_rows=block_rows)
    ends = linked.select(F.col("rep_a").alias("rep"), F.col("copies_b").alias("n")).unionByName(linked.select(F.col("rep_b").alias("rep"), F.col("copies_a").alias("n")))
    others = ends.groupBy("rep").agg(F.sum("n").alias("n"))
    return classes.join(others, "rep", "left").select("record", F.col("rep").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))

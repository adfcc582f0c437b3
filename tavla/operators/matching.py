"""Matching entities across companies by vector similarity, gated by lexical evidence.

Exact search by matrix products: the vectors of a domain are cut in blocks, every unordered pair of blocks is one task, and a task
serves both directions. Products in single precision leave out what can't be among the best, within a bound of their rounding; the rest is scored
in double precision. A score of 0.75 lies too far out for the triangle inequality to leave blocks out (with 59,000 vectors of 64
dimensions in 64 or 256 clusters, the clusters' centres and radii excluded none or 1 % of them), so the products are quadratic in a domain; what is
shuffled for them is a row per vector and block, and each task keeps only the best few per (source, other company).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavla.functions.text import pair_key
from tavla.session import cut

#: Most and fewest vectors of one side of a task (the most at up to 64 dimensions, where they take 16 megabytes), and those of a strip that is multiplied at a time.
BLOCK_ROWS, LEAST_ROWS, STRIP_ROWS = 32_768, 1_024, 512

#: Pairs that are scored at a time, and the share of pairs from which on a threshold doesn't leave out enough.
SCORED, DENSE = 65_536, 1 / 16

_PAIRS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("company", T.StringType()), T.StructField("candidate", T.StringType()), T.StructField("score", T.DoubleType())]
)

_PAIRS_ARROW = pa.schema([("source", pa.string()), ("company", pa.string()), ("candidate", pa.string()), ("score", pa.float64())])


class Bags:
    """Bags of words that are asked for overlaps, by the rule of functions.text.lexical_overlap.

    Each word of an asking bag stands for all words here that it is related to, which are found by its own beginnings
    and ends and by those of the others.
    """

    def __init__(self, bags: Sequence[Sequence[str] | None]):
        self.none = np.array([x is None for x in bags], bool)
        self.number = {w: n for n, w in enumerate(sorted({w for bag in bags for w in bag or ()}))}
        self.parts: dict[str, set[int]] = {}
        for w, n in self.number.items():
            for part in self._ends(w):
                self.parts.setdefault(part, set()).add(n)
        self.known: dict[str, list[int]] = {}
        at, words = _places(bags, lambda w: (self.number[w],))
        order = np.argsort(words, kind="stable")
        self.holders = at[order]  # of all words, one word after the other
        self.counts = np.bincount(words, minlength=len(self.number))
        self.starts = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _ends(w: str) -> set[str]:
        return {w[:k] for k in range(3, len(w))} | {w[k:] for k in range(1, len(w) - 2)}

    def related(self, w: str) -> list[int]:
        if w not in self.known:
            found = set(self.parts.get(w, ())) if len(w) >= 3 else set()
            self.known[w] = list(found | {self.number[p] for p in {w} | self._ends(w) if p in self.number})
        return self.known[w]

    def asked(self, bags: Sequence[Sequence[str] | None]) -> Asked:
        return Asked(self, bags)

    def overlaps(self, bags: Sequence[Sequence[str] | None]) -> np.ndarray:
        return self.asked(bags).rows(slice(0, len(bags)))


class Asked:
    """What some bags ask of others. The words that join most pairs have a bit each, the pairs of the others are written one by one."""

    def __init__(self, there: Bags, bags: Sequence[Sequence[str] | None]):
        self.there, self.width = there, len(there.none)
        at, words = _places(bags, there.related)
        pairs = np.bincount(words, minlength=len(there.counts)) * there.counts
        busy = np.argsort(-pairs, kind="stable")
        self.planes, rest = [], np.ones(len(pairs), bool)
        for lo in range(0, len(busy), 64):
            some = busy[lo : lo + 64]
            if pairs[some].sum() * 4 <= len(bags) * self.width:
                break
            bit = np.zeros(len(pairs), np.uint64)
            bit[some] = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
            asking, held = np.zeros(len(bags), np.uint64), np.zeros(self.width, np.uint64)
            np.bitwise_or.at(asking, at, bit[words])
            np.bitwise_or.at(held, there.holders, np.repeat(bit, there.counts))
            self.planes.append((asking, held))
            rest[some] = False
        self.at, self.words = at[rest[words]], words[rest[words]]

    def rows(self, part: slice) -> np.ndarray:
        """The overlaps of the bags of a slice with all bags there."""
        out = np.zeros((part.stop - part.start, self.width), bool)
        lo, hi = np.searchsorted(self.at, (part.start, part.stop))
        counts = self.there.counts[self.words[lo:hi]]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        holders = self.there.holders[np.repeat(self.there.starts[self.words[lo:hi]], counts) + within]
        out[np.repeat(self.at[lo:hi] - part.start, counts), holders] = True
        for asking, held in self.planes:
            for n in range(0, self.width, 1_024):
                out[:, n : n + 1_024] |= (asking[part][:, None] & held[None, n : n + 1_024]) != 0
        return out


def _places(bags: Sequence[Sequence[str] | None], numbers: Callable[[str], Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bag, number of the word) of all words of all bags, bag by bag."""
    each = [[n for w in bag or () for n in numbers(w)] for bag in bags]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.repeat(np.arange(len(each)), sizes), np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum()))


class Gate:
    """Which pairs does lexical evidence allow? Words are None for an entity without any name; a scope is None for a general product."""

    def __init__(self, words: Sequence, scopes: Sequence, there_words: Sequence, there_scopes: Sequence):
        self.words, self.scopes = Bags(there_words).asked(words), Bags(there_scopes).asked(scopes)
        self.nameless, self.general = (np.array([x is None for x in bags], bool) for bags in (words, scopes))

    def rows(self, part: slice) -> np.ndarray:
        out = self.words.rows(part)
        out[self.nameless[part]] = True
        out[:, self.words.there.none] = True
        general, general_there = self.general[part], self.scopes.there.none
        if not (general.all() and general_there.all()):
            out &= (general[:, None] & general_there[None, :]) | (~general[:, None] & ~general_there[None, :] & self.scopes.rows(part))
        return out


class Side:
    """One block of a task, in the order of the ids, so that a stable order by score puts the smaller of equal candidates first."""

    def __init__(self, table: pa.Table, gated: bool):
        table = table.combine_chunks().sort_by("id")
        self.ids, self.company = table["id"].combine_chunks(), table["company"].combine_chunks()
        self.active = table["active"].to_numpy()
        vectors = table["vector"].combine_chunks()
        self.vectors = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1) if len(table) else np.empty((0, 0))
        self.words, self.scopes = (table["words"].to_pylist(), table["scope"].to_pylist()) if gated else (None, None)


def _bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shorter vectors whose products are no less than those of a and b: half of the coordinates along their main axes, and the length of the rest."""
    axes = np.linalg.eigh(a.T @ a + b.T @ b)[1][:, ::-1]
    half = a.shape[1] // 2

    def short(x: np.ndarray) -> np.ndarray:
        turned = x @ axes
        return np.concatenate([turned[:, :half], np.linalg.norm(turned[:, half:], axis=1, keepdims=True)], axis=1).astype(np.float32)

    return short(a), short(b)


def best_of(a: Side, b: Side, k: int, least: float | None, gated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, score): of each entity of a, the k best active candidates of every other company in b."""
    there = np.flatnonzero(b.active)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if not len(a.ids) or not len(there):
        return found[0]
    code = pa.chunked_array([a.company, b.company]).combine_chunks().dictionary_encode().indices.to_numpy()
    company, of_company = code[: len(a.ids)], code[len(a.ids) :]
    there = there[np.argsort(of_company[there], kind="stable")]
    cuts = np.flatnonzero(np.diff(of_company[there], prepend=-1, append=-1))
    candidates = b.vectors[there]
    left, right = a.vectors.astype(np.float32), candidates.astype(np.float32)
    longest = [float(np.sqrt(np.einsum("ij,ij->i", x, x).max())) for x in (a.vectors, candidates)]
    near = 4 * (left.shape[1] + 8) * 2.0**-24 * longest[0] * longest[1]  # twice what single precision may err
    bounds = _bounds(a.vectors, candidates) if least is not None and not gated and left.shape[1] >= 16 and np.isfinite(near) else None
    gate = Gate(a.words, a.scopes, [b.words[i] for i in there], [b.scopes[i] for i in there]) if gated else None

    for lo in range(0, len(a.ids), STRIP_ROWS):
        part = slice(lo, min(lo + STRIP_ROWS, len(a.ids)))
        denied = ~gate.rows(part) if gated else None
        pairs = []
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            rows = np.flatnonzero(company[part] != of_company[there[first]])
            if not len(rows):
                continue
            some = slice(None) if len(rows) == part.stop - lo else rows
            hits = None
            if bounds:
                hits = bounds[0][part][some] @ bounds[1][first:last].T >= least - near
                if np.count_nonzero(hits) > DENSE * hits.size:
                    hits = None
            if hits is None:
                score = left[part][some] @ right[first:last].T
                if gated:
                    np.copyto(score, -np.inf, where=denied[some, first:last])
                floor = np.full(len(rows), np.finfo(np.float32).min if least is None else least - near)
                if last - first > k:
                    kth = score.max(axis=1) if k == 1 else np.partition(score, -k, axis=1)[:, -k]
                    floor = np.maximum(floor, kth - near)
                hits = score >= floor.astype(np.float32)[:, None]
            i, j = np.divmod(np.flatnonzero(hits), last - first)
            pairs.append((lo + rows[i], first + j))
        if pairs:
            found.append(_best_pairs(a.vectors, candidates, *map(np.concatenate, zip(*pairs, strict=True)), of_company[there], k, least))
    i, j, score = map(np.concatenate, zip(*found, strict=True))
    return i, there[j], score


def _best_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, company: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the pairs of each (i, company of j), equal scores in the order of j. Each score is computed alike, so that equal vectors have equal ones."""
    score = np.empty(len(i))
    for lo in range(0, len(i), SCORED):
        at = slice(lo, lo + SCORED)
        score[at] = np.einsum("ij,ij->i", a[i[at]], b[j[at]])
    if least is not None:
        i, j, score = (x[score >= least] for x in (i, j, score))
    order = np.lexsort((j, -score, company[j], i))
    i, j, score = i[order], j[order], score[order]
    new = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(company[j], prepend=-1) != 0))
    best = np.arange(len(i)) - np.repeat(new, np.diff(new, append=len(i))) < k
    return i[best], j[best], score[best]


def _blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """``df`` with its block within the domain and the number of blocks of the domain: enough to keep all cores busy, of ``block_rows`` at most."""
    busy = 2 * df.sparkSession.sparkContext.defaultParallelism ** 0.5  # blocks whose pairs are about two tasks a core
    n = F.count(F.lit(1))
    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(64 * block_rows) / F.col("dim"))))
    rows = F.least(most, F.greatest(F.lit(min(block_rows, LEAST_ROWS)), F.ceil(n / busy)))
    sizes = df.groupBy("domain", "dim").agg(F.ceil(n / rows).cast("int").alias("blocks"))
    return df.join(F.broadcast(sizes), ["domain", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _dealt(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` once for each task (domain, dim, i, j) that their block takes part in.

    They are dealt by all four and to a fixed number of partitions: the rows of a domain would else stay in one task, or be coalesced into few by their bytes.
    """
    tasks = _blocks(rows, block_rows).select(*rows.columns, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select(*rows.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return tasks.repartition(max(256, 32 * rows.sparkSession.sparkContext.defaultParallelism), "domain", "dim", "i", "j")


def _search(df: DataFrame, k: int, least: float | None, gated: bool, block_rows: int) -> DataFrame:
    """``source, company, candidate, score``: the k best (gated: the best corroborated) active candidates of each other company.

    Entities without company, domain or vector take no part, nor do those with a null, NaN or infinite coordinate; vectors are compared with those of their own length. Equal scores go to the smaller candidate.
    """
    columns = ["id", "company", "domain", "dim", "vector", "active", *(["words", "scope"] if gated else [])]
    usable = df.where("id is not null and company is not null and domain is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('Infinity'))")
    rows = cut(usable.withColumn("dim", F.size("vector")).withColumn("active", F.coalesce("active", F.lit(False))).select(columns))

    def best(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[-2].as_py(), key[-1].as_py()
        first = Side(table.filter(pc.equal(table["block"], i)), gated)
        second = first if i == j else Side(table.filter(pc.equal(table["block"], j)), gated)
        out = []
        for a, b in ((first, second), (second, first))[: 1 if i == j else 2]:
            source, candidate, score = best_of(a, b, k, least, gated)
            out.append(pa.table([a.ids.take(pa.array(source)), b.company.take(pa.array(candidate)), b.ids.take(pa.array(candidate)), pa.array(score)], schema=_PAIRS_ARROW))
        return pa.concat_tables(out)

    found = _dealt(rows, block_rows).groupBy("domain", "dim", "i", "j").applyInArrow(best, _PAIRS)
    w = Window.partitionBy("source", "company").orderBy(F.desc("score"), "candidate")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_candidates(df: DataFrame, *, k: int = 3, min_score: float = 0.75, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``source, company, candidate, score, rank``: the k best candidates of every other company, from ``min_score`` on.

    ``df`` has id, company, domain, vector (array<double>, unit length) and active. An inactive entity can be a source, not a candidate.
    """
    return _search(df, k, min_score, False, block_rows)


def best_corroborated(df: DataFrame, *, auto: float = 0.90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``source, company, candidate, score, status``: the best candidate of every other company that lexical evidence allows, whatever its score.

    ``df`` has also words (the bag of content words, null for an entity without names) and scope.
    """
    best = _search(df, 1, None, True, block_rows).drop("rank")
    return best.withColumn("status", F.when(F.col("score") >= auto, "auto_confirmed").otherwise("pending_review"))


def unordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``key, a, b, score``: each unordered pair once, with its best score."""
    return pairs.groupBy(pair_key(F.col(a), F.col(b)).alias("key")).agg(
        F.min(F.least(a, b)).alias("a"), F.max(F.greatest(a, b)).alias("b"), F.max("score").alias("score")
    )


def pick_by_verdict(candidates: DataFrame, verdicts: DataFrame, *, key: str = "key") -> DataFrame:
    """The best candidate judged the same per (source, company), else the best one judged uncertain, else none.

    Candidates without a verdict are skipped.
    """
    order = F.when(F.col("verdict") == "same_coverage", 0).when(F.col("verdict") == "uncertain", 1)
    w = Window.partitionBy("source", "company").orderBy("priority", F.desc("score"), "candidate")
    judged = candidates.join(verdicts.select(key, "verdict"), key).withColumn("priority", order).where("priority is not null")
    return judged.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "priority")


def rebuild_protected(old: DataFrame, new: DataFrame, *, key: str = "id", status: str = "status", reviewed: Sequence[str] = ("confirmed", "rejected")) -> DataFrame:
    """Reviewed rows stay as they are; all others give way to the new rows that don't clash with a reviewed one."""
    kept = old.where(F.col(status).isin(*reviewed))
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def touching(matches: DataFrame, entity: str | Column, a: str = "document_id", b: str = "matched_document_id") -> DataFrame:
    """Matches that have the entity at either side, with the other side as ``other``."""
    x = F.lit(entity) if isinstance(entity, str) else entity
    return matches.where((F.col(a) == x) | (F.col(b) == x)).withColumn("other", F.when(F.col(a) == x, F.col(b)).otherwise(F.col(a)))


def with_both_sides(matches: DataFrame, docs: DataFrame, columns: Sequence[str], *, key: str = "id", a: str = "document_id", b: str = "matched_document_id") -> DataFrame:
    """Matches with columns of both documents as a_<column> and b_<column>; a match with a missing side is dropped."""
    left = docs.select(F.col(key).alias(a), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = docs.select(F.col(key).alias(b), *[F.col(c).alias(f"b_{c}") for c in columns])
    return matches.join(left, a).join(right, b)


def first_per_company(matches: DataFrame, docs: DataFrame, entity: str, wanted: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(the first match of an entity with each wanted company, in either direction; the wanted companies without one)."""
    other = docs.select(F.col("id").alias("other"), F.col("company_id").alias("company"))
    found = touching(matches, entity).join(other, "other").join(wanted.select("company"), "company", "left_semi")
    w = Window.partitionBy("company").orderBy(*order)
    picked = found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return picked, wanted.select("company").join(picked.select("company"), "company", "left_anti")

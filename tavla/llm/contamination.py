"""Evaluation texts that leaked into training texts.

Greedy string tiling of every document against the items with which it shares a seed: runs of at
least ``min_match`` equal words are found by Karp-Rabin hashes, the longest unmarked match is marked
first, and what is left of the others is tried again. Tiles whose gap is one changed or left-out
word are then read as one passage, and the longest passage and the tiled share of the item decide.

The items' hashed word runs are broadcast in blocks of bounded size, so that documents are
scanned where they lie and never shuffled.
"""

from __future__ import annotations

import bisect
import heapq
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavla.llm.bpe import CHARS_AT_ONCE, slices, spread

#: Words of items that one block may hold (about 200 bytes each once indexed). More items make more blocks.
BLOCK_WORDS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Marks, format characters and everything that is neither letter, digit nor blank vanish within a word.
_DROPPED = regex.compile(r"[^\p{L}\p{N}\s]+")


def words_of(text: str) -> list[str]:
    """The words of a text between blanks, regardless of case, punctuation, vowel points and invisible marks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROPPED.sub("", text.lower().replace("|", " ")).split()


def rolling_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash of every window, by one multiply-and-add sweep per word of the window."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = h * _BASE + x[k : k + n]
    return h


def tile(seeds: list[tuple[int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping (item, doc, length) tiles from the seeds (item, doc) where ``min_match`` words agree.

    Seeds on one diagonal are joined to maximal matches. The longest match is marked first (ties: the
    first in the item, then in the document); a match that a marked tile cuts is tried again with what is left.
    """
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for i, d in seeds:
        by_diagonal[d - i].append(i)
    heap = []
    for diagonal, starts in by_diagonal.items():
        starts.sort()
        begin = last = starts[0]
        for i in starts[1:]:
            if i > last + 1:
                heap.append((begin - last - min_match, begin, begin + diagonal))
                begin = i
            last = i
        heap.append((begin - last - min_match, begin, begin + diagonal))
    heapq.heapify(heap)
    item_marked: set[int] = set()
    doc_marked: set[int] = set()
    tiles = []
    while heap:
        negative, i, d = heapq.heappop(heap)
        length = -negative
        free = [i + k not in item_marked and d + k not in doc_marked for k in range(length)]
        if all(free):
            tiles.append((i, d, length))
            item_marked.update(range(i, i + length))
            doc_marked.update(range(d, d + length))
            continue
        k = 0
        while k < length:
            if not free[k]:
                k += 1
                continue
            e = k
            while e < length and free[e]:
                e += 1
            if e - k >= min_match:
                heapq.heappush(heap, (k - e, i + k, d + k))
            k = e
    return sorted(tiles)


def _edge(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the item that a passage gains at its end over one changed or left-out word; a and b follow the end."""
    best = 0
    for skip in (1, 0):  # changed, left out
        x, y = a[1:], b[skip:]
        n = min(len(x), len(y))
        same = x[:n] == y[:n]
        run = n if same.all() else int(np.argmin(same))
        if run:
            best = max(best, run + 1)
    return best


def longest_passage(tiles: list[tuple[int, int, int]], item: np.ndarray, doc: np.ndarray) -> int:
    """Words of the item in its longest passage: tiles with single changed or left-out words between them,
    and what follows one more such word at either end."""
    by_start = {(i, d): n for i, d, n in tiles}
    reached: set[tuple[int, int]] = set()
    best = 0
    for i, d, n in tiles:
        if (i, d) in reached:
            continue
        ei, ed = i + n, d + n
        while True:
            nxt = next(((ei + 1, ed + gap) for gap in (1, 0) if (ei + 1, ed + gap) in by_start), None)
            if nxt is None:
                break
            reached.add(nxt)
            ei, ed = nxt[0] + by_start[nxt], nxt[1] + by_start[nxt]
        length = ei - i + _edge(item[ei:], doc[ed : ed + len(item)]) + _edge(item[:i][::-1], doc[max(0, d - len(item)) : d][::-1])
        best = max(best, length)
    return best


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b begin with in common."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    return n if same.all() else int(np.argmin(same))


def longest_chain(seeds: list[tuple[int, int]], item: np.ndarray, doc: np.ndarray, min_match: int) -> int:
    """As ``longest_passage``, over all maximal matches: a tile elsewhere takes no words from a passage.

    Where a word is repeated, the last word of a match may stand for its repetition, the first having been left out; then the
    match must be long enough without it. The same holds for the first word of a passage.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each diagonal, by their beginnings
    for i, d in sorted(seeds):
        found = runs[d - i]
        if found and found[-1][1] >= i + min_match - 1:
            found[-1] = (found[-1][0], i + min_match)
        else:
            found.append((i, i + min_match))
    starts = {diagonal: [b for b, _ in found] for diagonal, found in runs.items()}
    best = 0
    for diagonal, found in runs.items():
        for begin, end in found:
            head = item[:begin][::-1]
            d = begin + diagonal
            before = _edge(head, doc[max(0, d - len(item)) : d][::-1])
            before_spare = _alike(head, doc[max(0, d + 1 - len(item)) : d + 1][::-1])
            todo = [(diagonal, begin, end, 0)]
            seen: set[tuple[int, int, int, int]] = set()
            while todo:
                state = todo.pop()
                if state in seen:
                    continue
                seen.add(state)
                at, since, ei, first = state  # first: the words before the first change, none as long as there is none
                rest = item[ei:]
                after = _edge(rest, doc[ei + at : ei + at + len(item)])
                after_spare = _alike(rest, doc[ei + at - 1 : ei + at - 1 + len(item)])
                length = ei - since
                if first:
                    gain = max(before, before_spare if first > min_match else 0) + max(after, after_spare if length > min_match else 0)
                else:
                    both = [before + after, before_spare, after_spare]
                    if length > min_match:
                        both += [before_spare + after, before + after_spare]
                    if length > min_match + 1:
                        both.append(before_spare + after_spare)
                    gain = max(both)
                best = max(best, ei - begin + gain)
                for to in (at, at - 1):  # changed, left out
                    k = bisect.bisect_right(starts.get(to, ()), ei + 1) - 1
                    if k < 0:
                        continue
                    b, e = runs[to][k]
                    # Words that both runs have may stand on either side of the left-out one.
                    shift = max(0, min_match - (e - ei - 1))
                    if e > ei + 1 and b <= ei + 1 - shift and length - shift >= min_match:
                        todo.append((to, ei + 1 - shift, e, first or length - shift))
    return best


class ItemIndex:
    """The hashed word runs of one block of items."""

    def __init__(self, items: list[tuple[object, str]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.keys = [k for k, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], np.int64) for _, t in items]
        hashes, owner, at = [], [], []
        for n, w in enumerate(self.words):
            h = rolling_hashes(w, min_match)
            hashes.append(h)
            owner.append(np.full(len(h), n))
            at.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.empty(0, np.int64)

    def document_ids(self, text: str) -> np.ndarray:
        """Word numbers of a text; words that no item has are -1."""
        get = self.vocabulary.get
        words = words_of(text)
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(number of the item, tiles) of every item that shares a run of ``min_match`` words with a document."""
        for n, found in self.seeds(ids):
            yield n, tile(found, self.min_match)

    def seeds(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(number of the item, places in item and document of the runs of ``min_match`` words they share) of every such item."""
        m = self.min_match
        if len(ids) < m or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        where = np.flatnonzero(known[m:] - known[:-m] == m)  # windows without a foreign word
        if not len(where):
            return
        h = rolling_hashes(ids, m)[where]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in np.flatnonzero(hi > lo):
            d = int(where[k])
            for j in range(lo[k], hi[k]):
                n, i = int(self.owner[j]), int(self.at[j])
                if np.array_equal(self.words[n][i : i + m], ids[d : d + m]):  # a hash proves nothing
                    seeds[n].append((i, d))
        yield from seeds.items()


def find_leaks(
    docs: DataFrame,
    doc_key: str,
    doc_text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    *,
    min_match: int = 6,
    min_words: int = 18,
    min_share: float | None = None,
) -> DataFrame:
    """``<doc_key>, <item_key>, passage_words, tiled_words, item_words``: every document with a passage of at least
    ``min_words`` successive words of an item (single changed or left-out words may occur, with ``min_match`` unchanged
    ones between them), or, where ``min_share`` is given, whose tiles in whatever order cover at least that share of an item.

    Defined results: null and empty texts and items leak nothing; items of fewer words than ``min_words`` are never
    found; repeated rows are reported each; an empty table on either side gives an empty result; further columns are
    ignored, whatever their names.
    """
    doc_field, item_field = docs.schema[doc_key], items.schema[item_key]
    from pyspark.sql.types import IntegerType, StructField, StructType

    out_item = item_field.name if item_field.name != doc_field.name else f"item_{item_field.name}"
    schema = StructType(
        [StructField(doc_field.name, doc_field.dataType), StructField(out_item, item_field.dataType)]
        + [StructField(n, IntegerType()) for n in ("passage_words", "tiled_words", "item_words")]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    spark = docs.sparkSession
    texts = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("k"), F.col(item_text).alias("t"))
    size = texts.agg(F.coalesce(F.sum(F.length("t") / 4 + 1), F.lit(0)).alias("n")).first()["n"]  # words are seldom shorter
    blocks = int(size // BLOCK_WORDS) + 1
    corpus = spread(docs.select(F.col(doc_key), F.col(doc_text)).where(F.length(doc_text) >= min_words))

    def scan(block: DataFrame) -> DataFrame:
        index = spark.sparkContext.broadcast(ItemIndex([(r["k"], r["t"]) for r in block.toLocalIterator()], min_match))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix: ItemIndex = index.value
            for batch in batches:
                keys, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for part in slices(list(map(len, whole)), CHARS_AT_ONCE):
                    rows = []
                    for key, text in zip(keys[part], whole[part], strict=True):
                        ids = ix.document_ids(text)
                        for n, seeds in ix.seeds(ids):
                            item, tiles = ix.words[n], tile(seeds, min_match)
                            passage = max(longest_passage(tiles, item, ids), longest_chain(seeds, item, ids, min_match))
                            tiled = sum(t[2] for t in tiles)
                            if len(item) >= min_words and (passage >= min_words or (min_share is not None and tiled >= min_share * len(item))):
                                rows.append((key, ix.keys[n], passage, tiled, len(item)))
                    columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return corpus.mapInArrow(run, schema)

    found = scan(texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == 0))
    for b in range(1, blocks):
        found = found.unionByName(scan(texts.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)))
    return found

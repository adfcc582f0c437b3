"""Mapping freely typed values to the closest entry of a reference list.

The reference forms stand in a BK-tree under the Levenshtein distance, a true metric; a node's child at edge e
can hold an answer within r of a query only if e lies within r of the query's distance to the node. Queries run through the tree in
batches: one bit-parallel distance computation serves all (query, node) pairs of a level. Every distinct value is searched once.
The tree is broadcast; a list above ``SHARD_FORMS`` finished forms is cut into shards, and the winners of the shards are
merged by the whole score. What depends on the list as a whole (implied forms, known words) is derived before it is cut.

The forms of an entry are its name and synonyms and what the list itself implies: where many entries share the
first part of their code and the beginning of a form, or the last part and the end of a form, beginnings and ends are recombined.
A list whose codes have no such parts is taken as it stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavla.session import cut, discard

UNMATCHED = "UNMATCHED"

#: Forms that one broadcast tree may hold (under 1 kB each); a longer list is searched shard by shard.
SHARD_FORMS = 50_000
#: Values a worker remembers with their answers before it starts afresh.
REMEMBERED = 200_000
#: (query, node) pairs whose distances are computed at a time.
PAIRS_AT_ONCE = 200_000

#: A word outside the list is one in its own right if it is at least this share of the words of all distinct values, so at most 1 / share words are.
OWN_WORD_SHARE = 1 / 8_000
#: Distinct words of the list, a category each, that may be broadcast (16 bytes each); a list of more is refused.
MOST_WORDS = 16_000_000
#: A value that is more than this share of all rows gets its answer by broadcast (at most 1 / share values), the others by shuffle.
HOT_SHARE = 1 / 2_000
#: Codes that must share a beginning or an end for it to be recombined.
SUPPORT = 3

# Final letters and the letters they stand for.
FINAL_LETTERS = str.maketrans("ךםןףץ", "כמנפצ")

_QUOTES = re.compile(r"['\"`׳״’‘“”]")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_OTHER = re.compile(r"[^\w\s]|_")
_REFERENCE = re.compile(r"\[[^\]]*\]\s*[^\w]*$")
_SEPARATOR = re.compile(r"\s*[:,;]\s+|\s+[-–]\s+|\*\s*-\s+")


def bare(text: str) -> str:
    """Text without vowel points and invisible marks, in lower case, final letters as the others."""
    if text.isascii():
        return text.casefold()
    return _MARKS.sub("", unicodedata.normalize("NFKC", text)).casefold().translate(FINAL_LETTERS)


def plain(text: str) -> str:
    """Words of a :func:`bare` text with single blanks between them; punctuation parts words, quotes don't."""
    return " ".join(_OTHER.sub(" ", _QUOTES.sub("", text)).split())


def damerau(a: Sequence, b: Sequence) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions. A common beginning and end don't matter."""
    if a == b:
        return 0
    lo, least = 0, min(len(a), len(b))
    while lo < least and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b or (len(a) == 1 and len(b) == 1):
        return max(len(a), len(b))
    last: dict = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            row, before = last.get(y, 0), column
            cost = x != y
            if not cost:
                column = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][before] + (i - row - 1) + 1 + (j - before - 1))
        last[x] = i
    return d[len(a) + 1][len(b) + 1]


@lru_cache(REMEMBERED)
def near_carrier(got: str, carrier: str) -> bool:
    """One letter apart, two from a long carrier. The same few beginnings and ends come again and again."""
    return damerau(got, carrier) <= 1 + (len(carrier) > 7)


@lru_cache(REMEMBERED)
def word_distance(a: str, b: str) -> int:
    return damerau(a, b)


def bag_distance(a: str, b: str) -> int:
    """Letters of the longer rest after what both texts have is taken away: no edit distance, transpositions included, is smaller."""
    more = sum(n for x in set(a) if (n := a.count(x) - b.count(x)) > 0)
    return max(more, more + len(b) - len(a))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


class BKTree:
    """A BK-tree over distinct strings that answers batches of queries."""

    def __init__(self, forms: list[str]):
        self.forms = forms
        letters = sorted({c for f in forms for c in f})
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: a letter that no form has
        self.lengths = np.array([len(f) for f in forms], np.int64)
        self.wide = int(self.lengths.max(initial=0)) > 63  # beyond one machine word distances take the plain recurrence
        if not self.wide:
            self.masks = np.zeros((len(forms), len(letters) + 1), np.uint64)
            for n, f in enumerate(forms):
                for k, c in enumerate(f):
                    self.masks[n, self.code[c]] |= np.uint64(1 << k)
        self._build()

    def _build(self) -> None:
        """All forms start at the root; those at one distance of a node form its subtree at that edge."""
        self.edge = np.zeros(len(self.forms), np.int64)
        parent = np.full(len(self.forms), -1, np.int64)
        pending = [np.arange(len(self.forms))] if self.forms else []
        while pending:
            group = pending.pop()
            node, rest = group[0], group[1:]
            if not len(rest):
                continue
            codes, lengths = self.encode([self.forms[node]])
            far = self.distances(np.zeros(len(rest), np.int64), rest, codes, lengths)
            for d in np.unique(far):
                child = rest[far == d]
                parent[child[0]], self.edge[child[0]] = node, d
                pending.append(child)
        # Children of a node stand together, by edge.
        self.span = int(self.edge.max(initial=0)) + 2
        keys = np.where(parent >= 0, parent * self.span + self.edge, -1)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def encode(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(q) for q in queries], np.int64)
        codes = np.zeros((len(queries), int(lengths.max(initial=0)) + 1), np.int64)
        for n, q in enumerate(queries):
            codes[n, : len(q)] = [self.code.get(c, 0) for c in q]
        return codes, lengths

    def distances(self, q: np.ndarray, node: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Levenshtein distances of the pairs (query q, form node)."""
        out = np.empty(len(q), np.int64)
        for lo in range(0, len(q), PAIRS_AT_ONCE):
            part = slice(lo, lo + PAIRS_AT_ONCE)
            out[part] = (self._plain if self.wide else self._bits)(q[part], node[part], codes, lengths)
        return out

    def _bits(self, q: np.ndarray, node: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bit-parallel columns: bit k of plus and minus tells how a cell differs from the one above it."""
        one = np.uint64(1)
        m = self.lengths[node]
        top = (m - 1).clip(0).astype(np.uint64)
        plus, minus = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), np.uint64)
        score, n = m.copy(), lengths[q]
        letters, masks, row = np.ascontiguousarray(codes.T), self.masks.ravel(), node * self.masks.shape[1]
        for j in range(int(n.max(initial=0))):
            eq = masks.take(row + letters[j].take(q))
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(horizontal | plus), plus & horizontal
            active = j < n
            score += np.where(active, ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64), 0)
            up, down = (up << one) | one, down << one
            plus, minus = down | ~(vertical | up), up & vertical
        return np.where(m == 0, n, score)

    def _plain(self, q: np.ndarray, node: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        back = {v: k for k, v in self.code.items()}
        texts = {int(x): "".join(back.get(int(c), "\0") for c in codes[x, : lengths[x]]) for x in np.unique(q)}
        return np.array([levenshtein(texts[int(x)], self.forms[int(n)]) for x, n in zip(q, node, strict=True)], np.int64)

    def within(self, queries: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, form, distance) of every form within a query's radius."""
        found = [(np.empty(0, np.int64),) * 3]
        if not self.forms or not queries:
            return found[0]
        codes, lengths = self.encode(queries)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = self.distances(q, node, codes, lengths)
            near = d <= radius[q]
            found.append((q[near], node[near], d[near]))
            lo = np.searchsorted(self.keys, node * self.span + (d - radius[q]).clip(0), "left")
            hi = np.searchsorted(self.keys, node * self.span + (d + radius[q]).clip(None, self.span - 1), "right")
            count = (hi - lo).clip(0)
            ends = np.cumsum(count)
            child = self.order[np.repeat(lo - (ends - count), count) + np.arange(int(ends[-1]))]
            q, node = np.repeat(q, count), child
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def finished_forms(entries: DataFrame, rewrites: Sequence[tuple[str, str]], support: int = SUPPORT) -> DataFrame:
    """``c, form, k``: every plain form of a category with the code it stands for, from entries ``c, k, t`` (category, code, texts).

    Beside its own forms a code has those that recombine beginnings and ends: a form is parted where its beginning is shared by the most
    codes with the same first part and its end by the most with the same last part, at least ``support`` of each. A written form
    wins over one that ``rewrites`` make, then the smaller code.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, k, p) for c, k, ts in zip(pdf["c"], pdf["k"], pdf["t"], strict=True) for t in ts if t and (p := plain(bare(t)))]
            yield pd.DataFrame(rows, columns=["c", "k", "form"])

    own = cut(entries.mapInPandas(flatten, "c string, k string, form string").distinct())
    part = F.split("k", "_")
    parted = own.where(F.size(part) == 2).select("c", "k", "form", part[0].alias("first"), part[1].alias("last"), F.split("form", " ").alias("words"))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = parted.where(F.size("words") > 1).select("*", at.alias("at"))
    cuts = cuts.select(
        "c", "k", "form", "first", "last", "at", F.array_join(F.slice("words", F.lit(1), F.col("at")), " ").alias("head"), F.array_join(F.slice("words", F.col("at") + 1, F.size("words")), " ").alias("tail")
    )
    begins = cuts.groupBy("c", "first", "head").agg(F.count(F.lit(1)).alias("nb"))
    ends = cuts.groupBy("c", "last", "tail").agg(F.count(F.lit(1)).alias("ne"))
    counted = cuts.join(begins, ["c", "first", "head"]).join(ends, ["c", "last", "tail"])
    best = cut(
        counted.groupBy("c", "k", "form", "first", "last").agg(F.max(F.struct(F.least("nb", "ne").alias("n"), "at", "head", "tail")).alias("b")).where(F.col("b.n") >= support).select("c", "first", "last", "b.head", "b.tail")
    )
    latin = lambda c: c.rlike(r"^\p{ASCII}*$")
    heads = best.select("c", "first", "head", latin(F.col("head")).alias("script")).distinct()
    tails = best.select("c", "last", "tail", latin(F.col("tail")).alias("script")).distinct()
    codes = parted.select("c", "k", "first", "last").distinct()
    implied = codes.join(heads, ["c", "first"]).join(tails, ["c", "last", "script"]).select("c", "k", F.concat_ws(" ", "head", "tail").alias("form"))
    patterns = [(plain_rewrite(old), new) for old, new in rewrites]

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, k, f in zip(pdf["c"], pdf["k"], pdf["form"], strict=True):
                rows.append((c, k, f, 0))
                rows += [(c, k, " ".join(f.replace(old, new, 1).split()), 1) for old, new in patterns if old in f]
            yield pd.DataFrame(rows, columns=["c", "k", "form", "level"])

    every = own.unionByName(implied).mapInPandas(rewritten, "c string, k string, form string, level int")
    return cut(every.groupBy("c", "form").agg(F.min(F.struct("level", "k")).alias("b")).select("c", "form", F.col("b.k").alias("k")))


class Words:
    """The words of the list, or with ``category`` those of one category, held by their 64-bit hashes as Spark's xxhash64 gives them."""

    def __init__(self, hashes: np.ndarray, category: str | None = None):
        self.hashes = hashes  # sorted
        self.before = "" if category is None else category + "\0"
        self.asked: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        got = self.asked.get(word)
        if got is None:
            if len(self.asked) > REMEMBERED:
                self.asked.clear()
            h = np.uint64(xxhash.xxh64_intdigest((self.before + word).encode(), 42)).astype(np.int64)
            at = int(np.searchsorted(self.hashes, h))
            got = self.asked[word] = at < len(self.hashes) and bool(self.hashes[at] == h)
        return got


class Matcher:
    """Maps typed values to codes by one shard of the forms of one category."""

    def __init__(self, codes: dict[str, str], known: Words | set[str], own_words: set[str], openers: Sequence[str], closers: Sequence[str]):
        self.tree = BKTree(sorted(codes))
        self.codes = [codes[f] for f in self.tree.forms]
        self.own_words = own_words
        self.known = known
        self.own_by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(own_words):
            self.own_by_length[len(w)].append(w)
        self.openers = [(c, c.replace(" ", ""), c.count(" ") + 1) for c in sorted((plain(bare(x)) for x in openers), key=len, reverse=True)]
        self.closers = [(c, c.replace(" ", ""), c.count(" ") + 1) for c in sorted((plain(bare(x)) for x in closers), key=len, reverse=True)]
        self.reach = 1 + max((k for _, _, k in (*self.openers, *self.closers)), default=1)
        self.opened: dict[tuple, tuple[int, str] | None] = {}
        self.closed: dict[tuple, int] = {}

    def _misspelt(self, got: str, carrier: str) -> bool:
        """Is this the carrier with one letter wrong (two in a long one), and no word of the list?"""
        most = 1 + (len(carrier) > 7)
        if len(carrier) <= 3 or abs(len(got) - len(carrier)) > most or len(set(got).difference(carrier)) > most:  # an edit brings one new letter at most
            return False
        return got not in self.known and near_carrier(got, carrier)

    def _opener(self, words: tuple[str, ...], more: bool) -> tuple[int, str] | None:
        """(words taken by a carrier at the beginning, rest of the last of them); ``more`` tells whether further words follow."""
        for carrier, want, k in self.openers:
            for n in dict.fromkeys((k, max(1, k - 1), k + 1)) if k > 1 else (1,):
                if n > len(words) or (n == len(words) and not more):
                    continue
                got = "".join(words[:n])
                # A one-letter end of the carrier is written together with the next word.
                if carrier[-2:-1] == " " and n == k and got.startswith(want) and len(got) > len(want) + 1:
                    return n, got[len(want) :]
                if got == want or self._misspelt(got, want):
                    return n, ""
        return None

    def _closer(self, words: tuple[str, ...], more: bool) -> int:
        """Words taken by a carrier at the end."""
        for _, want, k in self.closers:
            for n in dict.fromkeys((k, max(1, k - 1), k + 1)) if k > 1 else (1,):
                if n < len(words) or (n == len(words) and more):
                    got = "".join(words[-n:])
                    if got == want or self._misspelt(got, want):
                        return n
        return 0

    def _strip(self, words: list[str]) -> Iterator[list[str]]:
        """The words, and the words without each carrier that stands, perhaps misspelt, at either end."""
        yield words
        if len(self.opened) > REMEMBERED or len(self.closed) > REMEMBERED:
            self.opened.clear(), self.closed.clear()
        changed = True
        while changed and words:
            changed = False
            more = len(words) > self.reach
            # The same few beginnings and ends come again and again.
            key = (more, *words[: self.reach])
            if key not in self.opened:
                self.opened[key] = self._opener(key[1:], more)
            if found := self.opened[key]:
                words, changed = [*([found[1]] if found[1] else []), *words[found[0] :]], True
                yield words
            more = len(words) > self.reach
            key = (more, *words[-self.reach :])
            if key not in self.closed:
                self.closed[key] = self._closer(key[1:], more)
            if n := self.closed[key]:
                words, changed = words[:-n], True
                yield words
            if not changed and len(words) > 1 and (words[0].isdigit() or len(words[0]) == 1):  # an enumeration
                words, changed = words[1:], True
                yield words
            if not changed and len(words) > 1 and words[-1].isdigit():
                words, changed = words[:-1], True
                yield words

    def variants(self, value: str) -> list[str]:
        """The readings of a value, the plainest first: as typed, without enumerations and carriers, parts exchanged at a separator."""
        t = _REFERENCE.sub("", bare(value))
        seen: dict[str, None] = {}
        for words in self._strip(plain(t).split()):
            if words:
                seen.setdefault(" ".join(words))
        for sep in _SEPARATOR.finditer(t):
            left, right = plain(t[: sep.start()]), plain(t[sep.end() :])
            if left and right:
                for words in self._strip(right.split()):
                    for front in self._strip(left.split()):
                        seen.setdefault(" ".join([*words, *front]))
        return list(seen)

    def _strange(self, query: str, form: str) -> bool:
        """Does the query hold a word that no word of the form stands for: one of the list's or one in its own right, one
        closer to such a word, or one unlike all?"""
        words = form.split()
        there = {*words, *map("".join, zip(words, words[1:], strict=False))}  # a blank may be missing
        for w in query.split():
            if w in there or w.isdigit() or len(w) < 3:
                continue
            far = 4
            for x in there:
                if abs(len(w) - len(x)) < far:
                    far = min(far, word_distance(w, x))
                    if far < 2:
                        break
            if far < 2:
                continue
            if w in self.own_words or w in self.known or far > max(2, len(w) // 2):
                return True
            for n in range(len(w) - 3, len(w) + 4):
                for x in self.own_by_length.get(n, ()):
                    if abs(n - len(w)) < far and word_distance(w, x) < min(far, len(w) // 3 + 1):
                        return True
        return False

    def match(self, values: list[str]) -> list[tuple[int, int, int, str] | None]:
        """The score of every value's closest form within a sixth of its length plus one, four at most; None where there is none.

        A score is (distance, Levenshtein distance, -length of the reading, code), the smallest wins: distances count a
        transposition as one, so the tree is asked for forms within twice the accepted distance, as far as needed.
        """
        readings = [self.variants(v) for v in values]
        best: list[tuple | None] = [None] * len(values)
        longest = int(self.tree.lengths.max(initial=0))
        for radius in (0, 1, 2, 4, 8):
            # Four transpositions are eight edits, and beyond four edits lie distances of three or more.
            asked: dict[str, list[int]] = defaultdict(list)
            for n, x in enumerate(readings):
                if best[n] is None or (radius > 4 and best[n][0] > 3):
                    for r in x:
                        # Three are accepted of twelve letters on; five edits then change the length by one.
                        if len(r) <= longest + radius and (radius <= 4 or len(r) > 10):
                            asked[r].append(n)
            if not asked:
                break
            queries = list(asked)
            limits = np.array([min(radius, 2 * ((len(r) + 4) // 6 + 1)) if radius > 1 else radius for r in queries], np.int64)
            q, node, d = self.tree.within(queries, limits)
            order = np.argsort(d, kind="stable")
            near: dict[int, tuple] = {}  # the best score of every reading
            for q, node, d in zip(q[order].tolist(), node[order].tolist(), d[order].tolist(), strict=True):
                query, form = queries[q], self.tree.forms[node]
                most = min(4, len(form) // 6 + 1) if len(form) > 4 else 1
                held = near.get(q)
                if held is not None:
                    most = min(most, held[0])
                if (d + 1) // 2 > most or (d > 1 and bag_distance(query, form) > most):
                    continue
                exact = d if d < 2 else damerau(query, form)
                if exact > most:
                    continue
                score = (exact, d, -len(query), self.codes[node])
                if (held is None or score < held) and not (exact and self._strange(query, form)):
                    near[q] = score
            for q, score in near.items():
                for n in asked[queries[q]]:
                    if best[n] is None or score < best[n]:
                        best[n] = score
        return best


def plain_rewrite(old: str) -> str:
    """A rewrite's pattern in the letters of plain forms."""
    return old.casefold().translate(FINAL_LETTERS)


def own_words(frequent: list[str], near: set[str], known: Words | set[str], openers: Sequence[str], closers: Sequence[str]) -> set[str]:
    """The frequent words that are no misspelling (``near``), joining or prefixing of known ones or of carriers' words."""
    carriers = {w for c in (*openers, *closers) for w in plain(bare(c)).split()}
    has = lambda w: w in carriers or w in known
    left = sorted(w for w in frequent if not has(w) and not w.isdigit() and len(w) > 1 and w not in near)
    close = {w for w in left for c in carriers if abs(len(w) - len(c)) < 2 and damerau(w, c) < 2}
    return {w for w in left if w not in close and not any(has(w[:k]) and has(w[k:]) for k in range(2, len(w) - 1))}


def shortened_keys(word: str) -> list[str]:
    """The word and what one letter left out makes of it: words within one edit or transposition share one of them."""
    return [word, *{word[:k] + word[k + 1 :] for k in range(len(word))}]


def _near_words(frequent: DataFrame, words: DataFrame) -> set[str]:
    """The frequent words (column w, a bounded number) within one edit of a word of the list."""
    rows = [(w, k) for (w,) in frequent.select("w").toLocalIterator() for k in shortened_keys(w)]
    if not rows:
        return set()
    asked = frequent.sparkSession.createDataFrame(rows, "w string, key string")
    keys = F.array_union(F.array("x"), F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.concat(F.substring("x", F.lit(1), i - 1), F.substring("x", i + 1, F.length("x")))))
    listed = words.select(F.col("w").alias("x")).select("x", F.explode(keys).alias("key"))
    pairs = listed.join(F.broadcast(asked), "key").select("w", "x").distinct()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"w": [w for w, x in zip(pdf["w"], pdf["x"], strict=True) if damerau(w, x) < 2]}, dtype=object)

    return {r["w"] for r in pairs.mapInPandas(close, "w string").distinct().collect()}


def map_to_canonical(
    items: DataFrame,
    value: str,
    category: str,
    reference: DataFrame,
    *,
    code: str,
    code_category: str,
    name: str,
    synonyms: str,
    out: str = "matched_code",
    openers: Sequence[str] = (),
    closers: Sequence[str] = (),
    rewrites: Sequence[tuple[str, str]] = (),
    own_word_share: float = OWN_WORD_SHARE,
    shard_forms: int = SHARD_FORMS,
) -> DataFrame:
    """``items`` with ``out``: the code of the entry of the item's category that its value means, or ``UNMATCHED``.

    Every row of ``items`` gives one row. Distinct values are searched once; their answers come back to the rows by broadcast for values that
    make a large share of all rows, by shuffle for the others. ``openers`` and ``closers`` are carrier phrases around an
    item, ``rewrites`` other ways to write a form. ``own_word_share`` guards against words that lie close to the list but mean
    something else: a word in that many distinct values is no misspelling.

    Defined results: null and blank values and those of unknown or null categories are UNMATCHED; null or empty
    synonyms leave the name alone; entries with a null code or category are ignored; an empty list leaves all UNMATCHED; further
    columns are kept, except that ``out`` replaces one of its name. The result doesn't depend on the number of shards.
    """
    spark = items.sparkSession
    texts = F.concat(F.array(F.col(name)), F.coalesce(F.col(synonyms), F.array().cast("array<string>")))
    entries = reference.where(F.col(code).isNotNull() & F.col(code_category).isNotNull()).select(F.col(code_category).alias("c"), F.col(code).alias("k"), texts.alias("t"))
    forms = finished_forms(entries, rewrites)
    told = cut(forms.select("c", F.explode(F.split("form", " ")).alias("w")).distinct())
    if told.count() > MOST_WORDS:
        raise ValueError(f"the list has more than {MOST_WORDS} distinct words")
    listed = told.select("w").distinct()
    hashes = told.select(F.explode(F.array(F.xxhash64("w"), F.xxhash64(F.concat("c", F.lit("\0"), "w")))).alias("h")).toArrow()["h"].to_numpy()
    hashes = np.unique(hashes)

    asked = items.groupBy(F.col(category).alias("c"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = cut(asked.where("c is not null and v is not null"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = Counter(w for v in pdf["v"] for w in plain(bare(v)).split())
            if counts:  # blank values alone have no words
                yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})

    typed = cut(values.select("v").mapInPandas(split, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    totals = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).crossJoin(typed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"))).first()
    # At most 1 / share words; each is one in its own right.
    frequent = typed.where(F.col("n") >= max(3, totals["words"] * own_word_share)).join(listed, "w", "left_anti")
    own = own_words([r["w"] for r in frequent.collect()], _near_words(frequent, listed), Words(hashes), openers, closers)

    shards = -(-forms.count() // shard_forms) or 1
    schema = "c string, v string, far int, edits int, reading int, code string"

    def answers(shard: DataFrame) -> DataFrame:
        codes: dict[str, dict[str, str]] = defaultdict(dict)
        for r in shard.toLocalIterator():
            codes[r["c"]][r["form"]] = r["k"]
        sent = spark.sparkContext.broadcast({c: Matcher(x, Words(hashes, c), own, openers, closers) for c, x in codes.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for c, part in pdf.groupby("c", sort=False)["v"]:
                    if c in sent.value:
                        got = part.tolist()
                        rows += [(c, v, *s) for v, s in zip(got, sent.value[c].match(got), strict=True) if s]
                yield pd.DataFrame(rows, columns=["c", "v", "far", "edits", "reading", "code"])

        # Written at once, so that the driver and the executors hold one shard at a time.
        found = cut(values.select("c", "v").repartition(spark.sparkContext.defaultParallelism, "c", "v").mapInPandas(run, schema))
        sent.destroy()
        return found

    parts = [answers(forms if shards == 1 else forms.where(F.pmod(F.xxhash64("form"), F.lit(shards)) == s)) for s in range(shards)]
    score = F.struct("far", "edits", "reading", "code")
    won = cut(reduce(DataFrame.unionByName, parts).groupBy("c", "v").agg(F.min(score).alias("s")).select("c", "v", F.col("s.code").alias("__code")))
    for table in (typed, forms, told, *parts):
        discard(table)
    keyed = won.select(F.col("c").alias("__c"), F.col("v").alias("__v"), "__code")
    # Every row of the most common values looks its answer up; the others go through a shuffle. A row that has its answer is dealt anywhere.
    hot = values.where(F.col("n") > totals["rows"] * HOT_SHARE).select(F.col("c").alias("__c"), F.col("v").alias("__v"))
    common = hot.join(keyed, ["__c", "__v"], "left").select("__c", "__v", F.coalesce("__code", F.lit(UNMATCHED)).alias("__hot"))
    dealt = [c for c, t in items.dtypes if "map<" not in t and "variant" not in t]
    plain_items = items.drop(out) if out in items.columns and out not in (value, category) else items
    marked = plain_items.join(F.broadcast(common), (F.col(category) == F.col("__c")) & (F.col(value) == F.col("__v")), "left").drop("__c", "__v")
    cold = marked.withColumns(
        {
            "__cold": F.col("__hot").isNull() & F.col(value).isNotNull(),
            "__cat": F.coalesce(F.col(category), F.lit("")),
            "__key": F.when(F.col("__hot").isNull() & F.col(value).isNotNull(), F.col(value)).otherwise(F.xxhash64(*[c for c in dealt if c in plain_items.columns]).cast("string")),
        }
    )
    rest = keyed.select(F.lit(True).alias("__cold"), F.col("__c").alias("__cat"), F.col("__v").alias("__key"), "__code")
    found = cold.join(rest, ["__cold", "__cat", "__key"], "left")
    return found.withColumn(out, F.coalesce("__hot", "__code", F.lit(UNMATCHED))).drop("__hot", "__code", "__key", "__cold", "__cat")

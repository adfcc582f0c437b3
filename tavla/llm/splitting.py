"""Splitting oversized texts at natural boundaries.

Boundaries between pre-tokens have a strength: paragraph, line, sentence, clause, blank, none. A sparse
table over the strengths answers which boundary of a permissible window is the strongest; ties go to
the rightmost. The next piece steps back from the cut by the overlap, again to the strongest boundary near it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavla.llm.bpe import CHARS_AT_ONCE, Encoder, load_model, slices, spread

PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, NONE = 5, 4, 3, 2, 1, 0

SENTENCE_END = re.compile(r"""[.!?…׃。]["'’”)\]]*$""")
CLAUSE_END = re.compile(r"""[,;:–—|]["')\]]*$""")


class StrongestBoundary:
    """Sparse table for range maxima; of equal strengths the rightmost is the answer."""

    def __init__(self, strengths: np.ndarray):
        n = len(strengths)
        # The position in the low bits lets a plain maximum break ties rightward.
        level = strengths.astype(np.int64) * (n + 1) + np.arange(n)
        self.levels, self.mod, span = [level], n + 1, 1
        while 2 * span <= n:
            level = np.maximum(level[:-span], level[span:])
            self.levels.append(level)
            span *= 2

    def query(self, lo: int, hi: int) -> int:
        """The strongest position in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]) % self.mod)


def boundary_strength(before: str, after: str) -> int:
    """The strength of the boundary between two neighbouring pre-tokens."""
    if before.isspace():
        if after.isspace():
            return NONE  # the run of blanks goes on
        breaks = before.count("\n") + before.count(" ")
        return PARAGRAPH if breaks > 1 else LINE if breaks else BLANK
    if not after[:1].isspace():
        return NONE
    if "\n" in after:
        return NONE  # the break itself stays with the text before it
    if SENTENCE_END.search(before):
        return SENTENCE
    return CLAUSE if CLAUSE_END.search(before) else BLANK


#: Words whose marks a worker remembers before it starts afresh.
REMEMBERED = 300_000


class Boundaries:
    """The strengths of all boundaries of a text at once, from marks that each pre-token keeps. As :func:`boundary_strength` gives them."""

    def __init__(self):
        self.marks: dict[str, int] = {}

    @staticmethod
    def _mark(word: str) -> int:
        blank = word.isspace()
        breaks = min(2, word.count("\n") + word.count("\u2029")) if blank else 0
        end = 0 if blank else 2 if SENTENCE_END.search(word) else 1 if CLAUSE_END.search(word) else 0
        return blank | breaks << 1 | end << 3 | word[:1].isspace() << 5 | ("\n" in word) << 6

    def of(self, words: list[str]) -> np.ndarray:
        """The strength after every word; that after the last is a paragraph's."""
        if len(self.marks) > REMEMBERED:
            self.marks.clear()
        marks = self.marks
        for w in set(words):
            if w not in marks:
                marks[w] = self._mark(w)
        m = np.fromiter((marks[w] for w in words), np.int64, len(words))
        before, after = m[:-1], m[1:]
        of_break, of_end = np.array([BLANK, LINE, PARAGRAPH, PARAGRAPH]), np.array([BLANK, CLAUSE, SENTENCE, SENTENCE])
        blank = np.where(after & 1, NONE, of_break[before >> 1 & 3])
        word = np.where(((after >> 5 & 1) == 0) | ((after >> 6 & 1) == 1), NONE, of_end[before >> 3 & 3])
        return np.append(np.where(before & 1, blank, word), PARAGRAPH)[: len(words)]


def text_units(encoder: Encoder, boundaries: Boundaries, words: list[str], sizes: np.ndarray, limit: int) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """(units, token counts, strengths after, whether they are the pre-tokens) of a text: its pre-tokens, where one that is larger
    than an eighth of the limit is taken character by character, so that a text without blanks can be cut as well."""
    strengths = boundaries.of(words)
    most = max(1, limit // 8)
    if sizes.max(initial=0) <= most:
        return words, sizes, strengths, True
    units: list[str] = []
    strong: list[int] = []
    for w, n, s in zip(words, sizes.tolist(), strengths.tolist(), strict=True):
        parts = list(w) if n > most else [w]
        units += parts
        strong += [NONE] * (len(parts) - 1) + [s]
    return units, encoder.token_counts(units), np.array(strong), False


def split_text(encoder: Encoder, text: str, limit: int, overlap: int, boundaries: Boundaries | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, in characters. A text within the limit is one piece."""
    words = encoder.pattern.findall(text)
    sizes = encoder.token_counts(words)
    whole = int(sizes.sum())
    if whole <= limit:
        return [(0, len(text), whole)]
    units, sizes, strengths, plain = text_units(encoder, boundaries or Boundaries(), words, sizes, limit)
    cum = np.concatenate([[0], np.cumsum(sizes)])  # tokens before unit i
    char = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])

    def count(s: int, e: int) -> int:
        """Tokens of the units s to e as a text of their own. Pre-tokens are the same there, but for blanks at the end, which no word follows."""
        if not plain:
            return encoder.count(text[char[s] : char[e]])
        b = e
        while b > s and units[b - 1].isspace():
            b -= 1
        return int(cum[b] - cum[s]) + (encoder.count(text[char[b] : char[e]]) if b < e else 0)

    table = StrongestBoundary(strengths)  # strengths[i] is that of the boundary after unit i
    n, s, out = len(sizes), 0, []
    while True:
        room = limit
        while True:
            top = max(s + 1, int(np.searchsorted(cum, cum[s] + room, "right")) - 1)
            if top >= n:
                e = n
            else:
                low = max(s + 1, int(np.searchsorted(cum, cum[s] + room // 2, "left")))
                e = table.query(min(low, top) - 1, top - 1) + 1
            tokens = count(s, e)
            if tokens <= limit or e == s + 1:
                break
            room = min(room, int(cum[e] - cum[s])) - max(1, tokens - limit)  # a cut can change how its blanks are encoded
        out.append((int(char[s]), int(char[e]), tokens))
        if e == n:
            return out
        if overlap <= 0:
            s = e
            continue
        near = int(np.searchsorted(cum, cum[e] - overlap * 6 // 5, "left"))
        far = int(np.searchsorted(cum, cum[e] - overlap * 4 // 5, "right")) - 1
        near, far = max(near, s + 1), min(far, e - 1)
        s = table.query(near - 1, far - 1) + 1 if near <= far else max(s + 1, min(near, e))


def split_oversized(
    df: DataFrame, key: str, text: str, *, limit: int = 1_500, overlap: int = 100, only_oversized: bool = False, model: bytes | None = None
) -> DataFrame:
    """``<key>, piece_no, start_char, end_char, n_tokens, piece``: every text as pieces of at most ``limit`` tokens,
    consecutive pieces overlapping by about ``overlap`` tokens.

    Defined results: null texts have no piece; an empty text is one empty piece; a text within the limit is one
    piece, and is left out with ``only_oversized``; a text without any boundary is cut between characters; a single
    character of more tokens than the limit stays whole; repeated rows are split each; further columns are ignored.
    """
    if limit < 1 or overlap < 0 or 2 * overlap >= limit:
        raise ValueError("limit must be positive and more than twice the overlap")
    sent = df.sparkSession.sparkContext.broadcast(model or load_model())  # under 2 MB, fixed by the vocabulary
    rows = df.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    if only_oversized:
        rows = rows.where(F.octet_length(text) > limit)  # a token has at least one byte
    schema = df.select(F.col(key)).schema
    for name, kind in (("piece_no", T.IntegerType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()), ("n_tokens", T.IntegerType()), ("piece", T.StringType())):
        schema = schema.add(name, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, boundaries = Encoder(sent.value), Boundaries()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(list(map(len, texts)), CHARS_AT_ONCE):
                rows = [
                    (k, no, start, end, tokens, t[start:end])
                    for k, t in zip(keys[part], texts[part], strict=True)
                    for pieces in (split_text(encoder, t, limit, overlap, boundaries),)
                    if len(pieces) > 1 or not only_oversized
                    for no, (start, end, tokens) in enumerate(pieces)
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return spread(rows).mapInArrow(run, schema)

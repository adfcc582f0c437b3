"""Encoding with a public byte-level BPE vocabulary through sentencepiece.

A sentencepiece BPE model is serialised directly from the vocabulary: every token becomes a piece
whose bytes are mapped to printable characters and whose score is the negative of its rank, under
identity normalisation. sentencepiece merges the best-scored neighbours first, which is the
merge order of the ranks. Texts are cut into pre-tokens first; each distinct pre-token of a worker is
encoded once, and documents are assembled from the encoded pre-tokens by array arithmetic.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default folder of the vocabulary files; a parameter of :func:`load_model`.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens a worker remembers (some 100 bytes each) before it starts afresh.
REMEMBERED = 400_000
#: Characters that are encoded at a time, so that a batch of long texts needs no more memory than one of short ones.
CHARS_AT_ONCE = 2_000_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file in the order of their ranks, which must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"the ranks of {path} are not contiguous")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, length-delimited or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is token i; an unknown piece, which no text needs, comes last."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Encodes texts by a serialised model. Lives in one Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(PATTERN)
        self.chars = byte_characters()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)

    def _learn(self, new: list[str], at: int) -> None:
        """Encode pre-tokens that were not met before; they get the numbers from ``at`` on."""
        chars = self.chars
        coded = self.sp.encode(["".join([chars[b] for b in t.encode()]) for t in new], out_type=int, num_threads=1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for x in coded for i in x), np.int32, int(sizes.sum()))
        while at + len(new) > len(self.sizes):
            self.sizes, self.starts = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.starts, 2 * len(self.starts))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.sizes[at : at + len(new)] = sizes
        self.starts[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def pretokens(self, texts: Iterable[str]) -> list[list[str]]:
        return [self.pattern.findall(t) for t in texts]

    def numbers(self, words: list[list[str]]) -> np.ndarray:
        """The number of every pre-token, in order; new ones are encoded first."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, at = self.index, len(self.index)
        new = [t for t in dict.fromkeys(t for x in words for t in x) if t not in index]
        if new:
            index.update(zip(new, range(at, at + len(new)), strict=True))
            self._learn(new, at)
        n = sum(map(len, words))
        return np.fromiter((index[t] for x in words for t in x), np.int64, n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i stand at offsets[i]:offsets[i + 1]."""
        words = self.pretokens(texts)
        k = self.numbers(words)
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[k] - (ends - sizes), sizes) + np.arange(total)]
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return np.concatenate([[0], np.concatenate([[0], ends])[last]]).astype(np.int64), ids

    def count(self, text: str) -> int:
        return int(self.token_counts(self.pattern.findall(text)).sum())

    def token_counts(self, words: list[str]) -> np.ndarray:
        """The number of ids of every pre-token."""
        k = self.numbers([words])  # may enlarge the tables
        return self.sizes[k]


def decode(tokens: list[bytes], ids: Iterable[int]) -> str:
    """The text of ids, by the inverse of the byte mapping; ids outside the vocabulary are an error."""
    return b"".join(tokens[i] for i in ids).decode("utf-8")


def load_model(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    return serialise_model(read_ranks(os.path.join(folder, f"{name}.tiktoken")))


def spread(df: DataFrame) -> DataFrame:
    """More partitions where a scan has fewer than the session has cores; a scan that has enough is not shuffled."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to no more than ``most``, or hold one item."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def encode_column(df: DataFrame, key: str, text: str, *, model: bytes | None = None) -> DataFrame:
    """``<key>, ids``: the ids of every text, without special tokens, one row for each row of ``df``.

    Defined results: null and empty texts have an empty list; repeated rows stay repeated; whole texts
    are encoded, whatever their length; special tokens' strings are ordinary text; further columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model or load_model())  # under 2 MB, fixed by the vocabulary
    schema = df.select(F.col(key)).schema.add("ids", T.ArrayType(T.IntegerType()))
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(list(map(len, texts)), CHARS_AT_ONCE):
                offsets, ids = encoder.encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start).cast(key_type), lists], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)

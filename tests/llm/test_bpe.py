import random
import os

import pytest

from tavla.llm import bpe
from tavla.llm.splitting import Boundaries, StrongestBoundary, boundary_strength, split_oversized, split_text

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary")

TEXTS = [
    "", " ", "  a  b\n\n c\t", "<|endoftext|>", "it's we'll 'tis", "x" * 3000, "😀👩‍👩‍👧 שלום‏ עולם", "\0a", "ß" * 300 + " 1234567890", "ביטוח חיים: 25,000 ₪ (ש\"ח)\n" * 50, "Привет, мир!", "a" + " " * 50 + "b",
]


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(tokens):
    return bpe.Encoder(bpe.serialise_model(tokens))


@pytest.fixture(scope="module")
def reference(tokens):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_ids_and_round_trip(encoder, reference, tokens):
    offsets, ids = encoder.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        got = ids[offsets[i] : offsets[i + 1]].tolist()
        assert got == reference.encode_ordinary(t)
        assert bpe.decode(tokens, got) == t


def test_forgetting_changes_nothing(tokens, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = bpe.Encoder(bpe.serialise_model(tokens))
    for t in TEXTS * 2:
        assert e.encode([t])[1].tolist() == reference.encode_ordinary(t)


def test_column(spark, reference):
    rows = [(1, "ביטוח", 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, "x " * 5000, 9), (None, "a", 9)]
    df = spark.createDataFrame(rows, "id bigint, t string, ids int")
    got = sorted(((r["id"] or 0), r["ids"]) for r in bpe.encode_column(df, "id", "t").collect())
    assert got == sorted(((i or 0), reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert bpe.encode_column(df.limit(0), "id", "t").count() == 0


def test_slices():
    assert [(s.start, s.stop) for s in bpe.slices([5, 1, 1, 9, 2], 6)] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(bpe.slices([], 6)) == []


@pytest.mark.parametrize("text", [" ".join(f"word{i}" for i in range(400)), "א" * 600, "\n" * 700, "שורה אחת.\n\n" * 90, "😀" * 200, "משפט. " * 150, "ab " * 300])
@pytest.mark.parametrize("overlap", [0, 10])
def test_pieces(encoder, reference, text, overlap):
    pieces = split_text(encoder, text, 60, overlap)
    assert pieces[0][0] == 0
    assert pieces[-1][1] == len(text)
    for (a, b, n), (c, d, _) in zip(pieces, pieces[1:], strict=False):
        assert a < c <= b < d
        assert n <= 60
        if overlap:
            assert 0 < len(reference.encode_ordinary(text[c:b])) <= 30
        else:
            assert c == b
    assert all(len(reference.encode_ordinary(text[a:b])) == n <= 60 for a, b, n in pieces)


def test_cuts_stand_at_the_strongest_boundaries(encoder):
    text = ("a b c, d e f. " * 6 + "\n\n") * 8
    assert all(text[:b].endswith("\n\n") for _, b, _ in split_text(encoder, text, 60, 5))


def test_range_maximum_breaks_ties_rightward():
    import numpy as np

    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, 50)
    t = StrongestBoundary(s)
    for lo in range(50):
        for hi in range(lo, 50):
            assert t.query(lo, hi) == max(range(lo, hi + 1), key=lambda i: (s[i], i))


def test_strengths():
    assert boundary_strength("\n\n", "a") > boundary_strength("\n", "a") > boundary_strength("a.", " b") > boundary_strength("a,", " b") > boundary_strength("a", " b") > boundary_strength("a", "b")


def test_split_column(spark):
    long = "משפט קצר. " * 400
    df = spark.createDataFrame([(1, long, 5), (2, "קצר", 5), (3, None, 5), (4, "", 5), (1, long, 5)], "id bigint, t string, piece int")
    got = split_oversized(df, "id", "t", limit=200, overlap=20)
    assert {r["id"] for r in got.collect()} == {1, 2, 4}
    big = split_oversized(df, "id", "t", limit=200, overlap=20, only_oversized=True).collect()
    assert {r["id"] for r in big} == {1}
    assert all(r["piece"] == long[r["start_char"] : r["end_char"]] and r["n_tokens"] <= 200 for r in big)
    assert split_oversized(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError, match="limit"):
        split_oversized(df, "id", "t", limit=100, overlap=50)


def test_strengths_of_a_whole_text(encoder):
    rng = random.Random(12)
    parts = ["a", "a.", " b", " b,", "\n", "\n\n", " ", "   ", "\u2029", " x!", "5", "\t\n ", "’”", "?)", "\u00a0"]
    boundaries = Boundaries()
    for _ in range(60):
        words = encoder.pattern.findall("".join(rng.choice(parts) for _ in range(40)))
        want = [boundary_strength(a, b) for a, b in zip(words, words[1:], strict=False)] + [5]
        assert boundaries.of(words).tolist() == want
    assert boundaries.of([]).tolist() == []


def test_pieces_with_blanks_everywhere(encoder, reference):
    rng = random.Random(13)
    for _ in range(40):
        text = "".join(rng.choice(["word", " ", "  ", "\n", " \n\n", ".", "\t", "x" * 40, "שלום"]) for _ in range(300))
        pieces = split_text(encoder, text, 40, 4)
        assert all(n == len(reference.encode_ordinary(text[a:b])) and (n <= 40 or b == a + 1) for a, b, n in pieces)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(q[0] <= p[1] for p, q in zip(pieces, pieces[1:], strict=False))

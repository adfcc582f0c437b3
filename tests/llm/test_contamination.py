import random

from tavla.llm import contamination as C
from tavla.llm.contamination import ItemIndex, find_leaks, longest_passage, tile, words_of


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, passage_words string")
    return sorted((r["doc_id"], r["item_id"]) for r in find_leaks(d, "doc_id", "text", e, "item_id", "text", **more).collect())


ITEM = [f"מילה{i}" for i in range(60)]


def text(words):
    return "פתיחה אחרת " + " ".join(words) + " סיום שונה"


def changed(words, at):
    return [f"שונה{i}" if i in at else w for i, w in enumerate(words)]


def left_out(words, at):
    return [w for i, w in enumerate(words) if i not in at]


def test_definition(spark):
    w = ITEM[10:40]
    docs = [
        (1, text(ITEM)), (2, text(w[:18])), (3, text(w[:17])), (4, text(changed(w, {7, 14, 21}))), (5, text(left_out(w, {7, 14, 21}))), (6, text(changed(w, {5, 10, 15, 20, 25}))),
        (7, text(w[:9] + ["a", "b"] + w[11:20])), (8, "\n".join(f"‏{x.upper()},-" for x in w)), (9, None), (10, ""), (11, text(w[9:18] + w[:9])), (12, text(changed(w[:18], {2}))),
        (13, text(w) * 200), (13, text(w) * 200),
    ]
    items = [(100, " ".join(ITEM)), (101, None), (102, ""), (103, " ".join(ITEM[:10]))]
    assert run(spark, docs, items) == [(1, 100), (2, 100), (4, 100), (5, 100), (8, 100), (12, 100), (13, 100), (13, 100)]
    assert run(spark, docs[:1], []) == []
    assert run(spark, [], items) == []


def test_reordered_passages_by_coverage(spark):
    parts = [ITEM[i : i + 10] for i in range(0, 60, 10)]
    parts.reverse()
    docs = [(1, text([w for p in parts for w in p])), (2, text(ITEM[:12]))]
    assert run(spark, docs, [(100, " ".join(ITEM))], min_share=0.9) == [(1, 100)]
    assert run(spark, docs, [(100, " ".join(ITEM))]) == []


def test_several_blocks_find_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}_{i}" for i in range(40))) for k in range(12)]
    docs = [(k, f"start {items[k % 12][1]} end {items[(k + 5) % 12][1]}") for k in range(20)]
    once = run(spark, docs, items)
    monkeypatch.setattr(C, "BLOCK_WORDS", 300)
    assert run(spark, docs, items) == once
    assert len(once) == 40


def greedy_model(a, b, least):
    """Greedy string tiling by comparing everything with everything."""
    ma, mb, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for d in range(len(b)):
                n = 0
                while i + n < len(a) and d + n < len(b) and a[i + n] == b[d + n] and i + n not in ma and d + n not in mb:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return sorted(tiles)
        tiles.append(best)
        ma.update(range(best[0], best[0] + best[2]))
        mb.update(range(best[1], best[1] + best[2]))


def test_tiles_match_the_plain_algorithm():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randrange(5, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(5, 40))]
        seeds = [(i, d) for i in range(len(a) - 2) for d in range(len(b) - 2) if a[i : i + 3] == b[d : d + 3]]
        assert tile(seeds, 3) == greedy_model(a, b, 3) if seeds else True


def test_index_agrees_with_itself():
    index = ItemIndex([(1, " ".join(ITEM)), (2, "short one")], 6)
    ids = index.document_ids(" ".join(ITEM[5:30]))
    assert [(n, t) for n, t in index.matches(ids)] == [(0, [(5, 0, 25)])]
    assert longest_passage([(5, 0, 25)], index.words[0], ids) == 25
    assert list(index.matches(index.document_ids(""))) == []


def test_words():
    assert words_of('‏שָלום, עולם! ש"ח A-1 b|c …') == ["שלום", "עולם", "שח", "a1", "b", "c"]


def test_a_longer_copy_elsewhere_takes_no_words_from_a_passage(spark):
    docs = [(1, text([*ITEM[:12], "אחר", "שונה", *changed(ITEM[:20], {10})])), (2, text([*ITEM[:12], "אחר", *changed(ITEM[:17], {10})])), (3, text([*ITEM[:12], "אחר", "שונה", *left_out(ITEM[:20], {10})]))]
    assert run(spark, docs, [(100, " ".join(ITEM))]) == [(1, 100), (3, 100)]


def longest_by_definition(item, doc, between=6):
    """Words of the item in the longest passage, by trying every beginning and every way on: a changed or left-out word may come
    where it is the first or ``between`` unchanged words lie behind the one before."""
    best = 0
    for i0 in range(len(item)):
        for d0 in range(len(doc)):
            if item[i0] != doc[d0]:
                continue
            todo, seen = [(i0, d0, between)], set()
            while todo:
                i, d, run = state = todo.pop()  # item[i] and doc[d] agree; run: unchanged words since the last change, before this one
                if state in seen:
                    continue
                seen.add(state)
                best = max(best, i + 1 - i0)
                run = min(between, run + 1)
                for di, dd, changes in ((1, 1, False), (2, 2, True), (2, 1, True)):
                    if changes and run < between:
                        continue
                    if i + di < len(item) and d + dd < len(doc) and item[i + di] == doc[d + dd]:
                        todo.append((i + di, d + dd, 0 if changes else run))
    return best


def test_probe_of_a_stray_tile(spark):
    item = [f"x{i}" for i in range(40)]
    doc = [*item[:11], *[f"y{i}" for i in range(30)], *changed(item[:19], {9})]
    assert longest_by_definition(item, doc) == 19
    assert run(spark, [(1, " ".join(doc)), (2, " ".join(doc[41:])), (3, " ".join(doc[:41]))], [(7, " ".join(item))]) == [(1, 7), (2, 7)]


def test_passages_match_the_definition():
    from tavla.llm.contamination import longest_chain, longest_passage

    rng = random.Random(21)
    for trial in range(150):
        words = 200 if trial % 3 else 6  # few words repeat within an item
        item = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(18, 45))]
        doc = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(len(item) - 10)
            part = item[a : a + rng.randrange(8, 40)]
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(part))
                part = [*part[:k], *rng.choice([[], ["other"]]), *part[k + 1 :]]
            doc += [*part, *(["gap"] * rng.randrange(3))]
        index = ItemIndex([(1, " ".join(item))], 6)
        ids = index.document_ids(" ".join(doc))
        got = max((max(longest_passage(tile(s, 6), index.words[n], ids), longest_chain(s, index.words[n], ids, 6)) for n, s in index.seeds(ids)), default=0)
        want = longest_by_definition(item, doc)
        assert (got >= 18) == (want >= 18), (item, doc, got, want)

"""What the matching queries read and how often they search."""

import pytest

from tavla.plans import common
from tavla.plans import matching as P

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["topk_candidates", "unordered_pairs", "rebuild_protected"])
def test_ranking_reads_no_names(spark, monkeypatch, name):
    read, table = [], common.table
    monkeypatch.setattr(common, "table", lambda s, d, t: read.append(t) or table(s, d, t))
    P.QUERIES[name](spark, SMALL)
    assert "document_embeddings" in read and "document_extractions" not in read


def test_judged_pairs_are_searched_once(spark):
    pairs, verdicts = P._judged(spark, SMALL)
    assert "FlatMapGroupsInArrow" not in pairs.join(verdicts, "key")._jdf.queryExecution().toString()

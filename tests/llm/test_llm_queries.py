"""The queries of the training-data problems on the smallest tables, against SQL or a plain computation."""

import glob
import os

import pytest

from tavla.llm import bpe, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

SCHEMAS = {
    "p1_found": "document_id:string,source_field:string,item_pos:int,code:string",
    "p3_found": "doc_a:string,doc_b:string",
    "p4_found": "document_id:string,group_id:string",
    "p5_found": "listing_id:bigint,document_id:string",
    "p6_found": "doc_a:string,doc_b:string",
    "p7_ids": "doc_id:bigint,ids:array<int>",
    "p8_found": "doc_id:bigint,item_id:bigint",
    "p9_found": "doc_id:bigint",
}


def table(name):
    import pyarrow.dataset as ds

    return ds.dataset(f"{DATA}/{name}.parquet").to_table().to_pylist()


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schema(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert ",".join(f"{n}:{t}" for n, t in df.dtypes) == SCHEMAS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_typed_items(spark):
    got = queries.p1_found(spark, DATA).collect()
    listed = {s for r in table("canonical_codes") for s in [r["canonical_name_he"], *(r["synonyms"] or [])]}
    want = {
        (r["document_id"], f, i)
        for r in table("document_extractions")
        for f in ("disease_list", "exclusions")
        for i, x in enumerate(r[f] or [])
        if x is not None and x.strip() and x not in listed
    }
    assert {(r["document_id"], r["source_field"], r["item_pos"]) for r in got} == want
    assert len(got) == len(want)


def test_shards_change_nothing(spark, monkeypatch):
    from functools import partial

    whole = sorted(map(tuple, queries.p1_found(spark, DATA).collect()))
    monkeypatch.setattr(queries, "map_to_canonical", partial(queries.map_to_canonical, shard_forms=700))
    assert sorted(map(tuple, queries.p1_found(spark, DATA).collect())) == whole


def test_tokens(spark):
    import tiktoken

    tokens = bpe.read_ranks(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in table("documents")}
    assert {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, DATA).collect()} == want
    big = {k for k, v in want.items() if len(v) > 1500}
    assert {r["doc_id"] for r in queries.p9_found(spark, DATA).collect()} == big
    pieces = queries.p9_pieces(spark, DATA).collect()
    assert {r["doc_id"] for r in pieces if r["piece_no"] == 1} == big
    assert all(r["n_tokens"] == len(reference.encode_ordinary(r["piece"])) <= 1500 for r in pieces)


def test_linked_once(spark):
    links = queries.p5_links(spark, DATA).collect()
    assert len({r["listing_id"] for r in links}) == len(links)
    assert all(0 < r["confidence"] <= r["any_match"] + 1e-9 for r in links)

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tavla.sources import files as S
from tavla.sources import listings as P


def one(spark, body, domain="life"):
    return spark.createDataFrame([(domain, body, "p1")], "domain string, body string, page string")


def line(i, content=None, error=None):
    return (json.dumps({"custom_id": i, "error": error, "response": {"body": {"choices": [{"message": {"content": content}}]}}}),)


def test_batch_decoding(spark, rows):
    good, nul = json.dumps({"a": "x"}), json.dumps({"a": "x\0y"})
    lines = spark.createDataFrame([line("1", good), line("2", nul), line("3", "no json"), line("4", None, "quota"), ("",), ("broken",)], "value string")
    errors = spark.createDataFrame([line("4", None, "e"), line("5", None, "e"), line("1", None, "e")], "value string")
    got = {r["custom_id"]: (r["result"]["a"] if r["result"] else None) for r in S.decoded_batch(lines, "a string", errors).collect()}
    assert got == {"1": "x", "2": "xy", "3": None, "4": None, "5": None}
    assert rows(S.decoded_batch(lines, "a string", errors, skip_failures=True), "custom_id") == [("1",), ("2",)]


def test_checkpoint(spark, rows):
    lines = spark.createDataFrame([(1, '{"k": "a", "v": "x"}'), (2, ""), (3, '{"k": "a", "v": null}'), (4, '{"k": "b", "v": "y"}')], "line int, value string")
    assert rows(S.last_checkpoint(lines, "k string, v string", "k", "line"), "k", "v") == [("a", None), ("b", "y")]


def test_requests(spark):
    df = spark.createDataFrame([("1", "שלום")], "id string, prompt string")
    row = json.loads(S.batch_lines(df, "id", "m", "s", "prompt").first()["value"])
    assert row["custom_id"] == "1"
    assert row["body"]["messages"][1]["content"] == "שלום"


def test_pages_and_confidence(spark, rows):
    pages = spark.createDataFrame([("d", 2, "x" * 20, None), ("d", 1, "short", "from ocr"), ("e", 1, "y" * 25, None)], "doc string, page int, t string, o string")
    assert rows(S.page_texts(pages, "doc", "page", "t", "o")) == [("d", "from ocr\n" + "x" * 20, "ocr"), ("e", "y" * 25, "text")]
    words = spark.createDataFrame([("p", 90.0), ("p", 80.0), ("p", -1.0), ("q", -1.0)], "page string, c double")
    assert rows(S.mean_confidence(words, "page", "c")) == [("p", 0.85), ("q", 0.0)]


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.dictionary(spark, str(tmp_path / "none.json"), "codes", "code string")
    (tmp_path / "d.json").write_text(json.dumps({"codes": [{"code": "A"}]}))
    assert S.dictionary(spark, str(tmp_path / "d.json"), "codes", "code string").collect() == [("A",)]
    df = spark.createDataFrame([("b", None), ("a", 'x "y"')], "id string, t string")
    assert S.write_csv(df, str(tmp_path / "o.csv"), ["id"]) == 2
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfid,t\r\na,")
    assert S.read_cache(spark, str(tmp_path / "cache"), "id string") is None
    S.write_cache(df.select("id"), str(tmp_path / "cache"))
    assert S.read_cache(spark, str(tmp_path / "cache"), "id string").count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.pdf").write_bytes(b"1")
    (tmp_path / "x" / "a.pdf").write_bytes(b"2")
    assert S.listed_files(spark, str(tmp_path / "x"), limit=1).first()["path"].endswith("a.pdf")


def test_modelled(spark, rows):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    assert rows(S.modelled(df, "t", "n", lambda texts: [len(t) for t in texts], out_type="int")) == [("a", 1), ("bb", 2)]


def test_families(spark, rows):
    body = {"IsSuccess": True, "FamilyPoliciesDetails": [{"Policies": [{"Title": " T ", "AttachmentNumber": None, "FilePath": "/x.pdf", "StartValidity": "2020-01-02T00:00:00", "EndValidity": P.NO_DATE}, {"Title": "no file"}]}]}
    assert rows(P.families_json(one(spark, json.dumps(body)), "body", "b"), "title", "appendix_numbers", "download_url", "marketing_start_date", "marketing_end_date") == [("T", [], "b/x.pdf", date(2020, 1, 2), None)]
    assert P.families_json(one(spark, json.dumps(body | {"IsSuccess": False})), "body", "b").count() == 0
    assert P.families_json(one(spark, None), "body", "b").count() == 0


def test_archive_and_forms(spark, rows):
    body = {"data": [{"documentURL": "u", "policyHeaderForDisplay": "", "policyHeader": "נספח 12", "tags": ["נספח 13"], "policyEndDate": "2099-01-01T00:00:00Z"}, {"documentURL": None}]}
    assert rows(P.archive_json(one(spark, json.dumps(body)), "body"), "title", "appendix_numbers", "marketing_end_date") == [("נספח 12", ["12", "13"], None)]
    assert P.archive_json(one(spark, json.dumps(body | {"err": "x"})), "body").count() == 0
    forms = {"status": 0, "collection": [{"formId": 7, "formName": "נספח 5", "fromDate": "01/02/2020"}, {"formId": None}]}
    assert rows(P.forms_json(one(spark, json.dumps(forms)), "body", "f/{form_id}"), "download_url", "appendix_numbers", "marketing_start_date") == [("f/7", ["5"], date(2020, 2, 1))]
    assert P.forms_json(one(spark, json.dumps(forms | {"status": 3})), "body", "f").count() == 0


def test_media(spark, rows):
    body = {"Data": [{"Department": [{"_name": "?"}, {"_name": "A"}], "umbracoFile": "/media/12/f.pdf"}, {"Department": None, "umbracoFile": "/media/12/g.pdf"}, {"Department": [{"_name": "A"}], "umbracoFile": "/media/12/"}]}
    assert rows(P.media_json(one(spark, json.dumps(body)), "body", {"A": "life"}, "b/"), "media_folder_id", "file_name", "download_url") == [("12", "f.pdf", "b/12/f.pdf")]


def test_html(spark, rows, value):
    html = """<table id="policies"><tr><th>x</th></tr><tr><td><a href="/a.PDF"><b>T&amp;U</b></a></td><td> 5 </td><td>-</td><td>1.2.2020</td><td></td></tr>
    <tr><td>no link</td><td>6</td></tr><tr><td><a href="/b.doc">b</a></td><td>7</td></tr></table>"""
    assert rows(P.table_html(one(spark, html), "body"), "title", "appendix_numbers", "download_url", "marketing_start_date", "marketing_end_date") == [("T&U", ["5"], "/a.PDF", date(2020, 2, 1), None)]
    assert P.table_html(one(spark, "<p>none</p>"), "body").count() == 0
    assert value(P.page_count, '<input id="HiddFieldNumOfLinks" value="7">') == 7
    assert value(P.page_count, '<input id="HiddFieldNumOfLinks" value="x">') == 1
    assert value(P.page_count, "") == 1
    links = '<a href="https://s//media/x.pdf">נספח 3 החל מ-1.1.2020</a><a href="https://s/media/x.pdf">later</a><a href="y.txt">z</a>'
    assert rows(P.anchors_html(one(spark, links), "page", "body"), "title", "download_url", "appendix_numbers", "marketing_start_date") == [("נספח 3 החל מ-1.1.2020", "https://s/media/x.pdf", ["3"], date(2020, 1, 1))]
    titled = '<a href="/media/ab/x.pdf">..</a><a title="T 1" href="/media/ab/x.pdf">..</a><a href="/media/cd/y.pdf">..</a><a href="/other/z.pdf">..</a>'
    assert rows(P.titled_html(one(spark, titled), "page", "body"), "media_id", "title") == [("ab", "T 1"), ("cd", "")]


def test_cells(spark, rows):
    df = spark.createDataFrame([("life", ["T", "5", "05/26", "x"], "u"), ("life", ["T", " ", "", ""], "u"), ("life", ["T", "5", "", ""], ""), ("life", ["T", "5"], "u")], "domain string, cells array<string>, link string")
    got = P.cell_rows(df, "cells", "link")
    assert rows(got, "title", "appendix_numbers", "marketing_start_date") == [("T", ["5"], date(2026, 5, 1))]
    assert P.without_titles(got, ["T"]).count() == 0
    assert P.without_titles(got, ["Z"]).count() == 1


def test_incremental_stage(spark, tmp_path, rows):
    from tavla.streaming.ledger import run_stage

    source, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    stage = lambda b: b.withColumn("y", F.col("x") + 1)
    spark.createDataFrame([(1,)], "x int").write.mode("append").parquet(source)
    run_stage(spark, source, "x int", sink, ck, stage)
    spark.createDataFrame([(2,)], "x int").write.mode("append").parquet(source)
    run_stage(spark, source, "x int", sink, ck, stage)
    run_stage(spark, source, "x int", sink, ck, stage)
    assert rows(spark.read.parquet(sink), "x", "y") == [(1, 2), (2, 3)]

from datetime import datetime

import pytest

from tavla import api


@pytest.fixture(scope="module")
def t(spark):
    day = lambda n: datetime(2024, 1, n)
    docs = [("a1", "A", "life", ["12/3", "7"], "Name 1", "f1.pdf", day(1)), ("a2", "A", "life", ["7"], None, "f2.pdf", day(2)), ("b1", "B", "health", [], "x", "f3.pdf", day(3))]
    return {
        "docs": spark.createDataFrame(docs, "id string, company_id string, domain string, appendix_number array<string>, appendix_name string, original_file_name string, created_date timestamp"),
        "ext": spark.createDataFrame([("a2", "kind", None)], "document_id string, coverage_type string, exclusions array<string>"),
        "emb": spark.createDataFrame([("a1",)], "document_id string"),
        "cls": spark.createDataFrame([("a1", "health")], "document_id string, main_category string"),
        "mat": spark.createDataFrame([("m1", "a2", "b1", 0.9, "confirmed"), ("m2", "b1", "a1", 0.8, "pending_review"), ("m3", "a2", "gone", 0.7, "confirmed")], "id string, document_id string, matched_document_id string, similarity_score double, status string"),
        "com": spark.createDataFrame([("A", "aa"), ("B", "bb"), ("C", "cc")], "id string, display_name string"),
    }


def test_documents(t, rows):
    args = (t["docs"], t["ext"], t["emb"], t["cls"])
    assert rows(api.documents(*args), "id", "has_extraction", "has_embedding") == [("a1", False, True), ("a2", True, False), ("b1", False, False)]
    assert rows(api.documents(*args, main_category="health", company_id=""), "id") == [("a1",)]
    assert rows(api.documents(*args, domain="health"), "id") == [("b1",)]


def test_analysis_and_extraction(t):
    r = api.analysis(t["docs"], "a2", extraction=t["ext"], classification=t["cls"]).first()
    assert r["extraction"]["coverage_type"] == "kind"
    assert r["classification"] is None
    assert api.analysis(t["docs"], "none", extraction=t["ext"]).count() == 0
    assert api.extraction(t["ext"], "a2").first()["exclusions"] == []


def test_matches(t, rows):
    assert rows(api.matches(t["mat"], t["docs"]), "id") == [("m1",), ("m2",)]
    assert rows(api.matches(t["mat"], t["docs"], document_id="a1"), "id", "a_company_id", "b_company_id") == [("m2", "B", "A")]
    assert rows(api.matches(t["mat"], t["docs"], status="confirmed"), "id") == [("m1",)]
    assert rows(api.review(t["mat"], "m2", "rejected"), "id", "status")[1] == ("m2", "rejected")
    with pytest.raises(ValueError, match="status"):
        api.review(t["mat"], "m2", "odd")


def test_public(t, rows):
    assert rows(api.companies(t["com"], t["docs"]), "id", "n_documents") == [("A", 2), ("B", 1), ("C", 0)]
    assert [r["id"] for r in api.appendices(t["docs"], "A").collect()] == ["a2", "a1"]
    assert rows(api.by_number(t["docs"], "A", "7"), "id", "candidates") == [("a2", 2)]
    assert rows(api.by_number(t["docs"], "A", "12/3"), "id") == [("a1",)]
    assert api.by_number(t["docs"], "A", "9").count() == 0
    assert rows(api.appendix(t["docs"], t["ext"], "A", "7"), "id", "coverage_type") == [("a2", "kind")]
    assert rows(api.appendix_matches(t["docs"], t["mat"], "A", "7"), "id", "other") == [("m1", "b1")]
    assert rows(api.appendix_matches(t["docs"], t["mat"], "A", "12/3"), "id", "other") == [("m2", "b1")]
    assert api.appendix_matches(t["docs"], t["mat"], "A", "12/3", status="confirmed").count() == 0
    assert rows(api.search(t["docs"], text="NAME"), "id") == [("a1",)]
    assert rows(api.search(t["docs"], text="12/", company_id="A"), "id") == [("a1",)]

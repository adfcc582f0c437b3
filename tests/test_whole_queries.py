"""Queries over the reference's whole set of fields, on rows written by hand."""

from tavla.plans.parsing import QUERIES as PARSING
from tavla.plans.relational import QUERIES as RELATIONAL

EXTRACTION = (
    "document_id string, insurance_amounts array<string>, waiting_period string, qualifying_period string, survival_period string, exclusions array<string>, "
    "restrictions array<string>, disease_list array<string>, disease_count int, created_date timestamp"
)


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_all_seven_criteria_count(spark, tmp_path):
    from datetime import datetime

    at = datetime(2020, 1, 1)
    save(spark, tmp_path, "document_extractions", [
        ("a", ["עד 200,000"], None, "30 ימים", "1 שבוע", None, ["x"], None, 5, at),
        ("b", ["100,000", "50"], None, "60 ימים", "14 ימים", [], ["x", "y"], None, None, at),
        ("c", None, "חודש", None, None, ["e"], None, None, None, at),
    ], EXTRACTION)
    save(spark, tmp_path, "document_matches", [("a:b", "a", "b", 0.9, "confirmed", at), ("a:c", "a", "c", 0.9, "confirmed", at)], "id string, document_id string, matched_document_id string, similarity_score double, status string, created_date timestamp")
    got = {r["id"]: (r["percent_a"], r["criteria"]) for r in PARSING["score_compare_all"](spark, str(tmp_path)).collect()}
    assert got == {"a:b": (90.0, 5), "a:c": (50.0, 2)}


def test_phrases_of_both_fields_get_codes_of_their_category(spark, tmp_path, rows):
    from datetime import datetime

    at = datetime(2020, 1, 1)
    save(spark, tmp_path, "document_extractions", [("a", None, "30", None, None, ["ספורט אתגרי", None], None, [" סרטן ", "אחר"], None, at), ("b", None, None, None, None, ["סרטן"], None, None, None, at)], EXTRACTION)
    save(spark, tmp_path, "canonical_codes", [("D1", "insured_event", "סרטן", None), ("E1", "exclusion", "ספורט", ["אתגרי"])], "code string, code_category string, canonical_name_he string, synonyms array<string>")
    d = str(tmp_path)
    assert rows(RELATIONAL["candidate_phrases_all"](spark, d)) == sorted([("a", "insured_event", " סרטן ", "disease_list"), ("a", "insured_event", "אחר", "disease_list"), ("a", "exclusion", "ספורט אתגרי", "exclusions"), ("b", "exclusion", "סרטן", "exclusions")], key=repr)
    assert rows(RELATIONAL["code_normalize_all"](spark, d)) == sorted([("insured_event", "סרטן", "D1"), ("insured_event", "אחר", None), ("exclusion", "ספורט אתגרי", "E1"), ("exclusion", "סרטן", None)], key=repr)

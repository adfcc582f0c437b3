"""The query API as DataFrame functions: each takes the tables it reads and returns a lazy frame.

Lookups by key filter before they join, so the filters reach the scans. What a service turns into "not found" is an empty frame here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavla.operators import matching as O
from tavla.operators import relational as R
from tavla.operators.ranking import latest

REVIEWABLE = ("confirmed", "rejected")


def documents(docs: DataFrame, extractions: DataFrame, embeddings: DataFrame, classifications: DataFrame, *, company_id: str | None = None, domain: str | None = None, main_category: str | None = None) -> DataFrame:
    """Documents with flags of what is known about them; a main category leaves out the unclassified."""
    base = R.where_equal(docs, company_id=company_id, domain=domain)
    rows = R.flagged(R.flagged(base, extractions, "id", "has_extraction", other_key="document_id"), embeddings, "id", "has_embedding", other_key="document_id")
    kinds = classifications.select(F.col("document_id").alias("id"), "main_category")
    return R.where_equal(rows.join(kinds, "id", "left"), main_category=main_category)


def analysis(docs: DataFrame, document_id: str, **sections: DataFrame) -> DataFrame:
    """One row: the document, and each section (a table with document_id) as a struct, null where there is none; no row for an unknown id."""
    out = docs.where(F.col("id") == document_id)
    for name, table in sections.items():
        rest = [c for c in table.columns if c != "document_id"]
        one = table.where(F.col("document_id") == document_id).select(F.col("document_id").alias("id"), F.struct(*rest).alias(name)).groupBy("id").agg(F.max(name).alias(name))
        out = out.join(one, "id", "left")
    return out


def extraction(extractions: DataFrame, document_id: str) -> DataFrame:
    """The extraction of a document, empty lists for missing ones."""
    rows = extractions.where(F.col("document_id") == document_id)
    lists = [c for c, t in rows.dtypes if t == "array<string>"]
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def matches(matches: DataFrame, docs: DataFrame, *, status: str | None = None, document_id: str | None = None) -> DataFrame:
    """Matches with both documents' company and name, of a status, of one document at either side."""
    rows = R.where_equal(matches, status=status)
    if document_id:
        rows = O.touching(rows, document_id).drop("other")
    return O.with_both_sides(rows, docs, ["company_id", "appendix_name"])


def review(matches: DataFrame, match_id: str, status: str) -> DataFrame:
    """Matches with one of them confirmed or rejected; another status is an error."""
    if status not in REVIEWABLE:
        raise ValueError(f"status must be one of {REVIEWABLE}")
    return matches.withColumn("status", F.when(F.col("id") == match_id, status).otherwise(F.col("status")))


def companies(companies: DataFrame, docs: DataFrame) -> DataFrame:
    """Companies with their number of documents, zero included."""
    n = docs.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n_documents"))
    return companies.join(n, "id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def appendices(docs: DataFrame, company_id: str, *, domain: str | None = None) -> DataFrame:
    """A company's documents, newest first."""
    return R.where_equal(docs.where(F.col("company_id") == company_id), domain=domain).orderBy(F.desc("created_date"), "id")


def by_number(docs: DataFrame, company_id: str, number: str) -> DataFrame:
    """The most recent document of a company with an appendix number (which may hold a slash), and how many there are."""
    rows = docs.where((F.col("company_id") == company_id) & F.array_contains("appendix_number", number)).withColumn("number", F.lit(number))
    count = rows.groupBy("number").agg(F.count(F.lit(1)).alias("candidates"))
    return latest(rows, ["number"], ["created_date", "id"]).join(F.broadcast(count), "number")


def appendix(docs: DataFrame, extractions: DataFrame, company_id: str, number: str) -> DataFrame:
    """A numbered appendix with its extraction, if there is one."""
    found = by_number(docs, company_id, number)
    own = extractions.select(F.col("document_id").alias("id"), *[c for c in extractions.columns if c not in found.columns and c != "document_id"])
    return found.join(own, "id", "left")


def appendix_matches(docs: DataFrame, matches: DataFrame, company_id: str, number: str, *, status: str | None = None) -> DataFrame:
    """The documents that match a numbered appendix, at either side; a match whose other document is gone is left out."""
    me = by_number(docs, company_id, number).select(F.col("id").alias("me"))  # one row
    touching = R.where_equal(matches, status=status).join(F.broadcast(me), (F.col("document_id") == F.col("me")) | (F.col("matched_document_id") == F.col("me")))
    other = touching.withColumn("other", F.when(F.col("document_id") == F.col("me"), F.col("matched_document_id")).otherwise(F.col("document_id")))
    side = docs.select(F.col("id").alias("other"), F.col("company_id").alias("other_company"), F.col("appendix_name").alias("other_name"), F.col("appendix_number").alias("other_numbers"))
    return other.join(side, "other").select("id", "status", "similarity_score", "other", "other_company", "other_name", "other_numbers")


def search(docs: DataFrame, *, text: str = "", **wanted: str | None) -> DataFrame:
    """Documents by equality filters and a text in file name, name or any number, regardless of case."""
    rows = R.where_equal(docs, **wanted)
    needle = text.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return rows if not text else rows.where(has(F.col("original_file_name")) | has(F.col("appendix_name")) | F.coalesce(F.exists("appendix_number", lambda n: F.lower(n).contains(needle)), F.lit(False)))

"""The query API over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla import api
from tavla.plans.common import DOCS, EXTR, MATCHES, docs, extractions, matches
from tavla.session import table

FIND = f"found AS (SELECT company_id, arg_max(id, struct_pack(c := created_date, i := id)) AS me, count(*) AS candidates FROM docs WHERE company_id = 'nirvad' AND list_contains(appendix_number, (SELECT min(n) FROM (SELECT unnest(appendix_number) AS n FROM docs WHERE company_id = 'nirvad' AND id IN (SELECT document_id FROM mat)))) GROUP BY 1)"


def _number(spark: SparkSession, d: str) -> str:
    """The smallest number of a matched document of the company."""
    m = matches(spark, d).select(F.col("document_id").alias("id"))
    row = docs(spark, d).where("company_id = 'nirvad'").join(m, "id", "left_semi").select(F.explode("appendix_number").alias("n")).agg(F.min("n").alias("n")).first()
    return row["n"] or ""


def api_documents(spark: SparkSession, d: str) -> DataFrame:
    """GET documents by domain and category, with flags; the coverage type stands for the category."""
    kinds = extractions(spark, d).select("document_id", F.col("coverage_type").alias("main_category"))
    rows = api.documents(docs(spark, d), table(spark, d, "document_extractions"), table(spark, d, "document_embeddings"), kinds, domain="health", main_category="סיעוד")
    return rows.select("id", "company_id", "has_extraction", "has_embedding", "main_category")


def api_matches(spark: SparkSession, d: str) -> DataFrame:
    """GET matches by status."""
    return api.matches(matches(spark, d), docs(spark, d), status="rejected").select("id", "similarity_score", "a_company_id", "b_company_id")


def api_companies(spark: SparkSession, d: str) -> DataFrame:
    """GET companies with their number of documents."""
    return api.companies(table(spark, d, "companies"), docs(spark, d)).select("id", "display_name", "n_documents")


def api_appendix(spark: SparkSession, d: str) -> DataFrame:
    """GET a numbered appendix of a company with its extraction."""
    return api.appendix(docs(spark, d), extractions(spark, d), "nirvad", _number(spark, d)).select("id", "candidates", "coverage_type", "coverage_name")


def api_appendix_matches(spark: SparkSession, d: str) -> DataFrame:
    """GET the matches of a numbered appendix."""
    return api.appendix_matches(docs(spark, d), matches(spark, d), "nirvad", _number(spark, d)).select("id", "status", "other", "other_company")


def _busiest(spark: SparkSession, d: str) -> str:
    """The document with the most matches; of several the smallest."""
    row = matches(spark, d).groupBy("document_id").count().orderBy(F.desc("count"), "document_id").first()
    return row["document_id"] if row else ""


def api_document_matches(spark: SparkSession, d: str) -> DataFrame:
    """GET matches of one document, which may stand at either side."""
    return api.matches(matches(spark, d), docs(spark, d), document_id=_busiest(spark, d)).select("id", "status", "a_company_id", "b_company_id")


def api_analysis(spark: SparkSession, d: str) -> DataFrame:
    """GET a document with what is known about it, a section each; null where there is none."""
    e = extractions(spark, d).select("document_id", "coverage_name", "disease_count")
    m = matches(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    none = e.where("document_id is null").select("document_id", "coverage_name")
    rows = api.analysis(docs(spark, d).select("id", "company_id"), _busiest(spark, d), extraction=e, matching=m, profile=none)
    return rows.select("id", "company_id", "extraction.coverage_name", "extraction.disease_count", F.col("matching.n").alias("n_matches"), F.col("profile").isNull().alias("no_profile"))


def api_extraction(spark: SparkSession, d: str) -> DataFrame:
    """GET the extraction of a document, missing lists as empty ones; here of the first document with an extraction."""
    e = extractions(spark, d)
    first = e.agg(F.min("document_id").alias("x")).first()["x"]
    return api.extraction(e, first).select("document_id", "coverage_name", "exclusions", "insurance_amounts")


def api_review(spark: SparkSession, d: str) -> DataFrame:
    """PATCH a match: the smallest pending one is confirmed, the others stay."""
    m = matches(spark, d)
    pending = m.where("status = 'pending_review'").agg(F.min("id").alias("x")).first()["x"]
    return api.review(m, pending or "", "confirmed").select("id", "status")


def api_appendices(spark: SparkSession, d: str) -> DataFrame:
    """GET a company's appendices of a domain, newest first."""
    return api.appendices(docs(spark, d), "nirvad", domain="health").select("id", "appendix_name", "created_date")


def api_health(spark: SparkSession, d: str) -> DataFrame:
    """GET health: can every table be read, and has it rows?"""
    names = ["companies", "policy_documents", "document_extractions", "document_matches"]
    parts = [table(spark, d, n).limit(1).agg(F.lit(n).alias("name"), (F.count(F.lit(1)) > 0).alias("filled")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES = {
    f.__name__: f
    for f in (
        api_documents, api_matches, api_companies, api_appendix, api_appendix_matches, api_document_matches, api_analysis, api_extraction, api_review, api_appendices, api_health,
    )
}
BUSIEST = "busiest AS (SELECT document_id AS me FROM mat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
ORACLES = {
    "api_documents": f"""WITH {DOCS}, {EXTR} SELECT d.id, d.company_id, true AS has_extraction, d.id IN (SELECT document_id FROM document_embeddings WHERE document_id IS NOT NULL) AS has_embedding, e.coverage_type AS main_category
FROM docs d JOIN extr e ON e.document_id = d.id WHERE d.domain = 'health' AND e.coverage_type = 'סיעוד'""",
    "api_matches": f"WITH {DOCS}, {MATCHES} SELECT m.id, m.similarity_score, a.company_id AS a_company_id, b.company_id AS b_company_id FROM mat m JOIN docs a ON a.id = m.document_id JOIN docs b ON b.id = m.matched_document_id WHERE m.status = 'rejected'",
    "api_companies": f"WITH {DOCS} SELECT c.id, c.display_name, count(d.id) AS n_documents FROM companies c LEFT JOIN docs d ON d.company_id = c.id GROUP BY ALL",
    "api_appendix": f"WITH {DOCS}, {EXTR}, {MATCHES}, {FIND} SELECT f.me AS id, f.candidates, e.coverage_type, e.coverage_name FROM found f LEFT JOIN extr e ON e.document_id = f.me",
    "api_appendix_matches": f"""WITH {DOCS}, {MATCHES}, {FIND} SELECT m.id, m.status, o.id AS other, o.company_id AS other_company FROM found f JOIN mat m ON f.me IN (m.document_id, m.matched_document_id)
JOIN docs o ON o.id = CASE WHEN m.document_id = f.me THEN m.matched_document_id ELSE m.document_id END""",
    "api_document_matches": f"""WITH {DOCS}, {MATCHES}, {BUSIEST} SELECT m.id, m.status, a.company_id AS a_company_id, b.company_id AS b_company_id FROM busiest x JOIN mat m ON x.me IN (m.document_id, m.matched_document_id)
JOIN docs a ON a.id = m.document_id JOIN docs b ON b.id = m.matched_document_id""",
    "api_analysis": f"""WITH {DOCS}, {EXTR}, {MATCHES}, {BUSIEST} SELECT d.id, d.company_id, e.coverage_name, e.disease_count, (SELECT count(*) FROM mat WHERE document_id = d.id) AS n_matches, true AS no_profile
FROM busiest x JOIN docs d ON d.id = x.me LEFT JOIN extr e ON e.document_id = d.id""",
    "api_extraction": f"WITH {EXTR} SELECT document_id, coverage_name, coalesce(exclusions, []) AS exclusions, coalesce(insurance_amounts, []) AS insurance_amounts FROM extr WHERE document_id = (SELECT min(document_id) FROM extr)",
    "api_review": f"WITH {MATCHES} SELECT id, CASE WHEN id = (SELECT min(id) FROM mat WHERE status = 'pending_review') THEN 'confirmed' ELSE status END AS status FROM mat",
    "api_appendices": f"WITH {DOCS} SELECT id, appendix_name, created_date FROM docs WHERE company_id = 'nirvad' AND domain = 'health' ORDER BY created_date DESC, id",
    "api_health": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) > 0 AS filled FROM {n}" for n in ("companies", "policy_documents", "document_extractions", "document_matches")),
}

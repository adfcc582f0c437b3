"""What the plans share: current rows of the domain tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.functions import measures as M
from tavla.functions import text as X
from tavla.operators.ranking import latest
from tavla.session import table

MODEL = "appendix-mini-64"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "policy_documents"), ["id"], ["created_date"])


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "document_extractions"), ["document_id"], ["created_date"])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each match, its status in plain spelling."""
    rows = table(spark, sf_dir, "document_matches").withColumn("status", F.lower(X.strip(F.col("status"))))
    return latest(rows, ["id"], ["created_date", "status", "similarity_score"])


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "document_canonical_codes").withColumn("code", F.upper(X.strip(F.col("code"))))
    return rows.where("code <> ''")


def entities(spark: SparkSession, sf_dir: str, asof: str = "2015-01-01", *, lexical: bool = True) -> DataFrame:
    """id, company, domain, vector, active and, if ``lexical``, words, scope of every document with a current unit vector."""
    vectors = table(spark, sf_dir, "document_embeddings").where(F.col("model_name") == MODEL)
    current = vectors.groupBy("document_id").agg(F.max(F.struct("created_date", "embedding")).alias("r")).select("document_id", M.unit(F.col("r.embedding")).alias("vector"))
    d = docs(spark, sf_dir)
    joined = current.where("vector is not null").join(d, current["document_id"] == d["id"]).drop("document_id")
    active = F.col("marketing_end_date").isNull() | (F.col("marketing_end_date") >= F.lit(asof).cast("date"))
    columns = ["id", F.col("company_id").alias("company"), "domain", "vector", active.alias("active")]
    if not lexical:
        return joined.select(*columns)
    e = extractions(spark, sf_dir).select(F.col("document_id").alias("id"), "coverage_type", "coverage_name")
    names = [F.col("appendix_name"), F.col("coverage_type"), F.col("coverage_name")]
    named = F.coalesce(*[X.filled(c) for c in names])
    return joined.join(e, "id", "left").select(
        *columns,
        F.when(named.isNotNull(), X.combined_tokens(*names)).alias("words"), X.scope_signature(names[0], names[2]).alias("scope"),
    )


def words_sql(expression: str) -> str:
    """The content words of a text, where the column ws of EXCLUDED is in scope."""
    return f"list_distinct(list_filter(regexp_extract_all(coalesce({expression}, ''), '[א-ת]+'), lambda x: length(x) >= 2 AND NOT list_contains(ws, x)))"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


DOCS = "docs AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_date DESC) AS rn FROM policy_documents) WHERE rn = 1)"
EXTR = "extr AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_date DESC) AS rn FROM document_extractions) WHERE rn = 1)"
BLANK = r"[\s\x{00a0}]+"
STATUS = rf"lower(regexp_replace(status, '^{BLANK}|{BLANK}$', '', 'g'))"
MATCHES = f"""mat AS (SELECT * EXCLUDE rn FROM (SELECT * REPLACE ({STATUS} AS status), row_number() OVER (PARTITION BY id
  ORDER BY created_date DESC NULLS LAST, {STATUS} DESC NULLS LAST, similarity_score DESC NULLS LAST) AS rn FROM document_matches) WHERE rn = 1)"""
CODES = rf"""codes AS (SELECT * FROM (SELECT * REPLACE (upper(regexp_replace(code, '^{BLANK}|{BLANK}$', '', 'g')) AS code) FROM document_canonical_codes) WHERE code <> '')"""
EXCLUDED = f"excluded AS (SELECT {_list(X.default_excluded())} AS ws)"
VECTORS = f"""vec AS (SELECT document_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (
  SELECT document_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY document_id ORDER BY created_date DESC, embedding DESC NULLS LAST) AS rn
  FROM document_embeddings WHERE model_name = '{MODEL}') WHERE rn = 1 AND e IS NOT NULL AND list_sum(list_transform(e, lambda y: y * y)) > 0)"""
SIDES = """sides AS (SELECT d.id, d.company_id AS company, d.domain, v.v, (d.marketing_end_date IS NULL OR d.marketing_end_date >= DATE '2015-01-01') AS active,
  d.appendix_name, e.coverage_type, e.coverage_name FROM vec v JOIN docs d ON d.id = v.document_id LEFT JOIN extr e ON e.document_id = d.id
  WHERE d.company_id IS NOT NULL AND d.domain IS NOT NULL)"""

"""Queries of the training-data problems, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.llm.bpe import encode_column
from tavla.llm.canonical import UNMATCHED, map_to_canonical
from tavla.llm.contamination import find_leaks
from tavla.llm.grouping import connected_groups
from tavla.llm.linkage import link_records
from tavla.llm.listings import PASSES, common_words, document_features, document_keys, listing_comparisons, listing_features, listing_keys
from tavla.llm.neighbours import most_similar
from tavla.llm.setjoin import similar_links, similar_pairs
from tavla.llm.splitting import split_oversized
from tavla.session import cut, discard, table


# Carrier phrases around a typed item, and other ways to write a form of the list (pattern, replacement).
OPENERS = ("מקרה של", "עקב", "לרבות", "אירוע", "אובחן", "בגין", "כל", "תביעה הנובעת מ")
CLOSERS = ("באישור רופא", "וסיבוכיו", "ראה סעיף 4", "לפי הגדרה", "כהגדרתו בפוליסה")
REWRITES = ((" של ה", " ב"), (" של ", " ב"))


def _mapped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every freely typed item of disease_list and exclusions with the code it means; exact names and synonyms are left out."""
    docs = table(spark, sf_dir, "document_extractions")
    parts = [
        docs.select("document_id", F.lit(field).alias("source_field"), F.lit(category).alias("category"), F.posexplode(field).alias("item_pos", "item"))
        for field, category in (("disease_list", "insured_event"), ("exclusions", "exclusion"))
    ]
    items = parts[0].unionByName(parts[1]).where(F.col("document_id").isNotNull() & F.col("item").rlike(r"[^\s\u00a0]"))
    reference = table(spark, sf_dir, "canonical_codes")
    listed = reference.select(F.explode(F.concat(F.array("canonical_name_he"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("item"))
    typed = items.join(listed.where("item is not null").distinct(), "item", "left_anti")
    return map_to_canonical(
        typed, "item", "category", reference, code="code", code_category="code_category", name="canonical_name_he", synonyms="synonyms", out="code",
        openers=OPENERS, closers=CLOSERS, rewrites=REWRITES,
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, source_field, item_pos, code: what each freely typed item means, or UNMATCHED."""
    return _mapped_items(spark, sf_dir).select("document_id", "source_field", "item_pos", "code").distinct()


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_field, item, n: the items that mean no entry of the list, with the number of rows that hold them."""
    return _mapped_items(spark, sf_dir).where(F.col("code") == UNMATCHED).groupBy("source_field", "item").agg(F.count(F.lit(1)).alias("n"))


def _code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "document_canonical_codes").where(F.col("source_field").isin("disease_list", "exclusions"))
    code = F.upper(F.regexp_replace("code", r"^\s+|\s+$", ""))
    return rows.select("document_id", F.when(code != "", F.array(code)).alias("codes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_a < doc_b: documents with at least 10 codes each whose sets have a Jaccard coefficient of 0.75 or more."""
    pairs = similar_pairs(_code_sets(spark, sf_dir), "document_id", "codes", 0.75, min_size=10)
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, class_id, copies, links: the same links counted per document, copies not written out; documents of at least 10 codes."""
    links = similar_links(_code_sets(spark, sf_dir), "document_id", "codes", 0.75, min_size=10)
    return links.withColumnRenamed("record", "document_id")


P3_COMMON = r"""
WITH codes AS (
  SELECT DISTINCT document_id, upper(regexp_replace(code, '^\s+|\s+$', '', 'g')) AS code
  FROM document_canonical_codes
  WHERE source_field IN ('disease_list', 'exclusions') AND document_id IS NOT NULL AND regexp_matches(code, '\S')
), sized AS (
  SELECT document_id, code, count(*) OVER (PARTITION BY document_id) AS n FROM codes
), common AS (
  SELECT a.document_id AS doc_a, b.document_id AS doc_b, a.n + b.n - count(*) AS either, count(*) AS shared
  FROM sized a JOIN sized b ON a.code = b.code AND a.document_id < b.document_id
  WHERE a.n >= 10 AND b.n >= 10 GROUP BY a.document_id, b.document_id, a.n, b.n
), found AS (SELECT doc_a, doc_b FROM common WHERE shared >= 0.75 * either)
"""
P3_SQL = P3_COMMON + "SELECT doc_a, doc_b FROM found"
P3_LINKS_SQL = (
    P3_COMMON
    + """, sets AS (SELECT document_id, list(code ORDER BY code) AS s FROM sized WHERE n >= 10 GROUP BY document_id),
ends AS (SELECT d, count(*) AS n FROM (SELECT doc_a AS d FROM found UNION ALL SELECT doc_b FROM found) GROUP BY d)
SELECT document_id, min(document_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies, coalesce(n, 0) AS links
FROM sets LEFT JOIN ends ON d = document_id"""
)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, group_id: every document linked to another one, with the smallest document of its group."""
    rows = table(spark, sf_dir, "document_matches")
    # Equal dates: the greatest status, then the greatest score decides.
    latest = rows.groupBy("id").agg(
        F.max(F.struct("created_date", "status", "similarity_score", "document_id", "matched_document_id")).alias("r")
    ).select("r.*")
    status = F.lower(F.regexp_replace("status", r"^\s+|\s+$", ""))
    links = latest.where((status == "confirmed") | ((status == "auto_confirmed") & (F.col("similarity_score") >= 0.90)))
    return connected_groups(links, "document_id", "matched_document_id").select(F.col("node").alias("document_id"), F.col("group").alias("group_id"))


P4_SQL = r"""
WITH RECURSIVE ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_date DESC NULLS LAST, status DESC NULLS LAST, similarity_score DESC NULLS LAST,
    document_id DESC NULLS LAST, matched_document_id DESC NULLS LAST) AS rn FROM document_matches
), links AS (
  SELECT document_id AS a, matched_document_id AS b FROM ranked
  WHERE rn = 1 AND document_id <> matched_document_id
    AND (lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'confirmed'
      OR (lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'auto_confirmed' AND similarity_score >= 0.90))
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (
  SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
)
SELECT node AS document_id, least(node, min(other)) AS group_id FROM reach GROUP BY node
"""

def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, document_id, confidence, any_match: each listing's most likely document."""
    policies = table(spark, sf_dir, "policy_documents").groupBy("id").agg(
        F.max(F.struct("created_date", "company_id", "appendix_name", F.date_format("marketing_start_date", "yyyy-MM-dd").alias("start"))).alias("r")
    )
    extractions = table(spark, sf_dir, "document_extractions").groupBy("document_id").agg(F.max(F.struct("created_date", "coverage_name", "coverage_type")).alias("e"))
    docs = policies.join(extractions, policies["id"] == extractions["document_id"], "left").select(
        "id", "r.company_id", "r.appendix_name", "r.start", "e.coverage_name", "e.coverage_type"
    )
    docs = cut(docs.where("id is not null"))
    common = common_words(docs, "appendix_name")
    companies = table(spark, sf_dir, "companies")
    if companies.count() > 100_000:
        raise ValueError("the list of companies is too long to be broadcast")
    named = [(r["id"], r["display_name"]) for r in companies.collect()]
    listings = listing_features(table(spark, sf_dir, "market_listings"), named, common)
    links = link_records(listings, document_features(docs, common), PASSES, listing_comparisons(), keys=(listing_keys, document_keys))
    discard(docs)
    return links.select(F.col("lid").alias("listing_id"), F.col("rid").alias("document_id"), "confidence", "any_match")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, document_id: each listing whose product is among the documents, with that document."""
    return p5_links(spark, sf_dir).select("listing_id", "document_id")


def _similar_documents(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    rows = table(spark, sf_dir, "document_embeddings").where("model_name = 'appendix-mini-64'")
    # The current row decides, null or not; equal dates: the greatest vector.
    current = rows.groupBy("document_id").agg(F.max(F.struct("created_date", "embedding")).alias("r")).select("document_id", "r.embedding")
    near = most_similar(current, "document_id", "embedding", k=5, dim=64, **more)
    return near.select(F.least("key", "other").alias("doc_a"), F.greatest("key", "other").alias("doc_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_a < doc_b: pairs in which at least one document is among the five most similar to the other."""
    return _similar_documents(spark, sf_dir)


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by exact search: nothing that could matter is left out, at the price of more visits."""
    return _similar_documents(spark, sf_dir, factor=1.0)


P6_SQL = """
WITH cur AS (SELECT document_id, embedding::DOUBLE[] AS e FROM document_embeddings WHERE model_name = 'appendix-mini-64'
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_date DESC NULLS LAST, embedding DESC NULLS LAST) = 1),
v AS (SELECT document_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM cur
  WHERE document_id IS NOT NULL AND len(e) = 64 AND list_sum(list_transform(e, lambda y: y * y)) > 0),
near AS (SELECT a.document_id AS a, b.document_id AS b FROM v a JOIN v b ON a.document_id <> b.document_id
  QUALIFY row_number() OVER (PARTITION BY a.document_id ORDER BY round(list_dot_product(a.u, b.u), 12) DESC, b.document_id) <= 5)
SELECT DISTINCT least(a, b) AS doc_a, greatest(a, b) AS doc_b FROM near
"""


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document's ids by byte_bpe_50k; empty and null texts have an empty list."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: documents with at least 18 successive words of an evaluation item."""
    found = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with their sizes; documents whose tiles cover half of an item in whatever order are reported as well."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", min_share=0.5)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, of at most 1,500 tokens and overlapping by about 100."""
    return split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id: documents of more than 1,500 tokens, by the second of their pieces."""
    pieces = split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", only_oversized=True)
    return pieces.where("piece_no = 1").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_exact": p6_exact, "p7_ids": p7_ids, "p8_found": p8_found, "p8_coverage": p8_coverage, "p9_found": p9_found, "p9_pieces": p9_pieces}
ORACLES = {"p3_found": P3_SQL, "p3_links": P3_LINKS_SQL, "p4_found": P4_SQL, "p6_exact": P6_SQL}

"""Lookups, pending sets, joins, aggregates and rewrites over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.functions import measures as M
from tavla.functions import text as X
from tavla.operators import codes as C
from tavla.operators import ranking as K
from tavla.operators import relational as R
from tavla.plans.common import BLANK, CODES, DOCS, EXTR, MATCHES, codes, docs, extractions, matches
from tavla.session import table

QUERIES, ORACLES = {}, {}
ASOF = "2015-06-30"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {DOCS} SELECT id, company_id, domain, marketing_end_date FROM docs WHERE domain = 'health' AND (marketing_end_date IS NULL OR marketing_end_date >= DATE '{ASOF}')")
def active_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents of a domain that are on sale on a day; the empty company filters nothing."""
    found = R.where_equal(docs(spark, d), company_id="", domain="health")
    return found.where(R.is_active(F.col("marketing_end_date"), ASOF)).select("id", "company_id", "domain", "marketing_end_date")


@query(f"""WITH {DOCS}, keyed AS (SELECT id, company_id, list_sort(appendix_number) AS numbers, marketing_start_date AS edition, (len(appendix_number) > 0 AND marketing_start_date IS NOT NULL) AS known FROM docs),
steps AS (SELECT company_id, numbers, edition, lead(edition) OVER (PARTITION BY company_id, numbers ORDER BY edition) AS nxt FROM (SELECT DISTINCT company_id, numbers, edition FROM keyed WHERE known AND company_id IS NOT NULL))
SELECT k.id, CASE WHEN k.known AND k.company_id IS NOT NULL THEN k.edition END AS valid_from, (s.nxt - INTERVAL 1 DAY)::DATE AS valid_to
FROM keyed k LEFT JOIN steps s ON s.company_id = k.company_id AND s.numbers = k.numbers AND s.edition = k.edition AND k.known""")
def validity_windows(spark: SparkSession, d: str) -> DataFrame:
    """An edition is valid until the day before the next one with the same numbers."""
    keyed = docs(spark, d).select("id", "company_id", F.when(F.size("appendix_number") > 0, F.array_sort("appendix_number")).alias("numbers"), F.col("marketing_start_date").alias("edition"))
    return K.next_edition_windows(keyed, ["company_id", "numbers"], "edition").select("id", "valid_from", "valid_to")


@query(f"""WITH {DOCS}, e AS (SELECT id, company_id, unnest(appendix_number) AS number, created_date FROM docs)
SELECT company_id, number, arg_max(id, struct_pack(c := created_date, i := id)) AS id, count(*) AS candidates FROM e GROUP BY ALL""")
def latest_by_number(spark: SparkSession, d: str) -> DataFrame:
    """The most recent document of every company and appendix number, and how many there were."""
    e = docs(spark, d).select("id", "company_id", F.explode("appendix_number").alias("number"), "created_date")
    return e.groupBy("company_id", "number").agg(F.max_by("id", F.struct("created_date", "id")).alias("id"), F.count(F.lit(1)).alias("candidates"))


@query(f"""WITH {DOCS}, n AS (SELECT min(x) AS x FROM (SELECT unnest(appendix_number) AS x FROM docs WHERE company_id = 'nirvad'))
SELECT id, appendix_name FROM docs, n WHERE company_id = 'nirvad' AND list_contains(appendix_number, x)""")
def by_number(spark: SparkSession, d: str) -> DataFrame:
    """documents of a company with a number among theirs; the smallest number that it has."""
    own = docs(spark, d).where("company_id = 'nirvad'")
    number = own.select(F.explode("appendix_number").alias("x")).agg(F.min("x").alias("x")).first()["x"]
    return own.where(F.array_contains("appendix_number", F.lit(number))).select("id", "appendix_name")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger made from the extractions: extracted at their date; classified, by version, where the type is known."""
    e = extractions(spark, d)
    return e.select(
        F.col("document_id").alias("id"), F.col("created_date").alias("extract_at"), F.lit("v2").alias("extract_version"),
        F.when(F.col("coverage_type").isNotNull(), F.col("created_date")).alias("classify_at"),
        F.when(F.col("coverage_type").isNotNull(), F.when(F.col("disease_count") > 3, "v2").otherwise("v1")).alias("classify_version"),
    )


LEDGER = """ledger AS (SELECT document_id AS id, created_date AS extract_at, 'v2' AS extract_version, CASE WHEN coverage_type IS NOT NULL THEN created_date END AS classify_at,
  CASE WHEN coverage_type IS NOT NULL THEN CASE WHEN disease_count > 3 THEN 'v2' ELSE 'v1' END END AS classify_version FROM extr)"""


@query(f"""WITH {DOCS}, {EXTR}, {LEDGER} SELECT id FROM docs WHERE id IN (SELECT id FROM ledger WHERE extract_at IS NOT NULL) AND id NOT IN (SELECT id FROM ledger WHERE classify_version = 'v2' AND classify_at IS NOT NULL)""")
def stage_pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are extracted but not classified by the current version."""
    return R.pending(docs(spark, d).select("id"), _ledger(spark, d), "id", stage="classify", version="v2", after="extract")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE id NOT IN (SELECT document_id FROM document_extractions WHERE document_id IS NOT NULL)")
def not_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Documents without an extraction."""
    return docs(spark, d).select("id").join(table(spark, d, "document_extractions").select(F.col("document_id").alias("id")), "id", "left_anti")


@query(f"""WITH {DOCS}, {EXTR}, {LEDGER}, done AS (SELECT id FROM docs WHERE pages_count > 15)
SELECT coalesce(l.id, x.id) AS id, l.extract_version, CASE WHEN x.id IS NOT NULL THEN TIMESTAMP '2025-01-01' ELSE l.classify_at END AS classify_at, CASE WHEN x.id IS NOT NULL THEN 'v3' ELSE l.classify_version END AS classify_version
FROM ledger l FULL JOIN done x ON x.id = l.id""")
def ledger_update(spark: SparkSession, d: str) -> DataFrame:
    """One stage is marked done for some documents, other stages stay."""
    done = docs(spark, d).where("pages_count > 15").select("id")
    at = F.lit("2025-01-01").cast("timestamp_ntz")
    return R.marked_done(_ledger(spark, d), done, "id", stage="classify", version="v3", at=at).select("id", "extract_version", "classify_at", "classify_version")


@query(f"""WITH {DOCS}, {CODES}, unmatched AS (SELECT DISTINCT document_id FROM codes WHERE confidence < 0.4), results AS (SELECT DISTINCT document_id FROM codes WHERE confidence > 0.95)
SELECT id FROM docs WHERE id NOT IN (SELECT document_id FROM unmatched WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM results WHERE document_id IS NOT NULL))""")
def deferred_marks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with nothing unmatched left, or with a fallback result."""
    c = codes(spark, d)
    key = F.col("document_id").alias("id")
    return R.settled(c.where("confidence < 0.4").select(key), c.where("confidence > 0.95").select(key), docs(spark, d), "id")


@query(f"""WITH {DOCS}, {EXTR} SELECT d.id, e.document_id IS NOT NULL AS has_extraction, d.id IN (SELECT document_id FROM document_embeddings WHERE document_id IS NOT NULL) AS has_embedding
FROM docs d LEFT JOIN extr e ON e.document_id = d.id WHERE e.coverage_type = 'שירות'""")
def document_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the documents of one type; the others, untyped ones included, drop out."""
    e = extractions(spark, d).select(F.col("document_id").alias("id"), "coverage_type")
    typed = docs(spark, d).select("id").join(e, "id", "left").where(F.col("coverage_type") == "שירות")
    both = R.flagged(R.flagged(typed, e, "id", "has_extraction"), table(spark, d, "document_embeddings"), "id", "has_embedding", other_key="document_id")
    return both.select("id", "has_extraction", "has_embedding")


@query(f"""WITH {DOCS}, {EXTR}, {CODES}, {MATCHES}, pc AS (SELECT document_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT code)), '; ') AS cs FROM codes GROUP BY 1),
pm AS (SELECT document_id, count(*) AS n FROM mat GROUP BY 1)
SELECT d.company_id, d.id, coalesce(d.appendix_name, '') AS appendix_name, coalesce(array_to_string(d.appendix_number, '; '), '') AS numbers, e.coverage_type, coalesce(pc.n, 0) AS n_codes, coalesce(pc.cs, '') AS codes, coalesce(pm.n, 0) AS n_matches
FROM docs d LEFT JOIN extr e ON e.document_id = d.id LEFT JOIN pc ON pc.document_id = d.id LEFT JOIN pm ON pm.document_id = d.id WHERE NOT starts_with(d.company_id, 'test_company')""")
def profile_export(spark: SparkSession, d: str) -> DataFrame:
    """One flat row per document; what hangs on a document is aggregated first, then joined."""
    c = codes(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n_codes"), F.array_join(F.array_sort(F.collect_set("code")), "; ").alias("codes"))
    m = matches(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n_matches"))
    e = extractions(spark, d).select(F.col("document_id").alias("id"), "coverage_type")
    rows = docs(spark, d).where(~F.col("company_id").startswith("test_company")).join(e, "id", "left").join(c, "id", "left").join(m, "id", "left")
    return rows.select(
        "company_id", "id", F.coalesce("appendix_name", F.lit("")).alias("appendix_name"), X.list_text(F.col("appendix_number")).alias("numbers"), "coverage_type",
        F.coalesce("n_codes", F.lit(0)).alias("n_codes"), F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


@query(f"WITH {DOCS} SELECT c.id, c.display_name, count(d.id) FILTER (d.domain = 'mixed') AS n FROM companies c LEFT JOIN docs d ON d.company_id = c.id GROUP BY ALL")
def company_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1: documents of one domain per company, companies without one included."""
    n = docs(spark, d).where("domain = 'mixed'").groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "companies").join(n, "id", "left").select("id", "display_name", F.coalesce("n", F.lit(0)).alias("n"))


@query(r"SELECT coverage_type AS value, count(*) AS n FROM document_extractions WHERE regexp_matches(coverage_type, '[^\s\x{00a0}]') GROUP BY 1")
def value_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Filled values as they stand, with their frequency."""
    return table(spark, d, "document_extractions").where(F.col("coverage_type").rlike(r"[^\s ]")).groupBy(F.col("coverage_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT item, count(*) AS n FROM (SELECT regexp_replace(unnest(disease_list), '^{BLANK}|{BLANK}$', '', 'g') AS item FROM document_extractions) WHERE item <> '' GROUP BY 1")
def item_frequency(spark: SparkSession, d: str) -> DataFrame:
    """A3: stripped list items with their frequency."""
    items = table(spark, d, "document_extractions").select(F.explode("disease_list").alias("item")).select(X.strip(F.col("item")).alias("item"))
    return items.where("item <> ''").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS} SELECT DISTINCT department_name AS value FROM docs WHERE department_name <> ''")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct filled values, sorted."""
    return docs(spark, d).where("department_name <> ''").select(F.col("department_name").alias("value")).distinct().orderBy("value")


@query(f"WITH {DOCS} SELECT company_id, list_sort(list(DISTINCT n)) AS numbers FROM (SELECT company_id, unnest(appendix_number) AS n FROM docs) GROUP BY 1")
def company_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct list items of each company."""
    n = docs(spark, d).select("company_id", F.explode("appendix_number").alias("n"))
    return n.groupBy("company_id").agg(F.array_sort(F.collect_set("n")).alias("numbers"))


@query(f"""WITH {DOCS}, f AS (SELECT d.company_id, d.id IN (SELECT document_id FROM document_extractions WHERE document_id IS NOT NULL) AS x, d.id IN (SELECT document_id FROM document_embeddings WHERE document_id IS NOT NULL) AS e FROM docs d)
SELECT company_id, count(*) AS total, count(*) FILTER (x) AS extracted, count(*) FILTER (e) AS embedded FROM f GROUP BY 1 HAVING count(*) > 1""")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals by company, companies with one document left out."""
    base = docs(spark, d).select("id", "company_id")
    flags = R.flagged(R.flagged(base, table(spark, d, "document_extractions"), "id", "x", other_key="document_id"), table(spark, d, "document_embeddings"), "id", "e", other_key="document_id")
    totals = flags.groupBy("company_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("x").alias("extracted"), F.count_if("e").alias("embedded"))
    return totals.where("total > 1")


@query(f"""WITH {DOCS} SELECT id FROM docs WHERE domain = 'life' AND (contains(lower(original_file_name), '12') OR contains(lower(appendix_name), '12') OR len(list_filter(appendix_number, lambda n: contains(lower(n), '12'))) > 0)""")
def ui_search(spark: SparkSession, d: str) -> DataFrame:
    """a compound filter: domain, and text in file name, name or any number."""
    has = lambda c: F.coalesce(F.lower(c).contains("12"), F.lit(False))
    any_number = F.coalesce(F.exists("appendix_number", lambda n: F.lower(n).contains("12")), F.lit(False))
    return docs(spark, d).where((F.col("domain") == "life") & (has(F.col("original_file_name")) | has(F.col("appendix_name")) | any_number)).select("id")


@query("SELECT code, starts_with(code, 'ELIG_') AS by_start, code LIKE 'ELIG_%' AS by_like FROM canonical_codes WHERE code LIKE 'ELIG_%' OR starts_with(code, 'AORT')")
def prefix_filters(spark: SparkSession, d: str) -> DataFrame:
    """a literal prefix and a pattern in which the underscore stands for any sign."""
    c = F.col("code")
    return table(spark, d, "canonical_codes").where(c.like("ELIG_%") | c.startswith("AORT")).select("code", c.startswith("ELIG_").alias("by_start"), c.like("ELIG_%").alias("by_like"))


@query("SELECT id, marketing_start_date FROM policy_documents WHERE domain IN ('life', 'mixed') AND marketing_start_date IS NOT NULL AND pages_count >= 12")
def projected_scan(spark: SparkSession, d: str) -> DataFrame:
    """an in-list and a threshold that reach the scan."""
    return table(spark, d, "policy_documents").where(F.col("domain").isin("life", "mixed") & F.col("marketing_start_date").isNotNull() & (F.col("pages_count") >= 12)).select("id", "marketing_start_date")


@query(f"""WITH {EXTR} SELECT document_id, list_filter(insurance_amounts, lambda x: contains(x, 'דולר') OR contains(x, 'ש"ח')) AS kept, CASE WHEN coverage_type IN (SELECT coverage_type FROM extr WHERE coverage_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) THEN coverage_type END AS category FROM extr""")
def enum_validation(spark: SparkSession, d: str) -> DataFrame:
    """an unknown category is null; of a list only allowed items stay, repetitions too."""
    e = extractions(spark, d)
    known = e.where("coverage_type is not null").groupBy("coverage_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("coverage_type", F.col("coverage_type").alias("category"))
    kept = F.filter("insurance_amounts", lambda x: x.contains("דולר") | x.contains('ש"ח'))
    return e.join(known, "coverage_type", "left").select("document_id", kept.alias("kept"), "category")


@query(f"""WITH {DOCS}, found AS (SELECT DISTINCT ON (document_id) document_id AS id, appendix_name FROM (SELECT document_id, appendix_name, snapshot_id FROM document_snapshots WHERE appendix_name <> '' ORDER BY document_id, snapshot_id))
SELECT d.id, coalesce(nullif(d.appendix_name, ''), f.appendix_name) AS appendix_name FROM docs d LEFT JOIN found f ON f.id = d.id""")
def backfilled_names(spark: SparkSession, d: str) -> DataFrame:
    """F16: missing names are taken from what the first crawl saw."""
    seen = table(spark, d, "document_snapshots").where("appendix_name <> ''").groupBy(F.col("document_id").alias("id")).agg(F.min_by("appendix_name", "snapshot_id").alias("appendix_name"))
    return R.backfilled(docs(spark, d).select("id", "appendix_name"), seen, "id", texts=["appendix_name"])


@query(f"""WITH old AS (SELECT id, appendix_number AS a FROM policy_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_date) = 1),
new AS (SELECT id, list_filter(appendix_number, lambda x: NOT contains(x, '/')) AS a FROM policy_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_date DESC) = 1)
SELECT n.id, CASE WHEN len(n.a) > 0 THEN n.a ELSE coalesce(o.a, n.a) END AS numbers FROM new n LEFT JOIN old o ON o.id = n.id""")
def preserved_numbers(spark: SparkSession, d: str) -> DataFrame:
    """a re-sync keeps the old numbers where it finds none."""
    p = table(spark, d, "policy_documents").select("id", "appendix_number", "created_date")
    old = K.latest_first(p, ["id"], ["created_date"]).select("id", F.col("appendix_number").alias("numbers"))
    new = K.latest(p, ["id"], ["created_date"]).select("id", F.filter("appendix_number", lambda x: ~x.contains("/")).alias("numbers"))
    return R.backfilled(new, old, "id", lists=["numbers"]).select("id", "numbers")


@query(f"""WITH {DOCS} SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 100)::BIGINT AS chunk FROM docs""")
def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a hundred documents in order."""
    return K.chunked(docs(spark, d).select("id"), ["id"], 100)


@query(f"WITH {DOCS} SELECT id, created_date FROM docs ORDER BY created_date DESC, id LIMIT 200")
def newest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most recent documents."""
    return K.top_rows(docs(spark, d).select("id", "created_date"), [F.desc("created_date"), F.col("id")], 200)


@query("""SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content."""
    return K.content_once(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("digest", "doc_id")


@query("""SELECT document_id, snapshot_id, record_state FROM document_snapshots QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, snapshot_id) = 1""")
def first_observations(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each document by arrival."""
    rows = table(spark, d, "document_snapshots").select("document_id", "snapshot_id", "record_state", "ingested_at")
    return K.latest_first(rows, ["document_id"], ["ingested_at", "snapshot_id"]).select("document_id", "snapshot_id", "record_state")


@query("""WITH best AS (SELECT c.*, row_number() OVER (PARTITION BY lower(trim(listed_title)) ORDER BY part, listing_id) AS rn FROM (SELECT *, CASE WHEN company_label IS NOT NULL THEN 0 ELSE 1 END AS part FROM market_listings WHERE listed_title IS NOT NULL) c)
SELECT lower(trim(listed_title)) AS title, listing_id FROM best WHERE rn = 1""")
def listing_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of two listings; of rows with one title the first listing's wins."""
    rows = table(spark, d, "market_listings").where("listed_title is not null").select(F.lower(F.trim("listed_title")).alias("title"), "listing_id", "company_label")
    parts = [rows.where("company_label is not null"), rows.where("company_label is null")]
    return R.union_once([p.select("title", "listing_id") for p in parts], "title")


QUESTIONS = [("base.name", "base"), ("base.amount", "base"), ("life.term", "life"), ("health.wait", "health")]
QUESTIONS_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ") t(question_id, cat))"


def _questions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    q = spark.createDataFrame(QUESTIONS, "question_id string, domain string")
    return q.where("domain = 'base'").select("question_id"), q.where("domain <> 'base'")


@query(f"""WITH {DOCS}, {QUESTIONS_SQL} SELECT d.id, d.domain, q.question_id, CASE WHEN starts_with(q.question_id, 'base.') THEN 'base' ELSE 'category' END AS scope FROM docs d JOIN q ON q.cat = 'base' OR q.cat = d.domain""")
def question_set(spark: SparkSession, d: str) -> DataFrame:
    """The base questions and those of the document's domain, with their scope."""
    base, special = _questions(spark)
    rows = R.expected_rows(docs(spark, d).select("id", "domain"), base, special, "domain")
    return rows.withColumn("scope", F.when(F.col("question_id").startswith("base."), "base").otherwise("category"))


@query(f"""WITH {DOCS}, {EXTR}, {QUESTIONS_SQL}, expected AS (SELECT d.id, q.question_id FROM docs d JOIN q ON q.cat = 'base' OR q.cat = d.domain),
given AS (SELECT document_id AS id, 'base.amount' AS question_id, 'ANSWERED' AS status, insurance_amounts[1] AS answer FROM extr WHERE len(insurance_amounts) > 0)
SELECT * FROM given UNION ALL SELECT e.id, e.question_id, 'AMBIGUOUS', NULL FROM expected e WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.id = e.id AND g.question_id = e.question_id)""")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """A placeholder for every expected answer that is missing."""
    base, special = _questions(spark)
    expected = R.expected_rows(docs(spark, d).select("id", "domain"), base, special, "domain").select("id", "question_id")
    e = extractions(spark, d).where(F.size("insurance_amounts") > 0)
    given = e.select(F.col("document_id").alias("id"), F.lit("base.amount").alias("question_id"), F.lit("ANSWERED").alias("status"), F.get("insurance_amounts", 0).alias("answer"))
    return R.filled_up(expected, given, ["id", "question_id"], status=F.lit("AMBIGUOUS"), answer=F.lit(None).cast("string"))


@query(f"""WITH {DOCS} SELECT id, CASE domain WHEN 'life' THEN 0.3 ELSE 0.2 END::DOUBLE AS weight FROM docs""")
def profile_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The option of the domain, else the default one."""
    options = spark.createDataFrame([("default", 0.2), ("life", 0.3)], "option string, weight double")
    return R.with_fallback(docs(spark, d).select("id", "domain"), options, "domain", "weight", "default").select("id", "weight")


@query(f"""WITH {EXTR}, new AS (SELECT document_id, 'new' AS coverage_name FROM extr WHERE disease_count > 6) SELECT document_id, coverage_name FROM extr WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by key."""
    e = extractions(spark, d)
    return R.upserted(e.select("document_id", "coverage_name"), e.where("disease_count > 6").select("document_id", F.lit("new").alias("coverage_name")), ["document_id"])


@query(f"""WITH {CODES}, new AS (SELECT document_id, upper(code) || '_N' AS code FROM codes WHERE code_category = 'exclusion' AND confidence > 0.9)
SELECT document_id, code FROM codes WHERE document_id NOT IN (SELECT document_id FROM new WHERE document_id IS NOT NULL) OR document_id IS NULL UNION ALL SELECT * FROM new""")
def replaced_codes(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a document are replaced by its new ones."""
    c = codes(spark, d)
    new = c.where("code_category = 'exclusion' and confidence > 0.9").select("document_id", F.concat("code", F.lit("_N")).alias("code"))
    return R.replaced_per_group(c.select("document_id", "code"), new, "document_id")


@query(f"""WITH {EXTR}, {DOCS} SELECT d.id, d.company_id, e.coverage_name FROM docs d JOIN extr e ON e.document_id = d.id""")
def extracted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their extraction."""
    e = extractions(spark, d).select(F.col("document_id").alias("id"), "coverage_name")
    return docs(spark, d).select("id", "company_id").join(e, "id")


@query("""SELECT document_id, 'definition' AS category, phrase, field AS source_field FROM (SELECT document_id, unnest([waiting_period, qualifying_period]) AS phrase, unnest(['waiting_period', 'qualifying_period']) AS field
FROM (SELECT * FROM document_extractions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_date DESC) = 1)) WHERE phrase IS NOT NULL""")
def candidate_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two text fields with their category and source; candidate_phrases_all has the reference's fields."""
    found = C.exploded_phrases(extractions(spark, d), "document_id", [("waiting_period", "definition"), ("qualifying_period", "definition")])
    return found.select("document_id", "category", "phrase", "source_field")


@query(rf"""WITH items AS (SELECT DISTINCT regexp_replace(unnest(exclusions), '^{BLANK}|{BLANK}$', '', 'g') AS phrase FROM document_extractions),
known AS (SELECT code, unnest(list_concat([canonical_name_he], coalesce(synonyms, []))) AS k FROM canonical_codes WHERE code_category = 'exclusion'),
hits AS (SELECT phrase, code, k FROM items JOIN known ON contains(phrase, k) OR contains(k, phrase) WHERE phrase <> '' AND k <> '')
SELECT i.phrase, h.code FROM items i LEFT JOIN (SELECT phrase, code FROM hits QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY length(k) DESC, k, code) = 1) h ON h.phrase = i.phrase WHERE i.phrase <> ''""")
def code_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The code of the longest known phrase that holds an exclusion or is held by it; code_normalize_all has both fields."""
    phrases = table(spark, d, "document_extractions").select(F.explode("exclusions").alias("p")).select(F.lit("exclusion").alias("category"), X.strip(F.col("p")).alias("phrase")).where("phrase <> ''").distinct()
    dictionary = C.code_phrases(table(spark, d, "canonical_codes"), "code", "code_category", "canonical_name_he", "synonyms")
    return C.normalised_phrases(phrases, dictionary.where("category = 'exclusion'")).select("phrase", "code")


#: The fields of the reference's candidate phrases that the tables have, and the categories of their codes.
PHRASE_FIELDS = [("disease_list", "insured_event"), ("exclusions", "exclusion")]


@query(f"WITH {EXTR} " + " UNION ALL ".join(f"SELECT document_id, '{c}' AS category, phrase, '{f}' AS source_field FROM (SELECT document_id, unnest({f}) AS phrase FROM extr) WHERE phrase IS NOT NULL" for f, c in PHRASE_FIELDS))
def candidate_phrases_all(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of the reference's list fields that the tables have, with their category and source."""
    return C.exploded_phrases(extractions(spark, d), "document_id", PHRASE_FIELDS).select("document_id", "category", "phrase", "source_field")


ITEMS_SQL = " UNION ".join(rf"SELECT '{c}' AS category, regexp_replace(x, '^{BLANK}|{BLANK}$', '', 'g') AS phrase FROM (SELECT unnest({f}) AS x FROM document_extractions)" for f, c in PHRASE_FIELDS)


@query(f"""WITH items AS (SELECT * FROM ({ITEMS_SQL}) WHERE phrase <> ''), known AS (SELECT code_category AS category, code, unnest(list_concat([canonical_name_he], coalesce(synonyms, []))) AS k FROM canonical_codes),
hits AS (SELECT i.category, phrase, code, k FROM items i JOIN known n ON n.category = i.category AND (contains(phrase, k) OR contains(k, phrase)) WHERE k <> '')
SELECT i.category, i.phrase, h.code FROM items i LEFT JOIN (SELECT category, phrase, code FROM hits QUALIFY row_number() OVER (PARTITION BY category, phrase ORDER BY length(k) DESC, k, code) = 1) h ON h.category = i.category AND h.phrase = i.phrase""")
def code_normalize_all(spark: SparkSession, d: str) -> DataFrame:
    """For each phrase of a category the code of the longest known phrase of it that holds the phrase or is held by it; unmatched phrases have none."""
    e = table(spark, d, "document_extractions")
    items = F.concat(*[F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("category"), X.strip(x).alias("phrase"))) for f, c in ((F.col(f), c) for f, c in PHRASE_FIELDS)])
    phrases = e.select(F.inline(items)).where("phrase <> ''").distinct()
    dictionary = C.code_phrases(table(spark, d, "canonical_codes"), "code", "code_category", "canonical_name_he", "synonyms")
    return C.normalised_phrases(phrases, dictionary).select("category", "phrase", "code")


@query(f"WITH {CODES}, n AS (SELECT document_id, count(DISTINCT code) AS n, list_sort(list(DISTINCT code)) AS cs FROM codes WHERE document_id IS NOT NULL GROUP BY 1) SELECT document_id, (n - 1)::INT AS at, cs[n] AS code, cs[1] AS first FROM n")
def code_by_index(spark: SparkSession, d: str) -> DataFrame:
    """A code chosen by its place, counted from zero; a place outside gives none."""
    sets = codes(spark, d).where("document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("code")).alias("cs"))
    at = F.size("cs") - 1
    return sets.select("document_id", at.alias("at"), M.item_at(F.col("cs"), at).alias("code"), M.item_at(F.col("cs"), F.lit(0)).alias("first"))


@query(f"""WITH {MATCHES}, inside AS (SELECT id FROM mat WHERE document_id IN (SELECT id FROM policy_documents WHERE domain = 'health') AND matched_document_id IN (SELECT id FROM policy_documents WHERE domain = 'health')) SELECT * FROM inside""")
def matches_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Matches whose two documents are in scope."""
    scope = table(spark, d, "policy_documents").where("domain = 'health'").select("id")
    m = matches(spark, d)
    both = m.join(scope.withColumnRenamed("id", "document_id"), "document_id", "left_semi").join(scope.withColumnRenamed("id", "matched_document_id"), "matched_document_id", "left_semi")
    return both.select("id")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind; the same plan runs on a stream (an extension)."""
    from tavla.streaming.ledger import windowed_counts

    w = windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """A grouped aggregate over the largest general table (an extension)."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))



@query(f"""WITH last AS (SELECT original_file_name AS name, arg_max(appendix_name, struct_pack(c := created_date, i := id)) AS title FROM policy_documents WHERE company_id <> 'keshtov' GROUP BY 1)
SELECT p.name, l.title, l.name IS NOT NULL AS listed FROM (SELECT DISTINCT original_file_name AS name FROM policy_documents) p LEFT JOIN last l ON l.name = p.name""")
def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with the last listing entry of their name; unmatched ones are marked."""
    p = table(spark, d, "policy_documents").withColumnRenamed("original_file_name", "name")
    listing = p.where("company_id <> 'keshtov'").select("name", F.struct(F.col("appendix_name").alias("title")).alias("entry"), F.struct("created_date", "id").alias("at"))
    return R.ingested(p.select("name").distinct(), listing, "name", "at").select("name", F.col("entry.title").alias("title"), "listed")


@query(f"WITH {CODES}, n AS (SELECT code, count(*) AS n FROM codes GROUP BY 1) SELECT n.code, coalesce(c.canonical_name_he, n.code) AS label, n.n FROM n LEFT JOIN canonical_codes c ON c.code = n.code")
def code_labels(spark: SparkSession, d: str) -> DataFrame:
    """Codes in use with their label, or the code itself where the dictionary has none."""
    n = codes(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return R.labelled_by(n, table(spark, d, "canonical_codes").select("code", F.col("canonical_name_he").alias("label")), "code", "label").select("code", "label", "n")

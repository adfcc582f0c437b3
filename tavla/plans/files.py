"""Files in and out as queries: what is written into the shared folder is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.functions import text as X
from tavla.operators import ranking as K
from tavla.operators import relational as R
from tavla.plans.common import BLANK, DOCS, EXTR, docs, extractions
from tavla.session import ensure_checkpoint_dir, table
from tavla.sources import files as S
from tavla.sources import listings as P

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, deleted when the session ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tavla-files-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@query(f"WITH {DOCS} SELECT domain, count(*) AS n, count(*) FILTER (bytes > 0) AS filled FROM (SELECT DISTINCT domain, 1 AS bytes FROM docs WHERE domain IS NOT NULL) GROUP BY 1")
def listed_folders(spark: SparkSession, d: str) -> DataFrame:
    """Files found below a folder, by path; here one file a domain."""
    folder = _folder(spark)
    named = docs(spark, d).where("domain is not null").select("domain", F.to_json(F.struct("id", "appendix_name")).alias("value"))
    named.repartition("domain").write.partitionBy("domain").text(folder)
    files = S.listed_files(spark, folder, "*.txt", with_content=False)
    return files.groupBy(F.regexp_extract("path", r"domain=([^/]+)", 1).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") > 0).alias("filled"))


@query("SELECT code, code_category, canonical_name_he, coalesce(len(synonyms), 0) AS n_synonyms FROM canonical_codes WHERE code_category = 'exclusion'")
def dictionary_slice(spark: SparkSession, d: str) -> DataFrame:
    """One category of a versioned dictionary file, which is one JSON document."""
    path = _folder(spark) + "/codes.v1.json"
    entries = F.collect_list(F.struct("code", "code_category", "canonical_name_he", "synonyms"))
    # The dictionary is the fixed reference list; a file of it is one document by its nature.
    table(spark, d, "canonical_codes").agg(entries.alias("codes")).select(F.lit("v1").alias("version"), "codes").coalesce(1).write.json(path)
    codes = S.dictionary(spark, path, "codes", "code: string, code_category: string, canonical_name_he: string, synonyms: array<string>")
    return R.where_equal(codes, code_category="exclusion").select("code", "code_category", "canonical_name_he", F.coalesce(F.size("synonyms"), F.lit(0)).alias("n_synonyms"))


@query(f"WITH {DOCS} SELECT id, appendix_name AS title, marketing_start_date AS start_date FROM docs WHERE marketing_start_date IS NOT NULL")
def cached_listing(spark: SparkSession, d: str) -> DataFrame:
    """A listing is fetched where no cache is there yet, written, and read from the cache the next time; dates come back as dates."""
    folder = _folder(spark)
    schema = "id string, title string, start_date date"
    if S.read_cache(spark, folder, schema) is None:
        fetched = docs(spark, d).where("marketing_start_date is not null").select("id", F.col("appendix_name").alias("title"), F.col("marketing_start_date").alias("start_date"))
        S.write_cache(fetched, folder)
    return S.read_cache(spark, folder, schema)


@query("""SELECT document_id, arg_max(record_state, struct_pack(t := ingested_at, s := snapshot_id)) AS state FROM document_snapshots WHERE document_id IS NOT NULL GROUP BY 1""")
def appended_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Results are appended to a JSONL checkpoint in two batches; the last line of every key holds."""
    folder = _folder(spark)
    rows = table(spark, d, "document_snapshots").where("document_id is not null").select("document_id", F.col("record_state").alias("state"), "ingested_at", "snapshot_id")
    for batch in ("pmod(snapshot_id, 2) = 0", "pmod(snapshot_id, 2) = 1"):
        S.append_lines(rows.where(batch), folder)
    lines = spark.read.text(folder)
    stamp = F.struct(F.get_json_object("value", "$.ingested_at").alias("t"), F.get_json_object("value", "$.snapshot_id").cast("bigint").alias("s"))
    return S.last_checkpoint(lines.withColumn("at", stamp), "document_id string, state string", "document_id", "at")


@query(f"""WITH {EXTR} SELECT document_id AS custom_id, 'POST' AS method, 'm' AS model, 'system' AS first_role, 'read' AS system, coverage_name AS prompt FROM extr WHERE coverage_name IS NOT NULL""")
def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    """One line of a batch service per request, read back."""
    lines = S.batch_lines(extractions(spark, d).where("coverage_name is not null"), "document_id", "m", "read", "coverage_name")
    message = "struct<role: string, content: string>"
    read = lines.select(F.from_json("value", f"custom_id string, method string, body struct<model: string, messages: array<{message}>>").alias("r"))
    at = lambda i: F.get("r.body.messages", i)
    return read.select("r.custom_id", "r.method", "r.body.model", at(0)["role"].alias("first_role"), at(0)["content"].alias("system"), at(1)["content"].alias("prompt"))


@query(f"""WITH {EXTR}, l AS (SELECT document_id, coverage_name || ' ' AS name, coverage_type FROM extr WHERE coverage_name IS NOT NULL)
SELECT document_id AS custom_id, name, [name, 'x'] AS items, 1 + (coverage_type IS NULL)::INT AS failed FROM l""")
def tolerated_results(spark: SparkSession, d: str) -> DataFrame:
    """Of several results of one id one is kept and the others count as failed; NUL characters go, at any depth."""
    e = extractions(spark, d).where("coverage_name is not null")
    nul = F.char(F.lit(0))
    content = F.to_json(F.struct(F.concat("coverage_name", nul, F.lit(" ")).alias("name"), F.array(F.concat("coverage_name", nul, F.lit(" ")), F.concat(nul, F.lit("x"))).alias("items")))

    def line(text: F.Column) -> F.Column:
        body = F.struct(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")).alias("body"))
        return F.to_json(F.struct(F.col("document_id").alias("custom_id"), body.alias("response")))

    # Every result comes twice, and once more broken where the type is missing.
    lines = e.select(line(content).alias("value")).unionByName(e.select(line(content).alias("value")))
    broken = e.where("coverage_type is null").select(line(F.lit("no json")).alias("value"))
    got = S.decoded_batch(lines.unionByName(broken), "name string, items array<string>", with_failures=True)
    return got.select("custom_id", "result.name", "result.items", F.col("failed").cast("int").alias("failed"))


@query(f"""WITH {DOCS} SELECT id, CASE WHEN pages_count >= 1 THEN pages_count ELSE 1 END AS pages FROM docs""")
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    """The number of pages that a hidden field names; one where it is missing or smaller."""
    field = F.concat(F.lit('<input type="hidden" value="'), F.coalesce(F.col("pages_count").cast("string"), F.lit("?")), F.lit('" id="HiddFieldNumOfLinks">'))
    return docs(spark, d).select("id", P.page_count(field).alias("pages"))


@query(r"""SELECT source AS page, round(avg(c), 6) AS confidence, string_agg(DISTINCT lang, ',' ORDER BY lang) AS text FROM (SELECT source, lang, (doc_id % 97)::DOUBLE AS c FROM documents WHERE source IS NOT NULL) GROUP BY 1""")
def written_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Recognised texts with their confidence, written as JSON and read back."""
    folder = _folder(spark)
    rows = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("page"))
    found = rows.agg(F.avg((F.col("doc_id") % 97).cast("double")).alias("confidence"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("text"))
    found.write.json(folder)
    # A null text (a page without any language) is an absent field.
    return spark.read.schema("page string, confidence double, text string").json(folder).select("page", F.round("confidence", 6).alias("confidence"), F.nullif("text", F.lit("")).alias("text"))


REPORTED = {"coverage_types": "coverage_type", "coverage_names": "coverage_name"}


@query(f"""WITH {EXTR}, {DOCS} SELECT 'coverage_types' AS report, coverage_type AS value, count(*) AS frequency FROM extr WHERE coverage_type <> '' GROUP BY ALL
UNION ALL SELECT 'coverage_names', coverage_name, count(*) FROM extr WHERE coverage_name <> '' GROUP BY ALL
UNION ALL SELECT 'department_names', department_name, count(*) FROM docs WHERE department_name <> '' GROUP BY ALL
UNION ALL SELECT 'diseases', item, count(*) FROM (SELECT regexp_replace(unnest(disease_list), '^{BLANK}|{BLANK}$', '', 'g') AS item FROM extr) WHERE item <> '' GROUP BY ALL""")
def frequency_reports(spark: SparkSession, d: str) -> DataFrame:
    """Four reports, each ordered by falling frequency, written and read back."""
    folder = _folder(spark)
    e = extractions(spark, d)
    values = {name: e.select(F.col(c).alias("value")) for name, c in REPORTED.items()}
    values["department_names"] = docs(spark, d).select(F.col("department_name").alias("value"))
    values["diseases"] = e.select(F.explode("disease_list").alias("value")).select(X.strip(F.col("value")).alias("value"))
    counted = {name: v.where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("frequency")) for name, v in values.items()}
    S.write_reports({name: (c, [F.desc("frequency"), F.col("value")]) for name, c in counted.items()}, folder)
    read = [spark.read.schema("value string, frequency bigint").json(f"{folder}/{name}").select(F.lit(name).alias("report"), "value", "frequency") for name in counted]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


@query("""SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND lang = 'he') GROUP BY 1""")
def new_contents(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content that isn't known yet; known are the digests of the Hebrew ones."""
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    known = rows.where("text is not null and lang = 'he'").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")).distinct()
    return K.content_once(rows.select("doc_id", "text"), "text", ["doc_id"], known=known).select("digest", "doc_id")


@query(f"""WITH {DOCS}, listing AS (SELECT original_file_name AS name, appendix_name AS title, created_date, id FROM docs WHERE marketing_start_date IS NOT NULL),
last AS (SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_date DESC, id DESC) = 1),
files AS (SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND document_id IS NOT NULL GROUP BY 1),
fresh AS (SELECT f.doc_id, d.document_id AS id FROM files f JOIN documents d ON d.doc_id = f.doc_id),
named AS (SELECT r.id, p.original_file_name AS name, r.doc_id FROM fresh r JOIN docs p ON p.id = r.id),
rows AS (SELECT n.id, l.title, l.name IS NOT NULL AS listed, min(n.doc_id) AS doc_id FROM named n LEFT JOIN last l ON l.name = n.name GROUP BY ALL)
SELECT id, title, listed, doc_id FROM rows UNION ALL SELECT id, appendix_name, false, NULL FROM docs WHERE id NOT IN (SELECT id FROM rows)""")
def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    """S31, S32, J17, W9, D2 as one chain: files of new content get the listing's last entry of their name and replace the stored rows of their key."""
    stored = docs(spark, d)
    texts = table(spark, d, "documents").where("text is not null and document_id is not null").select("doc_id", "text", F.col("document_id").alias("id"))
    fresh = K.content_once(texts, "text", ["doc_id"]).select("doc_id", "id")
    files = fresh.join(stored.select("id", F.col("original_file_name").alias("name")), "id")
    listing = stored.where("marketing_start_date is not null").select(F.col("original_file_name").alias("name"), F.col("appendix_name").alias("title"), F.struct("created_date", "id").alias("at"))
    rows = R.ingested(files, listing, "name", "at").groupBy("id", "title", "listed").agg(F.min("doc_id").alias("doc_id"))
    old = stored.select("id", F.col("appendix_name").alias("title"), F.lit(False).alias("listed"), F.lit(None).cast("bigint").alias("doc_id"))
    return R.upserted(old, rows, ["id"]).select("id", "title", "listed", "doc_id")


@query("""SELECT status, count(*) AS n, count(DISTINCT id) AS ids FROM document_matches GROUP BY 1""")
def appended_audit(spark: SparkSession, d: str) -> DataFrame:
    """An audit that only grows: each run appends its rows, none replaces another."""
    folder = _folder(spark)
    rows = table(spark, d, "document_matches").select("id", "status", F.pmod(F.xxhash64("id", "created_date"), F.lit(2)).alias("run"))
    for run in (0, 1):
        rows.where(F.col("run") == run).write.mode("append").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query(f"WITH {DOCS} SELECT id, company_id, NULL::VARCHAR AS language, NULL::INTEGER AS priority FROM docs")
def widened_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a table lacks are added as null; none is dropped or retyped."""
    stored = docs(spark, d).select("id", "company_id")
    return R.with_columns_of(stored, [("id", "string"), ("company_id", "string"), ("language", "string"), ("priority", "int")])

"""Inputs and features of documents: number choice, fingerprints, texts for models, export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.functions import text as X
from tavla.operators import codes as C
from tavla.operators import relational as R
from tavla.operators.matching import with_both_sides
from tavla.plans.common import BLANK, CODES, DOCS, EXTR, MATCHES, codes, docs, extractions, matches
from tavla.plans.files import _folder
from tavla.plans.matching import PERIOD_SQL
from tavla.plans.parsing import FIRST, ILS_SQL, USD_SQL, q
from tavla.session import table
from tavla.sources import files as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NUMBERS_SQL = "list_distinct(flatten(list_transform({mentions}, lambda m: regexp_extract_all(m, '\\d+'))))"
AFTER_SQL = f"regexp_extract_all({{t}}, {q(X.NUMBERS_AFTER_WORD)}, 1)"
BEFORE_SQL = f"regexp_extract_all({{t}}, {q(X.NUMBERS_BEFORE_WORD)}, 1)"
#: Characters that stand for the first page of a text.
PAGE_CHARS = 200


def _read_sql(t: str) -> str:
    return NUMBERS_SQL.format(mentions=f"list_concat({AFTER_SQL.format(t=t)}, {BEFORE_SQL.format(t=t)})")


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, text, substring(text, 1, {PAGE_CHARS}) AS page, document_id FROM documents WHERE text IS NOT NULL),
h AS (SELECT t.*, nullif(regexp_extract(regexp_replace(coalesce(d.original_file_name, ''), '\.[^./]*$', ''), '^[^_]*_(\d+)$', 1), '') AS hint, coalesce(d.original_file_name, '') AS name FROM t LEFT JOIN docs d ON d.id = t.document_id),
f AS (SELECT doc_id, coalesce(hint, nullif(regexp_extract(name, '_(\d+)_', 1), '')) AS hint, CASE WHEN len({_read_sql('page')}) > 0 THEN {_read_sql('page')} ELSE {_read_sql('text')} END AS found FROM h)
SELECT doc_id, hint, list_sort(CASE WHEN hint IS NOT NULL AND NOT list_contains(found, hint) THEN [hint] ELSE found END) AS by_name,
  list_sort(CASE WHEN len(found) = 0 AND hint IS NOT NULL THEN [hint] ELSE found END) AS by_text FROM f""")
def chosen_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The number of the first page, else of the whole text, against the file name's hint, which wins or loses a conflict."""
    named = docs(spark, d).select(F.col("id").alias("document_id"), "original_file_name")
    texts = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "document_id").join(named, "document_id", "left")
    hint = F.coalesce(X.prefixed_number(F.col("original_file_name")), X.first_group(F.col("original_file_name"), r"_(\d+)_"))
    found = X.first_found([X.appendix_numbers(F.substring("text", 1, PAGE_CHARS)), X.appendix_numbers(F.col("text"))])
    read = texts.select("doc_id", hint.alias("hint"), found.alias("found"))
    chosen = {n: F.array_sort(X.chosen_numbers(F.col("found"), F.col("hint"), hint_wins=w)) for n, w in (("by_name", True), ("by_text", False))}
    return read.select("doc_id", "hint", *[c.alias(n) for n, c in chosen.items()])


@query(f"""WITH {DOCS}, t AS (SELECT id, coalesce(appendix_number[1], '0') AS n FROM docs)
SELECT id, ['7', n] AS numbers, n AS hint FROM t WHERE n <> '7' AND regexp_full_match(n, '\\d+')""")
def labelled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers behind a label in a heading, and the digits right behind an appendix word in a file name."""
    n = F.coalesce(F.get("appendix_number", 0), F.lit("0"))
    rows = docs(spark, d).select("id", n.alias("n")).where("n <> '7' and n rlike '^[0-9]+$'")
    heading, name = F.concat(F.lit("תנאי נספחים מספר 7, "), "n", F.lit(" לפוליסה")), F.concat(F.lit("כללי_נספח_"), "n", F.lit("_2019.pdf"))
    return rows.select("id", X.labelled_appendix_numbers(heading).alias("numbers"), X.filename_hint(name).alias("hint"))


@query(f"""WITH {DOCS}, t AS (SELECT id, 'קובץ ' || replace(replace(id, '/', '-'), ':', '-') || '+א.pdf' AS name FROM docs)
SELECT id, CASE WHEN length(name) <= 24 THEN name ELSE substr(regexp_replace(name, '\\.[^.]*$', ''), 1, 24 - 4 - 8 - 1) || '_' || substr(sha1(name), 1, 8) || '.pdf' END AS name FROM t""")
def local_names(spark: SparkSession, d: str) -> DataFrame:
    """The decoded name of an address (a plus stays one), capped with a digest."""
    name = F.concat(F.lit("קובץ "), F.replace(F.replace("id", F.lit("/"), F.lit("-")), F.lit(":"), F.lit("-")), F.lit("+א.pdf"))
    # A blank is %20 in an address, where a form would write a plus.
    encoded = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2B"), F.lit("+"))
    return docs(spark, d).select("id", X.capped_name(X.url_name(F.concat(F.lit("https://files/media/"), encoded)), 24).alias("name"))


AMOUNT = f"CASE WHEN contains(x, '{X.COUNTED_UNITS}') THEN NULL WHEN {ILS_SQL} IS NOT NULL THEN struct_pack(v := try_cast(replace({ILS_SQL}, ',', '') AS DOUBLE), c := 'ILS') WHEN {USD_SQL} IS NOT NULL THEN struct_pack(v := try_cast(replace({USD_SQL}, ',', '') AS DOUBLE), c := 'USD') END"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"


BENEFITS = f"""typed AS (SELECT DISTINCT {_stripped('eligibility_conditions')} AS p FROM extr WHERE eligibility_conditions IS NOT NULL),
known AS (SELECT code, unnest(list_concat([canonical_name_he], coalesce(synonyms, []))) AS k FROM canonical_codes WHERE code_category = 'benefit_type'),
ben AS (SELECT p, arg_min(code, struct_pack(l := -length(k), k := k, c := code)) AS code FROM typed JOIN known ON k <> '' AND p <> '' AND (contains(p, k) OR contains(k, p)) GROUP BY p)"""


@query(f"""WITH {EXTR}, {BENEFITS}, a AS (SELECT e.*, list_filter(list_transform(coalesce(insurance_amounts, []), lambda x: {AMOUNT}), lambda y: y IS NOT NULL AND y.v IS NOT NULL) AS am,
  list_filter(list_transform(coalesce(restrictions, []), lambda x: {AMOUNT}), lambda y: y IS NOT NULL AND y.v IS NOT NULL) AS cm, regexp_extract_all(coalesce(age_range, ''), '\\d+') AS ages, b.code AS bcode,
  (insurance_amounts)[1] AS x FROM extr e LEFT JOIN ben b ON b.p = {_stripped('e.eligibility_conditions')})
SELECT document_id, {", ".join(f"{PERIOD_SQL.format(c=f'{c}_period')} AS {c}_days" for c in ("waiting", "qualifying", "survival"))}, list_min(list_transform(am, lambda y: y.v)) AS amount_min, list_max(list_transform(am, lambda y: y.v)) AS amount_max, am[1].c AS currency,
  coalesce(len(exclusions), 0) AS n_exclusions, coalesce(len(disease_list), 0) AS n_disease_list, coalesce(len(restrictions), 0) AS n_restrictions, list_max(list_transform(cm, lambda y: y.v)) AS maximum,
  try_cast(nullif(regexp_extract(eligibility_conditions, {q(X.PERCENT)}, 1), '') AS DOUBLE) AS percent, try_cast(ages[1] AS INTEGER) AS min_age, try_cast(ages[2] AS INTEGER) AS max_age,
  CASE WHEN coverage_type IS NOT NULL AND x <> '' THEN ({AMOUNT}).v END AS deductible, coalesce(bcode, eligibility_conditions) AS benefit_type FROM a""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """All numeric features of the extractions. The conditions stand for the benefit, whose code is looked up by rule, the
    restrictions for the caps, and the first amount for the deductible, which applies where there is a coverage type."""
    e = extractions(spark, d).withColumns({"applies": F.col("coverage_type").isNotNull(), "first_amount": F.get("insurance_amounts", 0)})
    dictionary = C.code_phrases(table(spark, d, "canonical_codes"), "code", "code_category", "canonical_name_he", "synonyms").where("category = 'benefit_type'")
    typed = e.select("document_id", F.lit("benefit_type").alias("category"), F.col("eligibility_conditions").alias("phrase"))
    coded = C.normalised_phrases(typed, dictionary).select("document_id", F.col("code").alias("benefit_code"))
    f = C.fingerprint(
        e.join(coded, "document_id", "left"), amounts="insurance_amounts", waiting="waiting_period", qualifying="qualifying_period", survival="survival_period", caps="restrictions",
        calculation="eligibility_conditions", ages="age_range", deductible_applies="applies", deductible_text="first_amount", benefit="eligibility_conditions", benefit_code="benefit_code",
        counts=["exclusions", "disease_list", "restrictions"],
    )
    return f.select(
        "document_id", "waiting_days", "qualifying_days", "survival_days", "amount_min", "amount_max", "currency", "n_exclusions", "n_disease_list", "n_restrictions",
        "maximum", "percent", "min_age", "max_age", "deductible", "benefit_type",
    )


TEXTS = ("coverage_type", "coverage_name", "eligibility_conditions", "qualifying_period", "waiting_period", "survival_period", "age_range")
LISTS = ("insurance_amounts", "exclusions", "restrictions", "disease_list")
# The headings of a profile's input.
HEADS = ("# שדות מובנים שחולצו מהמסמך", "\n# תשובות ממאגר השאלות", "\n# ממצאים נוספים")
ASKED = {"q.wait": "waiting_period", "q.survive": "survival_period", "q.age": "age_range"}

_text_sql = lambda text: "E'" + text.replace("\n", "\\n") + "'"
_line_sql = lambda label, c: f"'{label}: ' || nullif({c}, '')"
_list_sql = lambda label, c, sep: f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}, '{sep}') END"


@query(f"""WITH {EXTR}, {DOCS} SELECT e.document_id, array_to_string(list_filter(list_concat([{_text_sql(HEADS[0])}, {", ".join(_line_sql(c, f'e.{c}') for c in TEXTS)}, {", ".join(_list_sql(c, f'e.{c}', ', ') for c in LISTS)}, {_line_sql('department_name', 'd.department_name')}],
  [{_text_sql(HEADS[1])}], [{", ".join(f"CASE WHEN e.{c} <> '' THEN '[FOUND] {i}: ' || e.{c} END" for i, c in ASKED.items())}],
  CASE WHEN len(e.restrictions) > 0 THEN list_concat([{_text_sql(HEADS[2])}], list_transform(list_distinct(list_filter(e.restrictions, lambda x: x <> '')).list_sort(), lambda x: '- ' || x)) ELSE [] END), lambda x: x IS NOT NULL AND x <> ''), E'\\n') AS text
FROM extr e JOIN docs d ON d.id = e.document_id""")
def profile_inputs(spark: SparkSession, d: str) -> DataFrame:
    """A document's fields, the answers about it that are not NOT_FOUND, and its further findings (its distinct restrictions), a section each."""
    e = extractions(spark, d).join(docs(spark, d).select(F.col("id").alias("document_id"), "department_name"), "document_id")
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    answers = F.array(*[F.struct(F.lit(i).alias("id"), F.when(filled(c), "FOUND").otherwise("NOT_FOUND").alias("status"), F.col(c).alias("text")) for i, c in ASKED.items()])
    told = F.transform(F.filter(answers, lambda a: a["status"] != "NOT_FOUND"), lambda a: F.concat(F.lit("["), a["status"], F.lit("] "), a["id"], F.lit(": "), a["text"]))
    fields = [X.labelled(c, F.col(c)) for c in TEXTS] + [F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, ", "))) for c in LISTS] + [X.labelled("department_name", F.col("department_name"))]
    known = F.array_sort(F.array_distinct(F.filter("restrictions", lambda x: x != "")))
    findings = F.when(F.size("restrictions") > 0, F.concat(F.array(F.lit(HEADS[2])), F.transform(known, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>"))
    return e.select("document_id", X.sections((HEADS[0], F.array(*fields)), (HEADS[1], told), ("", findings)).alias("text"))


# The labels of a pair's input.
SIDE_TEXTS = {
    "שם הנספח": "appendix_name", "סוג כיסוי": "coverage_type", "שם כיסוי": "coverage_name", "תנאי זכאות": "eligibility_conditions", "תקופת אכשרה": "qualifying_period",
    "תקופת המתנה": "waiting_period", "טווח גילאים": "age_range", "תקופת הישרדות": "survival_period",
}
SIDE_LISTS = {"סכומי ביטוח": "insurance_amounts", "חריגים": "exclusions", "הגבלות": "restrictions", "רשימת מחלות": "disease_list"}


@query(f"""WITH {MATCHES}, {EXTR}, {DOCS}, s AS (SELECT d.id, array_to_string(list_filter([' (חברת ' || coalesce(d.company_id, '') || ') ===', {", ".join(_line_sql(n, c) for n, c in SIDE_TEXTS.items())}, {", ".join(_list_sql(n, c, '; ') for n, c in SIDE_LISTS.items())}],
  lambda x: x IS NOT NULL), E'\\n') AS t FROM docs d JOIN extr e ON e.document_id = d.id)
SELECT m.id, '=== מסמך A' || a.t || E'\\n\\n=== מסמך B' || b.t AS prompt FROM mat m JOIN s a ON a.id = m.document_id JOIN s b ON b.id = m.matched_document_id""")
def pair_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a match, label by label, for a judge."""
    e = extractions(spark, d).drop("id").withColumnRenamed("document_id", "id")
    fields = [X.labelled(n, F.col(c)) for n, c in SIDE_TEXTS.items()] + [F.when(F.size(c) > 0, F.concat(F.lit(f"{n}: "), F.array_join(c, "; "))) for n, c in SIDE_LISTS.items()]
    company = F.concat(F.lit(" (חברת "), F.coalesce("company_id", F.lit("")), F.lit(") ==="))
    sides = docs(spark, d).select("id", "company_id", "appendix_name").join(e, "id").select("id", X.joined([company, *fields]).alias("side"))
    both = with_both_sides(matches(spark, d), sides, ["side"])
    return both.select("id", F.concat(F.lit("=== מסמך A"), "a_side", F.lit("\n\n=== מסמך B"), "b_side").alias("prompt"))


@query(f"""WITH {CODES} SELECT c.document_id, c.code, k.canonical_name_he AS name, count(*) AS n FROM codes c JOIN canonical_codes k ON k.code = c.code GROUP BY ALL""")
def required_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes with their entry, which must be there; spellings that the list lacks are left out before."""
    listed = table(spark, d, "canonical_codes").select("code", F.col("canonical_name_he").alias("name"))
    known = codes(spark, d).join(listed, "code", "left_semi").groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return R.required(known, listed, "code").select("document_id", "code", "name", "n")


SIMPLE = ["id", "company_id", "original_file_name", "file_path", "domain", "department_name", "extraction_method"]
CELLS = ["coverage_type", "coverage_name", "eligibility_conditions", "qualifying_period", "waiting_period", "survival_period", "age_range"]
_cell = lambda c: f"coalesce({c}, '')"


@query(f"""WITH {DOCS}, {EXTR}, {CODES}, {MATCHES}, cj AS (SELECT document_id, to_json(list(struct_pack(category := code_category, code := code, n := n) ORDER BY code_category, code))::VARCHAR AS j FROM (SELECT document_id, code_category, code, count(*) AS n FROM codes GROUP BY ALL) GROUP BY 1),
mj AS (SELECT document_id, to_json(list(struct_pack(id := matched_document_id, status := status) ORDER BY matched_document_id))::VARCHAR AS j FROM mat GROUP BY 1)
SELECT {", ".join(f"{_cell(f'd.{c}')} AS {c}" for c in SIMPLE)}, array_to_string(coalesce(d.appendix_number, []), '; ') AS appendix_number, {", ".join(f"coalesce(d.{c}::VARCHAR, '') AS {c}" for c in ("marketing_start_date", "marketing_end_date", "pages_count"))},
  CASE WHEN d.marketing_end_date IS NULL OR d.marketing_end_date >= DATE '2015-06-30' THEN 'true' ELSE 'false' END AS is_active,
  {", ".join(f"{_cell(f'e.{c}')} AS extraction_{c}" for c in CELLS)}, {", ".join(f"array_to_string(coalesce(e.{c}, []), '; ') AS extraction_{c}" for c in LISTS)}, coalesce(e.disease_count::VARCHAR, '') AS extraction_disease_count,
  {", ".join(f"coalesce(({PERIOD_SQL.format(c=f'e.{c}_period')})::VARCHAR, '') AS fingerprint_{c}_days" for c in ("waiting", "qualifying", "survival"))}, coalesce(cj.j, '') AS canonical_codes, coalesce(mj.j, '') AS cross_company_matches
FROM docs d LEFT JOIN extr e ON e.document_id = d.id LEFT JOIN cj ON cj.document_id = d.id LEFT JOIN mj ON mj.document_id = d.id""")
def exported_rows(spark: SparkSession, d: str) -> DataFrame:
    """One CSV row per document with everything known about it, lists joined and what is one to many as JSON; written as one file and read back.

    The columns are those of the reference whose tables are here (documents, extractions, codes, matches, and the periods of the fingerprints)."""
    e = extractions(spark, d)
    days = [X.period_days(F.col(f"{c}_period")).alias(f"fingerprint_{c}_days") for c in ("waiting", "qualifying", "survival")]
    told = e.select(
        F.col("document_id").alias("id"), *[F.col(c).alias(f"extraction_{c}") for c in CELLS], *[X.list_text(F.col(c)).alias(f"extraction_{c}") for c in LISTS],
        F.col("disease_count").alias("extraction_disease_count"), *days,
    )
    counted = codes(spark, d).groupBy("document_id", "code_category", "code").agg(F.count(F.lit(1)).alias("n"))
    one = lambda *cs: F.array_sort(F.collect_list(F.struct(*cs)))
    of_codes = counted.groupBy(F.col("document_id").alias("id")).agg(X.json_cell(one(F.col("code_category").alias("category"), "code", "n")).alias("canonical_codes"))
    of_matches = matches(spark, d).groupBy(F.col("document_id").alias("id")).agg(X.json_cell(one(F.col("matched_document_id").alias("id"), "status")).alias("cross_company_matches"))
    rows = docs(spark, d).join(told, "id", "left").join(of_codes, "id", "left").join(of_matches, "id", "left").select(
        *SIMPLE, X.list_text(F.col("appendix_number")).alias("appendix_number"), "marketing_start_date", "marketing_end_date", "pages_count",
        R.is_active(F.col("marketing_end_date"), "2015-06-30").alias("is_active"), *[c for c in told.columns if c != "id"], "canonical_codes", "cross_company_matches",
    )
    path = _folder(spark) + "/export.csv"
    S.write_csv(rows, path, ["company_id", "id"])
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)
    # The byte order mark belongs to the file, not to the first column's name.
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in read.columns])

"""Text parsing, fingerprints, listings and files as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.functions import measures as M
from tavla.functions import positions as N
from tavla.functions import text as X
from tavla.operators import clustering as L
from tavla.operators import codes as C
from tavla.plans.common import BLANK, CODES, DOCS, EXCLUDED, EXTR, MATCHES, MODEL, SIDES, VECTORS, codes, docs, extractions, matches, words_sql
from tavla.plans.matching import PERIOD_SQL
from tavla.sources import files as S
from tavla.sources import listings as P
from tavla.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _numbers_sql(mentions: str) -> str:
    return f"list_sort(list_distinct(flatten(list_transform({mentions}, lambda m: regexp_extract_all(m, '\\d+')))))"


@query(f"WITH {EXTR} SELECT document_id, {PERIOD_SQL.format(c='waiting_period')} AS waiting, {PERIOD_SQL.format(c='qualifying_period')} AS qualifying, {PERIOD_SQL.format(c='survival_period')} AS survival FROM extr")
def periods(spark: SparkSession, d: str) -> DataFrame:
    """Days of the periods of extracted texts."""
    e = extractions(spark, d)
    return e.select("document_id", *[X.period_days(F.col(f"{c}_period")).alias(c) for c in ("waiting", "qualifying", "survival")])


ILS, USD = q(X.ILS_AMOUNT), q(X.USD_AMOUNT)
FIRST = "coalesce(nullif(regexp_extract({c}, {p}, 1), ''), nullif(regexp_extract({c}, {p}, 2), ''))"
ILS_SQL, USD_SQL = FIRST.format(c="x", p=ILS), FIRST.format(c="x", p=USD)


@query(f"""SELECT DISTINCT x AS text, CASE WHEN contains(x, 'יחיד') THEN NULL WHEN {ILS_SQL} IS NOT NULL THEN try_cast(replace({ILS_SQL}, ',', '') AS DOUBLE) ELSE try_cast(replace({USD_SQL}, ',', '') AS DOUBLE) END AS value,
CASE WHEN contains(x, 'יחיד') THEN NULL WHEN {ILS_SQL} IS NOT NULL THEN CASE WHEN try_cast(replace({ILS_SQL}, ',', '') AS DOUBLE) IS NOT NULL THEN 'ILS' END WHEN try_cast(replace({USD_SQL}, ',', '') AS DOUBLE) IS NOT NULL THEN 'USD' END AS currency
FROM (SELECT unnest(insurance_amounts) AS x FROM document_extractions)""")
def amounts(spark: SparkSession, d: str) -> DataFrame:
    """Value and currency of amount texts."""
    x = table(spark, d, "document_extractions").select(F.explode("insurance_amounts").alias("text")).distinct()
    return x.withColumn("a", X.amount(F.col("text"))).select("text", "a.value", "a.currency")


@query(f"SELECT doc_id, try_cast(nullif(regexp_extract(text, {q(X.PERCENT)}, 1), '') AS DOUBLE) AS percent FROM documents WHERE text IS NOT NULL")
def percentages(spark: SparkSession, d: str) -> DataFrame:
    """The first percentage of a text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.percentage(F.col("text")).alias("percent"))


@query(f"SELECT doc_id, {_numbers_sql(f'list_concat(regexp_extract_all(text, {q(X.NUMBERS_AFTER_WORD)}, 1), regexp_extract_all(text, {q(X.NUMBERS_BEFORE_WORD)}, 1))')} AS numbers FROM documents WHERE text IS NOT NULL")
def appendix_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the appendices a text names (sorted, to compare)."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_sort(X.appendix_numbers(F.col("text"))).alias("numbers"))


@query(rf"""SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), E'\n'),
lambda x: regexp_replace(x, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')), E'\n'), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their blanks and line breaks tidied."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query(f"WITH {DOCS}, {EXCLUDED} SELECT id, list_sort({words_sql('appendix_name')}) AS words FROM docs, excluded")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    """Content words of names (sorted, to compare)."""
    return docs(spark, d).select("id", F.array_sort(X.combined_tokens(F.col("appendix_name"))).alias("words"))


@query(f"""WITH {MATCHES}, {DOCS}, {EXCLUDED}, w AS (SELECT id, {words_sql('appendix_name')} AS ws2 FROM docs, excluded)
SELECT m.id, (list_has_any(a.ws2, b.ws2) OR len(list_filter(a.ws2, lambda x: len(list_filter(b.ws2, lambda y: length(x) >= 3 AND length(y) >= 3 AND (starts_with(x, y) OR suffix(x, y) OR starts_with(y, x) OR suffix(y, x)))) > 0)) > 0) AS overlap
FROM mat m JOIN w a ON a.id = m.document_id JOIN w b ON b.id = m.matched_document_id""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Do the names of matched documents share a word, or one that begins or ends the other?"""
    from tavla.operators.matching import with_both_sides

    w = docs(spark, d).select("id", X.combined_tokens(F.col("appendix_name")).alias("words"))
    return with_both_sides(matches(spark, d), w, ["words"]).select("id", X.lexical_overlap(F.col("a_words"), F.col("b_words")).alias("overlap"))


@query(f"""WITH {EXTR}, n AS (SELECT document_id, list_transform(insurance_amounts, lambda a: list_max(list_transform(regexp_extract_all(coalesce(a, ''), '[\\d,]{{3,}}'), lambda t: try_cast(replace(t, ',', '') AS BIGINT)))) AS ns FROM extr)
SELECT document_id, list_max(ns) AS largest FROM n""")
def largest_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The largest number of any amount text."""
    return extractions(spark, d).select("document_id", X.largest_number(F.col("insurance_amounts")).alias("largest"))


FP = f"""parsed AS (SELECT document_id, waiting_period, coalesce(len(exclusions), 0) AS n_exclusions, coalesce(len(disease_list), 0) AS n_disease_list,
list_filter(list_transform(coalesce(insurance_amounts, []), lambda x: CASE WHEN contains(x, 'יחיד') THEN NULL WHEN {ILS_SQL} IS NOT NULL THEN struct_pack(v := try_cast(replace({ILS_SQL}, ',', '') AS DOUBLE), c := 'ILS') WHEN {USD_SQL} IS NOT NULL THEN struct_pack(v := try_cast(replace({USD_SQL}, ',', '') AS DOUBLE), c := 'USD') END), lambda a: a IS NOT NULL AND a.v IS NOT NULL) AS am FROM extr)"""


@query(f"""WITH {EXTR}, {FP} SELECT document_id, {PERIOD_SQL.format(c='waiting_period')} AS waiting_days, list_min(list_transform(am, lambda a: a.v)) AS amount_min, list_max(list_transform(am, lambda a: a.v)) AS amount_max, am[1].c AS currency, n_exclusions, n_disease_list FROM parsed""")
def fingerprint_features(spark: SparkSession, d: str) -> DataFrame:
    """Numeric features of the extractions; fingerprints has them all."""
    f = C.fingerprint(extractions(spark, d), amounts="insurance_amounts", waiting="waiting_period", qualifying="qualifying_period", survival="survival_period", counts=["exclusions", "disease_list"])
    return f.select("document_id", "waiting_days", "amount_min", "amount_max", "currency", F.col("n_exclusions"), F.col("n_disease_list"))


DAYS_SQL = f"""(CASE regexp_extract({{c}}, '{X.SHORT_DURATION}', 2) WHEN '' THEN NULL {" ".join(f"WHEN '{u}' THEN {X.PERIOD_DAYS[u]}" for u in ("יום", "ימים", "שבוע", "שבועות", "חודש", "חודשים", "שנה", "שנים"))} END * try_cast(nullif(regexp_extract({{c}}, '{X.SHORT_DURATION}', 1), '') AS BIGINT))"""


@query(f"""WITH {MATCHES}, {EXTR}, f AS (SELECT document_id, {DAYS_SQL.format(c="waiting_period")} AS wait, coalesce(len(exclusions), 0) AS ex, disease_count AS dis FROM extr),
w AS (SELECT m.id, [CASE WHEN a.wait = b.wait THEN 'tie' WHEN a.wait < b.wait THEN 'A' WHEN a.wait > b.wait THEN 'B' END, CASE WHEN a.ex = b.ex THEN 'tie' WHEN a.ex < b.ex THEN 'A' ELSE 'B' END,
  CASE WHEN a.dis = b.dis THEN 'tie' WHEN a.dis > b.dis THEN 'A' WHEN a.dis < b.dis THEN 'B' END] AS ws FROM mat m JOIN f a ON a.document_id = m.document_id JOIN f b ON b.document_id = m.matched_document_id)
SELECT id, round((len(list_filter(ws, lambda x: x = 'A')) + len(list_filter(ws, lambda x: x = 'tie')) / 2) * 100.0 / nullif(len(list_filter(ws, lambda x: x IS NOT NULL)), 0), 6) AS percent_a, len(list_filter(ws, lambda x: x IS NOT NULL)) AS criteria FROM w""")
def score_compare(spark: SparkSession, d: str) -> DataFrame:
    """The share of three criteria (waiting period, exclusions, diseases) that the first of two matched documents wins; score_compare_all has the reference's seven."""
    from tavla.operators.matching import with_both_sides

    f = extractions(spark, d).select(F.col("document_id").alias("id"), X.short_duration_days(F.col("waiting_period")).alias("wait"), M.size_of(F.col("exclusions")).alias("ex"), F.col("disease_count").alias("dis"))
    both = with_both_sides(matches(spark, d), f, ["wait", "ex", "dis"])
    winners = F.array(*[M.winner(F.col(f"a_{c}"), F.col(f"b_{c}"), better) for c, better in (("wait", False), ("ex", False), ("dis", True))])
    return both.select("id", F.round(M.share_of(winners), 6).alias("percent_a"), F.size(F.filter(winners, lambda x: x.isNotNull())).cast("bigint").alias("criteria"))


#: The reference's criteria: what is compared, and whether more is better.
CRITERIA = {"amount": True, "wait": False, "qualify": False, "survive": False, "ex": False, "restrict": False, "dis": True}
WINNERS_SQL = "[" + ", ".join(f"CASE WHEN a.{c} = b.{c} THEN 'tie' WHEN a.{c} {'>' if more else '<'} b.{c} THEN 'A' WHEN a.{c} {'<' if more else '>'} b.{c} THEN 'B' END" for c, more in CRITERIA.items()) + "]"


@query(f"""WITH {MATCHES}, {EXTR}, f AS (SELECT document_id, list_max(list_transform(insurance_amounts, lambda a: list_max(list_transform(regexp_extract_all(coalesce(a, ''), '[\\d,]{{3,}}'), lambda t: try_cast(replace(t, ',', '') AS BIGINT))))) AS amount,
  {DAYS_SQL.format(c="waiting_period")} AS wait, {DAYS_SQL.format(c="qualifying_period")} AS qualify, {DAYS_SQL.format(c="survival_period")} AS survive, coalesce(len(exclusions), 0) AS ex, coalesce(len(restrictions), 0) AS restrict, disease_count AS dis FROM extr),
w AS (SELECT m.id, {WINNERS_SQL} AS ws FROM mat m JOIN f a ON a.document_id = m.document_id JOIN f b ON b.document_id = m.matched_document_id)
SELECT id, round((len(list_filter(ws, lambda x: x = 'A')) + len(list_filter(ws, lambda x: x = 'tie')) / 2) * 100.0 / nullif(len(list_filter(ws, lambda x: x IS NOT NULL)), 0), 6) AS percent_a, len(list_filter(ws, lambda x: x IS NOT NULL)) AS criteria FROM w""")
def score_compare_all(spark: SparkSession, d: str) -> DataFrame:
    """The share of the seven criteria that the first of two matched documents wins; those without a value on either side don't count."""
    from tavla.operators.matching import with_both_sides

    days = [X.short_duration_days(F.col(f"{c}_period")).alias(n) for c, n in (("waiting", "wait"), ("qualifying", "qualify"), ("survival", "survive"))]
    sizes = [M.size_of(F.col("exclusions")).alias("ex"), M.size_of(F.col("restrictions")).alias("restrict"), F.col("disease_count").alias("dis")]
    f = extractions(spark, d).select(F.col("document_id").alias("id"), X.largest_number(F.col("insurance_amounts")).alias("amount"), *days, *sizes)
    both = with_both_sides(matches(spark, d), f, list(CRITERIA))
    winners = F.array(*[M.winner(F.col(f"a_{c}"), F.col(f"b_{c}"), more) for c, more in CRITERIA.items()])
    return both.select("id", F.round(M.share_of(winners), 6).alias("percent_a"), F.size(F.filter(winners, lambda x: x.isNotNull())).cast("bigint").alias("criteria"))


@query(f"""WITH {EXTR} SELECT document_id, array_to_string(list_filter([coverage_type, coverage_name, eligibility_conditions, array_to_string(restrictions, ', ')], lambda x: x IS NOT NULL AND x <> ''), E'\\n') AS text FROM extr""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """Filled fields in a fixed order, a line each."""
    e = extractions(spark, d)
    return e.select("document_id", X.joined([F.col("coverage_type"), F.col("coverage_name"), F.col("eligibility_conditions"), F.array_join("restrictions", ", ")]).alias("text"))


@query(f"""WITH {EXTR}, t AS (SELECT document_id, array_to_string(list_filter(['type: ' || nullif(coverage_type, ''), 'name: ' || nullif(coverage_name, ''), 'limits: ' || nullif(array_to_string(restrictions, '; '), '')], lambda x: x IS NOT NULL), E'\\n') AS text FROM extr)
SELECT document_id, text, (length(text) // 3 + 300)::BIGINT AS tokens FROM t""")
def labelled_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled lines for a model, and the tokens they may take."""
    e = extractions(spark, d)
    text = X.joined([X.labelled("type", F.col("coverage_type")), X.labelled("name", F.col("coverage_name")), X.labelled("limits", F.array_join("restrictions", "; "))])
    return e.select("document_id", text.alias("text")).select("document_id", "text", X.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH {DOCS} SELECT id, list_filter([domain, department_name, appendix_name], lambda x: x IS NOT NULL AND x <> '') AS chain, concat_ws(' / ', coalesce(domain, ''), coalesce(department_name, '')) AS label FROM docs""")
def level_chains(spark: SparkSession, d: str) -> DataFrame:
    """Filled levels and composite labels."""
    dd = docs(spark, d)
    return dd.select("id", X.level_chain(F.col("domain"), F.col("department_name"), F.col("appendix_name")).alias("chain"), F.concat_ws(" / ", F.coalesce("domain", F.lit("")), F.coalesce("department_name", F.lit(""))).alias("label"))


@query(f"""WITH {DOCS} SELECT id, nullif(regexp_extract(regexp_replace(original_file_name, '\\.[^./]*$', ''), '^[^_]*_(\\d+)$', 1), '') AS hint, CASE WHEN length(file_path) <= 20 THEN file_path ELSE
substr(regexp_replace(file_path, '\\.[^.]*$', ''), 1, 20 - 4 - 8 - 1) || '_' || substr(sha1(file_path), 1, 8) || '.pdf' END AS capped FROM docs""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Number hints and capped names of files."""
    return docs(spark, d).select("id", X.prefixed_number(F.col("original_file_name")).alias("hint"), X.capped_name(F.col("file_path"), 20).alias("capped"))


@query(f"""WITH {DOCS}, t AS (SELECT id, marketing_start_date AS s FROM docs) SELECT id, date_trunc('month', s)::DATE AS version, date_trunc('month', s)::DATE AS edition, s AS dotted, s AS slashed, CASE WHEN year(s) < 2015 THEN s END AS iso, s AS title_start FROM t""")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in every format are read back."""
    s = F.col("marketing_start_date")
    text = docs(spark, d).select(
        "id", F.concat(F.lit("גרסה "), F.date_format(s, "MM.yyyy")).alias("v"), F.date_format(s, "MM/yy").alias("e"), F.date_format(s, "dd.MM.yyyy").alias("t"),
        F.date_format(s, "dd/MM/yyyy").alias("u"), F.concat(F.date_format(s, "yyyy-MM-dd"), F.lit("T00:00:00+02:00")).alias("i"), F.concat(F.lit("נספח בתוקף החל מ-"), F.date_format(s, "d.M.yyyy")).alias("n"),
    )
    return text.select(
        "id", X.version_date(F.col("v")).alias("version"), X.edition_date(F.col("e")).alias("edition"), X.dotted_date(F.col("t")).alias("dotted"), X.slashed_date(F.col("u")).alias("slashed"),
        X.iso_date(F.col("i"), far_year=2015).alias("iso"), X.title_dates(F.col("n"))[0].alias("title_start"),
    )


#: Entries of one made-up body or page of a listing; a busy company has several.
PAGE_ROWS = 500


def _paged(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with the number ``part`` of their page within the key, dealt by file name, so that no page grows with the data."""
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("int").alias("parts"))
    return rows.join(parts, list(key)).withColumn("part", F.pmod(F.xxhash64("original_file_name"), F.col("parts")))


def _bodies(spark: SparkSession, d: str, fields: F.Column, name: str, **more) -> DataFrame:
    """JSON bodies of a listing made from the documents, of bounded size, each of one company and domain."""
    rows = _paged(docs(spark, d), "company_id", "domain").groupBy("company_id", "domain", "part").agg(F.collect_list(fields).alias(name))
    return rows.select("company_id", "domain", F.to_json(F.struct(*[v.alias(k) for k, v in more.items()], F.col(name))).alias("body"))


NUMBERS = f"{_numbers_sql(f'regexp_extract_all(t, {q(X.NUMBERS_AFTER_WORD)}, 1)')}"


@query(f"""WITH {DOCS}, r AS (SELECT domain, coalesce(regexp_replace(coalesce(appendix_name, ''), '^{BLANK}|{BLANK}$', '', 'g'), '') || ' נספח ' || coalesce(appendix_number[1], '') AS t, file_path, marketing_start_date AS s, marketing_end_date AS e FROM docs)
SELECT domain, regexp_replace(t, '^{BLANK}|{BLANK}$', '', 'g') AS title, {_numbers_sql(f"list_concat(regexp_extract_all(t, {q(X.NUMBERS_AFTER_WORD)}, 1), regexp_extract_all(t, {q(X.NUMBERS_BEFORE_WORD)}, 1))")} AS numbers, file_path AS download_url, CASE WHEN year(s) < 2018 THEN s END AS start_date, CASE WHEN year(e) < 2018 THEN e END AS end_date FROM r""")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    """A flat archive's bodies are read."""
    title = F.concat(X.strip(F.coalesce("appendix_name", F.lit(""))), F.lit(" נספח "), F.coalesce(F.get("appendix_number", 0), F.lit("")))
    fields = F.struct(
        F.col("file_path").alias("documentURL"), F.lit("").alias("policyHeaderForDisplay"), title.alias("policyHeader"), F.array().cast("array<string>").alias("tags"),
        F.date_format("marketing_start_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("policyIssueDate"), F.date_format("marketing_end_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("policyEndDate"),
    )
    rows = P.archive_json(_bodies(spark, d, fields, "data", err=F.lit("")), "body", far_year=2018)
    return rows.select("domain", "title", F.array_sort("appendix_numbers").alias("numbers"), "download_url", F.col("marketing_start_date").alias("start_date"), F.col("marketing_end_date").alias("end_date"))


@query(f"""WITH {DOCS} SELECT domain, regexp_replace(coalesce(appendix_name, ''), '^{BLANK}|{BLANK}$', '', 'g') AS title, CASE WHEN len(appendix_number) > 0 THEN [appendix_number[1]] ELSE [] END AS numbers, 'https://files/' || file_path AS download_url, marketing_start_date AS start_date, marketing_end_date AS end_date FROM docs""")
def families_listing(spark: SparkSession, d: str) -> DataFrame:
    """Families of policies are read from their bodies."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    policy = F.struct(
        F.col("appendix_name").alias("Title"), F.get("appendix_number", 0).alias("AttachmentNumber"), F.lit("x").alias("PolicyTypeDesc"), F.col("file_path").alias("FilePath"),
        F.date_format("marketing_start_date", stamp).alias("StartValidity"), F.coalesce(F.date_format("marketing_end_date", stamp), F.lit(P.NO_DATE)).alias("EndValidity"),
    )
    rows = P.families_json(_bodies(spark, d, F.struct(F.array(policy).alias("Policies")), "FamilyPoliciesDetails", IsSuccess=F.lit(True)), "body", "https://files/")
    return rows.select("domain", "title", F.col("appendix_numbers").alias("numbers"), "download_url", F.col("marketing_start_date").alias("start_date"), F.col("marketing_end_date").alias("end_date"))


@query(f"""WITH {DOCS} SELECT domain, regexp_replace(coalesce(appendix_name, ''), '^{BLANK}|{BLANK}$', '', 'g') AS title, 'https://forms/' || pages_count AS download_url, marketing_start_date AS start_date FROM docs WHERE pages_count IS NOT NULL""")
def forms_listing(spark: SparkSession, d: str) -> DataFrame:
    """Forms by id; those without one are dropped."""
    form = F.struct(F.col("pages_count").cast("bigint").alias("formId"), F.col("appendix_name").alias("formName"), F.lit("t").alias("typeDsc"), F.lit("s").alias("saleDsc"), F.date_format("marketing_start_date", "dd/MM/yyyy").alias("fromDate"), F.lit("").alias("toDate"))
    rows = P.forms_json(_bodies(spark, d, form, "collection", status=F.lit(0)), "body", "https://forms/{form_id}")
    return rows.select("domain", "title", "download_url", F.col("marketing_start_date").alias("start_date"))


@query(f"""WITH {DOCS} SELECT CASE domain WHEN 'health' THEN 'h' ELSE 'l' END AS domain, domain || ' / ' || coalesce(department_name, '') AS department_name, 'https://i' || file_path AS download_url FROM docs WHERE domain = 'health' OR (domain = 'life' AND department_name = 'סיעוד')""")
def items_listing(spark: SparkSession, d: str) -> DataFrame:
    """Items by category and subject; those out of scope are dropped."""
    item = F.struct(F.col("file_path").alias("fileUrl"), F.col("domain").alias("categoryName"), F.col("department_name").alias("subjectName"), F.col("appendix_name").alias("policyName"), F.lit(None).cast("string").alias("fromDate"), F.lit(None).cast("string").alias("endDate"))
    domains = spark.createDataFrame([("health", None, "h"), ("life", "סיעוד", "l")], "category string, subject string, domain string")
    return P.items_json(_bodies(spark, d, item, "items"), "body", domains, "https://i").select("domain", "department_name", "download_url")


@query(f"""WITH {DOCS} SELECT CASE department_name WHEN 'סיעוד' THEN 'health' ELSE 'life' END AS domain, department_name, company_id AS media_folder_id, original_file_name AS file_name FROM docs WHERE department_name IN ('סיעוד', 'תאונות')""")
def media_listing(spark: SparkSession, d: str) -> DataFrame:
    """Media files; the first known department gives the domain."""
    item = F.struct(
        F.array(F.struct(F.lit("?").alias("_name")), F.struct(F.col("department_name").alias("_name"))).alias("Department"), F.concat(F.lit("/media/"), F.col("company_id"), F.lit("/"), F.col("original_file_name")).alias("umbracoFile"),
        F.col("appendix_name").alias("policyName"), F.lit(None).cast("string").alias("fromDate"), F.lit(None).cast("string").alias("ToDate"),
    )
    rows = P.media_json(_bodies(spark, d, item, "Data"), "body", {"סיעוד": "health", "תאונות": "life"}, "https://m/")
    return rows.select("domain", "department_name", "media_folder_id", "file_name")


def _pages(spark: SparkSession, d: str, row: F.Column, head: str, tail: str) -> DataFrame:
    """HTML pages made from the documents, of bounded size, each of one company."""
    named = _paged(docs(spark, d), "company_id").withColumn("plain", X.strip(F.regexp_replace(F.coalesce("appendix_name", F.lit("")), '(?U)["\\s<>&\'\\p{Cf}]+', " ")))
    rows = named.groupBy("company_id", "part").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    return rows.select(F.lit("health").alias("domain"), F.col("company_id").alias("page"), F.concat(F.lit(head), "rows", F.lit(tail)).alias("html"))


PLAIN = r"regexp_replace(regexp_replace(coalesce(appendix_name, ''), '[\x{0022}\x{0027}\s\x{00a0}<>&\x{200e}\x{200f}]+', ' ', 'g'), '^ +| +$', '', 'g')"


@query(f"""WITH {DOCS} SELECT {PLAIN} AS title, [coalesce(appendix_number[1], '-')] AS numbers, '/f/' || id || '.pdf' AS download_url, marketing_start_date AS start_date FROM docs""")
def table_listing(spark: SparkSession, d: str) -> DataFrame:
    """Rows of HTML tables are read."""
    row = F.concat(F.lit('<tr><td><a class="x" href="/f/'), "id", F.lit('.pdf"><b>'), "plain", F.lit("</b></a></td><td> "), F.coalesce(F.get("appendix_number", 0), F.lit("-")), F.lit("</td><td>z</td><td>"), F.coalesce(F.date_format("marketing_start_date", "dd.MM.yyyy"), F.lit("")), F.lit("</td></tr>"))
    pages = _pages(spark, d, row, '<html><table id="policies"><tr><th>t</th></tr>', "</table></html>")
    return P.table_html(pages, "html").select("title", F.col("appendix_numbers").alias("numbers"), "download_url", F.col("marketing_start_date").alias("start_date"))


@query(f"""WITH {DOCS} SELECT company_id AS page, 'https://s/media/' || original_file_name AS download_url, count(*) AS n FROM docs GROUP BY ALL HAVING count(*) >= 1""")
def anchor_listing(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages, each address once a page."""
    row = F.concat(F.lit('<a href="https://s//media/'), "original_file_name", F.lit('">'), "plain", F.lit("</a>"))
    pages = _pages(spark, d, row, "<div>", "</div>")
    found = P.anchors_html(pages, "page", "html").select("page", "download_url")
    n = docs(spark, d).groupBy(F.col("company_id").alias("page"), F.concat(F.lit("https://s/media/"), "original_file_name").alias("download_url")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, ["page", "download_url"])


@query(f"""WITH {DOCS} SELECT company_id AS page, id AS media_id, CASE WHEN {PLAIN} = '' THEN '' ELSE {PLAIN} END AS title FROM docs""")
def titled_listing(spark: SparkSession, d: str) -> DataFrame:
    """Titled links first, then bare addresses."""
    row = F.concat(F.lit('<a title="'), "plain", F.lit('" href="/media/'), F.replace(F.replace("id", F.lit("/"), F.lit("|")), F.lit(":"), F.lit("~")), F.lit('/f.pdf">x</a>'))
    found = P.titled_html(_pages(spark, d, row, "<div>", "</div>"), "page", "html")
    return found.select("page", F.replace(F.replace("media_id", F.lit("|"), F.lit("/")), F.lit("~"), F.lit(":")).alias("media_id"), "title")


@query(f"""WITH {DOCS} SELECT original_file_name AS title, [appendix_number[1]] AS numbers, date_trunc('month', marketing_start_date)::DATE AS start_date FROM docs WHERE len(appendix_number) > 0 AND NOT contains(original_file_name, 'doc_')""")
def cell_listing(spark: SparkSession, d: str) -> DataFrame:
    """Rendered rows with a filled number cell, without excluded titles."""
    cells = F.array("original_file_name", F.coalesce(F.get("appendix_number", 0), F.lit(" ")), F.coalesce(F.date_format("marketing_start_date", "MM/yy"), F.lit("")), F.lit("x"))
    rows = docs(spark, d).select("domain", cells.alias("cells"), F.col("file_path").alias("link"))
    found = P.without_titles(P.cell_rows(rows, "cells", "link"), ["doc_"])
    return found.select("title", F.col("appendix_numbers").alias("numbers"), F.col("marketing_start_date").alias("start_date"))


@query(f"""WITH {EXTR} SELECT document_id AS custom_id, coverage_name AS name, CASE WHEN disease_count IS NOT NULL THEN disease_count::BIGINT END AS n FROM extr WHERE coverage_name IS NOT NULL OR disease_count IS NOT NULL""")
def batch_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results of a batch service are decoded; failed lines and those of the error file give no row."""
    e = extractions(spark, d)
    content = F.to_json(F.struct(F.col("coverage_name").alias("name"), F.col("disease_count").alias("n")))
    body = F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body"))
    lines = e.select(F.to_json(F.struct(F.col("document_id").alias("custom_id"), body.alias("response"))).alias("value"))
    errors = e.select(F.to_json(F.struct(F.concat(F.lit("failed:"), "document_id").alias("custom_id"), F.lit("quota").alias("error"))).alias("value"))
    got = S.decoded_batch(lines, "name string, n bigint", errors, skip_failures=True)
    return got.select("custom_id", "result.name", "result.n")


@query("""SELECT document_id, arg_max(record_state, snapshot_id) AS state FROM document_snapshots GROUP BY 1""")
def checkpoint_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last line of every key of a JSONL checkpoint."""
    lines = table(spark, d, "document_snapshots").select(F.to_json(F.struct("document_id", F.col("record_state").alias("state"))).alias("value"), F.col("snapshot_id").alias("line"))
    return S.last_checkpoint(lines, "document_id string, state string", "document_id", "line")


@query("""WITH p AS (SELECT document_id AS doc, doc_id AS page, text, length(regexp_replace(coalesce(text, ''), '[^\\pL]', '', 'g')) >= 20 AS layer FROM documents WHERE document_id IS NOT NULL)
SELECT doc, string_agg(CASE WHEN layer THEN text ELSE 'ocr ' || page END, E'\\n' ORDER BY page) AS text, CASE WHEN bool_or(NOT layer) THEN 'ocr' ELSE 'text' END AS method FROM p GROUP BY doc""")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages joined in order, each from the text layer or from OCR."""
    pages = table(spark, d, "documents").where("document_id is not null").select(F.col("document_id").alias("doc"), F.col("doc_id").alias("page"), "text", F.concat(F.lit("ocr "), F.col("doc_id")).alias("ocr"))
    return S.page_texts(pages, "doc", "page", "text", "ocr")


@query("""SELECT source AS page, round(coalesce(avg(c) FILTER (c >= 0), 0) / 100, 9) AS confidence FROM (SELECT source, (doc_id % 103) - 3 AS c FROM documents) GROUP BY 1""")
def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the confidences that are not negative."""
    words = table(spark, d, "documents").select(F.col("source").alias("page"), (F.col("doc_id") % 103 - 3).alias("c"))
    return S.mean_confidence(words, "page", "c").select("page", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {CODES} SELECT document_id, list_sort(list(code_category || '=' || code)) AS terms FROM (SELECT document_id, code_category, max(code) AS code FROM codes WHERE document_id IS NOT NULL GROUP BY ALL) GROUP BY 1")
def term_maps(spark: SparkSession, d: str) -> DataFrame:
    """Term to definition; of a repeated term the last wins."""
    c = codes(spark, d).where("document_id is not null")
    entries = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("code_category").alias("term"), F.col("code").alias("definition")))).alias("es"))
    terms = F.map_entries(C.last_of_terms(F.col("es")))
    return entries.select("document_id", F.array_sort(F.transform(terms, lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("terms"))


@query(f"""WITH v AS (SELECT document_id, embedding::DOUBLE[] AS e FROM document_embeddings WHERE model_name = '{MODEL}' AND embedding IS NOT NULL)
SELECT document_id, round(max(sqrt(list_sum(list_transform(e, lambda x: x * x)))), 6) AS length FROM v GROUP BY 1""")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2: lengths of the vectors."""
    v = table(spark, d, "document_embeddings").where((F.col("model_name") == MODEL) & F.col("embedding").isNotNull())
    return v.groupBy("document_id").agg(F.round(F.max(F.sqrt(M.dot(F.col("embedding"), F.col("embedding")))), 6).alias("length"))


def _places_sql(text: str, pattern: str) -> str:
    """Matches with their places, as functions.positions.places."""
    words, pieces = f"regexp_extract_all({text}, {q(pattern)})", f"string_split_regex({text}, {q(pattern)})"
    lengths = "coalesce(list_sum(list_transform({}, lambda x: length(x)))::INT, 0)"
    return f"list_transform(range(1, len({words}) + 1), lambda i: struct_pack(at := {lengths.format(f'({pieces})[1:i]')} + {lengths.format(f'({words})[1:i - 1]')}, word := ({words})[i]))"


def _nearest_sql(text: str, word: str, reach: int) -> str:
    lo = f"greatest(0, m.at - {reach})"
    around = f"substring({text}, {lo} + 1, m.at + length(m.word) + {reach} - {lo})"
    numbers = f"list_filter({_places_sql(around, N.NUMBER_RUN)}, lambda n: regexp_full_match(n.word, '\\d{{2,4}}'))"
    far = f"least(abs({lo} + n.at - m.at), abs({lo} + n.at - m.at - length(m.word)))"
    mentions = _places_sql(text, word)
    return f"list_min(flatten(list_transform({mentions}, lambda m: list_transform({numbers}, lambda n: struct_pack(far := {far}, mention := m.at, at := n.at, number := n.word))))).number"


@query(f"""WITH w AS (SELECT doc_id, substring(text, 1, {N.TITLE_CHARS}) AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, t, coalesce(nullif(regexp_extract(t, {q(N.CLEAN_NUMBER)}, 1), ''), {_nearest_sql('t', N.KEYWORD, N.NEAR_KEYWORD)}, {_nearest_sql('t', N.EDITION_WORD, N.NEAR_EDITION)}) AS number,
  {FIRST.format(c='t', p=q(N.EDITION))} AS mark FROM w)
SELECT doc_id, CASE WHEN ltrim(number, '0') <> '' THEN number END AS number,
  CASE WHEN substring(mark, 1, 2)::INT BETWEEN 1 AND 12 AND substring(mark, 4, 4)::INT > 0 THEN make_date(substring(mark, 4, 4)::BIGINT, substring(mark, 1, 2)::BIGINT, 1) END AS edition FROM n""")
def nearest_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Number and edition of a document's beginning, by position."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", N.title_number(F.col("text")).alias("number"), N.title_edition(F.col("text")).alias("edition"))


@query("""WITH l AS (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\f\\r]+') AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM l),
lines AS (SELECT doc_id, i // 7 AS line, string_agg(word, ' ' ORDER BY i % 7) AS t FROM w WHERE word <> '' GROUP BY ALL)
SELECT doc_id, string_agg(t, E'\\n' ORDER BY line) AS text FROM lines GROUP BY 1""")
def rtl_pages(spark: SparkSession, d: str) -> DataFrame:
    """Words of a page in reading order; the boxes, seven a line with uneven heights, are made from the texts' words."""
    texts = table(spark, d, "documents").where("text is not null")
    words = texts.select("doc_id", F.posexplode(F.split("text", r"[ \t\n\f\r]+")).alias("i", "word")).where("word <> ''")
    boxes = words.select("doc_id", (500 - (F.col("i") % 7) * 60).cast("double").alias("x"), (F.floor(F.col("i") / 7) * 20 + (F.col("i") % 3)).cast("double").alias("y"), "word")
    return L.rtl_lines(boxes, "doc_id", "x", "y", "word", 10.0)


LEADERS = f"""WITH RECURSIVE {DOCS}, {EXTR}, {VECTORS}, {SIDES}, firsts AS (SELECT company, domain, v, min(id) AS k FROM sides GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY company, domain ORDER BY k) AS n FROM firsts),
walk AS (SELECT company, domain, n, v, k AS seed, [struct_pack(k := k, v := v)] AS seeds FROM ordered WHERE n = 1
  UNION ALL SELECT company, domain, n, v, CASE WHEN best.s >= 0.87 THEN best.k ELSE k END, CASE WHEN best.s >= 0.87 THEN seeds ELSE list_append(seeds, struct_pack(k := k, v := v)) END
  FROM (SELECT o.*, w.seeds, list_max(list_transform(w.seeds, lambda x, i: struct_pack(s := list_dot_product(x.v, o.v), first := -i, k := x.k))) AS best FROM walk w JOIN ordered o ON o.company = w.company AND o.domain = w.domain AND o.n = w.n + 1)),
led AS (SELECT s.company, s.domain, s.id, w.seed FROM sides s JOIN walk w ON w.company = s.company AND w.domain = s.domain AND w.v = s.v)"""


def _led(spark: SparkSession, d: str) -> DataFrame:
    from tavla.plans.common import entities

    named = entities(spark, d).where("company is not null and domain is not null")
    return L.leader_clusters(named, ["company", "domain"], "id", "vector", ["id"], 0.87)


@query(f"{LEADERS} SELECT company, domain, id, seed FROM led")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Leader clustering of the vectors of each company and domain, in the order of the ids."""
    return _led(spark, d)


@query(f"""{LEADERS}, sized AS (SELECT l.seed, l.id, coalesce(d.pages_count, 0)::BIGINT AS n FROM led l JOIN docs d ON d.id = l.id)
SELECT seed, sum(n)::BIGINT AS total_frequency, count(*) AS member_count, list(id ORDER BY n DESC, id) AS members FROM sized GROUP BY 1""")
def cluster_totals(spark: SparkSession, d: str) -> DataFrame:
    """The clusters with their totals, members by weight; a document's pages stand for the frequency of a value."""
    pages = docs(spark, d).select("id", F.coalesce(F.col("pages_count").cast("bigint"), F.lit(0)).alias("n"))
    return L.cluster_totals(_led(spark, d).join(pages, "id"), "seed", "id", "n").orderBy(F.desc("total_frequency"), "seed")

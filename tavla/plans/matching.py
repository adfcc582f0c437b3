"""Matching across companies and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.functions import measures as M
from tavla.functions import text as X
from tavla.operators import codes as C
from tavla.operators import matching as O
from tavla.operators.ranking import latest
from tavla.plans.common import CODES, DOCS, EXCLUDED, EXTR, MATCHES, SIDES, VECTORS, codes, docs, entities, extractions, matches, words_sql
from tavla.session import cut, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PAIRS = "pairs AS (SELECT a.id AS source, b.company, b.id AS candidate, list_dot_product(a.v, b.v) AS score FROM sides a JOIN sides b ON a.domain = b.domain AND a.company <> b.company AND b.active)"
TOP3 = "top3 AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY score DESC, candidate) AS rank FROM pairs WHERE score >= 0.75 QUALIFY rank <= 3)"
BASE = f"WITH {DOCS}, {EXTR}, {VECTORS}, {SIDES}, {PAIRS}, {TOP3}"


@query(f"{BASE} SELECT source, company, candidate, round(score, 6) AS score, rank FROM top3")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three best active candidates of every other company in the domain."""
    return O.rank_candidates(entities(spark, d, lexical=False)).select("source", "company", "candidate", F.round("score", 6).alias("score"), "rank")


def _gate_sql() -> str:
    bag = words_sql("concat_ws(' ', appendix_name, coverage_type, coverage_name)")
    mention = "concat(regexp_extract_all(coalesce(appendix_name, ''), '{p}', 1), regexp_extract_all(coalesce(coverage_name, ''), '{p}', 1))".replace("{p}", X.SCOPE_MENTION)
    scope = f"list_distinct(list_filter(flatten(list_transform({mention}, lambda m: regexp_extract_all(m, '[א-ת]+'))), lambda x: length(x) >= 2 AND NOT list_contains(ws, x) AND NOT list_contains([{', '.join(repr(w) for w in X.SCOPE_WORDS)}], x)))"
    overlap = "(list_has_any({a}, {b}) OR length(list_filter({a}, lambda x: length(list_filter({b}, lambda y: length(x) >= 3 AND length(y) >= 3 AND (starts_with(x, y) OR suffix(x, y) OR starts_with(y, x) OR suffix(y, x)))) > 0)) > 0)"
    return f"""WITH {DOCS}, {EXTR}, {VECTORS}, {SIDES}, {EXCLUDED},
bags AS (SELECT *, nullif(coalesce(appendix_name, '') || coalesce(coverage_type, '') || coalesce(coverage_name, ''), '') IS NOT NULL AS named,
  {bag} AS words, CASE WHEN len({mention}) > 0 THEN {scope} END AS scope FROM sides, excluded),
allowed AS (SELECT a.id AS source, b.company, b.id AS candidate, list_dot_product(a.v, b.v) AS score FROM bags a JOIN bags b
  ON a.domain = b.domain AND a.company <> b.company AND b.active
  WHERE (a.scope IS NULL) = (b.scope IS NULL) AND (a.scope IS NULL OR {overlap.format(a="a.scope", b="b.scope")})
    AND (NOT a.named OR NOT b.named OR {overlap.format(a="a.words", b="b.words")}))
SELECT source, company, candidate, round(score, 6) AS score, CASE WHEN score >= 0.90 THEN 'auto_confirmed' ELSE 'pending_review' END AS status FROM allowed
QUALIFY row_number() OVER (PARTITION BY source, company ORDER BY score DESC, candidate) = 1"""


@query(_gate_sql())
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of every other company that shares a content word and a scope."""
    return O.best_corroborated(entities(spark, d)).select("source", "company", "candidate", F.round("score", 6).alias("score"), "status")


@query(f"{BASE} SELECT least(source, candidate) || '|||' || greatest(source, candidate) AS key, least(source, candidate) AS a, greatest(source, candidate) AS b, round(max(score), 6) AS score FROM top3 GROUP BY ALL")
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair once, whichever side found it."""
    pairs = O.rank_candidates(entities(spark, d, lexical=False)).withColumn("score", F.round("score", 6))
    return O.unordered(pairs, "source", "candidate")


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and a stand-in for judgements: a verdict by the lengths of the two ids and the score."""
    pairs = O.rank_candidates(entities(spark, d, lexical=False)).withColumn("score", F.round("score", 6)).withColumn("key", X.pair_key(F.col("source"), F.col("candidate")))
    pairs = cut(pairs)  # read twice, searched once
    n = F.pmod(F.floor(F.col("score") * 1000).cast("int"), F.lit(4))
    verdict = F.when(n == 0, "same_coverage").when(n == 1, "uncertain").when(n == 2, "different_coverage")
    return pairs, pairs.groupBy("key").agg(F.max("score").alias("score")).select("key", verdict.alias("verdict"))


VERDICT = """verdicts AS (SELECT least(source, candidate) || '|||' || greatest(source, candidate) AS key, CASE floor(round(max(score), 6) * 1000)::INT % 4 WHEN 0 THEN 'same_coverage' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'different_coverage' END AS verdict FROM top3 GROUP BY 1),
judged AS (SELECT t.source, t.company, t.candidate, round(t.score, 6) AS score, v.key, v.verdict FROM top3 t JOIN verdicts v ON v.key = least(source, candidate) || '|||' || greatest(source, candidate))"""


@query(f"""{BASE}, {VERDICT} SELECT source, company, candidate, score, verdict FROM judged WHERE verdict IN ('same_coverage', 'uncertain')
QUALIFY row_number() OVER (PARTITION BY source, company ORDER BY CASE verdict WHEN 'same_coverage' THEN 0 ELSE 1 END, score DESC, candidate) = 1""")
def verdict_pick(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate judged the same, else uncertain."""
    pairs, verdicts = _judged(spark, d)
    return O.pick_by_verdict(pairs, verdicts).select("source", "company", "candidate", "score", "verdict")


@query(f"""{BASE}, {VERDICT} SELECT count(DISTINCT source) AS sources, count(*) AS slots, count(DISTINCT key) AS unique_pairs,
count(*) FILTER (verdict IS NULL) AS unjudged, count(*) FILTER (verdict = 'different_coverage') AS rejected FROM judged""")
def candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sources with candidates, candidate slots, unordered pairs and outcomes."""
    pairs, verdicts = _judged(spark, d)
    return pairs.join(verdicts, "key").agg(
        F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("slots"), F.countDistinct("key").alias("unique_pairs"),
        F.count_if(F.col("verdict").isNull()).alias("unjudged"), F.count_if(F.col("verdict") == "different_coverage").alias("rejected"),
    )


@query(f"""{BASE}, {MATCHES}, kept AS (SELECT id, document_id, matched_document_id, similarity_score, status FROM mat WHERE status IN ('confirmed', 'rejected'))
SELECT * FROM kept UNION ALL SELECT source || ':' || candidate AS id, source, candidate, round(score, 6), CASE WHEN round(score, 6) >= 0.9 THEN 'auto_confirmed' ELSE 'pending_review' END
FROM top3 WHERE rank = 1 AND source || ':' || candidate NOT IN (SELECT id FROM kept)""")
def rebuild_protected(spark: SparkSession, d: str) -> DataFrame:
    """New matches replace all that nobody reviewed."""
    old = matches(spark, d).select("id", "document_id", "matched_document_id", "similarity_score", "status")
    best = O.rank_candidates(entities(spark, d, lexical=False)).where("rank = 1").withColumn("score", F.round("score", 6))
    new = best.select(
        F.concat_ws(":", "source", "candidate").alias("id"), F.col("source").alias("document_id"), F.col("candidate").alias("matched_document_id"),
        F.col("score").alias("similarity_score"), M.status_of(F.col("score")).alias("status"),
    )
    return O.rebuild_protected(old, new)


@query(f"""WITH {DOCS}, {MATCHES} SELECT m.id, m.status, m.similarity_score, a.company_id AS a_company_id, a.appendix_name AS a_appendix_name, b.company_id AS b_company_id, b.appendix_name AS b_appendix_name
FROM mat m JOIN docs a ON a.id = m.document_id JOIN docs b ON b.id = m.matched_document_id""")
def matches_with_documents(spark: SparkSession, d: str) -> DataFrame:
    """Matches with both documents."""
    return O.with_both_sides(matches(spark, d), docs(spark, d), ["company_id", "appendix_name"]).select(
        "id", "status", "similarity_score", "a_company_id", "a_appendix_name", "b_company_id", "b_appendix_name"
    )


BUSIEST = "busiest AS (SELECT e FROM (SELECT document_id AS e FROM mat UNION ALL SELECT matched_document_id FROM mat) GROUP BY e ORDER BY count(*) DESC, e LIMIT 1)"


def _busiest(m: DataFrame) -> str:
    """The document with the most matches (ties: the smallest id)."""
    ends = m.select(F.explode(F.array("document_id", "matched_document_id")).alias("e"))
    row = ends.groupBy("e").count().orderBy(F.desc("count"), "e").first()
    return row["e"] if row else ""


@query(f"""WITH {DOCS}, {MATCHES}, {BUSIEST} SELECT m.id, m.status, d.id AS other_id, d.company_id AS other_company
FROM mat m JOIN busiest x ON x.e IN (m.document_id, m.matched_document_id) JOIN docs d ON d.id = CASE WHEN m.document_id = x.e THEN m.matched_document_id ELSE m.document_id END
WHERE m.status IN ('confirmed', 'auto_confirmed')""")
def either_side_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matches of one document at either side, with the other document."""
    m, other = matches(spark, d), docs(spark, d).select(F.col("id").alias("other"), F.col("company_id").alias("other_company"))
    found = O.touching(m, _busiest(m)).where(F.col("status").isin("confirmed", "auto_confirmed"))
    return found.join(other, "other").select("id", "status", F.col("other").alias("other_id"), "other_company")


@query(f"""WITH {DOCS}, {MATCHES}, {BUSIEST}, others AS (SELECT m.*, CASE WHEN m.document_id = x.e THEN m.matched_document_id ELSE m.document_id END AS other FROM mat m JOIN busiest x ON x.e IN (m.document_id, m.matched_document_id)),
picked AS (SELECT o.id AS match_id, d.company_id AS company FROM others o JOIN docs d ON d.id = o.other QUALIFY row_number() OVER (PARTITION BY d.company_id ORDER BY o.similarity_score DESC NULLS LAST, o.id) = 1)
SELECT c.id AS company, p.match_id FROM companies c LEFT JOIN picked p ON p.company = c.id""")
def comparison_picker(spark: SparkSession, d: str) -> DataFrame:
    """One match per company for a document, and the companies without one."""
    m = matches(spark, d)
    wanted = table(spark, d, "companies").select(F.col("id").alias("company"))
    picked, missing = O.first_per_company(m, docs(spark, d), _busiest(m), wanted, [F.desc("similarity_score"), F.col("id")])
    return picked.select("company", F.col("id").alias("match_id")).unionByName(missing.withColumn("match_id", F.lit(None).cast("string")))


@query(f"WITH {MATCHES} SELECT document_id AS id FROM mat UNION SELECT matched_document_id FROM mat")
def endpoint_ids(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a match."""
    m = matches(spark, d)
    return m.select(F.explode(F.array("document_id", "matched_document_id")).alias("id")).distinct()


@query(f"""WITH {MATCHES} SELECT status, count(*) AS n, count(*) FILTER (similarity_score >= 0.95) AS strong, round(avg(similarity_score), 9) AS mean_score, count(similarity_score) AS scored,
round(avg((similarity_score >= 0.9)::INT), 9) AS auto_rate, count(*) >= 30 AS sufficient FROM mat GROUP BY status""")
def status_rates(spark: SparkSession, d: str) -> DataFrame:
    """Counts, means and rates by status, nulls left out."""
    score = F.col("similarity_score")
    return matches(spark, d).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(score >= 0.95).alias("strong"), F.round(F.avg(score), 9).alias("mean_score"), F.count(score).alias("scored"),
        F.round(F.avg((score >= 0.9).cast("double")), 9).alias("auto_rate"), (F.count(F.lit(1)) >= 30).alias("sufficient"),
    )


@query(f"""WITH {MATCHES}, {CODES}, sets AS (SELECT document_id, code_category, list(DISTINCT code) AS cs FROM codes WHERE document_id IS NOT NULL GROUP BY ALL),
scoped AS (SELECT * FROM mat WHERE document_id IN (SELECT document_id FROM sets) AND matched_document_id IN (SELECT document_id FROM sets)),
cats AS (SELECT DISTINCT m.id, m.status, m.document_id, m.matched_document_id, s.code_category FROM scoped m JOIN sets s ON s.document_id IN (m.document_id, m.matched_document_id)),
j AS (SELECT c.id, c.status, c.code_category, len(list_intersect(coalesce(a.cs, []), coalesce(b.cs, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(a.cs, []), coalesce(b.cs, [])))) AS jac
FROM cats c LEFT JOIN sets a ON a.document_id = c.document_id AND a.code_category = c.code_category LEFT JOIN sets b ON b.document_id = c.matched_document_id AND b.code_category = c.code_category)
SELECT id, status, round(avg(jac), 9) AS mean_jaccard, count(*) AS categories FROM j GROUP BY ALL""")
def jaccard_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap of the code sets of matched documents over the categories of either."""
    sets = C.code_sets(codes(spark, d).where("document_id is not null"), "document_id", "code_category", "code")
    m = matches(spark, d)
    keys = sets.select("key").distinct()
    scoped = m.join(keys.withColumnRenamed("key", "document_id"), "document_id", "left_semi").join(keys.withColumnRenamed("key", "matched_document_id"), "matched_document_id", "left_semi")
    each = C.category_jaccard(scoped.select("document_id", "matched_document_id").distinct(), sets, "document_id", "matched_document_id")
    mean = each.groupBy("document_id", "matched_document_id").agg(F.avg("jaccard").alias("mean"), F.count(F.lit(1)).alias("categories"))
    return scoped.join(mean, ["document_id", "matched_document_id"]).select("id", "status", F.round("mean", 9).alias("mean_jaccard"), "categories")


PERIOD_SQL = f"""CASE regexp_extract({{c}}, '{X.PERIOD}', 2) WHEN '' THEN NULL WHEN 'שעה' THEN greatest(1, round_even(regexp_extract({{c}}, '{X.PERIOD}', 1)::INT / 24, 0)::INT) WHEN 'שעות' THEN greatest(1, round_even(regexp_extract({{c}}, '{X.PERIOD}', 1)::INT / 24, 0)::INT)
  {" ".join(f"WHEN '{u}' THEN regexp_extract({{c}}, '{X.PERIOD}', 1)::INT * {n}" for u, n in X.PERIOD_DAYS.items())} END"""


@query(f"""WITH {MATCHES}, {EXTR}, f AS (SELECT document_id, {PERIOD_SQL.format(c="waiting_period")} AS days, coverage_type FROM extr)
SELECT m.id, abs(a.days - b.days) AS waiting_gap, nullif(a.coverage_type, '') = nullif(b.coverage_type, '') AS same_type FROM mat m JOIN f a ON a.document_id = m.document_id JOIN f b ON b.document_id = m.matched_document_id""")
def fingerprint_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the features of matched documents, nulls where either side has none."""
    f = extractions(spark, d).select("document_id", X.period_days(F.col("waiting_period")).alias("days"), "coverage_type").withColumnRenamed("document_id", "id")
    both = O.with_both_sides(matches(spark, d), f, ["days", "coverage_type"])
    return both.select("id", M.gap(F.col("a_days"), F.col("b_days")).alias("waiting_gap"), M.same_text(F.col("a_coverage_type"), F.col("b_coverage_type")).alias("same_type"))


@query(f"""WITH {MATCHES}, ranked AS (SELECT document_id, max(similarity_score) AS s FROM mat WHERE similarity_score IS NOT NULL GROUP BY document_id)
SELECT r.document_id, min(m.matched_document_id) AS matched_document_id, r.s AS similarity_score FROM ranked r JOIN mat m ON m.document_id = r.document_id AND m.similarity_score = r.s GROUP BY ALL""")
def best_of_document(spark: SparkSession, d: str) -> DataFrame:
    """The match with the highest score of every document."""
    scored = matches(spark, d).where("similarity_score is not null")
    best = scored.groupBy("document_id").agg(F.max(F.struct("similarity_score")).alias("s")).select("document_id", F.col("s.similarity_score").alias("similarity_score"))
    return scored.join(best, ["document_id", "similarity_score"]).groupBy("document_id", "similarity_score").agg(F.min("matched_document_id").alias("matched_document_id"))


@query(f"""WITH {MATCHES}, decisions AS (SELECT id, CASE WHEN similarity_score >= 0.97 THEN 'confirmed' WHEN similarity_score < 0.9 THEN 'rejected' ELSE 'postponed' END AS decision FROM mat WHERE status = 'pending_review')
SELECT m.id, CASE WHEN x.decision IN ('confirmed', 'rejected') THEN x.decision ELSE m.status END AS status FROM mat m LEFT JOIN decisions x USING (id)""")
def review_update(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on pending matches; only confirming and rejecting ones count."""
    from tavla.operators.relational import reviewed

    m = matches(spark, d)
    s = F.col("similarity_score")
    decisions = m.where("status = 'pending_review'").select("id", F.when(s >= 0.97, "confirmed").when(s < 0.9, "rejected").otherwise("postponed").alias("decision"))
    return reviewed(m, decisions).select("id", "status")


@query(f"""WITH {MATCHES}, pairs AS (SELECT least(document_id, matched_document_id) || '|||' || greatest(document_id, matched_document_id) AS key, bool_or(status <> 'pending_review' AND similarity_score IS NOT NULL) AS done FROM mat GROUP BY 1)
SELECT key FROM pairs WHERE NOT coalesce(done, false)""")
def remaining_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose judgement is still open; an entry without a verdict counts as open."""
    m = matches(spark, d).withColumn("key", X.pair_key(F.col("document_id"), F.col("matched_document_id")))
    done = m.where("status <> 'pending_review' and similarity_score is not null")
    return m.select("key").distinct().join(done.select("key").distinct(), "key", "left_anti")


@query("SELECT doc AS document_id, n FROM (SELECT document_id AS doc, count(*) AS n FROM document_matches GROUP BY 1)")
def match_rows(spark: SparkSession, d: str) -> DataFrame:
    """A pruned scan with a map-side count."""
    return table(spark, d, "document_matches").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS} SELECT id, company_id, appendix_name FROM docs")
def current_documents(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every document."""
    return latest(table(spark, d, "policy_documents").select("id", "company_id", "appendix_name", "created_date"), ["id"], ["created_date"]).select("id", "company_id", "appendix_name")

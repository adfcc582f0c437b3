"""Rule-based normalisation of phrases to codes, fingerprints and the calibration of matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavla.functions import measures as M
from tavla.functions import text as X
from tavla.session import cut

#: Phrases of a dictionary (about 100 bytes each) that are broadcast, each typed phrase being compared with all of its category.
BROADCAST_PHRASES = 5_000
#: Letters of the pieces by which phrases are joined with the dictionary before they are compared.
GRAM = 3


def exploded_phrases(df: DataFrame, key: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """``key, category, phrase, source_field, pos``: the phrases of text and list fields, in the order of the fields; nulls are skipped."""
    def one(field: str, category: str) -> Column:
        items = F.col(field) if dict(df.dtypes)[field].startswith("array") else F.array(F.col(field))
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(F.lit(category).alias("category"), x.alias("phrase"), F.lit(field).alias("source_field")))

    exploded = df.select(key, F.posexplode(F.concat(*[one(f, c) for f, c in fields])).alias("pos", "p"))
    return exploded.where("p.phrase is not null").select(key, "p.category", "p.phrase", "p.source_field", "pos")


def code_phrases(codes: DataFrame, code: str, category: str, name: str, synonyms: str) -> DataFrame:
    """``code, category, known, ord``: every name and synonym of the dictionary."""
    listed = codes.select(
        F.col(code).alias("code"), F.col(category).alias("category"),
        F.posexplode(F.concat(F.array(F.col(name)), F.coalesce(F.col(synonyms), F.array().cast("array<string>")))).alias("ord", "known"),
    )
    return listed.where("known is not null and known <> ''")


def _grams(c: Column, *sizes: int) -> Column:
    """The distinct pieces of a text of the given numbers of letters."""
    def of(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _rarest_gram(df: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``category, <key>, gram``: of each text the piece that the fewest dictionary phrases have; texts with a piece that none has are left out.

    Texts shorter than a piece are their own piece.
    """
    own = F.when(F.length(key) < GRAM, F.array(key)).otherwise(_grams(F.col(key), GRAM))
    pieces = df.select("category", key, F.size(own).alias("all"), F.explode(own).alias("gram")).join(counts, ["category", "gram"])
    best = pieces.groupBy("category", key).agg(F.min(F.struct("n", "gram")).alias("b"), F.count(F.lit(1)).alias("found"), F.max("all").alias("all"))
    return best.where("found = all").select("category", key, "b.gram")


def _holding(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """``category, __p, known, code``: the known phrases that hold a typed one ``__p`` of their category or are held by it."""
    distinct, known = cut(distinct), cut(known)
    sizes = range(1, GRAM + 1)
    listed = known.select("category", "known", F.explode(_grams(F.col("known"), *sizes)).alias("gram"))
    counts = listed.groupBy("category", "gram").agg(F.count(F.lit(1)).alias("n"))
    # A known phrase inside a typed one.
    short = not known.where(F.length("known").between(1, GRAM - 1)).isEmpty()
    typed = distinct.select("category", "__p", F.explode(_grams(F.col("__p"), *(sizes if short else [GRAM]))).alias("gram"))
    inside = typed.join(_rarest_gram(known, "known", counts), ["category", "gram"]).where(F.contains("__p", "known"))
    # A typed phrase inside a known one.
    around = _rarest_gram(distinct, "__p", counts).join(listed, ["category", "gram"]).where(F.contains("known", "__p"))
    return inside.select("category", "__p", "known").unionByName(around.select("category", "__p", "known")).join(known, ["category", "known"])


def normalised_phrases(phrases: DataFrame, dictionary: DataFrame, *, broadcast_phrases: int = BROADCAST_PHRASES) -> DataFrame:
    """``phrases`` with ``code``: that of the longest known phrase of its category that holds it or is held by it; null if none.

    Equal lengths go to the smaller known phrase, then code. Distinct phrases are matched once, with a small dictionary by broadcast. With a
    larger one, since a text that holds another has all its pieces of three letters, texts are joined on the rarest piece of the shorter one,
    whatever the sizes of both sides, and compared afterwards.
    """
    known = dictionary.select("category", "known", "code").where("known <> '' and category is not null").groupBy("category", "known").agg(F.min("code").alias("code"))
    distinct = phrases.select("category", X.strip(F.col("phrase")).alias("__p")).where("__p <> '' and category is not null").distinct()
    if dictionary.limit(broadcast_phrases + 1).count() <= broadcast_phrases:
        d = F.broadcast(known.withColumnRenamed("category", "__c"))
        hit = distinct.join(d, (F.col("category") == F.col("__c")) & (F.contains("__p", "known") | F.contains("known", "__p"))).drop("__c")
    else:
        hit = _holding(distinct, known)
    best = hit.groupBy("category", "__p").agg(F.min_by("code", F.struct(-F.length("known"), "known", "code")).alias("code"))
    return phrases.withColumn("__p", X.strip(F.col("phrase"))).join(best, ["category", "__p"], "left").drop("__p")


def fingerprint(
    df: DataFrame,
    *,
    amounts: str,
    waiting: str,
    qualifying: str,
    survival: str,
    caps: str | None = None,
    calculation: str | None = None,
    ages: str | None = None,
    deductible_applies: str | None = None,
    deductible_text: str | None = None,
    benefit: str | None = None,
    benefit_code: str | None = None,
    counts: Sequence[str] = (),
) -> DataFrame:
    """Numeric features of extracted texts: periods in days, least and greatest amount with the first one's currency, list sizes.

    Of the optional columns come ``maximum`` (the greatest of ``caps``), ``percent``, the two ages of a range ``ages``, ``deductible`` (only if it
    applies and has a text) and ``benefit_type`` (the code, else the text as it stands). What can't be read is null.
    """
    def read(c: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), X.amount), lambda a: a.isNotNull())

    values = lambda c: F.transform(F.col(c), lambda a: a["value"])
    out = df.withColumn("__parsed", read(amounts)).select(
        "*",
        X.period_days(F.col(waiting)).alias("waiting_days"),
        X.period_days(F.col(qualifying)).alias("qualifying_days"),
        X.period_days(F.col(survival)).alias("survival_days"),
        F.array_min(values("__parsed")).alias("amount_min"),
        F.array_max(values("__parsed")).alias("amount_max"),
        F.get(F.transform(F.col("__parsed"), lambda a: a["currency"]), 0).alias("currency"),
        *[M.size_of(F.col(c)).alias(f"n_{c}") for c in counts],
    )
    if caps:
        out = out.withColumn("__caps", read(caps)).withColumn("maximum", F.array_max(values("__caps"))).drop("__caps")
    if calculation:
        out = out.withColumn("percent", X.percentage(F.col(calculation)))
    if ages:
        numbers = X.groups(F.col(ages), r"(\d+)")
        out = out.withColumns({"min_age": F.get(numbers, 0).try_cast("int"), "max_age": F.get(numbers, 1).try_cast("int")})
    if deductible_applies and deductible_text:
        applies = F.col(deductible_applies) & (F.col(deductible_text) != "")
        out = out.withColumn("deductible", F.when(applies, X.amount(F.col(deductible_text))["value"]))
    if benefit:
        out = out.withColumn("benefit_type", F.coalesce(F.col(benefit_code), F.col(benefit)) if benefit_code else F.col(benefit))
    return out.drop("__parsed")


def code_sets(codes: DataFrame, key: str, category: str, code: str) -> DataFrame:
    return codes.groupBy(F.col(key).alias("key"), F.col(category).alias("category")).agg(F.collect_set(code).alias("codes"))


def category_jaccard(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, category, jaccard``: overlap of the code sets of each pair in every category that either side has; one-sided is zero."""
    left = pairs.select(a, b).join(sets.withColumnRenamed("key", a).withColumnRenamed("codes", "ca"), a)
    right = pairs.select(a, b).join(sets.withColumnRenamed("key", b).withColumnRenamed("codes", "cb"), b)
    both = left.join(right, [a, b, "category"], "full_outer")
    return both.select(a, b, "category", M.jaccard(F.col("ca"), F.col("cb")).alias("jaccard"))


def last_of_terms(entries: Column) -> Column:
    """A map of term to definition; of a repeated term the last definition wins."""
    n = F.size(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, n), lambda later: later["term"] == e["term"]))
    return F.map_from_entries(last)

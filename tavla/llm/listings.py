"""Market listings and policy documents made comparable, for linking them."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavla.llm.bpe import spread
from tavla.llm.canonical import BKTree, damerau
from tavla.llm.linkage import Comparison
from tavla.session import cut, discard

# Latin letters by which Hebrew names are spelt, and words of one meaning, in those letters.
LETTERS = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "o", "ז": "z", "ח": "ch", "ט": "t", "י": "i", "כ": "k", "ל": "l", "מ": "m",
    "נ": "n", "ס": "s", "ע": "a", "פ": "p", "צ": "tz", "ק": "k", "ר": "r", "ש": "sh", "ת": "t", "ך": "k", "ם": "m", "ן": "n", "ף": "p",
    "ץ": "tz",
}
TIERS = {
    "zhb": ("gold",),
    "ksp": ("silver",),
    "pltinh": ("platinum",),
    "ihlom": ("diamond",),
    "ailit": ("elite",),
    "klasi": ("classic",),
    "bsis": ("bsisi", "basic"),
    "morchb": ("morchbt",),
    "adip": ("moadp",),
    "tzair": ("tzairim",),
}
AUDIENCES = {
    "lmshpchh": ("mshp", "mshpchh"),
    "lshkirim": ("shkir", "shkirim"),
    "lzogot": ("zogi", "zogot"),
    "lildim": ("ild", "ildim"),
    "lichid": ("ichid",),
    "latzmaim": ("atzmai", "atzmaim"),
    "lgmlaim": ("gml", "gmlaim"),
    "lstodntim": ("stodnt", "stodntim"),
    "lkbotzh": ("lkb", "kbotzh"),
    "argon": ("airgon",),
}
#: Words around a name that say nothing about the product.
FILLERS = frozenset(["adkon", "pdf", "chdshh", "hpolish", "tnai", "mla", "nosch", "naot", "giloi", "mhdorh", "kisoi", "lchbri", "chbri"])
COMPANY_FILLERS = frozenset(["bitoch", "lbitoch", "chbrh", "bam", "isral", "kbotzt", "pnsih", "obitoch", "insurance", "ltd"])
ALIASES = {w: k for group in (TIERS, AUDIENCES) for k, ws in group.items() for w in ws}

_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")
_SPELLING = str.maketrans({**LETTERS, **dict.fromkeys("'\"`׳״")})


def spelt(text: str | None) -> list[str]:
    """The words of a text in Latin letters, regardless of case, quotes and invisible marks."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower().translate(_SPELLING))


#: The share of the texts that have a common word, and the fewest texts that make one. Words a text / share bounds their number.
COMMON_SHARE = 1 / 1_000
FEWEST_TEXTS = 5


def common_words(docs: DataFrame, column: str, share: float = COMMON_SHARE, fewest: int = FEWEST_TEXTS) -> list[str]:
    """Words of at least ``share`` of all texts, and of ``fewest`` texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        texts = 0
        for pdf in batches:
            texts += len(pdf)
            counts.update(w for t in pdf[column] for w in set(spelt(t)))
            if len(counts) > 100_000:
                yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})
                counts = Counter()
        yield pd.DataFrame({"w": [*counts, None], "n": [*counts.values(), texts]})  # null: the number of texts

    counted = cut(docs.select(column).mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    texts = counted.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = [r["w"] for r in counted.where(F.col("w").isNotNull() & (F.col("n") >= max(fewest, texts * share))).collect()]
    discard(counted)
    return found


class Reader:
    """Sorts the words of a name into its own name, tier, audience and product words."""

    def __init__(self, common: Sequence[str]):
        self.common = set(common) | set(TIERS) | set(AUDIENCES) | set(ALIASES) | FILLERS
        self.tree = BKTree(sorted(self.common))
        self.seen: dict[str, str] = {}

    def known(self, words: list[str]) -> list[str]:
        """Words with misspellings of common ones put right: one letter, two in words of seven or more."""
        new = sorted({w for w in words if w not in self.seen})
        for w in new:
            self.seen[w] = w
        new = [w for w in new if w not in self.common and len(w) > 2]
        if new:
            limit = np.array([1 + (len(w) > 3) for w in new])
            best: dict[int, tuple] = {}
            for q, node, d in zip(*(x.tolist() for x in self.tree.within(new, limit)), strict=True):
                form = self.tree.forms[node]
                exact = damerau(new[q], form)
                if exact <= 1 + (len(form) > 6) and len(form) > 2:
                    best[q] = min(best.get(q, (9, "")), (exact, form))
            for q, (_, form) in best.items():
                self.seen[new[q]] = form
        out = [self.seen[w] for w in words]
        if len(self.seen) > 300_000:
            self.seen = {}
        return out

    def read_all(self, texts: Sequence[str | None]) -> list[tuple[list[str], list[str], list[str], list[str]]]:
        """The reading of every text; words that are new are looked up together."""
        split = [spelt(t) for t in texts]
        self.known([w for words in split for w in words])
        return [self.sort(words) for words in split]

    def read(self, text: str | None) -> tuple[list[str], list[str], list[str], list[str]]:
        return self.read_all([text])[0]

    def sort(self, words: list[str]) -> tuple[list[str], list[str], list[str], list[str]]:
        words = [ALIASES.get(w, w) for w in self.known(words)]
        words = [w for w in words if w not in FILLERS]
        own = [w for w in words if w not in self.common and not w.isdigit() and len(w) > 3]
        return (
            list(dict.fromkeys(own)),
            sorted({w for w in words if w in TIERS}),
            sorted({w for w in words if w in AUDIENCES}),
            sorted({w for w in words if w in self.common and w not in TIERS and w not in AUDIENCES}),
        )


def company_reader(companies: list[tuple[str, str]]):
    """label -> company id: the company one of whose names the label has, one letter being wrong at most."""
    names = [(w, cid) for cid, shown in companies for w in {*spelt(cid), *spelt(shown)}]

    seen: dict[str, str | None] = {}

    def read(label: str | None) -> str | None:
        if label not in seen:
            if len(seen) > 100_000:
                seen.clear()
            seen[label] = closest(label)
        return seen[label]

    def closest(label: str | None) -> str | None:
        words = [w for w in spelt(label) if w not in COMPANY_FILLERS and len(w) > 2]
        best = min(((damerau(w, n), len(w), cid) for w in words for n, cid in names if abs(len(w) - len(n)) < 3), default=(9, 0, None))
        return best[2] if best[0] <= 2 else None

    return read


def signs(name: str) -> str:
    """A name with one sign for each of the Hebrew letters that are spelt by two."""
    return name.replace("tz", "Z").replace("sh", "S").replace("ch", "C")


def shortened(name: str) -> list[str]:
    """The beginning of a name, and what one letter left out makes of it: names with one letter wrong share one.

    A letter is a Latin one or a sign, so that a Hebrew letter spelt by two counts as one. Both ways of reading a name
    give keys, for s and h, or t and z, may also be two letters.
    """
    heads = {name[:8], signs(name)[:8]}
    return list({key for h in heads for key in (h[:7], *[h[:k] + h[k + 1 :] for k in range(len(h))])})


DATE_FORMATS = ("%Y-%m-%d", "%Y%m%d", "%d/%m/%Y", "%d.%m.%Y", "%d.%m.%y", "%d/%m/%y")


def read_date(text: str | None) -> tuple[str | None, str | None]:
    """(day, month) of a date in one of the lists' formats; a date without day has the month alone."""
    from datetime import datetime

    if not text:
        return None, None
    text = text.strip()
    if m := re.fullmatch(r"(\d{1,2})[./](\d{4})", text):
        return None, f"{m[2]}-{int(m[1]):02d}"
    for f in DATE_FORMATS:
        try:
            day = datetime.strptime(text, f)
        except ValueError:
            continue
        return day.strftime("%Y-%m-%d"), day.strftime("%Y-%m")
    return None, None


FEATURES = (
    "company string, own array<string>, tier array<string>, audience array<string>, product array<string>, "
    "cover_own array<string>, cover_tier array<string>, cover_audience array<string>, kind string, day string, month string, "
    "by_name array<string>, short array<string>"
)
_COLUMNS = [c.split()[0] for c in FEATURES.split(", ")]


def _features(company: str | None, title: tuple, cover: tuple, kind: str | None, day: str | None, month: str | None) -> tuple:
    own, tier, audience, product = title
    c_own, c_tier, c_audience, c_product = cover
    names = list(dict.fromkeys([*own, *c_own]))
    short = sorted({s for n in names for s in shortened(n)})
    return company, own, tier, audience, sorted({*product, *c_product}), c_own, c_tier, c_audience, " ".join(spelt(kind)) or None, day, month, sorted({n[:7] for n in names}), short


def _keyed(features: DataFrame, loose: Column) -> DataFrame:
    """Features with the keys of every pass; rows that are ``loose`` have keys of misspelt names without the company as well."""
    company, none = F.col("company"), F.array().cast("array<string>")
    keyed = lambda known, keys: F.when(known, keys).otherwise(none)
    return features.select(
        "*",
        keyed(company.isNotNull(), F.transform("short", lambda s: F.concat(company, F.lit("|"), s))).alias("by_company"),
        keyed(loose, F.col("short")).alias("by_part"),
        keyed(company.isNotNull() & F.col("day").isNotNull(), F.array(F.concat_ws("|", "company", "day"))).alias("by_day"),
        keyed(company.isNotNull() & F.col("month").isNotNull(), F.transform("product", lambda w: F.concat_ws("|", "company", "month", w))).alias("by_month"),
    )


def listing_keys(features: DataFrame) -> DataFrame:
    """Misspelt names are sought among all companies only where the company isn't known: the pass agrees on names
    alone, and over all listings it would make names agree among other pairs and so count for less."""
    return _keyed(features, F.col("company").isNull())


def document_keys(features: DataFrame) -> DataFrame:
    return _keyed(features, F.lit(True))


def listing_features(listings: DataFrame, companies: list[tuple[str, str]], common: Sequence[str]) -> DataFrame:
    """``lid`` and features of every listing; of several rows of a listing the greatest counts."""
    sent = listings.sparkSession.sparkContext.broadcast((companies, list(common)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, words = sent.value
        company, reader = company_reader(names), Reader(words)
        for pdf in batches:
            titles, covers = reader.read_all(pdf["listed_title"]), reader.read_all(pdf["cover_title"])
            rest = zip(pdf["listing_id"], pdf["company_label"], titles, covers, pdf["cover_kind"], pdf["sold_from"], strict=True)
            yield pd.DataFrame([(i, *_features(company(label), t, c, kind, *read_date(sold))) for i, label, t, c, kind, sold in rest], columns=["lid", *_COLUMNS])

    columns = ["company_label", "listed_title", "cover_kind", "cover_title", "sold_from"]
    once = listings.where("listing_id is not null").groupBy("listing_id").agg(F.max(F.struct(*columns)).alias("r")).select("listing_id", "r.*")
    return spread(once).mapInPandas(run, "lid bigint, " + FEATURES)


def document_features(docs: DataFrame, common: Sequence[str]) -> DataFrame:
    """``rid`` and features of every document (id, company_id, appendix_name, start, coverage_name, coverage_type)."""
    sent = docs.sparkSession.sparkContext.broadcast(list(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(sent.value)
        for pdf in batches:
            titles, covers = reader.read_all(pdf["appendix_name"]), reader.read_all(pdf["coverage_name"])
            rest = zip(pdf["id"], pdf["company_id"], titles, covers, pdf["coverage_type"], pdf["start"], strict=True)
            yield pd.DataFrame([(i, *_features(c, t, v, kind, day, day[:7] if day else None)) for i, c, t, v, kind, day in rest], columns=["rid", *_COLUMNS])

    rows = docs.select("id", "company_id", "appendix_name", F.col("start").cast("string"), "coverage_name", "coverage_type")
    return rows.mapInPandas(run, "rid string, " + FEATURES)


#: Days by which two dates of one product may differ.
NEAR_DAYS = 5

PASSES = ["by_company", "by_name", "by_part", "by_day", "by_month"]


def _closest(a: str, b: str) -> Column:
    """The smallest Levenshtein distance between a name of a and one of b; 99 where there is none."""
    far = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.levenshtein(x, y))))
    return F.coalesce(F.array_min(far), F.lit(99))


def _stem(a: str, b: str) -> Column:
    """Do names of a and b begin alike?"""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.levenshtein(F.substring(x, 1, 6), F.substring(y, 1, 6)) <= 1))


def _sets(a: str, b: str) -> Column:
    """2: a word in common, 1: one side has none, 0: none in common."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1).when(F.arrays_overlap(a, b), 2).otherwise(0)


def listing_comparisons() -> list[Comparison]:
    """The comparisons of listings (l) with documents (r); for each the level of a missing value lies between disagreement and agreement."""
    own = _closest("l.own", "r.own")
    cover = _closest("l.cover_own", "r.cover_own")
    name = (
        F.when(own == 0, 5).when(own == 1, 4).when(own == 2, 3)
        .when(_stem("l.own", "r.cover_own") | _stem("l.cover_own", "r.own"), 2)
        .when((F.size("l.own") == 0) | (F.size("r.own") == 0), 1).otherwise(0)
    )
    cover_name = F.when(cover == 0, 3).when(cover <= 2, 2).when((F.size("l.cover_own") == 0) | (F.size("r.cover_own") == 0), 1).otherwise(0)
    shared = F.size(F.array_intersect("l.product", "r.product"))
    product = F.when((F.size("l.product") == 0) | (F.size("r.product") == 0), 1).when(shared == F.size("l.product"), 3).when(shared > 0, 2).otherwise(0)
    company = F.when(F.col("l.company").isNull() | F.col("r.company").isNull(), 1).when(F.col("l.company") == F.col("r.company"), 2).otherwise(0)
    kind = (
        F.when(F.col("l.kind").isNull() | F.col("r.kind").isNull(), 1)
        .when(F.col("l.kind") == F.col("r.kind"), 3)
        .when(F.levenshtein("l.kind", "r.kind") <= 2, 2)
        .when(F.arrays_overlap(F.split("l.kind", " "), F.split("r.kind", " ")), 2)
        .otherwise(0)
    )
    first = F.to_date(F.concat("l.month", F.lit("-01")))
    date = (
        F.when(F.col("l.month").isNull() | F.col("r.day").isNull(), 1)
        .when(F.col("l.day") == F.col("r.day"), 4)
        .when(F.abs(F.datediff(F.to_date("l.day"), F.to_date("r.day"))) <= NEAR_DAYS, 3)
        .when(F.col("l.day").isNull() & F.to_date("r.day").between(F.date_sub(first, NEAR_DAYS), F.date_add(F.last_day(first), NEAR_DAYS)), 2)
        .otherwise(0)
    )
    return [
        Comparison("company", company, (0.01, 0.09, 0.9), (0.1, 0.1, 0.8)),
        Comparison("name", name, (0.02, 0.1, 0.13, 0.05, 0.1, 0.6), (0.8, 0.1, 0.05, 0.03, 0.01, 0.01)),
        Comparison("cover_name", cover_name, (0.02, 0.7, 0.08, 0.2), (0.24, 0.7, 0.05, 0.01)),
        Comparison("tier", _sets("l.tier", "r.tier"), (0.03, 0.3, 0.67), (0.6, 0.3, 0.1)),
        Comparison("cover_tier", _sets("l.cover_tier", "r.cover_tier"), (0.05, 0.8, 0.15), (0.15, 0.8, 0.05)),
        Comparison("audience", _sets("l.audience", "r.audience"), (0.03, 0.3, 0.67), (0.6, 0.3, 0.1)),
        Comparison("product", product, (0.02, 0.1, 0.18, 0.7), (0.7, 0.1, 0.15, 0.05)),
        Comparison("kind", kind, (0.1, 0.5, 0.1, 0.3), (0.4, 0.5, 0.05, 0.05)),
        Comparison("date", date, (0.02, 0.4, 0.15, 0.1, 0.33), (0.58, 0.4, 0.01, 0.005, 0.005)),
    ]

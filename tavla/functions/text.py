"""String functions: parsing of policy texts, names, dates and keys. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal, prefix letters, scope markers, units and number patterns.
STOP_WORDS = [
    "של", "עם", "על", "אל", "מן", "כל", "לא", "או", "גם", "כי", "אם", "זה", "זו", "אלו", "עד", "בין", "אין", "יש", "את", "לפי", "כפי",
]
GENERIC_TERMS = [
    "ביטוח", "חיים", "בריאות", "פוליסה", "נספח", "גילוי", "נאות", "תנאים", "כלליים", "מקרה", "כיסוי", "כתב", "שירות", "תכנית", "תוכנית", "מוצר",
    "מהדורה", "עדכון", "מעודכן", "נוסח", "פרטי", "כללי", "נוסף", "מחלות", "מוות", "מות",
]
PREFIX_LETTERS = ["ו", "ב", "כ", "ל", "מ", "ש", "ה"]
SCOPE_WORDS = ["בנק", "עיריית", "עירית", "עיריות", "עובדי", "לעובדי"]
SCOPE_MENTION = r"(?:בנק|עיריית|עירית|עובדי|לעובדי)\s+([א-ת]+(?:\s+[א-ת]+)?)"
HEBREW_WORD = r"([א-ת]+)"
PERIOD_DAYS = {"שנתיים": 730, "שנים": 365, "שנה": 365, "שבועות": 7, "שבוע": 7, "חודשים": 30, "חודש": 30, "ימים": 1, "יום": 1}
PERIOD = r"(\d+)\s*(שנתיים|שנים|שנה|שבועות|שבוע|חודשים|חודש|ימים|יום|שעות|שעה)"
COUNTED_UNITS = "יחיד"
ILS_AMOUNT = r"""(?:₪\s*([\d,]+(?:\.\d+)?))|(?:([\d,]+(?:\.\d+)?)\s*(?:₪|ש["'״]?ח))"""
USD_AMOUNT = r"(?:\$\s*([\d,]+(?:\.\d+)?))|(?:([\d,]+(?:\.\d+)?)\s*(?:\$|דולר))"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
NUMBERS_AFTER_WORD = r"""(?:נספח|נטפח)(?:ים)?[\s'"׳-]*(?:מס['׳]?)?[\s'"׳-]*(\d+(?:\s*(?:,|ו-?|-)\s*\d+)*)"""
NUMBERS_BEFORE_WORD = r"\((\d+(?:\s*,\s*\d+)*)\)\s*(?:נספח|נטפח|תוכנית)(?:ים)?"
NUMBERS_AFTER_LABEL = r"\bנספח(?:ים)?\s+(?:(?:מספר|מס)\s*'?\s*)?(\d+(?:\s*(?:,|ו-?|-)\s*\d+)*)"
VERSION_MARK = r"(?:(\d{1,2}[./]\d{4})\s*גרסה|גרסה\s*(\d{1,2}[./]\d{4}))"
TITLE_DATE = r"\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,2}\.\d{4}"
TITLE_START = rf"(?:בתוקף\s+)?(?:החל\s+)?מ-?\s*({TITLE_DATE})"
TITLE_END = rf"עד\s*ל?-?\s*({TITLE_DATE})"
HINT_WORDS = ["נספח", "מספר", "מס"]
SHORT_DURATION = r"(\d+)\s*(יום|ימים|שבוע|שבועות|חודש|חודשים|שנה|שנים)"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Null where the text is empty."""
    return F.when(c != "", c)


def groups(c: Column, pattern: str, group: int = 1) -> Column:
    """Every match of a group, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def first_group(c: Column, pattern: str, *numbers: int) -> Column:
    """The first of the groups that took part in the first match; null without a match."""
    return F.coalesce(*[filled(F.regexp_extract(c, pattern, n)) for n in numbers or (1,)])


def _numbers_in(mentions: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(mentions, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)))))


def appendix_numbers(c: Column) -> Column:
    """Numbers of all appendices a text names: those after the word first, then parenthesised ones before it, first seen."""
    return _numbers_in(F.concat(groups(c, NUMBERS_AFTER_WORD), groups(c, NUMBERS_BEFORE_WORD)))


def labelled_appendix_numbers(c: Column) -> Column:
    """As :func:`appendix_numbers` for texts that may write "number" between the word and the digits."""
    return _numbers_in(groups(c, NUMBERS_AFTER_LABEL))


def clean_text(c: Column) -> Column:
    """Runs of blanks as one, three or more line breaks as two, then every line and the whole stripped."""
    lines = F.split(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def period_days(c: Column) -> Column:
    """Days of the first number with a unit; hours round half to even, to one day at least; null without one."""
    unit = first_group(c, PERIOD, 2)
    n = F.regexp_extract(c, PERIOD, 1).try_cast("bigint")
    days = F.coalesce(*[F.when(unit == u, d) for u, d in PERIOD_DAYS.items()])
    return F.when(unit.isin("שעות", "שעה"), F.greatest(F.lit(1), F.bround(n / 24).cast("int"))).otherwise((n * days).cast("int"))


def amount(c: Column) -> Column:
    """struct<value double, currency string> of the first shekel, else the first dollar amount; null where there is none or the text counts units."""
    ils, usd = first_group(c, ILS_AMOUNT, 1, 2), first_group(c, USD_AMOUNT, 1, 2)

    def value(x: Column, currency: str) -> Column:
        number = F.replace(x, F.lit(","), F.lit("")).try_cast("double")
        return F.when(number.isNotNull(), F.struct(number.alias("value"), F.lit(currency).alias("currency")))

    return F.when(c.contains(COUNTED_UNITS), None).when(ils.isNotNull(), value(ils, "ILS")).otherwise(value(usd, "USD"))


def percentage(c: Column) -> Column:
    return first_group(c, PERCENT).try_cast("double")


def with_prefixes(words: Iterable[str]) -> list[str]:
    """Every word with each of its one- and two-letter prefixes. For closed word lists only."""
    pairs = ["", *PREFIX_LETTERS, *(a + b for a in PREFIX_LETTERS for b in PREFIX_LETTERS)]
    return sorted({p + w for w in words for p in pairs})


def default_excluded() -> list[str]:
    return with_prefixes([*STOP_WORDS, *GENERIC_TERMS])


def tokens(c: Column, *, word: str = HEBREW_WORD, excluded: Sequence[str] | None = None, least: int = 2) -> Column:
    """Distinct content words, in order of appearance; a null text has none.

    The closed list is tested against a constant hash set, once per word, whatever its size.
    """
    words = default_excluded() if excluded is None else list(excluded)
    kept = F.filter(groups(c, word), lambda x: (F.length(x) >= least) & ~x.isin(words))
    return F.array_distinct(kept)


def combined_tokens(*columns: Column, **options) -> Column:
    """The content words of several texts together."""
    return F.array_distinct(F.concat(*[tokens(c, **options) for c in columns]))


def scope_signature(*columns: Column) -> Column:
    """Whom a product is restricted to: null without a marker, else the words after the markers, perhaps none."""
    mentions = F.concat(*[groups(c, SCOPE_MENTION) for c in columns])
    words = F.array_distinct(F.flatten(F.transform(mentions, lambda m: tokens(m))))
    return F.when(F.size(mentions) > 0, F.filter(words, lambda x: ~x.isin(SCOPE_WORDS)))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Do two bags of words share a word, or have one of three letters or more that begins or ends one of the other's?"""

    def near(x: Column, y: Column) -> Column:
        long = (F.length(x) >= 3) & (F.length(y) >= 3)
        return long & (x.startswith(y) | x.endswith(y) | y.startswith(x) | y.endswith(x))

    return F.arrays_overlap(a, b) | F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))


def month_date(c: Column) -> Column:
    """The first of a month written M/YYYY or M.YYYY; null if it is none."""
    return F.try_to_timestamp(F.replace(c, F.lit("."), F.lit("/")), F.lit("M/yyyy")).cast("date")


def version_date(c: Column) -> Column:
    """The month of a text's version mark, in either word order."""
    return month_date(first_group(c, VERSION_MARK, 1, 2))


def edition_date(c: Column) -> Column:
    """The first of the month of an edition MM/YY; blank or bad: null. The year counts from 2000, whatever its digits."""
    text = strip(c)
    month, year = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("int"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int")
    fine = (month.between(1, 12)) & year.between(-1999, 7999) & (F.size(F.split(text, "/")) == 2)
    return F.when(fine, F.make_date(year + 2000, month, F.lit(1)))


def dotted_date(c: Column) -> Column:
    return F.try_to_timestamp(strip(c), F.lit("d.M.yyyy")).cast("date")


def slashed_date(c: Column) -> Column:
    return F.try_to_timestamp(strip(c), F.lit("d/M/yyyy")).cast("date")


def iso_date(c: Column, *, unset: str | None = None, far_year: int | None = None) -> Column:
    """The date as written in an ISO instant, in its own offset; ``unset`` and years from ``far_year`` on mean none."""
    day = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    if unset is not None:
        day = F.when(c != unset, day)
    return day if far_year is None else F.when(F.year(day) < far_year, day)


def title_date(c: Column) -> Column:
    """A date of a title: D.M.YYYY, D.M.YY or M.YYYY."""
    parts = F.split(c, r"\.")
    n = F.size(parts)
    month = F.when(n == 2, F.get(parts, 0)).otherwise(F.get(parts, 1)).try_cast("int")
    raw = F.element_at(parts, -1)
    year = F.when((n == 2) | (F.length(raw) == 4), raw.try_cast("int")).otherwise(raw.try_cast("int") + 2000)
    day = F.when(n == 2, F.lit(1)).otherwise(F.get(parts, 0).try_cast("int"))
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")).cast("date")


def title_dates(c: Column) -> tuple[Column, Column]:
    """(start, end) that a title mentions."""
    return title_date(first_group(c, TITLE_START)), title_date(first_group(c, TITLE_END))


def filename_hint(c: Column) -> Column:
    """The digits right after an appendix word in a file name without its extension."""
    parts = F.split(F.regexp_replace(c, r"\.[^./]*$", ""), r"[_\-]+")
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))).alias("a"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("b"))
    hit = F.filter(pairs, lambda p: p["b"].rlike(r"^\d+$") & (p["a"].isin(HINT_WORDS) | p["a"].endswith(HINT_WORDS[0])))
    return F.get(F.transform(hit, lambda p: p["b"]), 0)


def prefixed_number(c: Column) -> Column:
    """What stands after the first underscore of a file name's stem, if it is all digits."""
    return filled(F.regexp_extract(F.regexp_replace(c, r"\.[^./]*$", ""), r"^[^_]*_(\d+)$", 1))


def url_name(url: Column) -> Column:
    """The decoded last part of an address; a plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(F.substring_index(url, "/", -1), F.lit("+"), F.lit("%2B"))), F.substring_index(url, "/", -1))


def capped_name(name: Column, most: int = 150) -> Column:
    """A file name of at most ``most`` characters: a longer one keeps its beginning, a digest and its extension."""
    ext = F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    stem = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")
    digest = F.substring(F.sha1(F.encode(name, "UTF-8")), 1, 8)
    keep = most - F.length(ext) - F.length(digest) - 1
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(stem, F.lit(1), keep), F.lit("_"), digest, ext))


def joined(parts: Sequence[Column], sep: str = "\n") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def list_text(c: Column, sep: str = "; ") -> Column:
    """A list's items joined; null and empty lists are an empty text."""
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def labelled(name: str, value: Column) -> Column:
    """``name: value``, or null where the value is null or empty."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))


def estimated_tokens(c: Column, per: int = 3, fixed: int = 300) -> Column:
    return (F.floor(F.length(c) / per) + fixed).cast("bigint")


def without_nul(c: Column) -> Column:
    return F.replace(c, F.char(F.lit(0)), F.lit(""))


def json_cell(c: Column) -> Column:
    """JSON of a value, nulls kept; an empty text for null."""
    return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit(""))


def level_chain(*levels: Column) -> Column:
    """The levels of a category that are filled, in order."""
    return F.filter(F.array(*levels), lambda x: x.isNotNull() & (x != ""))


def largest_number(items: Column) -> Column:
    """The largest run of three or more digits or commas in any item of a list."""
    runs = F.flatten(F.transform(items, lambda x: F.coalesce(F.regexp_extract_all(x, F.lit(r"([\d,]{3,})"), F.lit(1)), F.array().cast("array<string>"))))
    return F.array_max(F.transform(runs, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")))


def short_duration_days(c: Column) -> Column:
    """Days of the first number with a unit; this reader knows neither hours nor the dual year."""
    unit, n = first_group(c, SHORT_DURATION, 2), F.regexp_extract(c, SHORT_DURATION, 1).try_cast("bigint")
    return n * F.coalesce(*[F.when(unit == u, PERIOD_DAYS[u]) for u in ("יום", "ימים", "שבוע", "שבועות", "חודש", "חודשים", "שנה", "שנים")])


def pair_key(a: Column, b: Column, sep: str = "|||") -> Column:
    """One key for an unordered pair."""
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def first_found(candidates: Sequence[Column]) -> Column:
    """The first list that isn't empty; an empty list if all are empty or null."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates], F.array().cast("array<string>"))


def chosen_numbers(found: Column, hint: Column, *, hint_wins: bool) -> Column:
    """The numbers read from a text, unless the file name's hint decides: it fills in where nothing was read, and where it
    isn't among those read it wins or loses as the source's reliability says."""
    found = F.coalesce(found, F.array().cast("array<string>"))
    hinted = F.when(hint.isNotNull() & (hint != ""), F.array(hint))
    lone = F.coalesce(hinted, found)
    if not hint_wins:
        return F.when(F.size(found) == 0, lone).otherwise(found)
    return F.when(hinted.isNotNull() & F.array_contains(found, hint), found).otherwise(lone)


def sections(*parts: tuple[str, Column]) -> Column:
    """A text of sections: a heading (empty for none), then the section's lines (a list; null and empty ones are left out)."""
    lines = [F.concat(F.array(F.lit(head)) if head else F.array().cast("array<string>"), F.filter(body, lambda x: x.isNotNull() & (x != ""))) for head, body in parts]
    return F.array_join(F.concat(*lines), "\n")

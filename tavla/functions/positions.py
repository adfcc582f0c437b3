"""Functions that need the places of matches: texts are split at the matches, whose lengths and those of the pieces give the places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tavla.functions import text as X

# The patterns and windows of title pages.
CLEAN_NUMBER = r"(?:נספח|תכנית)\s*(?:מספר|מס['׳]?)\s*[:\-]?\s*(\d{2,4})"
KEYWORD = "נספח|תכנית"
NUMBER_RUN = r"[\d/.]+"
LONE_NUMBER = r"^\d{2,4}$"
EDITION = r"מהדורה?\s{0,3}[:\-]?\s{0,3}(\d{2}[./]\d{4})|(\d{2}[./]\d{4})\s{0,3}מהדורה"
EDITION_WORD = "מהדורה"
TITLE_CHARS, NEAR_KEYWORD, NEAR_EDITION = 1500, 40, 80


def places(text: Column, pattern: str) -> Column:
    """array<struct<at int, word string>>: every match with its place, counted from zero."""
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    length = lambda items: F.aggregate(items, F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(words, lambda w, i: F.struct((length(F.slice(pieces, F.lit(1), i + 1)) + length(F.slice(words, F.lit(1), i))).alias("at"), w.alias("word")))


def nearest_number(text: Column, word: str, reach: int) -> Column:
    """The number closest to any mention of the word, within reach; of equally close ones that of the first mention, then the first.

    A number is a whole run of digits, slashes and points that is two to four digits, as it stands in the surroundings of the mention.
    """

    def near(m: Column, k: Column) -> Column:
        end = m["at"] + F.length(m["word"])
        lo = F.greatest(F.lit(0), m["at"] - reach)
        numbers = F.filter(places(F.substring(text, lo + 1, end + reach - lo), NUMBER_RUN), lambda n: n["word"].rlike(LONE_NUMBER))
        far = lambda n: F.least(F.abs(lo + n["at"] - m["at"]), F.abs(lo + n["at"] - end))
        return F.transform(numbers, lambda n: F.struct(far(n).alias("far"), k.alias("mention"), n["at"].alias("at"), n["word"].alias("number")))

    return F.array_min(F.flatten(F.transform(places(text, word), near)))["number"]


def title_number(text: Column, denied: Sequence[str] = ()) -> Column:
    """The number a title page names: next to its label, else near the word, else near the edition; denied ones and zero are none."""
    window = F.substring(text, 1, TITLE_CHARS)
    number = F.coalesce(X.first_group(window, CLEAN_NUMBER), nearest_number(window, KEYWORD, NEAR_KEYWORD), nearest_number(window, EDITION_WORD, NEAR_EDITION))
    bare = F.ltrim(number, F.lit("0"))
    return F.when((bare != "") & ~bare.isin(*denied) if denied else bare != "", number)


def title_edition(text: Column) -> Column:
    """The month of a title page's edition; null if it is none."""
    mark = X.first_group(F.substring(text, 1, TITLE_CHARS), EDITION, 1, 2)
    month, year = F.substring(mark, 1, 2).try_cast("int"), F.substring(mark, 4, 4).try_cast("int")
    return F.when(month.between(1, 12) & (year > 0), F.make_date(year, month, F.lit(1)))

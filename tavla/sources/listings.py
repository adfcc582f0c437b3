"""Parsers of publishers' listings: JSON bodies and HTML pages to rows. Each takes a column of bodies, so a whole archive is one job.

All give ``domain, title, appendix_numbers, download_url, marketing_start_date, marketing_end_date`` and what the shape adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavla.functions import text as X

FAMILIES = "IsSuccess boolean, FamilyPoliciesDetails array<struct<Policies: array<struct<Title: string, AttachmentNumber: string, PolicyTypeDesc: string, FilePath: string, StartValidity: string, EndValidity: string>>>>"
ARCHIVE = "err string, data array<struct<documentURL: string, policyHeaderForDisplay: string, policyHeader: string, tags: array<string>, policyIssueDate: string, policyEndDate: string>>"
FORMS = "status int, collection array<struct<formId: bigint, formName: string, typeDsc: string, saleDsc: string, fromDate: string, toDate: string>>"
ITEMS = "items array<struct<fileUrl: string, categoryName: string, subjectName: string, policyName: string, fromDate: string, endDate: string>>"
MEDIA = "Data array<struct<Department: array<struct<_name: string>>, umbracoFile: string, policyName: string, fromDate: string, ToDate: string>>"

#: Fixed value: the instant that stands for no date.
NO_DATE = "0001-01-01T00:00:00"


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _rows(title: Column, numbers: Column, url: Column, start: Column, end: Column, *more: Column) -> list[Column]:
    return [
        F.col("domain"), title.alias("title"), numbers.alias("appendix_numbers"), url.alias("download_url"),
        start.alias("marketing_start_date"), end.alias("marketing_end_date"), *more,
    ]


def families_json(df: DataFrame, body: str, base_url: str) -> DataFrame:
    """Families of policies; a failed response has none, a policy without a file is dropped."""
    b = df.withColumn("b", F.from_json(body, FAMILIES)).where("b.IsSuccess")
    p = b.select("domain", F.explode("b.FamilyPoliciesDetails").alias("f")).select("domain", F.explode("f.Policies").alias("p")).where("p.FilePath <> ''")
    number = X.strip(_some(F.col("p.AttachmentNumber")))
    return p.select(
        *_rows(
            X.strip(_some(F.col("p.Title"))), F.when(number != "", F.array(number)).otherwise(F.array().cast("array<string>")), F.concat(F.lit(base_url), F.col("p.FilePath")),
            X.iso_date(F.col("p.StartValidity"), unset=NO_DATE), X.iso_date(F.col("p.EndValidity"), unset=NO_DATE), X.strip(_some(F.col("p.PolicyTypeDesc"))).alias("kind"),
        )
    )


def archive_json(df: DataFrame, body: str, *, far_year: int = 2090) -> DataFrame:
    """A flat archive; an error has none, an entry without an address is dropped. Numbers come from title and tags."""
    b = df.withColumn("b", F.from_json(body, ARCHIVE)).where("b.err is null or b.err = '' or b.err = 'false' or b.err = '0'")
    p = b.select("domain", F.explode("b.data").alias("p")).where("p.documentURL <> ''")
    title = X.strip(_some(F.coalesce(X.filled(F.col("p.policyHeaderForDisplay")), F.col("p.policyHeader"))))
    text = F.concat_ws(" ", title, F.array_join(F.coalesce("p.tags", F.array().cast("array<string>")), " "))
    return p.select(
        *_rows(title, X.appendix_numbers(text), F.col("p.documentURL"), X.iso_date(F.col("p.policyIssueDate"), far_year=far_year), X.iso_date(F.col("p.policyEndDate"), far_year=far_year))
    )


def forms_json(df: DataFrame, body: str, url_template: str) -> DataFrame:
    """Forms by id; a status other than zero has none, a form without id is dropped. ``{form_id}`` of the template is filled in."""
    b = df.withColumn("b", F.from_json(body, FORMS)).where("b.status = 0")
    p = b.select("domain", F.explode("b.collection").alias("p")).where("p.formId is not null")
    title = X.strip(_some(F.col("p.formName")))
    url = F.replace(F.lit(url_template), F.lit("{form_id}"), F.col("p.formId").cast("string"))
    return p.select(
        *_rows(title, X.appendix_numbers(title), url, X.slashed_date(F.col("p.fromDate")), X.slashed_date(F.col("p.toDate")), _some(F.col("p.typeDsc")).alias("kind"), F.col("p.formId").alias("form_id"))
    )


def items_json(df: DataFrame, body: str, domains: DataFrame, base_url: str) -> DataFrame:
    """Items by category and subject; ``domains`` has category, subject (null: any) and domain. Items without file or domain are dropped."""
    b = df.select(F.explode(F.from_json(body, ITEMS)["items"]).alias("p")).where("p.fileUrl <> ''")
    known = domains.select(F.col("category").alias("__c"), F.col("subject").alias("__s"), "domain")
    p = b.join(known, (F.col("p.categoryName") == F.col("__c")) & (F.col("__s").isNull() | (F.col("p.subjectName") == F.col("__s"))))
    title = X.strip(_some(F.col("p.policyName")))
    department = F.concat_ws(" / ", _some(F.col("p.categoryName")), _some(F.col("p.subjectName")))
    return p.select(
        *_rows(title, X.appendix_numbers(title), F.concat(F.lit(base_url), F.col("p.fileUrl")), X.iso_date(F.col("p.fromDate")), X.iso_date(F.col("p.endDate")), department.alias("department_name"))
    )


def media_json(df: DataFrame, body: str, departments: dict[str, str], base_url: str) -> DataFrame:
    """Media files; the first department that is known gives the domain, an item without one or without a file name is dropped."""
    p = df.select(F.explode(F.from_json(body, MEDIA)["Data"]).alias("p"))
    known = F.create_map(*[F.lit(x) for kv in departments.items() for x in kv])
    names = F.transform(F.coalesce("p.Department", F.array().cast("array<struct<_name: string>>")), lambda d: d["_name"])
    first = F.get(F.filter(names, lambda n: F.element_at(known, n).isNotNull()), 0)
    path = F.regexp_replace(_some(F.col("p.umbracoFile")), "^(.*?)/media/", "$1")
    folder = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")
    name = F.when(F.instr(path, "/") > 0, F.expr("substr(__path, instr(__path, '/') + 1)")).otherwise(F.col("__path"))
    rows = p.withColumn("__path", path).withColumn("department_name", first).withColumn("domain", F.element_at(known, F.col("department_name"))).withColumn("file_name", name)
    return rows.where("domain is not null and file_name <> ''").select(
        *_rows(
            _some(F.col("p.policyName")), F.array().cast("array<string>"), F.concat(F.lit(base_url), F.col("__path")), X.iso_date(F.col("p.fromDate")), X.iso_date(F.col("p.ToDate")),
            F.col("department_name"), folder.alias("media_folder_id"), F.col("file_name"),
        )
    )


ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""


def _plain(html: Column) -> Column:
    """Text of a fragment: tags out, common entities read, blanks single."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return X.strip(F.regexp_replace(text, r"(?U)\s+", " "))


def table_html(df: DataFrame, html: str, table_id: str = "policies") -> DataFrame:
    """Rows of the table with the given id: the first cell's link to a PDF, the second's number, optional dates in the fourth and fifth."""
    table = F.regexp_extract(html, rf"""(?is)<table\b[^>]*id\s*=\s*["']{table_id}["'][^>]*>(.*?)</table>""", 1)
    row = df.select("domain", F.explode(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = row.select("domain", F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)).alias("c")).where("size(c) >= 2")
    url = F.regexp_extract(F.get("c", 0), ANCHOR, 1)
    number = _plain(F.get("c", 1))
    return cells.where(F.lower(url).endswith(".pdf")).select(
        *_rows(
            _plain(F.regexp_extract(F.get("c", 0), ANCHOR, 2)), F.when(number != "", F.array(number)).otherwise(F.array().cast("array<string>")), url,
            X.dotted_date(_plain(F.get("c", 3))), X.dotted_date(_plain(F.get("c", 4))),
        )
    )


def page_count(html: Column, field_id: str = "HiddFieldNumOfLinks") -> Column:
    """The value of a hidden field as a page count; one at least, and where it is missing or no number."""
    tag = F.regexp_extract(html, rf"""(?is)<[^>]*\bid\s*=\s*["']{field_id}["'][^>]*>""", 0)
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(tag, r"""(?i)value\s*=\s*["']\s*(-?\d+)\s*["']""", 1).try_cast("int"), F.lit(1)))


def anchors_html(df: DataFrame, page: str, html: str, doubled: str = "//media", single: str = "/media") -> DataFrame:
    """Links to PDFs of a page, each address once per page, the first title; dates and numbers come from the title."""
    links = df.select("domain", page, F.posexplode(F.arrays_zip(X.groups(F.col(html), ANCHOR, 1).alias("u"), X.groups(F.col(html), ANCHOR, 2).alias("t"))).alias("pos", "a"))
    # Only the path: the two slashes after the scheme stay.
    url = F.regexp_replace("a.u", rf"(?<=[^:]){doubled}", single)
    rows = links.where(F.lower("a.u").endswith(".pdf")).select("domain", page, url.alias("url"), "pos", _plain(F.col("a.t")).alias("title"))
    once = rows.groupBy("domain", page, "url").agg(F.min_by("title", "pos").alias("title"))
    start, end = X.title_dates(F.col("title"))
    return once.select(*_rows(F.col("title"), X.appendix_numbers(F.col("title")), F.col("url"), start, end, F.col(page)))


def titled_html(df: DataFrame, page: str, html: str, media: str = r"/media/([^/]+)/") -> DataFrame:
    """Media links of a page: those with a title first, then bare addresses; the first title wins. Addresses without a media id are dropped."""
    titled = df.select("domain", page, F.posexplode(X.groups(F.col(html), r"(?is)(<a\b[^>]*>)")).alias("pos", "tag")).select(
        "domain", page, "pos", F.lit(0).alias("rank"), F.regexp_extract("tag", r"""(?i)href\s*=\s*["']([^"']+)""", 1).alias("url"), F.regexp_extract("tag", r"""(?i)title\s*=\s*["']([^"']+)""", 1).alias("title")
    ).where("title <> ''")
    bare = df.select("domain", page, F.posexplode(X.groups(F.col(html), r"""(?i)href\s*=\s*["']([^"']+)""")).alias("pos", "url")).select("domain", page, "pos", F.lit(1).alias("rank"), "url", F.lit("").alias("title"))
    every = titled.unionByName(bare).withColumn("media_id", F.regexp_extract("url", media, 1)).where("media_id <> '' and lower(url) like '%.pdf'")
    once = every.groupBy("domain", page, "url", "media_id").agg(F.min_by("title", F.struct("rank", "pos")).alias("title"))
    title = _plain(F.col("title"))
    none = F.lit(None).cast("date")
    return once.select(*_rows(title, X.appendix_numbers(title), F.col("url"), none, none, F.col(page), F.col("media_id")))


def cell_rows(df: DataFrame, cells: str, link: str) -> DataFrame:
    """Rows of rendered tables (array of cells and a link): four cells, a link and a filled number cell are needed."""
    fine = df.where((F.size(cells) >= 4) & (F.col(link) != "") & (X.strip(F.get(cells, 1)) != ""))
    start = X.edition_date(F.get(cells, 2))
    return fine.select(*_rows(X.strip(F.get(cells, 0)), F.array(X.strip(F.get(cells, 1))), F.col(link), start, F.lit(None).cast("date"), X.strip(F.get(cells, 2)).alias("edition")))


def without_titles(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Rows whose title holds none of the excluded substrings and that name a number."""
    return df.where(~F.exists(F.array(*[F.lit(x) for x in excluded]), lambda x: F.contains(F.col("title"), x)) & (F.size("appendix_numbers") > 0))

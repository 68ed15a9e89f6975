"""Dates of pages and documents: what a page's metadata says, and which of a document's dates counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.columns import RECENCY_KINDS, days, first_date

#: Names under which pages state their dates, and the labels before dates in texts.
MODIFIED, PUBLISHED = ("datemodified", "article:modified_time"), ("datepublished", "article:published_time")
LABELS = r"(?i)(last updated(?: on)?:?|publishing date:?|published(?: on)?:?|date:|datetime=\")\s*"


def page_dates(html: Column) -> Column:
    """(modified, published) as a page's `time` and `meta` tags state them, else its JSON-LD; the first of each counts."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<(?:time|meta)\b[^>]*>)"), F.lit(1))
    attr = lambda t, name: F.nullif(F.regexp_extract(t, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1), F.lit(""))

    def read(t: Column) -> Column:
        role = F.lower(F.coalesce(attr(t, "itemprop"), attr(t, "property"), attr(t, "name"), F.lit("")))
        return F.struct(role.alias("role"), F.coalesce(attr(t, "datetime"), attr(t, "content")).alias("v"))

    found = F.transform(tags, read)
    first = lambda roles: F.get(F.filter(found, lambda x: x["role"].isin(*roles) & x["v"].isNotNull()), 0)["v"]
    ld = lambda key: F.nullif(F.regexp_extract(html, rf'"{key}"\s*:\s*"([^"]{{10,40}})"', 1), F.lit(""))
    return F.struct(F.coalesce(first(MODIFIED), ld("dateModified")).alias("modified"), F.coalesce(first(PUBLISHED), ld("datePublished")).alias("published"))


def labelled(text: Column) -> Column:
    """(kind, days) of the first label in a text with a date within 40 characters after it; null if there is none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LABELS + r"(?=([\s\S]{0,40}))"), F.lit(0))
    after = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LABELS + r"(?=([\s\S]{0,40}))"), F.lit(2))
    kind = lambda p: F.when(F.lower(p).contains("updated"), "modified").otherwise("published")
    each = F.transform(F.arrays_zip(parts.alias("p"), after.alias("a")), lambda x: F.struct(kind(x["p"]).alias("kind"), first_date(x["a"]).alias("days")))
    return F.get(F.filter(each, lambda x: x["days"].isNotNull()), 0)


def candidate(kind: Column | str, text: Column) -> Column:
    """A candidate of a document's date: its kind, and the days of the first date in a text."""
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), first_date(text).alias("days"))


def created_kind(source: Column, status: Column, uploads: str) -> Column:
    """What a creation date is: an upload's for sources that start with `uploads`, the ingestion's if the status says so, else the publication's."""
    return F.when(source.startswith(uploads), "upload_metadata").when(status.contains("ingestion"), "ingested").otherwise("published")


def document_date(candidates: Column, today: Column) -> Column:
    """Of (kind, days) candidates in their order: the newest that says how recent a document is, not after tomorrow, the last on ties;
    else the first of any other kind."""
    known = F.filter(candidates, lambda c: c["days"].isNotNull() & (c["days"] <= today + 1))
    placed = F.transform(known, lambda c, i: F.struct(c["days"].alias("days"), i.alias("i"), c["kind"].alias("kind")))
    recent = F.array_max(F.filter(placed, lambda c: c["kind"].isin(*RECENCY_KINDS)))
    other = F.get(F.filter(placed, lambda c: ~c["kind"].isin(*RECENCY_KINDS)), 0)
    best = F.coalesce(recent, other)
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), best["days"].alias("days")))


def asks_currentness(kind: Column, versioned: Column) -> Column:
    """Whether a question's answer depends on time."""
    return F.coalesce((kind != "timeless") | (versioned >= 0.5), F.lit(False))


def url_date_kind(kind: Column) -> Column:
    """The kind of a date that another document of the same URL lends."""
    return F.when(kind.isin("published", "observed"), kind).otherwise("modified")


def relevance_key(top2: Column) -> Column:
    """The band of relevance: hundredths, -1 without a value."""
    return F.coalesce(F.round(top2 * 100).cast("int"), F.lit(-1))


def iso_day(text: Column) -> Column:
    return days(F.left(text, F.lit(10)))

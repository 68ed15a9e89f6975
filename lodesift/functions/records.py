"""Rows of listings, which are JSON, as documents: identity, title, address, text, and the scope that the text has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a listing's row has its identity, title and address; the first that isn't empty counts.
IDENTITY = ("id", "slug", "fullName", "reportId", "contractId", "assetId", "githubUsername", "url", "name", "code")
TITLE = ("title", "name", "displayName", "fullName", "slug", "contractId", "code")
ADDRESS = ("url", "reportUrl", "rawUrl", "docs", "homepage", "sourceUrl", "evidenceUrl", "websiteUrl", "website", "externalUrl", "repository")
#: Bodies of a record and the scope that each gives; prose fields of a record without one; fields of a site's record.
BODIES = (("body", "stored_editorial_body"), ("application", "stored_application_body"), ("content", "stored_source_body"))
PROSE = ("title", "summary", "long_summary", "description", "body_preview")
SITE_TITLES, SITE_TEXTS = ("title", "parent.title", "hierarchy.lvl1", "hierarchy.lvl0"), ("content", "body", "items", "description", "title", "hierarchy")
#: Scopes that show only a part of a document.
PARTIAL = ("structured_record", "structured_record_with_detail", "transcript_excerpt", "ai_summary", "indexed_sections_or_metadata", "catalog_metadata")


def value(row: Column, key: str) -> Column:
    """A text or number under a key; null for nothing, empty texts, objects and lists."""
    found = F.get_json_object(row, f"$.{key}")
    return F.when((found != "") & ~found.rlike(r"^[{\[]"), found)


def first_value(row: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[value(row, k) for k in keys])


def document(source: Column, row: Column, request_url: Column, passage: Column) -> Column:
    """A listing's row as a document, whose id is null where the row has no identity; a passage's text is its content."""
    ident = first_value(row, IDENTITY)
    return F.struct(
        F.concat(source, F.lit(":"), ident).alias("id"),
        F.coalesce(first_value(row, TITLE), ident).alias("title"),
        F.coalesce(first_value(row, ADDRESS), request_url).alias("url"),
        F.when(passage, F.get_json_object(row, "$.content")).otherwise(row).alias("text"),
        F.when(passage, "research_chunk").otherwise("structured_record").alias("scope"),
    )


def date_hint(row: Column, pointers: dict[str, tuple[str, ...]]) -> Column:
    """The newest text under the paths declared for each kind of date."""
    newest = lambda paths: F.array_max(F.array(*[value(row, p) for p in paths]))
    return F.struct(*[newest(paths).alias(kind) for kind, paths in pointers.items()])


def record_id(row: Column, collection: Column) -> Column:
    """The identity of a collection's record: its slug, or its number or text."""
    by_slug = collection.isin("directory", "scf")
    return F.when(by_slug, value(row, "slug")).when(collection == "av_passages", F.coalesce(value(row, "av_id"), value(row, "id"))).otherwise(value(row, "id"))


def record_url(row: Column, collection: Column) -> Column:
    """The address of a collection's record; a directory's may be the first of a list, which may itself be text."""
    listed = F.coalesce(F.get_json_object(row, "$.links.website[0]"), F.get_json_object(F.get_json_object(row, "$.website"), "$[0]"), value(row, "website"))
    return F.coalesce(value(row, "url"), value(row, "submission_url"), F.when(collection == "directory", listed), F.lit(""))


def record_text(row: Column, collection: Column) -> Column:
    """(text, scope, whole): a stored body, else an excerpt, else the record itself, else its prose fields, each once."""
    prose = F.filter(F.array(*[value(row, k) for k in PROSE]), lambda x: x.isNotNull())
    made = (value(row, "summary").isNotNull()) | (value(row, "long_summary").isNotNull())
    told = lambda text, scope, whole: F.struct(text.alias("text"), F.lit(scope).alias("scope") if isinstance(scope, str) else scope.alias("scope"), F.lit(whole).alias("whole"))
    found = None
    for key, scope in BODIES:
        found = F.when(value(row, key).isNotNull(), told(value(row, key), scope, True)) if found is None else found.when(value(row, key).isNotNull(), told(value(row, key), scope, True))
    found = found.when(value(row, "chunk_text").isNotNull(), told(value(row, "chunk_text"), "transcript_excerpt", False))
    found = found.when(collection.isin("directory", "jobs"), told(row, F.when(collection == "jobs", "job_catalog_metadata").otherwise("project_metadata"), False))
    text = F.when(F.size(prose) > 0, F.array_join(F.array_distinct(prose), "\n\n")).otherwise(row)
    return found.otherwise(told(text, F.when(made, "ai_summary").otherwise("catalog_metadata"), False))


def needs_detail(collection: Column, complete: tuple[str, ...] = ("av_passages", "jobs", "directory")) -> Column:
    """Whether a collection's search shows less than its detail does."""
    return ~collection.isin(*complete)


def overridden(discovery: Column, detail: Column) -> Column:
    """The fields of a record as a map, those of its detail over those of its discovery."""
    kind = "map<string,string>"
    first, more = F.from_json(F.coalesce(discovery, F.lit("{}")), kind), F.from_json(F.coalesce(detail, F.lit("{}")), kind)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(more, k)), more)


def safe_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def detailed(text: Column, scope: Column, slug: Column, detail: Column) -> Column:
    """(text, scope) after the detail of a row is read: it counts where there is one and the slug is a safe part of a path."""
    use = safe_slug(slug) & detail.isNotNull()
    return F.struct(F.when(use, detail).otherwise(text).alias("text"), F.when(use, "structured_record_with_detail").otherwise(scope).alias("scope"))


def cell(text: Column) -> Column:
    """A value as a cell of a roster."""
    return F.coalesce(F.translate(text, "\n|", "  "), F.lit(""))


def catalog_score(terms: Column, name: Column, description: Column, common: tuple[str, ...] = ()) -> Column:
    """How well terms meet a catalog's entry: 3 for each in its name, else 1 for each in its description; plurals count as singular."""
    known = F.filter(terms, lambda t: ~t.isin(*common)) if common else terms
    one = lambda t: F.when((F.octet_length(t) > 4) & t.endswith("s"), F.expr("1")).otherwise(F.lit(0))
    stem = lambda t: F.left(t, F.char_length(t) - one(t))
    points = lambda t: F.when(F.contains(F.lower(name), stem(t)), 3).when(F.contains(F.lower(description), stem(t)), 1).otherwise(0)
    return F.aggregate(known, F.lit(0), lambda a, t: a + points(t))


_ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), _ADDRESS, i)


def canonical_page(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL is a page of these hosts: HTTPS, no user, no port, no encoded separator in its path."""
    path = F.lower(_part(url, 5))
    fine = (F.lower(_part(url, 1)) == "https") & F.lower(_part(url, 3)).isin(*hosts) & (_part(url, 2) == "") & _part(url, 4).isin("", "443")
    return F.coalesce(fine & ~path.rlike(r"\\|%2f|%5c"), F.lit(False))


def site_url(raw: Column, host: str, spanish: Column) -> Column:
    """The page of a site's record, without query and fragment; null if it isn't a page of the site. A Spanish index has its pages under /es."""
    whole = F.when(raw.rlike("^/(?!/)"), F.concat(F.lit(f"https://{host}"), raw)).otherwise(raw)
    path = F.when(_part(whole, 5) == "", "/").otherwise(_part(whole, 5))
    path = F.when(spanish & ~path.rlike("^/es(?:/|$)"), F.concat(F.lit("/es"), path)).otherwise(path)
    return F.when(canonical_page(whole, (host,)), F.concat(F.lit(f"https://{host}"), path))


def docs_url(path: Column, site: str) -> Column:
    """The page of a section's path on a site: folders stand for their index; null for paths that leave the site."""
    bare = F.regexp_replace(F.trim(path), "^/+", "")
    page = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), bare), "/+$", ""), "/index$", "")
    ok = (bare != "") & ~bare.rlike(r"://|[?#]|\\|%2[fF]|%5[cC]")
    return F.when(ok, F.concat(F.lit(f"https://{site}"), F.when(page == "", "/").otherwise(page)))


def site_title(row: Column, untitled: str = "Untitled record") -> Column:
    """The title of a site's record; an empty one counts."""
    return F.coalesce(*[F.get_json_object(row, f"$.{k}") for k in SITE_TITLES], F.lit(untitled))


def site_text(row: Column) -> Column:
    """The text of a site's record: its fields in order, lists and objects as JSON."""
    return F.concat_ws("\n\n", *[F.get_json_object(row, f"$.{k}") for k in SITE_TEXTS])


def index_flags(name: Column) -> Column:
    """What an index's name says of it: production, spanish, replica."""
    low = F.lower(name)
    return F.struct(low.rlike(r"prod").alias("production"), low.rlike(r"(?:^|[_-])es(?:[_-]|$)|spanish").alias("spanish"), low.rlike(r"_(?:asc|desc)$").alias("replica"))


def normalized_url(url: Column) -> Column:
    """A URL as the identity of a page: HTTPS on its own port, no user, a host's name and no number; without its fragment, else null."""
    named = ~_part(url, 3).rlike(r"^\d+(?:\.\d+){3}$|^\[") & (_part(url, 3) != "")
    ok = (F.lower(_part(url, 1)) == "https") & (_part(url, 2) == "") & _part(url, 4).isin("", "443") & named
    return F.when(ok, F.concat(F.lit("https://"), F.lower(_part(url, 3)), F.when(_part(url, 5) == "", "/").otherwise(_part(url, 5)), _part(url, 6)))


def original_id(url: Column) -> Column:
    return F.left(F.sha2(url.cast("binary"), 256), F.lit(16))


def original_eligible(scope: Column, production: Column, requested: Column, url: Column, api_host: Column) -> Column:
    """Whether the page behind a row may be read: the row shows a part, isn't a draft, wasn't read yet, and its page isn't the API's own."""
    page = normalized_url(url)
    host = F.regexp_extract(page, "^https://([^/]*)", 1)
    return F.coalesce(scope.isin(*PARTIAL) & F.coalesce(production, F.lit(True)) & ~F.coalesce(requested, F.lit(False)) & page.isNotNull() & ~host.eqNullSafe(F.lower(api_host)), F.lit(False))


def content_scope(provenance: Column) -> Column:
    """What a document's text is, from its provenance: made-up rows are always `synthetic_record`."""
    return F.when(F.get_json_object(provenance, "$.row.synthetic") == "true", "synthetic_record").otherwise(F.coalesce(F.get_json_object(provenance, "$.content_scope"), F.get_json_object(provenance, "$.content_kind"), F.lit("unknown")))


def same_host_move(url: Column, location: Column) -> Column:
    """Where a redirect leads if it stays on the host by HTTPS, else null."""
    host = F.lower(_part(url, 3))
    whole = F.when(location.rlike("^/(?!/)"), F.concat(F.lit("https://"), host, location)).otherwise(location)
    return F.when((F.lower(_part(whole, 1)) == "https") & (F.lower(_part(whole, 3)) == host) & (_part(whole, 2) == "") & _part(whole, 4).isin("", "443"), whole)

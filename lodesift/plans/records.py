"""Queries on rows of listings as documents, on pages, dates and replies.

The driver's tables stand in for listings: their rows are written as JSON, as a service would send them, and read back by the
operators. Where a rule depends on odd forms, `cases` deals these over the rows of a table by key, with what is expected of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.functions import dates, records, replies, texts
from lodesift.operators import pages as P
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def cases(key: str, values: list, kind: str = "string") -> Column:
    """A column that takes `values` in turn by `key`."""
    at, found = F.pmod(F.col(key), F.lit(len(values))), F.lit(None).cast(kind)
    for i, v in enumerate(values):
        found = F.when(at == i, F.lit(v).cast(kind)).otherwise(found)
    return found


def cases_sql(key: str, values: list) -> str:
    """`cases` in SQL."""
    arms = " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _if(condition: str, value: str) -> Column:
    return F.expr(f"CASE WHEN {condition} THEN {value} END")


@_r.add(
    "SELECT s_suppkey, 'listing:' || CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 's-' || s_suppkey ELSE s_name END AS id, s_name AS title, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 'https://report.example/' || s_suppkey ELSE 'https://api.example/list' END AS url, CASE WHEN s_suppkey % 5 = 0 THEN 'about ' || s_name END AS passage, "
    "CASE WHEN s_suppkey % 5 = 0 THEN 'research_chunk' ELSE 'structured_record' END AS scope FROM supplier"
)
def record_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Listing rows as documents: identity, title and address from the first field that isn't empty."""
    row = _json(id=_if("s_suppkey % 3 = 0", "s_suppkey"), slug=F.expr("CASE WHEN s_suppkey % 3 = 1 THEN 's-' || s_suppkey ELSE '' END"), name=F.col("s_name"), reportUrl=_if("s_suppkey % 2 = 0", "'https://report.example/' || s_suppkey"), content=F.expr("'about ' || s_name"))
    found = table(spark, folder, "supplier").select("s_suppkey", row.alias("row"))
    found = found.select("s_suppkey", records.document(F.lit("listing"), F.col("row"), F.lit("https://api.example/list"), F.col("s_suppkey") % 5 == 0).alias("d"))
    return found.select("s_suppkey", "d.id", "d.title", "d.url", F.when(F.col("d.scope") == "research_chunk", F.col("d.text")).alias("passage"), "d.scope")


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@_r.add(f"SELECT o_orderkey, greatest({_DAY}, CASE WHEN o_orderkey % 2 = 0 THEN '1996-06-01' END) AS modified, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} END AS observed FROM orders")
def record_date_hints(spark: SparkSession, folder: str) -> DataFrame:
    """The newest date that a row states under the paths of each kind."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = _json(updatedAt=day, checkedAt=F.when(F.col("o_orderkey") % 3 == 0, day), meta=F.struct(_if("o_orderkey % 2 = 0", "'1996-06-01'").alias("changedAt")))
    hint = records.date_hint(F.col("row"), {"modified": ("updatedAt", "meta.changedAt"), "observed": ("checkedAt", "meta.seenAt")})
    return table(spark, folder, "orders").select("o_orderkey", row.alias("row")).select("o_orderkey", hint.alias("h")).select("o_orderkey", "h.modified", "h.observed")


@_r.add("SELECT o_custkey, o_orderpriority, arg_min(o_totalprice, o_orderkey) AS first_total, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS artifacts, count(*) AS n_observed FROM orders GROUP BY 1, 2")
def merged_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one identity as one, with the artifacts of all."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus")
    found = P.merged(rows, ("o_custkey",), "o_orderpriority", "o_orderkey", "o_orderstatus")
    return found.select("o_custkey", "o_orderpriority", F.col("first.o_totalprice").alias("first_total"), F.array_join("artifacts", ",").alias("artifacts"), "n_observed")


@_r.add("SELECT o_orderkey, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) THEN 'admitted' ELSE 'omitted' END AS disposition FROM orders")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Which row of an identity is admitted and which are reported and omitted."""
    return P.admitted_ids(table(spark, folder, "orders"), ("o_custkey",), "o_orderpriority", "o_orderkey").select("o_orderkey", "disposition")


@_r.add("SELECT s_nationkey, 'Complete ' || s_nationkey || ' registry: ' || count(*) || ' rows' AS title, 's_suppkey | s_name' || chr(10) || string_agg(s_suppkey || ' | ' || s_name, chr(10) ORDER BY s_suppkey) AS text, count(*) AS n_rows FROM supplier GROUP BY 1")
def roster_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation's suppliers as one document."""
    return P.roster(table(spark, folder, "supplier"), "s_nationkey", "s_suppkey", ("s_suppkey", "s_name"))


_COLLECTIONS = ["articles", "directory", "jobs", "av_passages"]


def _records(spark: SparkSession, folder: str) -> DataFrame:
    row = _json(
        id=F.col("p_partkey"), slug=F.expr("'part-' || p_partkey"), av_id=_if("p_partkey % 8 = 3", "p_partkey + 1000"), title=F.col("p_name"), description=F.col("p_name"), summary=_if("p_partkey % 3 = 0", "'sum ' || p_type"),
        body=_if("p_partkey % 7 = 0", "'body ' || p_type"), chunk_text=_if("p_partkey % 5 = 0", "'chunk ' || p_brand"), submission_url=_if("p_partkey % 6 = 0", "'https://s.example/' || p_partkey"),
        website=_if("p_partkey % 16 = 1", "'[\"https://w.example/\"]'"),
    )
    return table(spark, folder, "part").select("p_partkey", cases("p_partkey", _COLLECTIONS).alias("collection"), row.alias("row"))


@_r.add(
    f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'body ' || p_type WHEN p_partkey % 5 = 0 THEN 'chunk ' || p_brand WHEN p_partkey % 4 IN (1, 2) THEN NULL WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || chr(10) || 'sum ' || p_type ELSE p_name END AS text, "
    "CASE WHEN p_partkey % 7 = 0 THEN 'stored_editorial_body' WHEN p_partkey % 5 = 0 THEN 'transcript_excerpt' WHEN p_partkey % 4 = 1 THEN 'project_metadata' WHEN p_partkey % 4 = 2 THEN 'job_catalog_metadata' WHEN p_partkey % 3 = 0 THEN 'ai_summary' ELSE 'catalog_metadata' END AS scope, "
    "p_partkey % 7 = 0 AS whole, p_partkey % 4 = 0 AS needs_detail FROM part"
)
def record_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of a collection's record and its scope; a record shown as itself has its JSON, left out here."""
    found = _records(spark, folder).select("p_partkey", records.record_text(F.col("row"), F.col("collection")).alias("t"), records.needs_detail(F.col("collection")).alias("needs_detail"))
    own = F.col("t.scope").isin("project_metadata", "job_catalog_metadata")
    return found.select("p_partkey", F.when(~own, F.col("t.text")).alias("text"), "t.scope", "t.whole", "needs_detail")


@_r.add(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'part-' || p_partkey WHEN 3 THEN CAST(CASE WHEN p_partkey % 8 = 3 THEN p_partkey + 1000 ELSE p_partkey END AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS id, "
    "CASE WHEN p_partkey % 6 = 0 THEN 'https://s.example/' || p_partkey WHEN p_partkey % 16 = 1 THEN 'https://w.example/' ELSE '' END AS url FROM part"
)
def record_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Identity and address of a collection's record."""
    c, row = F.col("collection"), F.col("row")
    return _records(spark, folder).select("p_partkey", records.record_id(row, c).alias("id"), records.record_url(row, c).alias("url"))


@_r.add("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind FROM part")
def detail_override(spark: SparkSession, folder: str) -> DataFrame:
    """A record's fields, those of its detail over those that the search gave."""
    first, more = _json(title=F.col("p_name"), brand=F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, _json(title=F.upper("p_name"), kind=F.col("p_type")))
    found = table(spark, folder, "part").select("p_partkey", records.overridden(first, more).alias("m"))
    return found.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("title", "brand", "kind")])


_SITE = (
    "WITH a AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'record:' || o_orderkey ELSE 'https://site.example' || CASE WHEN o_orderstatus = 'P' THEN '/es' ELSE '' END || '/p/' || o_custkey % 50 END AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'Untitled record' ELSE o_orderpriority END AS t FROM orders), "
    "g AS (SELECT o_orderstatus, page, min(o_orderkey) AS f, arg_min(t, o_orderkey) AS title, string_agg('c' || o_orderkey || chr(10) || chr(10) || '[\"i\",\"j\"]', chr(10) || chr(10) ORDER BY o_orderkey) AS text, count(*) AS n, bool_or(o_orderkey % 10 = 0) AS holds FROM a GROUP BY 1, 2) "
)


@_r.add(_SITE + "SELECT * FROM (SELECT o_orderstatus, page, title, text, n, holds, row_number() OVER (PARTITION BY o_orderstatus ORDER BY holds DESC, f) AS place FROM g) WHERE place <= 40")
def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a site's index as pages: grouped by address, pages that hold a term first."""
    raw = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'https://elsewhere.example/x' WHEN o_orderkey % 2 = 0 THEN '/p/' || o_custkey % 50 || '?q=' || o_orderkey ELSE 'https://site.example/p/' || o_custkey % 50 || '#a' END")
    row = _json(content=F.expr("'c' || o_orderkey"), items=F.array(F.lit("i"), F.lit("j")), hierarchy=F.when(F.col("o_orderkey") % 3 != 0, F.lit(None).cast("string")), parent=F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.col("o_orderpriority").alias("title"))))
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", records.site_url(raw, "site.example", F.col("o_orderstatus") == "P").alias("page"), row.alias("row"), (F.col("o_orderkey") % 10 == 0).alias("has"))
    rows = rows.withColumn("page", F.coalesce("page", F.concat(F.lit("record:"), F.col("o_orderkey").cast("string")))).withColumn("title", records.site_title(F.col("row"))).withColumn("text", records.site_text(F.col("row")))
    found = P.grouped_pages(rows, "o_orderstatus", "page", "o_orderkey", "title", "text", "has", 40)
    return found.withColumn("place", F.col("place").cast("bigint"))


_TERMS = ("the-and wh re-was 42", ["the and", "the", "and", "re was", "was", "42"])
_NORM = r"' ' || regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
_SECTIONS = "s AS (SELECT doc_id, lang, source, split_part(coalesce(text, ''), chr(10), 1) AS title, " + _NORM.format("split_part(coalesce(text, ''), chr(10), 1) || ' ' || lang || '/' || doc_id || ' ' || coalesce(text, '')") + " AS h, text FROM documents)"
_HOLDS = "(" + " OR ".join(f"contains(h, ' {t}')" for t in _TERMS[1]) + ")"


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    title, path = C.title_of(F.col("text")), F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string"))
    # The terms are one constant for the query, so they are folded and not computed by row.
    holds = texts.mentions(texts.section_terms(F.lit(_TERMS[0])), title, path, F.col("text"))
    return docs.select("doc_id", "lang", "source", title.alias("title"), holds.alias("holds"), "text")


@_r.add(f"WITH {_SECTIONS} SELECT doc_id, {_HOLDS} AS holds FROM s")
def section_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Sections that hold a term of the query at the start of a word."""
    return _sections(spark, folder).select("doc_id", "holds")


@_r.add(f"WITH {_SECTIONS}, g AS (SELECT lang, 'https://docs.example/' || source AS page, min(doc_id) AS f, arg_min(title, doc_id) AS title, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text, count(*) AS n, bool_or({_HOLDS}) AS holds FROM s GROUP BY 1, 2) SELECT * FROM (SELECT lang, page, title, text, n, holds, row_number() OVER (PARTITION BY lang ORDER BY holds DESC, f) AS place FROM g) WHERE place <= 12")
def section_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sections as pages of their site, those with a term first."""
    rows = _sections(spark, folder).withColumn("page", records.docs_url(F.concat(F.lit("/"), F.col("source"), F.lit("/index")), "docs.example"))
    return P.grouped_pages(rows, "lang", "page", "doc_id", "title", "text", "holds", 12).withColumn("place", F.col("place").cast("bigint"))


@_r.add(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'modified' WHEN o_orderkey % 5 = 1 THEN 'published' WHEN o_orderkey % 5 = 2 THEN 'event' ELSE NULL END AS kind, "
    "CASE WHEN o_orderkey % 5 = 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 WHEN o_orderkey % 5 IN (1, 2) THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS days FROM orders"
)
def document_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The date that counts among a document's candidates: the newest that says how recent it is, never one in the future."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    later = F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")
    made = F.array(
        dates.candidate("published", F.when(k.isin(0, 1), day)), dates.candidate("modified", F.when(k == 0, later)), dates.candidate("event", F.when(k == 2, day)),
        dates.candidate("ingested", F.when(k == 2, later)), dates.candidate("modified", F.when(k == 1, F.lit("2080-01-01"))), dates.candidate("published", F.when(k == 3, F.lit("2090-01-01"))),
    )
    found = table(spark, folder, "orders").select("o_orderkey", dates.document_date(made, F.lit(20_000)).alias("d"))
    return found.select("o_orderkey", "d.kind", F.col("d.days").cast("bigint").alias("days"))


_DATED = "CASE WHEN o_orderkey % 3 = 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS days, CASE o_orderkey % 2 WHEN 0 THEN 'published' ELSE 'event' END AS kind, 'https://u.example/' || o_custkey % 20 AS url, o_orderstatus, o_orderkey"


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    days = F.when(F.col("o_orderkey") % 3 == 0, F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint"))
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("https://u.example/"), (F.col("o_custkey") % 20).cast("string")).alias("url"), days.alias("days"), F.expr("CASE o_orderkey % 2 WHEN 0 THEN 'published' ELSE 'event' END").alias("kind"))


@_r.add(f"WITH a AS (SELECT {_DATED} FROM orders), b AS (SELECT o_orderstatus, url, max(days) AS d, arg_max(kind, (days, -o_orderkey)) FILTER (days IS NOT NULL) AS k FROM a GROUP BY 1, 2) SELECT o_orderkey, coalesce(a.days, b.d) AS days, CASE WHEN a.days IS NOT NULL THEN a.kind WHEN b.d IS NULL THEN NULL WHEN b.k IN ('published', 'observed') THEN b.k ELSE 'modified' END AS kind FROM a LEFT JOIN b USING (o_orderstatus, url)")
def lent_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Undated documents with the newest date of their URL."""
    return P.lent_dates(_dated(spark, folder), "o_orderstatus", "o_orderkey").select("o_orderkey", "days", "kind")


@_r.add(f"SELECT * FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS turn FROM (SELECT {_DATED} FROM orders) WHERE days IS NULL) WHERE turn <= 24")
def page_date_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The first undated pages of each search, whose dates are read."""
    return P.date_targets(_dated(spark, folder), "o_orderstatus", "o_orderkey", ("u.example",)).select("o_orderkey", F.col("turn").cast("bigint").alias("turn"))


@_r.add("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE CAST(floor((CASE s_suppkey % 3 WHEN 0 THEN 40 ELSE 50 END * 3600 + 60) / 3600) AS BIGINT) END AS age_hours, CASE s_suppkey % 3 WHEN 1 THEN 'stale' WHEN 2 THEN 'missing' END AS report FROM supplier")
def index_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Indexes that the inventory lacks or that are older than two days."""
    names = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    built = F.lit(1_770_000_000) - F.expr("CASE s_suppkey % 3 WHEN 0 THEN 40 ELSE 50 END") * 3600 - 60
    inventory = table(spark, folder, "supplier").where("s_suppkey % 3 <> 2").select(F.col("s_name").alias("name"), built.alias("built"))
    return P.freshness(names, inventory, "name", "built", F.lit(1_770_000_000)).select("s_suppkey", "age_hours", "report")


@_r.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'upstream' ELSE 'search_limit' END AS stage, CASE WHEN event_id % 2 = 0 THEN 'slow' ELSE 'lexical' END AS message, event_id % 9 AS matched FROM events WHERE event_id % 3 < 2")
def upstream_notices(spark: SparkSession, folder: str) -> DataFrame:
    """What a reply says of the service beside its rows, and the count of what it matched."""
    body = _json(notice=_if("event_id % 6 IN (0, 4)", "'slow'"), degraded=_if("event_id % 6 IN (1, 3)", "'lexical'"), counts=F.struct(_if("event_id % 2 = 0", "event_id % 9").alias("matched"), (F.col("event_id") % 9).alias("total")))
    rows = table(spark, folder, "events").select("event_id", body.alias("body")).select("event_id", F.explode(replies.notices(F.col("body"))).alias("n"), replies.matched_count(F.col("body")).alias("matched"))
    return rows.select("event_id", "n.stage", "n.message", "matched")


@_r.add("SELECT event_id, 'search_limit' AS stage, '_note: cut' AS message FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'search_annotation', 'hint: ' || event_type FROM events WHERE event_id % 3 = 0")
def search_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """What a search says of its own rows."""
    body = _json(_note=_if("event_id % 2 = 0", "'cut'"), hint=_if("event_id % 3 = 0", "event_type"), rows=F.array(F.lit(1)))
    return table(spark, folder, "events").select("event_id", body.alias("body")).select("event_id", F.explode(replies.annotations(F.col("body"))).alias("n")).select("event_id", "n.*")


_QUESTION = "old widgets of brand#13 and economy class"
_STEMS = (("old", "old"), ("widgets", "widget"), ("brand", "brand"), ("13", "13"), ("economy", "economy"), ("class", "clas"))
_POINTS = " + ".join(f"CASE WHEN contains(lower(p_name || ' ' || p_brand), '{s}') THEN 3 WHEN contains(lower(p_type), '{s}') THEN 1 ELSE 0 END" for _, s in _STEMS)


@_r.add(f"SELECT p_size, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY s DESC, p_partkey) AS place FROM (SELECT p_size, p_partkey, {_POINTS} AS s FROM part) WHERE s > 0) WHERE place <= 8")
def catalog_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a catalog whose details are read: those that a question's words meet best."""
    from lodesift.functions.questions import retrieval_terms

    points = records.catalog_score(retrieval_terms(F.lit(_QUESTION)), F.concat_ws(" ", "p_name", "p_brand"), F.col("p_type"))
    rows = table(spark, folder, "part").select("p_size", "p_partkey", points.alias("score"))
    return P.best_entries(rows, "p_size", "score", "p_partkey").select("p_size", "p_partkey", F.col("place").cast("bigint").alias("place"))


@_r.add("SELECT o_orderkey, CAST(floor(a / 5) AS BIGINT) AS page FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS a FROM orders) WHERE a < 10 AND a < o_custkey % 15")
def paged_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a listing gives in two pages of five, up to the count that it has matched."""
    rows = table(spark, folder, "orders").withColumn("matched", F.col("o_custkey") % 15)
    return P.paged(rows, "o_custkey", "o_orderkey", 5, 2, "matched").select("o_orderkey", F.col("page").cast("bigint").alias("page"))


@_r.add("SELECT o_orderkey, CAST(least(w, greatest(20 - coalesce(sum(w) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS sent FROM (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS w FROM orders)")
def shared_page_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that each query of a search may ask for out of one budget."""
    rows = table(spark, folder, "orders").withColumn("pages", F.col("o_orderkey") % 4)
    return P.shared_pages(rows, "o_custkey", "o_orderkey", "pages", 20).select("o_orderkey", "sent")


@_r.add("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderpriority = m")
def first_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the first query of a search that finds any."""
    return P.first_answer(table(spark, folder, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey")


@_r.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN p_brand WHEN l_suppkey % 3 = 0 THEN s_name ELSE NULL END AS detail, CASE WHEN l_partkey % 2 = 0 THEN 'key' WHEN l_suppkey % 3 = 0 THEN 'name' ELSE 'none' END AS found_by FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def project_details(spark: SparkSession, folder: str) -> DataFrame:
    """Details of projects, looked up once for each: by key, else by name."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("name"))
    keyed = table(spark, folder, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.lit(None).cast("bigint").alias("name"), F.col("p_brand").alias("detail"))
    named = table(spark, folder, "supplier").where("s_suppkey % 3 = 0").select(F.lit(None).cast("bigint").alias("key"), F.col("s_suppkey").alias("name"), F.col("s_name").alias("detail"))
    return P.project_details(rows, keyed.unionByName(named), "key", "name").select("l_orderkey", "l_linenumber", "detail", "found_by")


@_r.add("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN n_name ELSE s_name END AS text, CASE WHEN s_suppkey % 4 = 0 THEN 'structured_record_with_detail' ELSE 'structured_record' END AS scope FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def detailed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Listing rows with the text of their detail, where their slug is safe and there is one."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    slug = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'a-b_1' WHEN 1 THEN 'a/b' WHEN 2 THEN '' ELSE 'ok' END")
    found = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", records.detailed(F.col("s_name"), F.lit("structured_record"), slug, F.when(F.col("s_suppkey") % 4 != 3, F.col("n_name"))).alias("d"))
    return found.select("s_suppkey", "d.text", "d.scope")


@_r.add("SELECT p.page_id, h.held_id FROM (SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(url, '#.*', '') END AS u FROM pages) p LEFT JOIN (SELECT regexp_replace(url, '#.*', '') AS u, min(page_id) AS held_id FROM pages WHERE page_id % 2 = 0 AND starts_with(url, 'https://') GROUP BY 1) h ON p.u = h.u")
def held_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose whole body a document holds already."""
    pages = table(spark, folder, "pages")
    held = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), F.concat("url", F.lit("#top")).alias("url"))
    return P.held_bodies(pages.select("page_id", "url"), held).select("page_id", "held_id")


@_r.add("SELECT page_id, left(sha256(url), 16) AS id, page_id % 4 = 0 AND starts_with(url, 'https://') AND page_id % 3 <> 0 AS eligible FROM pages")
def original_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that may be read behind rows which show only a part, and the ids that they would have."""
    scope = F.expr("CASE WHEN page_id % 4 = 0 THEN 'ai_summary' ELSE 'research_chunk' END")
    found = records.original_eligible(scope, F.lit(None).cast("boolean"), F.col("page_id") % 3 == 0, F.col("url"), F.lit("api.example"))
    return table(spark, folder, "pages").select("page_id", records.original_id(F.col("url")).alias("id"), found.alias("eligible"))


@_r.add("SELECT o_custkey, count(*) AS eligible, " + ", ".join(f"count(*) FILTER (o_orderkey % 6 = {i}) AS {n}" for i, n in enumerate(("reused", "capped", "skipped", "used", "refused", "failed"))) + ", count(*) FILTER (o_orderkey % 6 > 2) AS attempted FROM orders GROUP BY 1")
def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the reads of originals in each session."""
    outcome = cases("o_orderkey", ["reused", "capped", "skipped", "used", "refused", "failed"])
    return P.read_counters(table(spark, folder, "orders").withColumn("outcome", outcome), "o_custkey")


@_r.add("SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN 'https://a.example/' || (s_suppkey - s_suppkey % 5) END AS target, least(s_suppkey % 5, 4) AS moves FROM supplier")
def followed_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Where redirects of a page lead in three moves; each of five pages leads to the one before it."""
    url = lambda c: F.concat(F.lit("https://a.example/"), c.cast("string"))
    s = table(spark, folder, "supplier")
    moves = s.where("s_suppkey % 5 > 0").select(url(F.col("s_suppkey")).alias("url"), F.concat(F.lit("/"), (F.col("s_suppkey") - 1).cast("string")).alias("location"))
    return P.moved(s.select("s_suppkey", url(F.col("s_suppkey")).alias("url")), moves).select("s_suppkey", F.col("at").alias("target"), F.col("moves").cast("bigint").alias("moves"))


@_r.add("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN event_id ELSE event_id % 50 END AS wait FROM events")
def reset_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds until a limit starts anew, from times and from waits."""
    reset = F.expr("CASE WHEN event_id % 2 = 0 THEN 1700000000 + event_id ELSE event_id % 50 END")
    return table(spark, folder, "events").select("event_id", replies.reset_wait(reset, F.lit(1_700_000_000), F.col("event_id") % 3 == 0).cast("bigint").alias("wait"))


@_r.add("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'http_429; retry after 7 s; trace t' || event_id ELSE 'timeout' END AS report, CASE WHEN event_id % 2 = 0 THEN 'not_assessed_after_stop' ELSE event_type END AS stage FROM events")
def failure_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Reads that failed, as the rows that report them."""
    some = F.col("event_id") % 4 == 0
    report = replies.read_report(F.when(some, 429), F.when(~some, "request timed out"), F.when(some, 7), F.when(some, F.concat(F.lit("t"), F.col("event_id").cast("string"))))
    return table(spark, folder, "events").select("event_id", report.alias("report"), replies.failure_stage(F.col("event_type"), F.col("event_id") % 2 == 0).alias("stage"))

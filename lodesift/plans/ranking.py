"""Queries on ranks, dates and authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.operators import ranking as R
from lodesift.operators.running import cuts
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql

#: Fixed value of the fixtures: 2026-09-23.
TODAY = 20_719

_V = "v AS (SELECT p_brand AS question_id, p_partkey AS id, CASE WHEN p_size > 10 THEN p_retailprice END AS relevance, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS currentness, CAST(p_partkey % 365 AS DOUBLE) AS recency, -CAST(p_size % 4 + 1 AS DOUBLE) AS authority FROM part)"


def _rank(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN count({c}) OVER (PARTITION BY question_id) // 2 + 1 ELSE rank() OVER (PARTITION BY question_id ORDER BY {c} DESC NULLS LAST) END AS {c}_rank"


_RANKED = f"{_V}, k AS (SELECT *, {', '.join(map(_rank, ('relevance', 'currentness', 'recency', 'authority')))} FROM v)"
_FUSED = f"{_RANKED}, f AS (SELECT *, 1.0::DOUBLE / (10 + relevance_rank) + 1.0::DOUBLE / (10 + currentness_rank) + 0.6::DOUBLE / (10 + recency_rank) + 0.5::DOUBLE / (10 + authority_rank) AS fused, CASE WHEN coalesce(currentness / 50, 0) >= 0.5 THEN 1 ELSE 2 END AS bucket FROM k)"
_CRITERIA = ("relevance", "currentness", "recency", "authority")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as candidates of their brand, with four criteria, some missing."""
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("question_id"), F.col("p_partkey").alias("id"), F.when(size > 10, F.col("p_retailprice")).alias("relevance"),
        F.when(size % 3 == 0, size.cast("double")).alias("currentness"), (F.col("p_partkey") % 365).cast("double").alias("recency"), (-(size % 4 + 1)).cast("double").alias("authority"),
    )


@_r.add(f"WITH {_RANKED} SELECT question_id, id, relevance_rank, currentness_rank, recency_rank, authority_rank FROM k")
def rank_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Competition ranks by four criteria, missing values in the middle."""
    rows = R.positions(_candidates(spark, folder), _CRITERIA)
    return rows.select("question_id", "id", *[f"{c}_rank" for c in _CRITERIA])


@_r.add(f"WITH {_FUSED} SELECT question_id, id, round(fused, 12) AS fused, bucket, row_number() OVER (PARTITION BY question_id ORDER BY bucket, fused DESC, id) AS place FROM f")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fused score, bucket and place of every candidate, as for a question about the present."""
    rows = R.fused(_candidates(spark, folder), _CRITERIA, R.WEIGHTS["current"])
    rows = rows.withColumn("bucket", R.bucket(F.lit("current"), F.lit(0.9), F.col("currentness") / 50))
    return R.final_order(rows).select("question_id", "id", F.round("fused", 12).alias("fused"), "bucket", F.col("place").cast("bigint").alias("place"))


@_r.add(f"WITH {_FUSED} SELECT question_id, bucket, count(*) AS n, min(id) AS first_id FROM f GROUP BY 1, 2")
def current_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates in each bucket."""
    rows = _candidates(spark, folder).withColumn("bucket", R.bucket(F.lit("current"), F.lit(0.9), F.col("currentness") / 50))
    return rows.groupBy("question_id", "bucket").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


#: A place for each line that no other line of the order with another kind or date has.
_ORD = "(CAST(l_linenumber AS BIGINT) * 1000000 + {}) * 256 + ascii(l_returnflag)"
_LINES = "SELECT l_orderkey AS id, " + _ORD.format("date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))") + " AS ord, CASE l_returnflag WHEN 'A' THEN 'published' WHEN 'N' THEN 'modified' ELSE 'event' END AS kind, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS days FROM lineitem"


@_r.add(f"WITH c AS ({_LINES}), n AS (SELECT id, arg_max(kind, (days, ord)) FILTER (kind <> 'event' AND days <= {TODAY} + 1) AS k1, max(days) FILTER (kind <> 'event' AND days <= {TODAY} + 1) AS d1, arg_min(kind, ord) FILTER (kind = 'event') AS k2, arg_min(days, ord) FILTER (kind = 'event') AS d2 FROM c GROUP BY id) SELECT id AS order_id, coalesce(k1, k2) AS kind, CAST(coalesce(d1, d2) AS INT) AS days FROM n")
def newest_document_date(spark: SparkSession, folder: str) -> DataFrame:
    """The newest date of each order's lines that drives recency, else the first of another kind."""
    flag = F.col("l_returnflag")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.expr(_ORD.format("unix_date(cast(l_shipdate as date))")).alias("ord"),
        F.when(flag == "A", "published").when(flag == "N", "modified").otherwise("event").alias("kind"), F.unix_date(F.col("l_shipdate").cast("date")).alias("days"),
    )
    return R.newest(rows, "order_id", TODAY, C.RECENCY_KINDS)


_DATED = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Published on ' || strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN 'seen ' || strftime(o_orderdate, '%Y-%m-%d') || ' and 2026-02-31' WHEN 2 THEN 'Date: ' || strftime(o_orderdate, '%-d/%-m/%Y') ELSE 'no date' END AS t, o_orderdate AS d FROM orders"


@_r.add(f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 IN (0, 1) OR (o_orderkey % 4 = 2 AND day(d) > 12) THEN date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) END AS INT) AS days FROM ({_DATED})")
def parse_first_date(spark: SparkSession, folder: str) -> DataFrame:
    """The first date in a sentence made from each order's date, in three spellings."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("Published on "), F.date_format(d, "MMMM d, yyyy"))).when(kind == 1, F.concat(F.lit("seen "), F.date_format(d, "yyyy-MM-dd"), F.lit(" and 2026-02-31")))
    text = text.when(kind == 2, F.concat(F.lit("Date: "), F.date_format(d, "d/M/yyyy"))).otherwise("no date")
    return table(spark, folder, "orders").select("o_orderkey", C.first_date(text).alias("days"))


@_r.add("WITH n AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END, newest) AS dated FROM orders LEFT JOIN n USING (o_custkey)")
def date_by_url_join(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a date of their own take the newest of their key."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    newest = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))
    own = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return orders.join(newest, "o_custkey", "left").select("o_orderkey", F.coalesce(own, "newest").alias("dated"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?', 1)"
#: Example rules of authority: (host, path prefix, tier).
_TIERS = (("blog.tionsh.example.net", "/", 1), ("thther.example.org", "/en/", 1), ("thther.example.org", "", 2), ("cheap-pills.example.com", "", 4))


@_r.add(f"SELECT page_id, {_HOST} AS host, CASE " + " ".join(f"WHEN {_HOST} = '{h}' AND starts_with({_PATH}, '{p}') THEN {t}" for h, p, t in _TIERS) + " ELSE 3 END AS tier FROM pages")
def authority_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Host and authority of each page's URL."""
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", C.host(url).alias("host"), C.authority_tier(url, F.lit(""), _TIERS).alias("tier"))


@_r.add(f"SELECT {_HOST} AS host, min(page_id) AS first_page, arg_min(page_id, (length(url), page_id)) AS best_page, count(*) AS n FROM pages GROUP BY 1")
def best_tier_per_url(spark: SparkSession, folder: str) -> DataFrame:
    """First and best page of each host; the shortest URL stands for the best tier."""
    rows = table(spark, folder, "pages").select("page_id", C.host(F.col("url")).alias("host"), F.length("url").alias("tier"))
    return rows.groupBy("host").agg(F.min("page_id").alias("first_page"), F.min_by("page_id", F.struct("tier", "page_id")).alias("best_page"), F.count("*").alias("n"))


@_r.add("SELECT item_id, scope, CASE scope WHEN 'article_visible_text' THEN 4 WHEN 'research_chunk' THEN 3 WHEN 'structured_record' THEN 2 WHEN 'catalog_metadata' THEN 1 ELSE 0 END AS scope_rank FROM (SELECT item_id, ['article_visible_text', 'research_chunk', 'structured_record', 'catalog_metadata', 'body_visible_text'][item_id % 5 + 1] AS scope FROM benchmark)")
def content_scope_rank(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a document its scope shows."""
    names = F.array(*[F.lit(x) for x in ("article_visible_text", "research_chunk", "structured_record", "catalog_metadata", "body_visible_text")])
    scope = F.get(names, (F.col("item_id") % 5).cast("int"))
    return table(spark, folder, "benchmark").select("item_id", scope.alias("scope"), C.scope_rank(scope).alias("scope_rank"))


@_r.add(f"SELECT c_mktsegment AS question_id, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY floor(c_acctbal / 1000) DESC, c_nationkey % 5 DESC, c_custkey) AS place FROM customer")
def uncertain_order(spark: SparkSession, folder: str) -> DataFrame:
    """Uncertain rows by band of relevance, then scope rank, then id."""
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("question_id"), F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 1000).alias("band"), (F.col("c_nationkey") % 5).alias("scope_rank"))
    found = R.ordered(rows, (F.desc("band"), F.desc("scope_rank"), "id"), -cuts(rows, F.col("band")))
    return found.select("question_id", "id", F.col("place").cast("bigint").alias("place"))


@_r.add("WITH o AS (SELECT o_orderpriority AS question_id, o_custkey, o_orderkey, o_orderdate FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY question_id, o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM o) SELECT question_id, o_orderkey AS id, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY o_orderdate DESC, o_orderkey) AS place FROM f WHERE k = 1) WHERE place <= 3")
def newest_dated_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The three newest rows of each question with distinct keys."""
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("question_id"), "o_custkey", F.col("o_orderkey").alias("id"), "o_orderdate")
    first = F.row_number().over(R.Window.partitionBy("question_id", "o_custkey").orderBy(F.desc("o_orderdate"), "id"))
    found = R.top(rows.withColumn("k", first).where("k = 1"), 3, F.desc("o_orderdate"), "id")
    return found.select("question_id", "id", F.col("place").cast("bigint").alias("place"))

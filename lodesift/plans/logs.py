"""Queries on logs: latencies, streaks, limits, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.operators import limits as L
from lodesift.operators import rollups as A
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table
from lodesift.streaming.requests import window_counts

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


@_r.add("SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1")
def stage_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of each stage."""
    return _events(spark, folder).groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))


@_r.add("SELECT event_type, n, " + ", ".join(f"l[CAST(round((n - 1) * {p}) AS INT) + 1] AS p{round(p * 100)}" for p in (0.5, 0.9, 0.99)) + " FROM (SELECT event_type, count(value) AS n, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)")
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Values at three places of each type's sorted values."""
    return A.percentiles(_events(spark, folder), "value", "event_type")


_FAILED = "event_type = 'error' OR value < 20"


@_r.add(f"WITH m AS (SELECT *, {_FAILED} AS f FROM events), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT event_id, user_id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g")
def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Failures in a row of each user; a low value stands for a failure."""
    return A.streaks(_events(spark, folder), "user_id", ("ts", "event_id"), F.expr(_FAILED)).select("event_id", "user_id", "streak")


@_r.add("WITH s AS (SELECT event_type, ts AS tm, 1 AS d FROM events UNION ALL SELECT event_type, ts + to_minutes(CAST(floor(value) AS BIGINT)), -1 FROM events WHERE value IS NOT NULL), g AS (SELECT event_type, tm, d, sum(d) AS n FROM s GROUP BY 1, 2, 3) SELECT event_type, CAST(max(o) AS BIGINT) AS peak FROM (SELECT event_type, sum(n) OVER (PARTITION BY event_type ORDER BY tm, d ROWS UNBOUNDED PRECEDING) AS o FROM g) GROUP BY 1")
def peak_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    """The most events of a type open at once, each for its value in minutes."""
    rows = _events(spark, folder).select("event_type", "ts", (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("until"))
    return A.peak_in_flight(rows.where("until is not null"), "event_type", "ts", "until")


@_r.add("SELECT event_id, event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) AS used, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def request_window_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type and hour counted, three allowed."""
    found = L.window_limit(_events(spark, folder), "event_type", "ts", "event_id", "1 hour", 3)
    return found.select("event_id", "event_type", "window_start", "used", "allowed")


@_r.add("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS used, greatest(count(*) - 3, 0) AS over FROM events GROUP BY 1, 2")
def request_window_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same windows as a batch over the streaming operator."""
    found = window_counts(_events(spark, folder), limit=3)
    return found.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "used", F.col("over").cast("bigint").alias("over"))


_WAIT = "CASE WHEN event_id % 3 = 0 THEN 3600 ELSE 60 + event_id % 600 END"


@_r.add(f"SELECT event_id, coalesce(epoch_us(ts) < max(CASE WHEN value < 20 THEN epoch_us(ts) + 1000000 * ({_WAIT}) END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM events")
def gate_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Events while a refusal of their type holds the gate closed, each refusal for the wait that it asked for."""
    return L.gates(_events(spark, folder), "event_type", "ts", "event_id", F.col("value") < 20, F.expr(_WAIT)).select("event_id", "closed")


@_r.add(
    "WITH f AS (SELECT event_type, min(epoch_us(ts) // 1000) + 5000000 AS first, 1800000 + 60000 * strlen(event_type) AS period FROM events GROUP BY 1), e AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS tm, first, period, CASE WHEN epoch_us(ts) // 1000 < first THEN 0 ELSE (epoch_us(ts) // 1000 - first) // period + 1 END AS epoch FROM events JOIN f USING (event_type)) "
    "SELECT event_id, epoch, first + epoch * period AS window_reset_ms, row_number() OVER w AS used, row_number() OVER w <= 4 AS allowed FROM e WINDOW w AS (PARTITION BY event_type, epoch ORDER BY tm, event_id)"
)
def rolled_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events counted in windows that roll by whole periods from the first one's end."""
    rows = _events(spark, folder).select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    first = rows.groupBy("event_type").agg((F.min("at_ms") + 5_000_000).alias("reset_ms")).withColumn("period_ms", F.lit(1_800_000) + F.octet_length("event_type") * 60_000)
    found = L.rolled_windows(rows.join(first, "event_type").withColumn("limit", F.lit(4)), "event_type", "at_ms", "event_id", "reset_ms", "period_ms", "limit")
    return found.select("event_id", "epoch", "window_reset_ms", "used", "allowed")


@_r.add("SELECT event_id, least(pow(2.0, event_id % 9 + 1), 90.0) AS seconds FROM events")
def backoff_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds before the next attempt, by the attempts made."""
    return _events(spark, folder).select("event_id", C.backoff_seconds(F.col("event_id") % 9 + 1).alias("seconds"))


@_r.add(
    "SELECT user_id, count(*) AS n_calls, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(*) FILTER (event_type = 'error') AS n_failed, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS n_bytes, array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS hosts "
    "FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"
)
def usage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, days, failures, bytes and hosts of each user in a window of days; types stand for hosts."""
    from lodesift.operators.rollups import usage_report as report

    rows = _events(spark, folder).select("user_id", "ts", "event_type", (F.col("event_type") == "error").alias("failed"), F.floor(F.col("value") * 100).alias("bytes"))
    return report(rows, "user_id", "ts", "failed", "bytes", "event_type", "2024-01-05", "2024-01-20")


@_r.add(
    "SELECT event_id, stage, message FROM (SELECT event_id, user_id * 30 AS hits, event_id % 4 AS k FROM events), (VALUES ('search_notice', 'count missing', 0), ('limit', 'more than can be shown', 1), ('limit', 'approximate count', 2)) AS v(stage, message, j) "
    "WHERE CASE j WHEN 0 THEN k IN (0, 1) WHEN 1 THEN k > 0 AND hits > 1000 ELSE event_id % 5 IN (0, 1) END"
)
def count_notices(spark: SparkSession, folder: str) -> DataFrame:
    """What searches say of their counts: missing, above what can be shown, approximate."""
    from lodesift.functions import replies

    k, fifth = F.col("event_id") % 4, F.col("event_id") % 5
    body = F.to_json(F.struct(F.when(k > 0, F.col("user_id") * 30).alias("nbHits"), F.when(k != 1, F.lit(3)).alias("nbPages"), F.when(fifth == 0, F.lit(False)).alias("exhaustiveNbHits"), F.struct((fifth != 1).alias("nbHits")).alias("exhaustive")))
    return _events(spark, folder).select("event_id", F.explode(replies.count_notices(body)).alias("n")).select("event_id", "n.stage", "n.message")


@_r.add("SELECT event_type, 'fetch_deadline' AS stage, count(*) AS n_late, min(event_id) AS first_late FROM events WHERE value > 100 GROUP BY 1")
def deadline_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Reads that took over the deadline, reported by type."""
    late = _events(spark, folder).where("value > 100")
    return late.groupBy("event_type").agg(F.lit("fetch_deadline").alias("stage"), F.count("*").alias("n_late"), F.min("event_id").alias("first_late"))


@_r.add("SELECT user_id, count(*) AS n_reports, count(*) FILTER (event_type IN ('search', 'http', 'error')) AS n_losses, count(*) FILTER (event_type = 'search_limit') AS n_search_limits, count(*) FILTER (event_type IN ('search', 'http', 'error')) > 0 AS degraded FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'http' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Reports and losses of each user; an event's type stands for a stage."""
    stage = F.when(F.col("event_type") == "error", "run.http").otherwise(F.col("event_type"))
    return A.load_summary(_events(spark, folder).withColumn("stage", stage), "user_id", "stage")


@_r.add("SELECT user_id, CASE WHEN n_bad = 0 THEN 'complete' WHEN n_bad = n THEN 'failed' ELSE 'partial' END AS status, CASE WHEN n_bad = 0 THEN 0 WHEN n_bad = n THEN 1 ELSE 2 END AS exit_code FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value < 20) AS n_bad FROM events GROUP BY 1)")
def run_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status and exit code of each user's run."""
    rows = _events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 20).alias("bad"))
    pick = lambda a, b, c: F.when(F.col("bad") == 0, a).when(F.col("bad") == F.col("n"), b).otherwise(c)
    return rows.select("user_id", pick("complete", "failed", "partial").alias("status"), pick(0, 1, 2).alias("exit_code"))


@_r.add("SELECT l_suppkey, count(*) AS calls, count(DISTINCT l_orderkey) AS sessions, CAST(sum((CAST(l_quantity AS BIGINT) * 420 + 9) // 10) AS BIGINT) AS nanos, round(sum(l_extendedprice), 2) AS spent FROM lineitem GROUP BY 1")
def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, sessions and cost of each provider."""
    rows = table(spark, folder, "lineitem")
    nanos = C.cost_nanos(F.col("l_quantity").cast("bigint"), F.lit(420))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("calls"), F.countDistinct("l_orderkey").alias("sessions"), F.sum(nanos).alias("nanos"), F.round(F.sum("l_extendedprice"), 2).alias("spent"))


@_r.add("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def listing_detail_join(spark: SparkSession, folder: str) -> DataFrame:
    """Listing rows with their details."""
    s, n, r = (table(spark, folder, x) for x in ("supplier", "nation", "region"))
    found = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return found.select("s_suppkey", "s_name", "n_name", "r_name")


_BUCKET = "WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000) AS i FROM events), r AS (SELECT event_type, at_ms, i, CAST(1 AS DOUBLE) AS have FROM e WHERE i = 1 UNION ALL SELECT e.event_type, e.at_ms, e.i, least((CASE WHEN r.have >= 1 THEN r.have - 1 ELSE r.have END) + (e.at_ms - r.at_ms) * CAST(0.0001 AS DOUBLE), 1) FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1)"


@_r.add(f"{_BUCKET} SELECT event_type, at_ms, have >= 1 AS granted, round(CASE WHEN have >= 1 THEN have - 1 ELSE have END, 6) AS tokens FROM r")
def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Grants of a bucket for each event type."""
    rows = _events(spark, folder).select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return L.token_bucket(rows, "event_type", "at_ms", 6).withColumn("tokens", F.round("tokens", 6))

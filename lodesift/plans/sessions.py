"""Queries on sessions, pools, calls and limits. Customers stand for sessions, their orders for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.operators import limits as L
from lodesift.operators import sessions as S
from lodesift.plans.records import cases, cases_sql
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    # Money as whole cents, so that no sum depends on its order.
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("session"), k.alias("id"), F.col("o_orderpriority").alias("source_id"), (F.pmod(k, F.lit(10)) / 10.0).alias("probability"), "o_orderstatus")


_ACTION = "CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 < 3 THEN 'leave_pool' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 = 0 THEN 'classify' WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 = 1 AND o_orderkey % 8 >= 3 THEN 'to_pool' END"


@_r.add(f"SELECT * FROM (SELECT o_custkey AS session, o_orderkey AS id, {_ACTION} AS action FROM orders) WHERE action IS NOT NULL")
def session_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """What a session that was broken off does with each of its documents."""
    d = _documents(spark, folder)
    return S.recovered(d, d.where("id % 2 = 0"), d.where("id % 4 = 0"), d.where("id % 8 < 3"), "session")


_POOLS = (
    "SELECT session, p.source_id, route, fetched, CASE WHEN p.source_id = '5-LOW' THEN 'unavailable' WHEN NOT fetched THEN 'unfetched' WHEN coalesce(pending, 0) > 0 THEN 'unscored_tail' ELSE 'spent' END AS state, coalesce(pending, 0) AS pending, coalesce(scored, 0) AS scored, coalesce(selected, 0) AS selected, best "
    "FROM (SELECT o_custkey AS session, o_orderpriority AS source_id, max(o_orderkey % 10) / 10.0 AS route, max(o_orderkey) % 3 <> 0 AS fetched FROM orders GROUP BY 1, 2) p "
    "LEFT JOIN (SELECT o_custkey AS session, o_orderpriority AS source_id, count(*) FILTER (o_orderkey % 5 = 0) AS pending, count(*) FILTER (o_orderkey % 5 > 0) AS scored, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 10 >= 4) AS selected, max(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 10 / 10.0 END) AS best FROM orders GROUP BY 1, 2) t USING (session, source_id)"
)


def _pools(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder)
    decisions = d.groupBy("session", "source_id").agg(F.max("probability").alias("route"), (F.max("id") % 3 != 0).alias("fetched"))
    registry = d.select("source_id").where("source_id <> '5-LOW'").distinct()
    return S.pools(decisions, registry, d.where("id % 5 = 0"), d.where("id % 5 > 0"), "session")


@_r.add(_POOLS)
def session_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Every source of a session as a pool of work."""
    return _pools(spark, folder)


@_r.add(f"SELECT session, source_id, pending FROM ({_POOLS}) WHERE state IN ('unfetched', 'unscored_tail')")
def open_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Pools with work left."""
    return S.open_pools(_pools(spark, folder)).select("session", "source_id", "pending")


@_r.add(
    f"SELECT session, count(*) FILTER (state = 'unfetched') AS unfetched, count(*) FILTER (state = 'unscored_tail') AS unscored_tail, count(*) FILTER (state = 'unavailable') AS unavailable, max(CASE WHEN state = 'unfetched' THEN route END) AS best_route, max(CASE WHEN state = 'unscored_tail' THEN best END) AS best_tail, "
    f"count(*) FILTER ((state = 'unfetched' AND route >= 0.6) OR (state = 'unscored_tail' AND (best >= 0.15 OR route >= 0.6))) AS actionable FROM ({_POOLS}) GROUP BY 1"
)
def pool_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pools of each session by state, the best of them, and how many are worth spending."""
    return S.pool_summary(_pools(spark, folder), "session")


@_r.add(f"SELECT session, source_id, row_number() OVER (PARTITION BY session ORDER BY route DESC NULLS LAST, source_id) AS place FROM ({_POOLS})")
def pool_order(spark: SparkSession, folder: str) -> DataFrame:
    """Pools by route."""
    return S.pool_order(_pools(spark, folder), "session", "source_id").select("session", "source_id", F.col("place").cast("bigint").alias("place"))


@_r.add(
    f"SELECT a.session, a.source_id, CASE WHEN state IS NULL THEN 'unknown' WHEN state = 'unavailable' THEN 'unavailable' WHEN state = 'spent' THEN 'spent' ELSE 'spend' END AS answer FROM (SELECT DISTINCT o_custkey AS session, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE o_orderpriority END AS source_id FROM orders) a LEFT JOIN ({_POOLS}) p ON a.session = p.session AND a.source_id = p.source_id"
)
def asked_pools(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the pools that a call asks for."""
    asked = _documents(spark, folder).select("session", F.expr("CASE WHEN id % 3 = 0 THEN 'other' ELSE source_id END").alias("source_id"))
    return S.asked_pools(asked, _pools(spark, folder), "session")


@_r.add("SELECT o_custkey AS session, o_orderpriority AS source_id, max(o_orderkey) % 3 <> 0 OR bool_or(o_orderkey % 7 = 0) AS fetched FROM orders GROUP BY 1, 2")
def mark_fetched(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions after a call has fetched more sources."""
    d = _documents(spark, folder)
    decisions = d.groupBy("session", "source_id").agg((F.max("id") % 3 != 0).alias("fetched"))
    return S.fetched(decisions, d.where("id % 7 = 0"), "session")


@_r.add("SELECT o_custkey AS session, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def held_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a session holds, in its list or deferred."""
    d = _documents(spark, folder)
    return S.held_ids(d.where("id % 2 = 0"), d.where("id % 3 = 0"), "session")


@_r.add("SELECT DISTINCT o_orderpriority AS source_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS eligible FROM orders")
def source_scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Sources in a scope's list, and those left out of it."""
    registry = _documents(spark, folder).select("source_id").distinct()
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("unknown",)], "source_id string")
    return S.eligible_sources(registry, allowed)


@_r.add("SELECT o_custkey AS session, o_orderkey AS id, CASE WHEN o_orderkey % 10 >= 4 THEN 'selected' ELSE 'rejected' END AS status, o_orderkey % 6 <> 0 AS found FROM orders")
def classified_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts with the documents that they are on, and those without one."""
    d = _documents(spark, folder)
    verdicts = d.select("session", "id", F.when(F.col("probability") >= 0.4, "selected").otherwise("rejected").alias("status"))
    return S.classified(d.where("id % 6 <> 0"), verdicts, "session")


@_r.add("SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS call, o_orderkey FROM orders")
def call_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each session in order."""
    d = _documents(spark, folder).select("session", F.col("id").alias("o_orderkey"))
    return S.call_numbers(d, "session", "o_orderkey").withColumn("call", F.col("call").cast("bigint"))


@_r.add("SELECT l_orderkey AS session, l_returnflag AS source_id, l_suppkey AS id, min(l_linenumber) AS call FROM lineitem GROUP BY 1, 2, 3")
def retrieved_index(spark: SparkSession, folder: str) -> DataFrame:
    """The first call that brought each document."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_returnflag").alias("source_id"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("call"))
    return S.retrieved_index(rows, "session")


_CALLS = "SELECT o_custkey AS session, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_orderkey % 4 = 0 THEN 'stopped' ELSE 'done' END AS outcome FROM orders"
_CHARGED = "CASE WHEN outcome = 'stopped' THEN 50000000 ELSE cents END"


@_r.add(
    f"SELECT session, o_orderkey, charged, spent, greatest(first * 3 - spent, 0) AS left_over FROM (SELECT session, o_orderkey, {_CHARGED} AS charged, CAST(sum({_CHARGED}) OVER w AS BIGINT) AS spent, first(cents) OVER w AS first FROM ({_CALLS}) WINDOW w AS (PARTITION BY session ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))"
)
def session_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """What each call costs and leaves of its session's cap."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("session"), "o_orderkey", cents.alias("cents"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'stopped' ELSE 'done' END").alias("outcome"), F.lit(50_000_000).cast("bigint").alias("allowance"))
    found = S.budgets(rows, "session", "o_orderkey", "cents", "outcome", "cents", "allowance")
    return found.select("session", "o_orderkey", "charged", "spent", F.col("left").alias("left_over"))


@_r.add("SELECT o_custkey AS session, o_orderstatus AS host, CAST(sum(o_orderkey % 5) AS BIGINT) AS n_requests, any_value(n) AS n_calls FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1, 2")
def session_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each session and its requests to each host."""
    d = _documents(spark, folder)
    return S.totals(d, d.select("session", F.col("o_orderstatus").alias("host"), (F.col("id") % 5).alias("n")), "session")


@_r.add("SELECT o_custkey AS session, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' ELSE 'b' END AS scope, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2")
def first_requests(spark: SparkSession, folder: str) -> DataFrame:
    """First requests that the sources of a session send to each limited scope."""
    d = _documents(spark, folder)
    scopes = d.where("source_id <> '5-LOW'").select("source_id", F.expr("CASE source_id WHEN '1-URGENT' THEN 'a' ELSE 'b' END").alias("scope")).distinct()
    return S.first_requests(d, scopes, "session")


@_r.add("SELECT o_orderkey, left(sha256(CAST(o_orderkey AS VARCHAR)), 12) AS name FROM orders")
def text_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files of texts outside a report."""
    return table(spark, folder, "orders").select("o_orderkey", S.text_name(F.col("o_orderkey")).alias("name"))


@_r.add("SELECT o_orderkey, o_orderpriority AS source_id, CASE WHEN o_orderkey % 4 = 0 THEN 'provenance' END AS report FROM orders")
def corrected_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that name another source than the one that brought them."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority WHEN o_orderkey % 8 = 0 THEN 'x' END").alias("source_id"))
    return S.corrected_sources(rows, "o_orderpriority", "source_id").drop("o_orderpriority")


@_r.add("SELECT s_suppkey AS source_id, coalesce(m, '') AS missing, m IS NULL AS ready FROM supplier LEFT JOIN (SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS m FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber > 6 GROUP BY 1) ON s_suppkey = l_suppkey")
def credential_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that sources need and the settings lack."""
    sources = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source_id"))
    needed = table(spark, folder, "lineitem").where("l_linenumber > 6").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("key"))
    return S.missing_keys(sources, needed, spark.createDataFrame([("N",)], "key string"))


@_r.add("SELECT 'run/' || l_suppkey AS folder, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_bytes FROM lineitem GROUP BY 1")
def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes of each folder."""
    files = table(spark, folder, "lineitem").select(F.concat_ws("/", F.lit("run"), F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_quantity").cast("bigint").alias("length"))
    return S.artifacts(files)


@_r.add("SELECT user_id, max(ts) < TIMESTAMP '2024-01-29 00:00:00' AND user_id % 3 <> 0 AS prune FROM events GROUP BY 1")
def idle_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that are idle and not in use."""
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("active"), F.first(F.col("user_id") % 3 == 0).alias("locked"))
    now = F.unix_seconds(F.to_timestamp(F.lit("2024-01-30 00:00:00")))
    return S.idle(rows, "active", now, 1, "locked").select("user_id", "prune")


@_r.add(
    "SELECT user_id, name, CAST(sum(value) AS BIGINT) AS value FROM (SELECT user_id, 'requests' AS name, 1 AS value, event_id FROM events UNION ALL SELECT user_id, 'tokens', CAST(json_extract_string(props, '$.k') AS BIGINT), event_id FROM events UNION ALL SELECT user_id, 'hosts.' || event_type, 2, event_id FROM events) WHERE event_id % 7 > 0 GROUP BY 1, 2"
)
def usage_by_field(spark: SparkSession, folder: str) -> DataFrame:
    """Usage summed field by field and host by host, over the calls of a window."""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.lit(1).alias("requests"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.create_map("event_type", F.lit(2)).alias("hosts"))
    return S.usage_sum(rows, ("user_id",), ("requests", "tokens"), "hosts", F.col("event_id") % 7 > 0)


_OUTCOMES = ["answered", "rate_limited", "never_sent", "rejected_credentials", "out_of_credit", "server_error", "timeout", "broken_reply", "hedge_unsent", "hedge_same_model", "hedge_other_model", "anything"]
_LEDGER = ["settle", "release", "release", "release", "release", "release", "retain", "retain", "release", "settle", "retain", "retain"]
_THEN = ["done", "cool", "retry", "disable", "stop", "retry", "retry", "stop", "done", "done", "done", "stop"]


@_r.add(f"SELECT event_id, {cases_sql('event_id', _LEDGER)} AS ledger, CASE WHEN {cases_sql('event_id', _THEN)} = 'retry' AND event_id % 5 >= 3 THEN 'give_up' ELSE {cases_sql('event_id', _THEN)} END AS next_step FROM events")
def attempt_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the reservation of each attempt, lost races of hedges among them, and what the client does next."""
    rows = table(spark, folder, "events").select("event_id", S.attempt_decision(cases("event_id", _OUTCOMES), F.col("event_id") % 5).alias("d"))
    return rows.select("event_id", "d.ledger", F.col("d.then").alias("next_step"))


@_r.add(
    "WITH RECURSIVE e AS (SELECT user_id, ts, ts - INTERVAL '6 hours' * (event_id % 3) AS sent, row_number() OVER (PARTITION BY user_id ORDER BY ts, ts - INTERVAL '6 hours' * (event_id % 3)) AS i FROM events WHERE event_type = 'error'), "
    "r AS (SELECT user_id, i, ts, ts AS last, true AS counted, 1 AS strike FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.ts, CASE WHEN e.sent >= r.last THEN e.ts ELSE r.last END, e.sent >= r.last, r.strike + CASE WHEN e.sent >= r.last THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) "
    "SELECT user_id, epoch_us(ts) AS at_us, counted, strike, CASE strike WHEN 1 THEN 1 WHEN 2 THEN 4 END AS pause FROM r"
)
def credential_strikes(spark: SparkSession, folder: str) -> DataFrame:
    """Rejections of credentials, of which those of one moment count once."""
    rows = table(spark, folder, "events").where("event_type = 'error'").select("user_id", "ts", (F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 3 * 6).cast("int"))).alias("sent"))
    return S.strikes(rows, "user_id", "sent", "ts").select("user_id", F.unix_micros("at").alias("at_us"), "counted", "strike", "pause")


_REPORT = "CASE WHEN event_id % 11 = 0 THEN 'a.fetch_deadline' WHEN event_id % 7 = 0 THEN 'b.search_limit' WHEN event_id % 5 = 0 THEN 'http' ELSE 'upstream' END"
_REPORTS = f"(SELECT user_id, event_id, event_type AS source_id, {_REPORT} AS stage FROM events)"


@_r.add(
    f"SELECT *, n_lost > 0 OR n_rate_limited > 0 AS partial, n_lost > 0 OR n_rate_limited > 0 OR n_limits > 0 AS degraded FROM (SELECT user_id, count(*) AS n_reports, count(*) FILTER (stage IN ('http', 'a.fetch_deadline')) AS n_lost, count(*) FILTER (stage = 'b.search_limit') AS n_limits, count(DISTINCT CASE WHEN stage = 'a.fetch_deadline' THEN source_id END) AS n_sources_cut, CAST(sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rate_limited FROM {_REPORTS} GROUP BY 1)"
)
def evidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What the reports of a session say of its evidence: losses, limits, sources cut off, refusals."""
    from lodesift.functions.columns import is_loss

    rows = table(spark, folder, "events").select("user_id", "event_id", F.col("event_type").alias("source_id"), F.expr(_REPORT).alias("stage"))
    return S.load_summary(rows, "user_id", is_loss(F.col("stage")), F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).cast("bigint"))


@_r.add(f"SELECT user_id, stage, count(*) AS n FROM {_REPORTS} WHERE stage IN ('http', 'a.fetch_deadline') GROUP BY 1, 2")
def loss_causes(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of each session by stage."""
    from lodesift.functions.columns import is_loss

    rows = table(spark, folder, "events").select("user_id", F.expr(_REPORT).alias("stage"))
    return rows.where(is_loss(F.col("stage"))).groupBy("user_id", "stage").agg(F.count("*").alias("n"))


@_r.add("SELECT event_id, " + cases_sql("event_id", ["failed", "busy", "partial", "complete"]) + " AS status, " + cases_sql("event_id", [1, 3, 2, 0]) + " AS exit_code FROM events")
def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Status and exit code of runs, busy ones among them."""
    k = F.col("event_id") % 4
    status, code = S.run_status(k == 0, k == 1, k == 2)
    return table(spark, folder, "events").select("event_id", status.alias("status"), code.alias("exit_code"))


@_r.add("SELECT o_custkey AS session, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 >= 4")
def check_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that claims are checked against when only selected ones count."""
    d = _documents(spark, folder)
    verdicts = d.where("id % 2 = 0").select("session", "id", F.when(F.col("probability") >= 0.4, "selected").otherwise("rejected").alias("status"))
    return S.check_scope(d, d.where("id % 3 = 0"), verdicts, "selected", "session").select("session", "id")


_WINDOWED = "SELECT user_id, epoch_us(ts) // 1000 AS at_ms, 100 AS lim, CAST(floor(value) AS BIGINT) % 101 AS remaining, (epoch_us(ts) // 3600000000 + 1) * 3600000 + event_id % 2 * 900 AS reset_ms FROM events WHERE event_id % 13 > 0"


@_r.add(f"SELECT user_id, max(reset_ms) AS reset_ms, 100 AS lim, max(greatest(lim - remaining, 0)) AS used, max(reset_ms - at_ms) AS period_ms, count(*) AS n FROM ({_WINDOWED}) GROUP BY user_id, reset_ms // 3600000")
def learned_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Request windows as replies tell of them."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, folder, "events").select("user_id", at.alias("at_ms"), F.lit(100).alias("limit"), (F.floor("value").cast("bigint") % 101).alias("remaining"), ((F.floor(at / 3_600_000) + 1) * 3_600_000 + F.col("event_id") % 2 * 900).alias("reset_ms"), (F.col("event_id") % 13 == 0).alias("one"))
    return L.learned_windows(rows, "user_id", "at_ms", "limit", "remaining", "reset_ms", "one").withColumnRenamed("limit", "lim")


_STATE = "(SELECT s_suppkey AS scope, 20 AS lim, s_suppkey % 25 AS used, 1000 + s_suppkey AS reset_ms, 600 AS period_ms, CASE WHEN s_suppkey % 6 = 0 THEN 900 + s_suppkey END AS paced_ms, CASE WHEN s_suppkey % 9 = 0 THEN 950 ELSE 0 END AS gate_ms FROM supplier WHERE s_suppkey % 8 > 0)"


def _state(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").where("s_suppkey % 8 > 0").select(
        k.alias("scope"), F.lit(20).alias("limit"), (k % 25).alias("used"), (k + 1000).alias("reset_ms"), F.lit(600).alias("period_ms"), F.when(k % 6 == 0, k + 900).alias("paced_ms"), F.when(k % 9 == 0, 950).otherwise(0).alias("gate_ms")
    )


def _demands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("booking"), F.col("l_suppkey").alias("scope"), F.col("l_quantity").cast("bigint").alias("n")).groupBy("booking", "scope").agg(F.sum("n").alias("n"))


_DEMANDS = "(SELECT l_orderkey AS booking, l_suppkey AS scope, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"
_WAIT = "greatest(0, coalesce(gate_ms - 900, 0), CASE WHEN used + least(n, lim) > lim THEN reset_ms - 900 ELSE 0 END, coalesce(paced_ms - 900, 0))"


@_r.add(f"SELECT booking, wait_ms, CASE WHEN wait_ms = 0 THEN 'booked' WHEN wait_ms <= 104 THEN 'waits' ELSE 'refused' END AS answer FROM (SELECT booking, max({_WAIT}) AS wait_ms FROM {_DEMANDS} d LEFT JOIN {_STATE} s USING (scope) GROUP BY 1)")
def window_bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Whether bookings of several scopes may have all that they demand, wait for room, or are refused."""
    return L.bookings(_demands(spark, folder), _state(spark, folder), "booking", 900, 104)


@_r.add(f"SELECT scope, CAST(used + coalesce(t, 0) AS BIGINT) AS used, CASE WHEN t > 0 THEN greatest(coalesce(paced_ms, 0), 900) + CAST(floor(t * period_ms / lim) AS BIGINT) ELSE paced_ms END AS paced_ms FROM {_STATE} LEFT JOIN (SELECT scope, CAST(sum(n) AS BIGINT) AS t FROM {_DEMANDS} WHERE booking % 20 = 0 GROUP BY 1) USING (scope)")
def booked_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows after bookings were let in, with the next one paced."""
    return L.booked(_state(spark, folder), _demands(spark, folder).where("booking % 20 = 0"), 900).select("scope", "used", "paced_ms")

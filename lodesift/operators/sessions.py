"""Sessions: pools of unspent work, recovery, calls and their budget, totals, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A session's cap in first budgets, and the route from which a source counts as promising.
BUDGETS, EXTEND_ROUTE = 3, 0.6


def held_ids(documents: DataFrame, deferred: DataFrame, by: str) -> DataFrame:
    """(by, id) of every document that a session holds, scored or not."""
    return documents.select(by, "id").unionByName(deferred.select(by, "id")).distinct()


def eligible_sources(registry: DataFrame, allowed: DataFrame, key: str = "source_id") -> DataFrame:
    """`registry` with `eligible`: sources in a scope's list, and those left out of it."""
    return registry.join(allowed.select(key, F.lit(True).alias("_in")).distinct(), key, "left").withColumn("eligible", F.coalesce("_in", F.lit(False))).drop("_in")


def classified(documents: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """(by, id, status, found) of each classified id: a verdict on a document that is not there is not found."""
    return verdicts.join(documents.select(by, "id", F.lit(True).alias("found")), [by, "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recovered(documents: DataFrame, scored: DataFrame, verdicts: DataFrame, pool: DataFrame, by: str) -> DataFrame:
    """(by, id, action) of a session that was broken off: `to_pool` for documents neither scored nor classified, `classify` for
    those scored and not classified, `leave_pool` for pool entries that are classified."""
    mark = lambda rows, name: rows.select(by, "id", F.lit(True).alias(name)).distinct()
    every = mark(documents, "_doc").join(mark(scored, "_s"), [by, "id"], "left").join(mark(verdicts, "_v"), [by, "id"], "left").join(mark(pool, "_p"), [by, "id"], "left")
    action = F.when(F.col("_v").isNotNull() & F.col("_p").isNotNull(), "leave_pool").when(F.col("_v").isNull() & F.col("_s").isNotNull(), "classify").when(F.col("_v").isNull() & F.col("_s").isNull() & F.col("_p").isNull(), "to_pool")
    return every.select(by, "id", action.alias("action")).where("action is not null")


def pools(decisions: DataFrame, registry: DataFrame, deferred: DataFrame, scores: DataFrame, by: str, selected: float = 0.4) -> DataFrame:
    """Every source of a session as a pool: its route, state, pending and scored documents, how many were selected, the best.

    `decisions` are (by, source_id, route, fetched); `deferred` and `scores` (by, source_id, ...). A source that the registry no
    longer has is `unavailable`; one not fetched is `unfetched`; one with deferred documents has an `unscored_tail`.
    """
    known = registry.select("source_id", F.lit(True).alias("_r")).distinct()
    tails = deferred.groupBy(by, "source_id").agg(F.count("*").alias("pending"))
    stats = scores.groupBy(by, "source_id").agg(F.count("*").alias("scored"), F.count_if(F.col("probability") >= selected).alias("selected"), F.max("probability").alias("best"))
    found = decisions.join(known, "source_id", "left").join(tails, [by, "source_id"], "left").join(stats, [by, "source_id"], "left")
    state = F.when(F.col("_r").isNull(), "unavailable").when(~F.col("fetched"), "unfetched").when(F.col("pending") > 0, "unscored_tail").otherwise("spent")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return found.select(by, "source_id", "route", "fetched", state.alias("state"), zero("pending"), zero("scored"), zero("selected"), "best")


def open_pools(found: DataFrame) -> DataFrame:
    """Pools with work left."""
    return found.where(F.col("state").isin("unfetched", "unscored_tail"))


def actionable(state: Column, route: Column, best: Column, uncertain: float = 0.15) -> Column:
    """Whether spending a pool promises anything: a route worth it, or a tail whose source has shown something."""
    return F.coalesce(((state == "unfetched") & (route >= EXTEND_ROUTE)) | ((state == "unscored_tail") & ((best >= uncertain) | (route >= EXTEND_ROUTE))), F.lit(False))


def pool_summary(found: DataFrame, by: str) -> DataFrame:
    """(by, unfetched, unscored_tail, unavailable, best_route, best_tail, actionable)."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return found.groupBy(by).agg(
        count("unfetched"), count("unscored_tail"), count("unavailable"), F.max(F.when(F.col("state") == "unfetched", F.col("route"))).alias("best_route"),
        F.max(F.when(F.col("state") == "unscored_tail", F.col("best"))).alias("best_tail"), F.count_if(actionable(F.col("state"), F.col("route"), F.col("best"))).alias("actionable"),
    )


def pool_order(found: DataFrame, by: str, ordinal: str) -> DataFrame:
    """Pools by route, best first, ties in the order of the registry; a session has as many rows as the registry."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("route"), ordinal)))


def asked_pools(asked: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, source_id, answer) of pools that a call asks for: `spend`, `spent`, `unavailable` or `unknown`."""
    known = found.select(by, "source_id", "state")
    answer = F.when(F.col("state").isNull(), "unknown").when(F.col("state") == "unavailable", "unavailable").when(F.col("state") == "spent", "spent").otherwise("spend")
    return asked.select(by, "source_id").distinct().join(known, [by, "source_id"], "left").select(by, "source_id", answer.alias("answer"))


def fetched(decisions: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """`decisions` with the sources of a call marked as fetched."""
    now = sources.select(by, "source_id", F.lit(True).alias("_now")).distinct()
    return decisions.join(now, [by, "source_id"], "left").withColumn("fetched", F.col("fetched") | F.coalesce("_now", F.lit(False))).drop("_now")


def call_numbers(calls: DataFrame, by: str, order: str) -> DataFrame:
    """`calls` numbered from 1 in each session."""
    return calls.withColumn("call", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def retrieved_index(documents: DataFrame, by: str) -> DataFrame:
    """(by, source_id, id, call): the first call that brought each document."""
    return documents.groupBy(by, "source_id", "id").agg(F.min("call").alias("call"))


def budgets(calls: DataFrame, by: str, order: str, first: str, outcome: str, used: str, allowance: str) -> DataFrame:
    """`calls` with charged, spent and left: what each call of a session costs and what it leaves of the cap, three first budgets.

    A call that was stopped is charged its whole allowance. A session's calls are few, so they are one window.
    """
    charged = F.when(F.col(outcome) == "stopped", F.col(allowance)).otherwise(F.col(used))
    session = Window.partitionBy(by).orderBy(order)
    rows = calls.withColumn("charged", charged).withColumn("spent", F.sum("charged").over(session.rowsBetween(Window.unboundedPreceding, 0)))
    cap = F.first(F.col(first)).over(session.rowsBetween(Window.unboundedPreceding, 0)) * BUDGETS
    return rows.withColumn("left", F.greatest(cap - F.col("spent"), F.lit(0)))


def totals(calls: DataFrame, requests: DataFrame, by: str) -> DataFrame:
    """(by, host, n_calls, n_requests): calls of a session and its requests to each host."""
    n = calls.groupBy(by).agg(F.count("*").alias("n_calls"))
    return requests.groupBy(by, "host").agg(F.sum("n").alias("n_requests")).join(n, by)


def first_requests(chosen: DataFrame, scopes: DataFrame, by: str) -> DataFrame:
    """(by, scope, n): requests that the chosen sources send first to each limited scope."""
    return chosen.join(scopes, "source_id").groupBy(by, "scope").agg(F.count("*").alias("n"))


def text_name(ident: Column) -> Column:
    """The name of the file of a text that isn't in a report."""
    return F.left(F.sha2(ident.cast("string").cast("binary"), 256), F.lit(12))


def corrected_sources(rows: DataFrame, connector: str, said: str) -> DataFrame:
    """`rows` with the source that brought them, whatever they say, and `report` where they said another."""
    wrong = ~F.col(said).eqNullSafe(F.col(connector))
    return rows.withColumn("report", F.when(wrong, "provenance")).withColumn(said, F.col(connector))


def missing_keys(sources: DataFrame, needed: DataFrame, present: DataFrame) -> DataFrame:
    """(source_id, missing, ready): the keys that a source needs and the settings lack, in order and joined."""
    have = present.select("key", F.lit(True).alias("_h")).distinct()
    lacks = needed.join(have, "key", "left").where("_h is null").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("missing"))
    found = sources.select("source_id").join(lacks, "source_id", "left")
    return found.select("source_id", F.coalesce("missing", F.lit("")).alias("missing"), F.col("missing").isNull().alias("ready"))


def artifacts(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """(folder, n_files, n_bytes) of (path, length), as the `binaryFile` reader lists them."""
    return files.groupBy(F.regexp_replace(F.col(path), "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def idle(sessions: DataFrame, active_at: str, now: Column, days: int = 30, locked: str | None = None) -> DataFrame:
    """`sessions` with `prune`: idle for more than `days` and not in use."""
    old = F.unix_seconds(F.col(active_at).cast("timestamp")) < now - days * 86_400
    return sessions.withColumn("prune", old & ~F.coalesce(F.col(locked), F.lit(False)) if locked else old)


def usage_sum(rows: DataFrame, by: tuple[str, ...], fields: tuple[str, ...], counts: str, window: Column | None = None) -> DataFrame:
    """(by, name, value): usage summed field by field, and the map `counts` key by key as `counts.key`, over the rows in `window`."""
    some = rows.where(window) if window is not None else rows
    each = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("bigint").alias("value")) for f in fields])
    more = F.transform(F.map_entries(counts), lambda e: F.struct(F.concat(F.lit(f"{counts}."), e["key"]).alias("name"), e["value"].cast("bigint").alias("value")))
    found = some.select(*by, F.explode(F.concat(each, F.coalesce(more, F.array().cast("array<struct<name:string,value:bigint>>")))).alias("e"))
    return found.groupBy(*by, "e.name").agg(F.sum("e.value").alias("value"))


def attempt_decision(outcome: Column, attempt: Column, most: int = 3) -> Column:
    """(ledger, then) of an attempt: what becomes of its reservation, and what the client does next."""
    rows = (
        ("answered", "settle", "done"), ("rate_limited", "release", "cool"), ("never_sent", "release", "retry"), ("rejected_credentials", "release", "disable"), ("out_of_credit", "release", "stop"),
        ("server_error", "release", "retry"), ("timeout", "retain", "retry"), ("broken_reply", "retain", "stop"), ("hedge_unsent", "release", "done"), ("hedge_same_model", "settle", "done"), ("hedge_other_model", "retain", "done"),
    )
    ledger, then = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, a, b in rows:
        ledger, then = ledger.when(outcome == name, a), then.when(outcome == name, b)
    last = (then.otherwise("stop") == "retry") & (attempt >= most)
    return F.struct(ledger.otherwise("retain").alias("ledger"), F.when(last, "give_up").otherwise(then.otherwise("stop")).alias("then"))


def strikes(rows: DataFrame, by: str, sent: str, at: str) -> DataFrame:
    """`rows` of rejected credentials with `counted`, `strike` and `pause`: rejections of requests sent before the latest counted one
    was known are the same strike. The first two strikes pause 1 s and 4 s, the third is final (null).

    Rejections are rare: a provider has three before it is disabled, so that a fold by provider stays small.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(sent).alias("sent")))), lambda x: x)
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.array().cast("array<struct<at:timestamp,sent:timestamp,counted:boolean,strike:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        counts = acc["last"].isNull() | (x["sent"] >= acc["last"])
        n = F.coalesce(F.get(acc["out"], F.size(acc["out"]) - 1)["strike"], F.lit(0)) + counts.cast("int")
        return F.struct(F.when(counts, x["at"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), x["sent"].alias("sent"), counts.alias("counted"), n.alias("strike")))).alias("out"))

    found = rows.withColumns({at: F.col(at).cast("timestamp"), sent: F.col(sent).cast("timestamp")}).groupBy(by).agg(F.aggregate(ordered, start, step)["out"].alias("o"))
    return found.select(by, F.explode("o").alias("e")).select(by, "e.*", F.when(F.col("e.strike") == 1, 1).when(F.col("e.strike") == 2, 4).alias("pause"))


def load_summary(reports: DataFrame, by: str, loss: Column, limited: Column) -> DataFrame:
    """(by, n_reports, n_lost, n_limits, n_sources_cut, partial, degraded): what a session's reports say of its evidence."""
    cut = F.count_distinct(F.when(F.element_at(F.split("stage", r"\."), -1) == "fetch_deadline", F.col("source_id")))
    found = reports.groupBy(by).agg(F.count("*").alias("n_reports"), F.count_if(loss).alias("n_lost"), F.count_if(F.element_at(F.split("stage", r"\."), -1) == "search_limit").alias("n_limits"), cut.alias("n_sources_cut"), F.coalesce(F.sum(limited), F.lit(0)).alias("n_rate_limited"))
    partial = (F.col("n_lost") > 0) | (F.col("n_rate_limited") > 0)
    return found.withColumn("partial", partial).withColumn("degraded", partial | (F.col("n_limits") > 0))


def run_status(failed: Column, busy: Column, partial: Column) -> tuple[Column, Column]:
    """(status, exit code) of a run: complete 0, failed 1, partial 2, busy 3."""
    status = F.when(failed, "failed").when(busy, "busy").when(partial, "partial").otherwise("complete")
    return status, F.when(failed, 1).when(busy, 3).when(partial, 2).otherwise(0)


def check_scope(documents: DataFrame, scored: DataFrame, verdicts: DataFrame, scope: str, by: str) -> DataFrame:
    """The documents that claims are checked against: `selected` ones, all `scored` ones, or `all` that are held."""
    keys = {"selected": lambda: verdicts.where("status = 'selected'"), "scored": lambda: scored}
    if scope == "all":
        return documents
    if scope not in keys:
        raise ValueError("scope must be selected, scored or all")
    return documents.join(keys[scope]().select(by, "id").distinct(), [by, "id"], "left_semi")

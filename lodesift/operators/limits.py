"""Rate limits over a log of requests: fixed windows, closed gates, deadlines, token buckets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.operators.running import blocks, running, spans


def window_limit(rows: DataFrame, by: str, at: str, ident: str, period: str, limit: int) -> DataFrame:
    """`rows` with window_start, used and allowed: requests counted in fixed windows, `limit` allowed in each.

    A window's requests are counted in pieces of ten minutes, so that a busy key is not one task's sort.
    """
    start = F.window(F.col(at).cast("timestamp"), period)["start"]
    rows = rows.withColumn("window_start", start.cast("timestamp_ntz"))
    rows = running(rows, "used", F.lit(1).cast("bigint"), (by, "window_start"), (at, ident), spans(at, 600))
    return rows.withColumn("allowed", F.col("used") <= limit)


def rolled_windows(rows: DataFrame, by: str, at_ms: str, ident: str, reset_ms: str, period_ms: str, limit: str, bucket: Column | None = None) -> DataFrame:
    """`rows` with epoch, window_reset_ms, used and allowed: requests counted in windows that roll by whole periods.

    A key's first window ends at its `reset_ms`, epoch 0, whenever it has begun. A request at or after an end is in the window that as many
    whole periods later ends after it. Each window counts from nothing; the first `limit` of it are allowed.
    """
    late = F.floor((F.col(at_ms) - F.col(reset_ms)) / F.col(period_ms)) + 1
    epoch = F.when(F.col(at_ms) < F.col(reset_ms), F.lit(0)).otherwise(late).cast("bigint")
    rows = rows.withColumn("epoch", epoch).withColumn("window_reset_ms", F.col(reset_ms) + F.col("epoch") * F.col(period_ms))
    pieces = blocks(at_ms, 60_000) if bucket is None else bucket
    found = running(rows, "used", F.lit(1).cast("bigint"), (by, "epoch"), (at_ms, ident), pieces)
    return found.withColumn("allowed", F.col("used") <= F.col(limit))


def gates(rows: DataFrame, by: str, at: str, ident: str, refused, seconds: int | Column = 10) -> DataFrame:
    """`rows` with `closed`: whether a refusal before has closed the gate, each for its `seconds`; of several the latest end holds."""
    wait = seconds if isinstance(seconds, Column) else F.lit(seconds)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    until = F.when(refused, micros + (wait * 1_000_000).cast("bigint"))
    rows = running(rows, "_until", until, (by,), (at, ident), spans(at), "max", own=False)
    return rows.withColumn("closed", F.coalesce(micros < F.col("_until"), F.lit(False))).drop("_until")


def token_bucket(rows: DataFrame, by: str, at_ms: str, per_minute: int) -> DataFrame:
    """(by, at_ms, granted, tokens): a bucket for each key, folded in the order of time.

    Capacity is ten seconds' worth, one at least; it starts full. The fold reads a key's rows in order, in Arrow batches
    from a sorted partition, and holds one number for each key.
    """
    capacity, rate = max(per_minute / 60 * 10, 1.0), per_minute / 60_000

    def fold(batches):
        key, last, tokens = None, 0, capacity
        for pdf in batches:
            granted, left = [], []
            for k, t in zip(pdf[by], pdf[at_ms]):
                if k != key:
                    key, last, tokens = k, t, capacity
                tokens, last = min(tokens + (t - last) * rate, capacity), t
                granted.append(tokens >= 1)
                tokens -= granted[-1]
                left.append(round(tokens, 9))
            yield pd.DataFrame({by: pdf[by], at_ms: pdf[at_ms], "granted": granted, "tokens": left})

    kind = rows.schema[by].dataType.simpleString()
    ordered = rows.select(by, F.col(at_ms).cast("bigint").alias(at_ms)).repartition(by).sortWithinPartitions(by, at_ms)
    return ordered.mapInPandas(fold, f"{by} {kind}, {at_ms} bigint, granted boolean, tokens double")


def learned_windows(replies: DataFrame, by: str, at_ms: str, limit: str, remaining: str, reset_ms: str, instance_scoped: str | None = None, tolerance: int = 2_000) -> DataFrame:
    """(by, reset_ms, limit, used, period_ms, n): the request windows that replies tell of.

    Replies whose resets lie within `tolerance` of one another are of one window: its reset and its length are the largest, its
    limit is that of the last reply, and what is used is the largest count. Replies with a reset that is past, without a limit, or of
    one instance only say nothing. First equal resets are folded, so that what is sorted for a key is its distinct resets.
    """
    some = replies.where((F.col(reset_ms) > F.col(at_ms)) & (F.col(limit) > 0))
    if instance_scoped:
        some = some.where(~F.coalesce(F.col(instance_scoped), F.lit(False)))
    used = F.greatest(F.col(limit) - F.coalesce(F.col(remaining), F.col(limit)), F.lit(0))
    said = some.groupBy(by, reset_ms).agg(F.max(used).alias("_used"), F.max(F.col(reset_ms) - F.col(at_ms)).alias("_period"), F.max(F.struct(F.col(at_ms), F.col(limit))).alias("_last"), F.count("*").alias("_n"))
    order = Window.partitionBy(by).orderBy(reset_ms)
    apart = F.coalesce(F.col(reset_ms) - F.lag(reset_ms).over(order) > tolerance, F.lit(True))
    said = said.withColumn("_new", apart.cast("int")).withColumn("_island", F.sum("_new").over(order))
    found = said.groupBy(by, "_island").agg(F.max(reset_ms).alias("reset_ms"), F.max("_last").alias("_last"), F.max("_used").alias("used"), F.max("_period").alias("period_ms"), F.sum("_n").alias("n"))
    return found.select(by, "reset_ms", F.col("_last")[limit].alias("limit"), "used", "period_ms", "n")


def bookings(demands: DataFrame, state: DataFrame, by: str, now: int, patience: int | None = None) -> DataFrame:
    """(by, wait_ms, answer): whether each booking may have all that it demands now, each on its own against the `state`.

    `demands` are (by, scope, n), `state` (scope, limit, used, reset_ms, period_ms, paced_ms, gate_ms). A booking waits for the longest
    of its scopes: a closed gate, no room in the window (more than a window holds counts as a whole one), or pacing. `booked`
    without a wait, `waits` within `patience`, else `refused`. A scope without a state has no limit.
    """
    room = F.when(F.col("used") + F.least("n", "limit") > F.col("limit"), F.col("reset_ms") - now).otherwise(0)
    wait = F.greatest(F.lit(0), F.coalesce(F.col("gate_ms") - now, F.lit(0)), F.coalesce(room, F.lit(0)), F.coalesce(F.col("paced_ms") - now, F.lit(0)))
    found = demands.join(state, "scope", "left").groupBy(by).agg(F.max(wait).cast("bigint").alias("wait_ms"))
    later = F.lit(True) if patience is None else F.col("wait_ms") <= patience
    return found.withColumn("answer", F.when(F.col("wait_ms") == 0, "booked").when(later, "waits").otherwise("refused"))


def booked(state: DataFrame, demands: DataFrame, now: int) -> DataFrame:
    """`state` after the `demands` of bookings that were let in: more used, and the next one paced evenly over the window."""
    taken = demands.groupBy("scope").agg(F.sum("n").alias("_n"))
    found = state.join(taken, "scope", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    paced = F.greatest(F.coalesce("paced_ms", F.lit(0)), F.lit(now)) + F.floor(F.col("_n") * F.col("period_ms") / F.col("limit"))
    return found.withColumn("paced_ms", F.when(F.col("_n") > 0, paced).otherwise(F.col("paced_ms")).cast("bigint")).withColumn("used", F.col("used") + F.col("_n")).drop("_n")

"""Rollups over logs and pools: percentiles, streaks, load, usage, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.operators.running import blocks, cuts, even_pieces, running, spans


def percentiles(rows: DataFrame, value: str, by: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(by, n, p50, ...): the value at index round((n - 1) * share) of each group's sorted values.

    Equal values are counted first, so a group moves its distinct values and not its rows; their running counts are made
    in pieces that the values' own percentiles bound.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(F.col(by).alias("_k")).agg(F.sum("c").alias("n"))
    placed = running(counts, "upto", F.col("c"), (by,), (value,), cuts(counts, F.col(value))).join(totals, F.col(by).eqNullSafe(F.col("_k")))
    at = lambda p: F.round((F.col("n") - 1) * p) + 1
    return placed.groupBy(by, "n").agg(*[F.min(F.when(F.col("upto") >= at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def streaks(rows: DataFrame, by: str, order: tuple[str, ...], failed: Column, bucket: Column | None = None) -> DataFrame:
    """`rows` with `streak`: failures in a row up to and with this one; 0 after a success.

    The order is cut into pieces (`bucket`, by default even ones of a key's span of its first column, a time). A piece is summed up
    as its failures, those after its last success, and whether it has one; these fold over a key once, and each row adds what
    its piece begins with to its own count, so that no key is one task's sort.
    """
    rows = rows.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("bigint"))
    if bucket is None:
        rows = even_pieces(rows, "_p", (by,), F.unix_micros(F.col(order[0]).cast("timestamp")))
    else:
        rows = rows.withColumn("_p", bucket)
    inside = Window.partitionBy(by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum("_f").over(inside)).withColumn("_m", F.max(F.when(F.col("_f") == 0, F.col("_n"))).over(inside))
    sums = rows.groupBy(by, "_p").agg(F.max("_n").alias("_all"), F.max("_m").alias("_last"))
    earlier = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    # Failures up to the last success of any earlier piece; what came after it is carried into this one.
    reset = F.max(F.col("_before") + F.col("_last")).over(earlier)
    sums = sums.select(F.col(by).alias("_k"), F.col("_p").alias("_q"), (F.col("_before") - F.coalesce(reset, F.lit(0))).alias("_carried"))
    found = rows.join(sums, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    streak = F.when(F.col("_m").isNull(), F.col("_n") + F.col("_carried")).otherwise(F.col("_n") - F.col("_m"))
    return found.withColumn("streak", streak.cast("bigint")).drop("_f", "_p", "_n", "_m", "_k", "_q", "_carried")


def peak_in_flight(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, peak): the most intervals [start, end) open at once; an end comes before a start at the same time."""
    steps = rows.select(by, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(rows.select(by, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = steps.groupBy(by, "at", "d").agg(F.sum("d").alias("d_sum"))
    return running(steps, "open", F.col("d_sum"), (by,), ("at", "d"), spans("at")).groupBy(by).agg(F.max("open").alias("peak"))


def load_summary(rows: DataFrame, by: str, stage: str) -> DataFrame:
    """(by, n_reports, n_losses, n_search_limits, degraded): reports of a run."""
    loss, limit = C.is_loss(F.col(stage)), F.element_at(F.split(stage, r"\."), -1) == "search_limit"
    found = rows.groupBy(by).agg(F.count("*").alias("n_reports"), F.count_if(loss).alias("n_losses"), F.count_if(limit).alias("n_search_limits"))
    return found.withColumn("degraded", (F.col("n_losses") > 0) | (F.col("n_search_limits") > 0))


def pool_stats(rows: DataFrame, by: str = "source_id") -> DataFrame:
    """(by, n_scored, n_selected, best): what the scored documents of a pool say."""
    chosen = C.status(F.col("probability")) == "selected"
    return rows.groupBy(by).agg(F.count("probability").alias("n_scored"), F.count_if(chosen).alias("n_selected"), F.max("probability").alias("best"))


def line_offsets(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """`rows` with n_lines and first_line: where each text starts when they are bundled in order."""
    lines = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("bigint")
    rows = rows.withColumn("n_lines", lines)
    return running(rows, "first_line", F.col("n_lines"), (by,), (order,), blocks(order), own=False).withColumn("first_line", F.col("first_line") + 1)


def usage_report(rows: DataFrame, by: str, at: str, failed: str, size: str, host: str, first_day: str, end_day: str) -> DataFrame:
    """(by, n_calls, n_days, n_failed, n_bytes, hosts) of the calls from a first day up to, and without, another."""
    some = rows.where((F.col(at) >= F.lit(first_day).cast("timestamp")) & (F.col(at) < F.lit(end_day).cast("timestamp")))
    return some.groupBy(by).agg(
        F.count("*").alias("n_calls"), F.count_distinct(F.col(at).cast("date")).alias("n_days"), F.count_if(failed).alias("n_failed"),
        F.sum(F.col(size).cast("bigint")).alias("n_bytes"), F.array_join(F.array_sort(F.collect_set(host)), " ").alias("hosts"),
    )

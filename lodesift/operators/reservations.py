"""A budget with reservations that are open for a while: what is accounted after each event, and where spending stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators.rollups import streaks
from lodesift.operators.running import blocks, running_sums


def reservations(rows: DataFrame, by: str, order: tuple[str, ...], kind: str, reserved: str, cost: str, budget: int, stop_after: int = 3, bucket: Column | None = None) -> DataFrame:
    """`rows` with open, settled, retained, accounted, in_flight and state, from events in the order of `order`.

    `reserve` opens a reservation; `settle` replaces it by its cost, `release` gives it back (the call never ran), `retain` keeps it
    whole (nobody knows what the call has cost). Every end row has the `reserved` amount of its own reservation. A key stops at its first
    event of these, which is its `state` there, and rows after it are `stopped`: a reservation that would go over the budget is `refused`; a settlement that
    ends over it is `overspent`; the `stop_after`-th retained call in a row, without a settled one between, is `unresolved`. Rows
    before it are `open`. What a stopped key's rows add is still shown, as if it went on.

    The sums are made in pieces of the order (`bucket`), all in one pass; the first stop is one row a key.
    """
    is_ = lambda *k: F.col(kind).isin(*k)
    amount, spent = F.coalesce(F.col(reserved), F.lit(0)).cast("bigint"), F.coalesce(F.col(cost), F.lit(0)).cast("bigint")
    pieces = blocks(order[0]) if bucket is None else bucket
    ends = is_("settle", "release", "retain")
    sums = {
        "open": F.when(is_("reserve"), amount).when(ends, -amount).otherwise(0), "settled": F.when(is_("settle"), spent).otherwise(0),
        "retained": F.when(is_("retain"), amount).otherwise(0), "in_flight": F.when(is_("reserve"), 1).when(ends, -1).otherwise(0).cast("bigint"),
    }
    found = running_sums(rows, sums, (by,), order, pieces).withColumn("accounted", F.col("open") + F.col("settled") + F.col("retained"))
    over = F.col("accounted") > budget
    cause = F.when(over & is_("reserve"), "refused").when(over & is_("settle"), "overspent")
    place = F.struct(*order)
    here = found.select(F.col(by).alias("_k"), place.alias("_at"), cause.alias("_why")).where("_why is not null")
    # Of ended calls only, how many in a row were retained.
    ended = streaks(rows.where(is_("settle", "retain")), by, order, is_("retain"), pieces).where(F.col("streak") >= stop_after)
    here = here.unionByName(ended.select(F.col(by).alias("_k"), place.alias("_at"), F.lit("unresolved").alias("_why")))
    first = here.groupBy("_k").agg(F.min(F.struct("_at", "_why")).alias("_first"))
    found = found.join(first, F.col(by).eqNullSafe(F.col("_k")), "left")
    stop = F.col("_first._at")
    state = F.when(stop.isNull() | (place < stop), "open").when(place == stop, F.col("_first._why")).otherwise("stopped")
    return found.withColumn("state", state).drop("_k", "_first")

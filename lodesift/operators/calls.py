"""Calls to a scorer as data: the running ledger, validity of passes, reads of originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.operators.running import blocks, running

#: Fixed value: tokens that are reserved for a call before its size is known.
RESERVED = 65_536


def ledger(rows: DataFrame, by: str, order: tuple[str, ...], outcome: str, used: str, nanos_per_10: int, budget: int, bucket: Column | None = None) -> DataFrame:
    """`rows` with delta, accounted and stopped: what each finished call adds to the cost of its provider, in nanos.

    settled: the cost of the tokens used; released (never run): nothing; retained (unknown): the whole reservation.
    `stopped` says that the budget was passed before the row, or that the row passed it or used more than was reserved.
    """
    price = lambda t: C.cost_nanos(t, F.lit(nanos_per_10))
    delta = F.when(F.col(outcome) == "settled", price(F.col(used))).when(F.col(outcome) == "retained", price(F.lit(RESERVED))).otherwise(F.lit(0)).cast("bigint")
    pieces = bucket if bucket is not None else blocks(order[0])
    found = running(rows.withColumn("delta", delta), "accounted", F.col("delta"), (by,), order, pieces)
    return found.withColumn("stopped", (F.col("accounted") > budget) | ((F.col(outcome) == "settled") & (F.col(used) > RESERVED)))


def pass_validity(rows: DataFrame, by: str, ident: str, probability: str, registry: DataFrame) -> DataFrame:
    """(by, n, n_distinct, valid): a pass is valid if it names every source of the `registry` (of column `ident`) once, no other,
    and each with a probability from 0 to 1."""
    known = registry.select(F.col(ident).alias("_known")).distinct()
    total = known.agg(F.count("_known")).scalar()
    bad = F.count_if(~F.coalesce(F.col(probability).between(0, 1) & ~F.isnan(probability), F.lit(False)))
    found = rows.join(known, F.col(ident) == F.col("_known"), "left").groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(ident).alias("n_distinct"), bad.alias("_bad"), F.count_distinct("_known").alias("_named"))
    valid = (F.col("n") == F.col("n_distinct")) & (F.col("n") == F.col("_named")) & (F.col("_named") == total) & (F.col("_bad") == 0)
    return found.withColumn("valid", valid).drop("_bad", "_named")


def best_routes(passes: DataFrame, registry: DataFrame, by: str, lens: str, ident: str, probability: str, selected: float = 0.15, fetched: float = 0.4) -> DataFrame:
    """(by, ident, route, lens, n_passes, selected, fetch_now): the best probability of each source over the valid passes of a question.

    A pass is the rows of one lens of one question, and counts as a whole or not at all. Of equal probabilities the first lens by name is told.
    A question without a valid pass has no routes.
    """
    key = F.struct(by, lens)
    ok = pass_validity(passes.withColumn("_pass", key), "_pass", ident, probability, registry).where("valid").select("_pass")
    held = passes.withColumn("_pass", key).join(ok, "_pass", "left_semi")
    best = F.max_by(F.col(lens), F.struct(F.col(probability).alias("p"), F.transform(F.split(F.col(lens), ""), lambda c: -F.ascii(c)).alias("o")))
    found = held.groupBy(by, ident).agg(F.max(probability).alias("route"), best.alias(lens), F.count("*").alias("n_passes"))
    return found.withColumn("selected", F.col("route") >= selected).withColumn("fetch_now", F.col("route") >= fetched)


def reused(rows: DataFrame, call: str, key: tuple[str, ...], ident: str = "id") -> DataFrame:
    """`rows` with decision and scored_in: `reuse` where an earlier call holds the same key, `copy` where the row is not the
    first of its call and key, else `score`; and the call whose score counts.

    Keys are compared column by column, so that no joined text can mix them up. A null in a key is a value.
    """
    first = rows.groupBy(*key).agg(F.min(F.struct(call, ident)).alias("_f"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    found = rows.join(first.select("_f", *[F.col(c).alias(f"_{c}") for c in key]), same).drop(*[f"_{c}" for c in key])
    decision = F.when(F.col("_f")[call] < F.col(call), "reuse").when(F.col("_f")[ident] < F.col(ident), "copy").otherwise("score")
    return found.withColumn("decision", decision).withColumn("scored_in", F.col("_f")[call]).drop("_f")


def original_reads(rows: DataFrame, by: str, per_call: int = 4, per_session: int = 12, charged: Column | None = None) -> DataFrame:
    """`rows` (by, id, url, route) that are read: one for each page, best route first, with `place`.

    URLs are equal without their fragment. What the session has already `charged` counts against its limit.
    """
    page = F.regexp_replace("url", "#.*$", "")
    rows = rows.where("url <> ''").withColumn("page", page)
    best = rows.groupBy(by, "page").agg(F.max_by(F.struct("id", "route"), F.struct("route", (-F.col("id")).alias("o"))).alias("_b"))
    best = best.select(by, "page", "_b.id", "_b.route")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("route"), "id"))
    room = F.greatest(F.lit(per_session) - (charged if charged is not None else F.lit(0)), F.lit(0))
    return best.withColumn("place", place).where(F.col("place") <= per_call).where(F.col("place") <= room)

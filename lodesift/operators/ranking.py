"""Ranking: competition ranks, weighted reciprocal-rank fusion, buckets and final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.operators.running import even_pieces, running

#: Weights of relevance, currentness, recency and authority by the kind of question.
WEIGHTS = {
    "current": (1.0, 1.0, 0.6, 0.5),
    "comparative": (1.0, 0.6, 0.2, 0.5),
    "versioned": (1.0, 0.7, 0.4, 0.6),
    "versioned_other": (1.0, 0.5, 0.3, 0.6),
    "timeless": (1.0, 0.0, 0.0, 0.3),
}
#: Fixed value: what is added to a rank before it is inverted.
OFFSET = 10


def _positions(rows: DataFrame, criteria: tuple[str, ...], by: str) -> DataFrame:
    """(_q, _c, _v, _rank): the competition rank of each value of each criterion, in one pass over all of them.

    Equal values are counted first, then counts are summed in pieces of the order, so that no large group is one task's sort. A missing value is a value too and gets the middle of the known, floor(known / 2) + 1.
    """
    counts = _long(rows, criteria, by).groupBy("_q", "_c", "_v").agg(F.count("*").alias("_n"))
    counts = even_pieces(counts, "_p", ("_q", "_c"), -F.col("_v"))
    known = F.when(F.col("_v").isNotNull(), F.col("_n"))
    group = Window.partitionBy("_q", "_c")
    pieces = counts.groupBy("_q", "_c", "_p").agg(F.sum(known).alias("_k"))
    before = F.sum("_k").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(F.col("_q").alias("_q2"), F.col("_c").alias("_c2"), F.col("_p").alias("_p2"), F.coalesce(before, F.lit(0)).alias("_before"), F.coalesce(F.sum("_k").over(group), F.lit(0)).alias("_known"))
    inside = F.sum(known).over(Window.partitionBy("_q", "_c", "_p").orderBy(F.desc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    found = counts.join(pieces, F.col("_q").eqNullSafe(F.col("_q2")) & (F.col("_c") == F.col("_c2")) & (F.col("_p") == F.col("_p2")))
    rank = F.when(F.col("_v").isNull(), F.floor(F.col("_known") / 2) + 1).otherwise(F.col("_before") + F.col("_inside") + 1)
    return found.select("_q", "_c", "_v", rank.cast("bigint").alias("_rank"))


def _long(rows: DataFrame, criteria: tuple[str, ...], by: str, *more: str) -> DataFrame:
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(criteria)])
    return rows.select(*more, F.col(by).alias("_q"), F.explode(values).alias("_x")).select(*more, "_q", F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v"))


def positions(rows: DataFrame, criteria: tuple[str, ...], by: str = "question_id") -> DataFrame:
    """`rows` with `<criterion>_rank` for each: its competition rank, largest first; a missing value is in the middle of the known.

    Criteria become rows (group, criterion, value), are ranked in one pass and come back by the row that they were of.
    """
    ranks = _positions(rows, criteria, by).select(F.col("_q").alias("_q3"), F.col("_c").alias("_c3"), F.col("_v").alias("_v3"), "_rank")
    # Rows are numbered before their criteria become rows.
    long = _long(rows.select("*", F.struct(*rows.columns).alias("_row"), F.monotonically_increasing_id().alias("_id")), criteria, by, "_row", "_id")
    met = long.join(ranks, F.col("_q").eqNullSafe(F.col("_q3")) & (F.col("_c") == F.col("_c3")) & F.col("_v").eqNullSafe(F.col("_v3")))
    each = [F.max(F.when(F.col("_c") == i, F.col("_rank"))).alias(f"{c}_rank") for i, c in enumerate(criteria)]
    back = met.groupBy("_id").agg(F.first("_row").alias("_row"), *each)
    return back.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], *[f"{c}_rank" for c in criteria])


def ranked(rows: DataFrame, value: str, by: str = "question_id") -> DataFrame:
    """`rows` with `<value>_rank`; see `positions`."""
    return positions(rows, (value,), by)


def fused(rows: DataFrame, criteria: tuple[str, ...], weights: tuple[float, ...], by: str = "question_id") -> DataFrame:
    """`rows` with a rank for each criterion and `fused`, the sum of weight / (10 + rank) in the order of the criteria."""
    total = F.lit(0.0)
    for c, w in zip(criteria, weights):
        total = total + F.lit(float(w)) / (F.lit(OFFSET) + F.col(f"{c}_rank"))
    return positions(rows, criteria, by).withColumn("fused", total)


def bucket(intent: Column, confidence: Column, still_current: Column) -> Column:
    """1 for what is still current where the question is about the present with confidence 0.6 or more; else 2."""
    asks = (intent == "current") & (confidence >= 0.6)
    return F.when(asks & (F.coalesce(still_current, F.lit(0.0)) >= 0.5), 1).otherwise(2)


def ordered(rows: DataFrame, order: tuple, pieces: Column, by: str = "question_id") -> DataFrame:
    """`rows` with `place`, from 1 in each group in this order; `pieces` never fall along it and are counted apart."""
    return running(rows, "place", F.lit(1).cast("bigint"), (by,), order, pieces)


def final_order(rows: DataFrame, by: str = "question_id", width: int = 4_096) -> DataFrame:
    """`rows` with `place`: by bucket, then fused score, then id.

    The inverse of a fused score grows about as the rank does, so pieces of `width` of it hold about as many rows each, and no
    percentiles are needed.
    """
    piece = F.col("bucket") * F.lit(1 << 40) + F.floor(F.lit(1.0) / F.col("fused") / width)
    return ordered(rows, ("bucket", F.desc("fused"), "id"), piece, by)


def top(rows: DataFrame, most: int, *order, by: str = "question_id") -> DataFrame:
    """The first `most` rows of each group with their `place`, of which each task keeps no more before the shuffle; all if `most` is 0."""
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return rows.where(F.col("place") <= most) if most else rows


def newest(rows: DataFrame, by: str, today: int, kinds: tuple[str, ...]) -> DataFrame:
    """(by, kind, days) of each group of candidates (by, ord, kind, days).

    The newest date of a kind that drives recency, up to tomorrow (the later candidate on equal days); without one, the
    first candidate of another kind.
    """
    drives = F.col("kind").isin(*kinds) & (F.col("days") <= today + 1)
    other = ~F.col("kind").isin(*kinds)
    found = rows.where("days is not null").groupBy(by).agg(
        F.max_by(F.struct("kind", "days"), F.when(drives, F.struct("days", "ord"))).alias("newest"),
        F.min_by(F.struct("kind", "days"), F.when(other, F.col("ord"))).alias("first"),
    )
    best = F.coalesce("newest", "first")
    return found.select(by, best["kind"].alias("kind"), best["days"].alias("days"))

"""Running sums and maxima of groups that are too large for one task's sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, name: str, value: Column, by: tuple[str, ...], order: tuple[str, ...], bucket: Column, of: str = "sum", own: bool = True) -> DataFrame:
    """`rows` with `name`: the sum or max (`of`) of `value` over a row's group up to the row, without it unless `own`.

    `bucket` cuts the order into pieces and never falls along it. Pieces are folded first, so that only one value of
    each piece meets by group, and rows are sorted within their piece. Null keys are a group; without a value the sum is 0
    and the maximum null.
    """
    fold = {"sum": F.sum, "max": F.max}[of]
    rows = rows.withColumn("_bucket", bucket).withColumn("_value", value)
    pieces = rows.groupBy(*by, "_bucket").agg(fold("_value").alias("_all"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate((*by, "_bucket"))], fold("_all").over(earlier).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rows = rows.withColumn("_inside", fold("_value").over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate((*by, "_bucket"))]
    rows = rows.join(pieces, same, "left")
    zero = F.lit(0)
    found = F.coalesce("_before", zero) + F.coalesce("_inside", zero) if of == "sum" else F.greatest("_before", "_inside")
    return rows.withColumn(name, found).drop("_bucket", "_value", "_inside", "_before", *[f"_by{i}" for i in range(len(by) + 1)])


def running_sums(rows: DataFrame, values: dict[str, Column], by: tuple[str, ...], order: tuple, bucket: Column) -> DataFrame:
    """`rows` with several running sums at once, each up to and with its row: one pass over pieces, one sort and one join."""
    rows = rows.withColumns({"_bucket": bucket} | {f"_v{i}": v for i, v in enumerate(values.values())})
    at = range(len(values))
    pieces = rows.groupBy(*by, "_bucket").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in at])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate((*by, "_bucket"))]
    pieces = pieces.select(*keys, *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in at])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_i{i}": F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) for i in at})
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate((*by, "_bucket"))]
    found = rows.join(pieces, same).withColumns({name: F.col(f"_b{i}") + F.col(f"_i{i}") for i, name in enumerate(values)})
    return found.drop("_bucket", *[f"_by{i}" for i in range(len(by) + 1)], *[f"_{c}{i}" for c in "vbi" for i in at])


def blocks(column: str, width: int = 65_536) -> Column:
    """Pieces of an order by a whole number."""
    return F.floor(F.col(column) / width)


def spans(column: str, seconds: int = 3_600) -> Column:
    """Pieces of an order by a time."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (seconds * 1_000_000))


def even_pieces(rows: DataFrame, name: str, by: tuple[str, ...], at: Column, rows_each: int = 65_536) -> DataFrame:
    """`rows` with `name`: pieces of each group along the number `at`, about one for every `rows_each` of its rows.

    Small groups, most of them, are one piece. The pieces of a large one are equal spans between its ends, so they hold as many rows each
    if these lie evenly; they never fall along `at`. Null groups are groups; a number that is null or none is in the first piece.
    """
    rows = rows.withColumn("_at", at.cast("double"))
    finite = F.when(F.abs("_at") < float("inf"), F.col("_at"))
    ends = rows.groupBy(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(by)]).agg(F.ceil(F.count("*") / rows_each).alias("_k"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    # Groups of one piece need no numbers: only large ones are looked up.
    ends = ends.where("_k > 1 and _hi > _lo")
    same = [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(by)]
    found = rows.join(ends, same, "left")
    piece = F.least(F.floor((F.col("_at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_k")), F.col("_k") - 1)
    piece = F.when(~F.isnan("_at"), F.greatest(piece, F.lit(0)))
    return found.withColumn(name, F.coalesce(piece, F.lit(0))).drop("_at", "_k", "_lo", "_hi", *[f"_e{i}" for i in range(len(by))])


def cuts(rows: DataFrame, value: Column, pieces: int = 64) -> Column:
    """Pieces of an order by a number, of about as many rows each wherever the values lie; missing values are in the first piece.

    The bounds are approximate percentiles of all rows, a few numbers. NaN and infinities are in the last or first piece.
    """
    at = [i / pieces for i in range(1, pieces)]
    bounds = rows.agg(F.percentile_approx(value.cast("double"), at, 1_000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]).cast("array<double>"), lambda b: b <= value)) if bounds else F.lit(0)

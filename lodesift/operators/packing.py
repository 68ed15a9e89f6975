"""Greedy packing in order, without one task for a key.

A batch ends before the row that would be one too many or one byte too much, so each row has a next start if a batch begins at it, and the
starts are the orbit of the first row. Rows are cut into pieces. For each of the few places where a batch can begin in a
piece, the piece says where in the next one a batch begins then, and how many began on the way; a piece is a small function. Functions are composed in
groups of pieces, and groups of groups, in as many rounds as the logarithm of the number of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators.running import blocks, running
from lodesift.sources.shared import kept

#: Rows of a piece, and pieces of a group.
PIECE, GROUP = 256, 256


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _steps(own: Column, ahead: Column, base: int, most: int, limit: int) -> Column:
    """For each row of a piece how many rows a batch takes that begins at it; `ahead` are the sizes of the next rows.

    The piece ends where the rows do if it has none ahead; a batch that begins near the end is then as short.
    """

    def step(x: Column, i: Column) -> Column:
        rest = F.slice(F.concat(own, ahead), i + 2, most - 1)
        start = F.struct((F.lit(base) + x).cast("bigint").alias("total"), F.lit(1).alias("n"), F.lit(True).alias("open"))

        def add(s: Column, y: Column) -> Column:
            fits = s["open"] & (s["total"] + y <= limit)
            return F.struct((s["total"] + y).alias("total"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(rest, start, add, lambda s: s["n"])

    return F.transform(own, step)


def _functions(steps: Column, most: int) -> Column:
    """For each place of entry 0..most - 1: (where the next piece is entered, batches begun here), from the last row to the first."""
    none = F.array().cast("array<struct<to:int,n:bigint>>")
    size = F.size(steps)

    def add(done: Column, k: Column) -> Column:
        i = size - 1 - k  # done[0] is the row after it
        to = F.get(steps, i)
        after = F.get(done, to - 1)
        own = F.struct(F.coalesce(after["to"], i + to - size).alias("to"), (F.coalesce(after["n"], F.lit(0)) + 1).cast("bigint").alias("n"))
        return F.concat(F.array(own), F.slice(done, 1, most - 1))

    heads = F.aggregate(F.sequence(F.lit(0), size - 1), none, add)
    # A piece shorter than the batch before it is passed over.
    at = lambda e: F.coalesce(F.get(heads, e), F.struct((e - size).alias("to"), F.lit(0).cast("bigint").alias("n")))
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), at)


def _composed(functions: Column, most: int) -> Column:
    """One function of several, applied in order."""
    same = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(e.alias("to"), F.lit(0).cast("bigint").alias("n")))

    def after(done: Column, f: Column) -> Column:
        return F.transform(done, lambda x: F.struct(F.get(f, x["to"])["to"].alias("to"), (x["n"] + F.get(f, x["to"])["n"]).alias("n")))

    return F.aggregate(functions, same, after)


def _entries(pieces: DataFrame, most: int, levels: int) -> DataFrame:
    """(k, piece, entry, before): where each piece of (k, piece, f) is entered, and how many batches began before it."""
    groups = pieces.groupBy("k", F.floor(F.col("piece") / GROUP).alias("g")).agg(F.array_sort(F.collect_list(F.struct("piece", "f"))).alias("x"))
    if levels > 1:
        known = _entries(groups.select("k", F.col("g").alias("piece"), _composed(F.col("x.f"), most).alias("f")), most, levels - 1)
        groups = groups.join(known.select(F.col("k").alias("_k"), F.col("piece").alias("g"), "entry", "before"), ["g"]).where(F.col("k").eqNullSafe(F.col("_k")))
    else:
        groups = groups.withColumns({"entry": F.lit(0), "before": F.lit(0).cast("bigint")})
    start = F.struct("entry", "before", F.array().cast("array<struct<piece:bigint,entry:int,before:bigint>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        go = F.get(x["f"], s["entry"])
        told = F.struct(x["piece"].alias("piece"), s["entry"].alias("entry"), s["before"].alias("before"))
        return F.struct(go["to"].alias("entry"), (s["before"] + go["n"]).alias("before"), F.concat(s["out"], F.array(told)).alias("out"))

    return groups.select("k", F.explode(F.aggregate("x", start, add, lambda s: s["out"])).alias("e")).select("k", "e.piece", "e.entry", "e.before")


def _marked(steps: Column, entry: Column, before: Column) -> Column:
    """The batch of each row of a piece."""
    start = F.struct(entry.alias("next"), before.alias("n"), F.array().cast("array<bigint>").alias("out"))

    def add(s: Column, i: Column) -> Column:
        begins = s["next"] == i
        n = s["n"] + F.when(begins, 1).otherwise(0)
        to = F.when(begins, i + F.get(steps, i)).otherwise(s["next"])
        return F.struct(to.alias("next"), n.alias("n"), F.concat(s["out"], F.array(n - 1)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), start, add, lambda s: s["out"])


def packed(rows: DataFrame, by: str, order: str, size: str, base: int, most: int = 8, limit: int = 44_000, bucket: Column | None = None, piece: int = PIECE) -> DataFrame:
    """(by, order, size, batch): rows packed in order, each batch at most `most` rows and `limit` bytes with its `base`.

    A row too large to share is a batch of its own. Keys are null-safe; `order` is a number, unique in its key. A key of any size is spread over its pieces;
    only pieces of a group, 256 small functions, meet in one row.
    """
    if most > piece:
        raise ValueError("a batch may not be longer than a piece")
    named = rows.select(F.col(by).alias("k"), F.col(order).alias("o"), F.col(size).alias("z"))
    placed = running(named, "at", F.lit(1).cast("bigint"), ("k",), ("o",), blocks("o") if bucket is None else bucket, own=False)
    placed = placed.withColumn("piece", F.floor(F.col("at") / piece))
    # The first rows of a piece are shown to the piece before it as well.
    early = (F.col("at") % piece < most) & (F.col("piece") > 0)
    to = F.explode(F.when(early, F.array("piece", F.col("piece") - 1)).otherwise(F.array("piece")))
    spread = placed.select("k", "o", "z", "at", F.col("piece").alias("own"), to.alias("piece"))
    item = F.struct("at", F.col("z").cast("bigint").alias("z"), "o")
    cells = spread.groupBy("k", "piece").agg(F.array_sort(F.collect_list(F.when(F.col("own") == F.col("piece"), item))).alias("x"), F.transform(F.array_sort(F.collect_list(F.when(F.col("own") != F.col("piece"), item))), lambda x: x["z"]).alias("ahead"))
    steps = _bind(F.struct(F.col("x.z").alias("own"), "ahead"), lambda s: _steps(s["own"], s["ahead"], base, most, limit))
    cells = kept(cells.select("k", "piece", "x", steps.alias("steps")), "pieces")
    pieces = cells.select("k", "piece", _functions(F.col("steps"), most).alias("f"))
    last = cells.agg(F.max("piece")).first()[0]
    levels = 1
    while last is not None and last >= GROUP**levels:
        levels += 1
    known = _entries(pieces, most, levels).select(F.col("k").alias("_k"), F.col("piece").alias("_p"), "entry", "before")
    met = cells.join(known, (F.col("piece") == F.col("_p")) & F.col("k").eqNullSafe(F.col("_k")))
    each = met.select("k", F.explode(F.arrays_zip("x", _marked(F.col("steps"), F.col("entry"), F.col("before")).alias("b"))).alias("e"))
    kind = dict(rows.dtypes)[size]
    return each.select(F.col("k").alias(by), F.col("e.x.o").alias(order), F.col("e.x.z").cast(kind).alias(size), F.col("e.b").alias("batch"))

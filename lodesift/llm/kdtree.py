"""Sharding by a k-d tree: recursive splits at weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, global_index, numbered
from lodesift.llm.thresholds import boundary

_TOP = (1 << 31) - 1


def _coordinates(rows: DataFrame, named: tuple, numeric: tuple) -> list[F.Column]:
    """Columns in 0..2^31-1: named values by hash, so that equal ones lie together; numbers by their place in the range."""
    ends = rows.agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in numeric for k, f in (("lo", F.min), ("hi", F.max))]).first() if numeric else None
    out = [F.pmod(F.xxhash64(c), F.lit(1 << 31)).cast("bigint") for c in named]
    for c in numeric:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        span = (hi - lo) if lo is not None and hi > lo else None
        place = F.floor((F.col(c).cast("double") - lo) / span * _TOP) if span else F.lit(0)
        out.append(F.coalesce(place, F.lit(0)).cast("bigint"))
    return out


def leaves(rows: DataFrame, shards: int, named: tuple = ("source", "lang"), numeric: tuple = ("size", "id"), tolerance: float = 0.0005) -> DataFrame:
    """`rows` (with `id` and `size`) with `shard`, 0 to `shards` - 1, of nearly equal summed size.

    A node that shall have n leaves is split at the weighted median for n // 2 of n along the dimension whose range
    in the node is widest against its range in all rows (ties: the first). Rows that are level there are ordered by a
    hash of the row and its number among equal rows, so that a hot value and a group of copies are split too; the median is
    exact to `tolerance` of the left side's size. Which of several equal rows goes where makes no difference.
    """
    rows = cut(numbered(rows, "copy"))
    coordinates = _coordinates(rows, named, numeric)
    d = len(coordinates)
    tie = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 32)).cast("bigint")
    rows = cut(rows.select("*", F.array(*coordinates).alias("at"), tie.alias("tie"), F.lit(0).alias("shard"), F.lit(shards).alias("n")))
    spans = None
    while True:
        nodes = rows.where("n > 1").groupBy("shard", "n").agg(F.sum("size").alias("total"), *[F.expr(f"max(at[{i}]) - min(at[{i}])").cast("double").alias(f"w{i}") for i in range(d)])
        nodes = cut(nodes)
        if nodes.isEmpty():
            return rows.drop("at", "tie", "n", "copy")
        spans = spans or [max(x, 1.0) for x in nodes.select(*[f"w{i}" for i in range(d)]).first()]
        widths = [F.col(f"w{i}") / F.lit(spans[i]) for i in range(d)]
        widest = F.lit(d - 1)
        for i in range(d - 2, -1, -1):
            widest = F.when(widths[i] >= F.greatest(*widths[i + 1 :], F.lit(0.0)), i).otherwise(widest)
        nodes = nodes.select("shard", widest.alias("dim"), F.expr("cast(total as double) * (n div 2) / n").alias("need"))
        # One row for each node: at most `shards`.
        keyed = rows.join(F.broadcast(nodes), "shard", "left").withColumn("key", F.expr("shiftleft(get(at, dim), 32) + tie"))
        sides = boundary(keyed.where("n > 1").select(F.col("shard").alias("no"), "key", "size"), nodes.select(F.col("shard").alias("no"), "need"), tolerance)
        nearer = ~F.col("all") & F.expr("before + edge - need < need - before")
        sides = sides.select(F.col("no").alias("shard"), F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("below"))
        moved = keyed.join(F.broadcast(sides), "shard", "left")
        left = F.expr("n > 1 and key < below")
        moved = moved.withColumn("half", F.expr("n div 2")).withColumn("left", left)
        rows = cut(moved.select(
            *[c for c in rows.columns if c not in ("shard", "n")],
            F.when((F.col("n") > 1) & ~F.col("left"), F.col("shard") + F.col("half")).otherwise(F.col("shard")).cast("int").alias("shard"),
            F.when(F.col("n") <= 1, F.col("n")).when(F.col("left"), F.col("half")).otherwise(F.col("n") - F.col("half")).cast("int").alias("n"),
        ))


def shard(df: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", named: tuple = ("source", "lang"), numeric: tuple = ()) -> DataFrame:
    """(id, size, crc, shard, slot) of each row; size is the UTF-8 bytes of the text (null: none) plus 1.

    The number of shards is given, or follows from `target_bytes`. Slots count from 0 in each shard without a gap.
    The tree's dimensions are the named columns, the size, the id (its number, or 0) and more `numeric` columns.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"d_{c}") for c in (*named, *numeric)], (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    if shards is None:
        rows = cut(rows)
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    number = tuple(n for n, kind in rows.select("id").dtypes if kind not in ("string", "binary"))
    placed = leaves(rows, shards, tuple(f"d_{c}" for c in named), ("size", *number, *(f"d_{c}" for c in numeric)))
    placed = global_index(placed.select("id", "size", "crc", "shard", F.xxhash64("id", "crc").alias("h")), "shard", "h", "id", "crc")
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    placed = placed.join(F.broadcast(first), "shard")  # one row for each shard
    return placed.select("id", "size", "crc", "shard", (F.col("index") - F.col("first")).alias("slot"))

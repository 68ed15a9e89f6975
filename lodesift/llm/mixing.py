"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash. A source's target is met by whole passes over the source and one partial pass:
the documents whose hash is below a threshold. The threshold comes from word sums by source and hash bucket; only the
bucket that crosses the budget is refined, and documents are then taken by a filter on their hash, without a sort.
What the first threshold leaves short of the budget is filled by nested thresholds over documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.common import WORD, cut, hinted, numbered
from lodesift.llm.thresholds import boundary

#: Nested thresholds of the partial pass.
LEVELS = 3


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: bool = True) -> DataFrame:
    """(id, source, size, h) of each row: words of the text (null: 0) and a hash in 60 bits of its id, source and text.

    With `copies` the hash is also of the row's number among rows equal in these, so that a group of copies can be taken in part.
    """
    size, key = _size_and_key(F.col(id_col), F.col(text_col), F.col(source_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    rows = numbered(rows, "copy") if copies else rows.withColumn("copy", F.lit(0))
    return rows.select("id", "source", "size", _hash(F.col("key"), F.col("copy")).alias("h"))


def _size_and_key(ident: F.Column, text: F.Column, source: F.Column) -> tuple[F.Column, F.Column]:
    told = F.to_json(F.struct(ident.cast("string").alias("i"), source.cast("string").alias("s"), F.md5(text.cast("binary")).alias("t")))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    return size, F.md5(told.cast("binary"))


def _hash(key: F.Column, copy: F.Column) -> F.Column:
    digest = F.md5(F.concat(key, F.lit(" "), copy.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, no, target) from (source, source_size).

    The sources, by code point with null last, take the weights in turn and share the sum of all sizes. A target
    stops at `most` times its source's size; what is over is shared again by weight until no target is above. With
    the sources in the order of most * size / weight, those before the first that keeps its share are the full ones.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("no", F.row_number().over(by_name)).withColumn("w", turn.cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "no")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("cap").over(every) / float(most) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("keeps", F.col("cap") >= F.col("rate") * F.col("w"))
    rate = F.first(F.when(F.col("keeps"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(rate, F.lit(0.0)) * F.col("w")))
    return rows.select("source", "source_size", "no", "target")


def plan(rows: DataFrame, weights: tuple = (1, 2, 3), most: int = 3, levels: int = LEVELS) -> DataFrame:
    """One row for each source of `rows` (from `sized`): its target, whole passes and nested thresholds."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = cut(targets(sizes, weights, most))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    known = known.withColumn("passes", passes)
    known = known.withColumn("fit0", F.col("target") - F.col("passes") * F.col("source_size"))
    keyed = rows.join(hinted(known.select(F.col("source").alias("s"), "no")), rows.source.eqNullSafe(F.col("s"))).select("no", F.col("h").alias("key"), "size")
    for i in range(levels):
        open_rows = keyed.where("size > 0")
        if i:
            open_rows = open_rows.join(hinted(known.select("no", f"fit{i}", f"below{i - 1}")), "no")
            open_rows = open_rows.where(f"key >= below{i - 1} and size <= fit{i}").select("no", "key", "size")
        found = boundary(open_rows, known.where(f"fit{i} > 0").select("no", F.col(f"fit{i}").alias("need")))
        # The last threshold may go past the budget by one document if that ends nearer to it.
        nearer = F.lit(i == levels - 1) & ~F.col("all") & F.expr("before + edge - need < need - before")
        found = found.select("no", F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias(f"below{i}"), (F.col("need") - F.col("before")).alias(f"fit{i + 1}"))
        start = "0" if not i else f"below{i - 1}"
        known = known.join(found, "no", "left").withColumn(f"below{i}", F.expr(f"coalesce(below{i}, {start})")).withColumn(f"fit{i + 1}", F.expr(f"coalesce(fit{i + 1}, 0D)"))
        known = cut(known)
    return known


def repeats(levels: int = LEVELS) -> F.Column:
    """How often the mix takes a row that has `size`, `h` and the columns of its source's `plan`."""
    part = F.expr("h < below0")
    for i in range(1, levels):
        part = part | F.expr(f"h >= below{i - 1} and h < below{i} and size <= fit{i}")
    return F.col("passes") + F.when(part & (F.col("size") > 0), 1).otherwise(0)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, repeats, taken) of each row of `df`.

    A null source is a source of its own; rows without words have size 0 and nothing is taken of them. Null and repeated ids are
    ids like others; of rows that are equal in id, source and text as many are taken as the budget asks for. Reruns agree,
    as every choice follows from the rows' content. An empty table gives none.
    """
    rows = cut(sized(df, id_col, text_col, source_col))
    known = plan(rows, weights, most)
    out = rows.join(hinted(known.withColumnRenamed("source", "s")), rows.source.eqNullSafe(F.col("s"))).withColumn("repeats", repeats())
    return out.select("id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of `df` as often as the mix takes them (see `mix`), with their columns; texts are not shuffled.

    A row travels as one struct, so that its columns may have any name and type. Rows without words are not taken. Rows
    equal in id, source and text are taken together here, as whole rows can't be made from their content.
    """
    sizes = sized(df, id_col, text_col, source_col, copies=False)
    known = plan(cut(sizes), weights, most).withColumnRenamed("source", "its_source")
    size, key = _size_and_key(F.col(id_col), F.col(text_col), F.col(source_col))
    h = _hash(key, F.lit(0))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source_col).alias("s"), size.alias("size"), h.alias("h"))
    rows = rows.join(hinted(known), F.col("s").eqNullSafe(F.col("its_source"))).withColumn("repeats", repeats())
    rows = rows.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "repeats")))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns])

"""Budget thresholds from histograms: where, in the order of a key, the running size of a group first exceeds a need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.common import cut

#: Buckets of a histogram, for each group.
BUCKETS = 4096
#: Groups up to which their table, one narrow row for each, is broadcast.
MOST_GROUPS = 100_000


def boundary(rows: DataFrame, needs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(no, need, low, high, before, edge, all) for every group of `needs` (no, need).

    `rows` are (no, key, size) with a non-negative bigint key. The rows of the group with key < low sum to `before`,
    which is at most the need; the cell low..high holds `edge` more and crosses it. `all` is true where all rows
    fit: then `before` is their sum and `low` is above every key. A cell ends as one key, or once it holds at most
    `tolerance` times the need. Each round reads the rows of the crossing cells only, sums them by bucket, and moves
    to the bucket that crosses; nothing is sorted and no more than 4,096 sums of a group meet.
    """
    state = needs.select("no", "need", F.lit(0).cast("bigint").alias("low"), F.lit((1 << 63) - 1).alias("high"), F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("edge"), F.lit(False).alias("all"), F.lit(False).alias("fixed"))
    done, first = None, True
    few = needs.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    while True:
        known = state.select("no", "need", "low", "high", "before")
        inside = rows.join(F.broadcast(known) if few else known, "no")
        if not first:
            inside = inside.where("key between low and high")
        cells = inside.withColumn("cell", F.expr(f"(key - low) div ((high - low) div {BUCKETS} + 1)"))
        cells = cells.groupBy("no", "need", "before", "cell").agg(F.sum("size").alias("edge"), F.min("key").alias("low"), F.max("key").alias("high"))
        running = F.sum("edge").over(Window.partitionBy("no").orderBy("cell")) + F.col("before")
        cells = cells.withColumn("after", running)
        over = F.when(F.col("after") > F.col("need"), F.struct("low", "high", "edge", "after"))
        found = cells.groupBy("no", "need").agg(F.min_by(over, F.when(over.isNotNull(), F.col("cell"))).alias("c"), F.max("after").alias("total"))
        found = found.select(
            "no", "need",
            F.coalesce("c.low", F.lit((1 << 63) - 1)).alias("low"),
            F.coalesce("c.high", F.lit((1 << 63) - 1)).alias("high"),
            F.coalesce(F.expr("c.after - c.edge"), "total").alias("before"),
            F.coalesce("c.edge", F.lit(0)).alias("edge"),
            F.col("c").isNull().alias("all"),
            (F.col("c").isNull() | F.expr(f"c.low = c.high or c.edge <= need * {tolerance!r}")).alias("fixed"),
        )
        found = cut(found)
        ended = found.where("fixed").drop("fixed")
        done = ended if done is None else done.unionByName(ended)
        state, first = found.where("not fixed"), False
        if state.isEmpty():
            return done

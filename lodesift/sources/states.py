"""The state of sessions as a table of versions: a call writes what it has changed, any earlier version can be read again.

The table lies in partitions by session and call. A call overwrites its own partitions only, so that a call which is tried again leaves one version, and
sessions that it doesn't touch keep their files. What a session knows after a call is its latest version up to that call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(rows: DataFrame, path: str, by: str, call: int) -> None:
    """Writes `rows` as the version `call` of the sessions that they name."""
    out = rows.withColumn("call", F.lit(call)).repartition(F.col(by), F.xxhash64(*[c for c in rows.columns if c != by]) % 8)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "call").parquet(path)


def load(spark: SparkSession, path: str, by: str, upto: int | None = None) -> DataFrame:
    """The latest version of each session, or the one that was the latest after the call `upto`.

    Which version that is comes from folder names; the files of other versions are pruned when the query runs.
    """
    rows = spark.read.parquet(path)
    known = rows.select(by, "call").where(F.col("call") <= upto) if upto is not None else rows.select(by, "call")
    last = known.distinct().groupBy(F.col(by).alias("_b")).agg(F.max("call").alias("_c"))
    # One row a session and no more: its folders are listed by the driver anyway.
    return rows.join(F.broadcast(last), (F.col(by) == F.col("_b")) & (F.col("call") == F.col("_c")), "left_semi")


def continued(held: DataFrame, more: DataFrame, by: str, ident: str) -> DataFrame:
    """What the sessions of `more` know once it is added: a row of the same id replaces the one that was held."""
    asked = more.select(F.col(by).alias("_b")).distinct()
    old = held.join(asked, F.col(by) == F.col("_b"), "left_semi")
    both = old.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)))
    last = both.withColumn("_turn", F.row_number().over(Window.partitionBy(by, ident).orderBy(F.desc("_new"))))
    return last.where("_turn = 1").drop("_new", "_turn")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of every file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

"""Small helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package (ASCII white space, as `bytes.split()` has it).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or the one that the session has set.

    A local one is made only in local mode, where the driver's process holds the executors too; elsewhere a session
    that names none is an error.
    """
    sc = spark.sparkContext
    named, held = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodesift-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Queries that are made inside drop their shuffle files when they end."""
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, old)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared folder, so that no later step recomputes them; what was shuffled for them goes."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()


def slices(batches, most: int = 512):
    """Smaller batches (or arrays), so that little is held at a time."""
    for b in batches:
        for i in range(0, len(b) if isinstance(b, pa.Array) else b.num_rows, most):
            yield b.slice(i, most)


def hinted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A materialised table of few narrow rows with a broadcast hint, if it has at most `most` of them; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(rows: DataFrame, name: str = "copy", piece: int = 4_096) -> DataFrame:
    """`rows` with `name`: rows equal in every column are numbered from 0 each among themselves.

    Rows are counted by their content and made anew from it, so that no group of copies is one task's sort; a large group is
    made in pieces that are dealt over tasks.
    """
    counts = cut(rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias("_n")))
    upto = lambda lo, hi: F.explode(F.sequence(lo, hi)).alias(name)
    zero = F.lit(0).cast("bigint")
    few = counts.where(F.col("_n") <= piece).select(*rows.columns, upto(zero, F.col("_n") - 1))
    large = counts.where(F.col("_n") > piece).select("*", F.explode(F.sequence(zero, F.floor((F.col("_n") - 1) / piece))).alias("_p"))
    large = large.repartition(F.xxhash64(*rows.columns), "_p")
    return few.unionByName(large.select(*rows.columns, upto(F.col("_p") * piece, F.least(F.col("_n"), (F.col("_p") + 1) * piece) - 1)))


def per_text(make, kind: str):
    """A column function of one text column, run in Arrow batches: only the text leaves the JVM, no other column.

    `make()` opens what a partition needs and returns (function of an Arrow array, what closes it). The function counts as not
    deterministic, so that no rule of the optimizer runs it twice.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each, close = make()
        try:
            for t in slices(texts):
                yield each(t)
        finally:
            close()
            pa.default_memory_pool().release_unused()

    # Spark reads the kind of function from the hints, which have to be types here.
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def words(text) -> F.Column:
    """The words of a text column; none for a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def global_index(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `index`, the row's place from 0 in the order of `order`.

    Rows are range-partitioned, so that a large group of the leading columns spreads over many tasks; only one
    row count per partition meets in one place. Rows equal in all of `order` get neighbouring places.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    placed = placed.withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1))
    from pyspark.sql import Window

    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    # One row for each partition: the size is bounded by the number of tasks.
    joined = placed.join(F.broadcast(starts), "_p")
    return joined.withColumn("index", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")

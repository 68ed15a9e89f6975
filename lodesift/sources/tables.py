"""Readers: tables of a folder as DataFrames, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows with a declared schema; lines that don't parse are kept in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def registry(documents: DataFrame, family: str = "corpus") -> DataFrame:
    """(id, name, family, n_documents) of each source that has documents."""
    found = documents.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_documents"))
    return found.select("id", F.initcap("id").alias("name"), F.lit(family).alias("family"), "n_documents")


def dispatched(sources: DataFrame, readers: dict, family: str = "family") -> DataFrame:
    """The rows that the reader of each family gives for its sources, as one table.

    `readers` are functions of the sources of a family. A source of a family without a reader is an error, as nothing would tell of its loss.
    """
    unknown = [r[0] for r in sources.where(~F.coalesce(F.col(family).isin(*readers), F.lit(False))).select(family).limit(1).collect()]
    if unknown:
        raise ValueError(f"no reader of the family {unknown[0]!r}")
    found = None
    for name, read in readers.items():
        rows = read(sources.where(F.col(family) == name)).withColumn(family, F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found

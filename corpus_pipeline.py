"""The corpus pipeline: stages over `documents`, each the rows that the one before has kept.

Every stage reads whole texts and all rows. Where a stage keeps a row, it keeps it as it is: rows travel as one struct, so that
further columns may have any name and type. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.llm import bpe, language, mixing, quality, simhash_wide
from lodesift.llm.common import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; operator 7.

    A null, empty or blank text has no language and goes. A null or unknown declaration or source says nothing, the text alone
    decides. Repeated rows share their verdict; a tie goes to the first language by name.
    """
    return language.known_only(docs, language.fit(docs), "text", "lang", "source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 keeps; operator 8.

    A null, empty or blank text has too few words and goes. Only the text counts; repeated rows share their verdict.
    """
    return quality.kept(docs, quality.POLICIES[-1])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five words and a similarity of 0.8; operator 1 and an exact search after it.

    The smallest doc_id of a group stays, a null one first; of rows that tie, one. Rows equal in every column count once. Texts
    without words, null ones among them, are one group.
    """
    return simhash_wide.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from not at all to three times; operator 2.

    A null source is a source of its own. Texts without words are not taken. Rows of one doc_id are taken together.
    """
    return mixing.repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; operator 5.

    A null text has no ids, like an empty one, and makes the round trip as an empty text. Repeated rows are encoded as often as
    they come. Columns other than doc_id, lang and source end here.
    """
    coded = bpe.recode(docs.select("doc_id", "lang", "source", "text"))
    whole = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding),
]
#: SQL can't express the language models and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` through every stage, each written to the shared folder and read again."""
    import uuid

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

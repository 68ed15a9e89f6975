"""The best documents of many questions at once, found from rare words and score bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.sources.shared import kept


def hashed(text: Column) -> Column:
    """The distinct words of a text as 64-bit hashes, as which they meet, are counted and compared."""
    return F.array_distinct(F.transform(C.tokens(text), lambda x: F.xxhash64(x)))


def _asked(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """(question_id, n, word, df, turn): a question's words, the rarest first; `turn` from 1."""
    words = questions.select("question_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    words = words.join(counts, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # A question's words, few rows each.
    return words.withColumn("turn", F.row_number().over(Window.partitionBy("question_id").orderBy("df", "word")))


def _scored(pairs: DataFrame, questions: DataFrame, texts: DataFrame) -> DataFrame:
    """`pairs` with `hits`, the words of the question that the document holds."""
    met = pairs.join(texts, "id").join(questions.select("question_id", "w"), "question_id")
    return met.select("question_id", "id", F.size(F.array_intersect("w", "t")).alias("hits"))


def best_documents(questions: DataFrame, docs: DataFrame, most: int = 10, probe: int = 4, spare: int = 4) -> DataFrame:
    """(question_id, id, usable_evidence, place): the `most` documents that hold the largest share of a question's words.

    Documents that hold none of its words are not found. Ties go to the smaller id. The result is exact, and words that nearly all
    documents hold make no pairs. A question's rarest words are looked up first, as many as have `probe` times `most` documents
    between them; the hits of its `most`-th document among these are a bound T. A document that is as good holds T of n words, and
    so m + 1 or more of the n - T + 1 + m rarest, whatever m is: these are looked up with m = T / `spare`, and only documents that hold so many of
    them are scored. Where fewer documents are found T is 1 and all words are looked up. A word's documents are joined, never gathered;
    counts of words meet by word, combined in each task first. Texts are split into words once, which are written for the steps that read them.
    """
    asked = questions.select("question_id", hashed(F.col("question")).alias("w"))
    texts = kept(docs.select("id", hashed(F.col("text")).alias("t")), "words")
    held = texts.select("id", F.explode("t").alias("word"))
    words = kept(_asked(asked, held.groupBy("word").agg(F.count("*").alias("df"))), "asked")
    before = F.coalesce(F.sum("df").over(Window.partitionBy("question_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = words.withColumn("before", before).where((F.col("before") < probe * most) & (F.col("df") > 0))
    near = held.join(first.select("question_id", "word"), "word").select("question_id", "id").distinct()
    # The bound: the hits of the `most`-th document, of which each task sends no more of a question than that.
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("hits")))
    bound = _scored(near, asked, texts).withColumn("turn", turn).where(F.col("turn") <= most).groupBy("question_id")
    bound = bound.agg(F.min("hits").alias("least"), F.count("*").alias("k")).where(F.col("k") == most)
    rare = words.join(bound.select("question_id", "least"), "question_id", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    rare = rare.withColumn("m", F.least(F.floor(F.col("least") / spare), F.col("least") - 1)).where(F.col("turn") <= F.col("n") - F.col("least") + 1 + F.col("m"))
    pairs = held.join(rare.select("question_id", "word", "m"), "word").groupBy("question_id", "id", "m").agg(F.count("*").alias("met"))
    found = _scored(pairs.where("met > m").select("question_id", "id"), asked, texts)
    found = found.join(asked.select("question_id", F.size("w").alias("n")), "question_id")
    score = F.col("hits").cast("double") / F.col("n")
    order = Window.partitionBy("question_id").orderBy(F.desc("usable_evidence"), "id")
    found = found.select("question_id", "id", score.alias("usable_evidence")).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= most)

"""Queries on the scorer seam: intent, signals, claims, coverage, failures, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import dates
from lodesift.operators import documents as D
from lodesift.operators import scoring as M
from lodesift.plans.documents import CHUNK_ROWS as _CHUNKS
from lodesift.plans.documents import SIZE
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql

_TOK = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'))"
_ANSWERS = "SELECT o_orderkey, o_orderkey % 3 / 10.0 AS current, o_orderkey % 4 / 10.0 AS comparative, o_orderkey % 5 / 10.0 AS versioned, o_orderkey % 2 / 10.0 AS timeless FROM orders"
_BEST = "greatest(current, comparative, versioned, timeless)"


@_r.add(f"SELECT o_orderkey, CASE WHEN timeless = b THEN 'timeless' WHEN versioned = b THEN 'versioned' WHEN comparative = b THEN 'comparative' ELSE 'current' END AS kind, b AS confidence, NOT timeless = b OR versioned >= 0.5 AS asks FROM (SELECT *, {_BEST} AS b FROM ({_ANSWERS}))")
def intent_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The intent of questions from the scorer's answers, and whether it asks for what is current."""
    k = F.col("o_orderkey")
    answers = table(spark, folder, "orders").select("o_orderkey", *[(k % n / 10.0).alias(name) for n, name in ((3, "current"), (4, "comparative"), (5, "versioned"), (2, "timeless"))])
    found = M.intent(answers, "o_orderkey").join(answers.select("o_orderkey", "versioned"), "o_orderkey")
    return found.select("o_orderkey", "kind", "confidence", dates.asks_currentness(F.col("kind"), F.col("versioned")).alias("asks"))


_SHARE = lambda words: f"len(list_intersect(t, {list(words)})) / {float(len(words))}"
_Q = "the and of house"


@_r.add(
    f"SELECT doc_id, round(p, 9) AS usable_evidence, round(sqrt(p), 9) AS relevant, round(c, 9) AS contradicts, round(i, 9) AS injection FROM (SELECT doc_id, {_SHARE(_Q.split())} AS p, {_SHARE(('not', 'never', 'no'))} AS c, {_SHARE(('ignore', 'instructions', 'prompt'))} AS i FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents))"
)
def chunk_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The four signals of the lexical scorer for one question."""
    rows = table(spark, folder, "documents").select("doc_id", F.lit(_Q).alias("question"), "text")
    return M.lexical()(rows).select("doc_id", *[F.round(s, 9).alias(s) for s in M.SIGNALS])


_CH = "SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount, max(l_tax) AS l_tax, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line for each number of an order, as chunks of a document.

    Lines are dealt by order, about 262,144 to a task, as nearly every line is a group of its own and a task that sums up its part of the file holds all of it.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_suppkey")
    found = lines.repartition(lines.count() // 262_144 + 1, "l_orderkey").groupBy("l_orderkey", "l_linenumber")
    return found.agg(F.max("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"), F.min("l_suppkey").alias("l_suppkey"))


@_r.add(f"SELECT l_orderkey, max(l_discount) AS usable_evidence, max(l_tax) AS relevant, round(CASE WHEN count(*) = 1 THEN max(l_discount) ELSE (list_reverse_sort(list(l_discount))[1] + list_reverse_sort(list(l_discount))[2]) / 2 END, 9) AS top2_mean, arg_max(l_linenumber, (l_discount, -l_linenumber)) AS best_chunk, count(*) AS n_chunks FROM ({_CH}) GROUP BY 1")
def signal_maxima(spark: SparkSession, folder: str) -> DataFrame:
    """Each signal's maximum over a document's chunks, the mean of the two best, and the best chunk."""
    rows = _lines(spark, folder).select("l_orderkey", F.col("l_linenumber").alias("chunk"), F.col("l_discount").alias("usable_evidence"), F.col("l_tax").alias("relevant"))
    found = M.document_scores(rows, ("l_orderkey",), "chunk", ("usable_evidence", "relevant"))
    return found.withColumn("top2_mean", F.round("top2_mean", 9))


@_r.add("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE round(pow(0.5, greatest(10592 - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), 0) / 365.0), 9) END AS still_current FROM orders")
def currentness_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How current documents are by their dates."""
    days = F.when(F.col("o_orderkey") % 4 != 0, F.unix_date(F.col("o_orderdate").cast("date")))
    return table(spark, folder, "orders").select("o_orderkey", F.round(M.currentness(days, F.lit(10_592)), 9).alias("still_current"))


_CLAIMS = f"(SELECT item_id AS claim_id, {_TOK.format('text')} AS w FROM benchmark)"


@_r.add(
    f"WITH RECURSIVE {_CHUNKS}, a AS (SELECT claim_id, len(w) AS n, unnest(w) AS word FROM {_CLAIMS}), h AS (SELECT id, chunk, unnest({_TOK.format('decode(array_slice(raw, s + 1, e))')}) AS word FROM c), p AS (SELECT claim_id, id, chunk, count(*) / CAST(n AS DOUBLE) AS s, least(count(*) FILTER (word IN ('not', 'never', 'no')), 1) AS g FROM a JOIN h USING (word) GROUP BY claim_id, id, chunk, n) "
    "SELECT claim_id, id, round(max(s), 9) AS supports, round(max(s * g), 9) AS contradicts, round(max(s * (1 - s)), 9) AS qualifies, CAST(arg_max(chunk, (s, -chunk)) AS INT) AS chunk FROM p GROUP BY 1, 2"
)
def claim_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """What documents say on claims: support, contradiction, qualification over all their chunks, and the chunk that supports most."""
    claims = table(spark, folder, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    chunks = D.chunks(D.dealt(docs), SIZE).select("id", "chunk", F.col("piece").alias("text"))
    return M.claim_judgments(claims, chunks).select("claim_id", "id", *[F.round(c, 9).alias(c) for c in ("supports", "contradicts", "qualifies")], "chunk")


_OUT = "CASE WHEN s_suppkey % 5 = 0 THEN 'failed' WHEN s_suppkey % 5 = 1 THEN 'refused' ELSE 'ok' END"


@_r.add(f"WITH c AS (SELECT s_suppkey AS call, {_OUT} AS outcome, s_name AS cause FROM supplier), b AS (SELECT l_orderkey AS id, call, outcome, cause FROM lineitem JOIN c ON l_suppkey = call WHERE outcome <> 'ok') SELECT id, arg_min(cause, (outcome = 'refused', call)) AS cause, arg_min(call, (outcome = 'refused', call)) AS call FROM b GROUP BY 1")
def failed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a chunk in a call that failed, and the failure that counts."""
    calls = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("call"), F.expr(_OUT).alias("outcome"), F.col("s_name").alias("cause"))
    return M.failed_documents(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("call")), calls)


@_r.add("SELECT l_orderkey AS id, count(*) AS planned, count(*) FILTER (l_suppkey % 5 > 0) AS answered, bool_and(l_suppkey % 5 > 0) AS complete, min(CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber END) AS missing_first FROM (" + _CH + ") GROUP BY 1")
def chunk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Which of a document's chunks have been answered."""
    rows = _lines(spark, folder).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("chunk"), "l_suppkey")
    return M.coverage(rows, rows.where("l_suppkey % 5 > 0"))


@_r.add("SELECT o_orderkey, 'q' || o_custkey || '=a' AS key, CAST(0.25 AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 'q' || o_custkey || '=b', o_orderkey % 7 / 10.0 FROM orders UNION ALL SELECT o_orderkey, 'q' || o_custkey || '#confidence', 0.5 FROM orders")
def choice_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of choice questions as single probabilities."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("id"), F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.col("o_orderkey") % 7 / 10.0).alias("options"), F.lit(0.5).alias("sure"))
    return M.flattened(rows, "o_orderkey", "id", "options", "sure")


@_r.add("SELECT l_orderkey, count(*) FILTER (l_suppkey % 9 > 0) AS n, count(*) FILTER (l_suppkey % 9 = 0) = 0 AND bool_and(l_discount <= 0.08) AS valid FROM (" + _CH + ") GROUP BY 1")
def reply_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with every expected key once and nothing but probabilities."""
    rows = _lines(spark, folder)
    value = F.when(F.col("l_discount") <= 0.08, F.col("l_discount")).otherwise(F.lit(float("nan")))
    return M.response_validity(rows.where("l_suppkey % 9 > 0").select("l_orderkey", "l_linenumber", value.alias("v")), rows, "l_orderkey", "l_linenumber", "v")


@_r.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'direct' ELSE 'complementary' END AS lens, CAST(0.8 AS DOUBLE) AS usable_evidence, coalesce(value BETWEEN 0 AND 1, false) AS valid, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(round(event_id % 100 / 8.0) AS INT) END AS band FROM events")
def scorer_constants(spark: SparkSession, folder: str) -> DataFrame:
    """The lens of each routing pass, the scorer for tests, the range of scores, and bands of relevance."""
    rows = M.fixture(table(spark, folder, "events"))
    band = dates.relevance_key(F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100 / 800.0))
    return rows.select("event_id", M.route_lens(F.col("event_id")).alias("lens"), "usable_evidence", M.valid(F.col("value")).alias("valid"), band.alias("band"))

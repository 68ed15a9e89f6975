"""Queries on documents: scores, chunks, dedupe, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.operators import documents as D
from lodesift.operators import ranking as R
from lodesift.operators.search import best_documents
from lodesift.plans.registry import Registry
from lodesift.sources.tables import registry, table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql

#: Chunk size of the chunk queries, small enough that texts of the test tables have several.
SIZE = 3_000

_DOCS = "d AS (SELECT doc_id AS id, source AS source_id, split_part(coalesce(text, ''), chr(10), 1) AS title, 'https://' || source || '.example/' || left(sha256(coalesce(text, '')), 16) AS url, text, sha256(coalesce(text, '')) AS digest FROM documents)"
_TOK = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'))"
_SCORES = (
    "a AS (SELECT question_id, len(w) AS n, unnest(w) AS word FROM (SELECT item_id AS question_id, " + _TOK.format("text") + " AS w FROM benchmark)), "
    "h AS (SELECT doc_id AS id, unnest(" + _TOK.format("text") + ") AS word FROM documents), "
    "s AS (SELECT question_id, id, CAST(count(*) AS DOUBLE) / n AS p FROM a JOIN h USING (word) GROUP BY question_id, id, n)"
)
_STATUS = "CASE WHEN p >= 0.4 THEN 'selected' WHEN p >= 0.15 THEN 'uncertain' ELSE 'rejected' END"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return D.from_texts(table(spark, folder, "documents"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def scores(spark: SparkSession, folder: str, least: float = 0.0) -> DataFrame:
    return D.lexical_scores(_questions(spark, folder), D.dealt(_docs(spark, folder).select("id", "text")), least)


@_r.add(f"WITH {_SCORES} SELECT question_id, id AS doc_id, round(p, 9) AS usable_evidence, {_STATUS} AS status, relevance_rank, place FROM (SELECT *, rank() OVER (PARTITION BY question_id ORDER BY p DESC) AS relevance_rank, row_number() OVER (PARTITION BY question_id ORDER BY p DESC, id) AS place FROM s) WHERE place <= 10")
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each question by the share of its words that they hold."""
    found = best_documents(_questions(spark, folder), _docs(spark, folder), 10)
    # Ranks of the ten follow from the ten: every document with a higher score is among them.
    rank = F.rank().over(R.Window.partitionBy("question_id").orderBy(F.desc("usable_evidence")))
    return found.select("question_id", F.col("id").alias("doc_id"), F.round("usable_evidence", 9).alias("usable_evidence"), C.status(F.col("usable_evidence")).alias("status"), rank.cast("bigint").alias("relevance_rank"), F.col("place").cast("bigint").alias("place"))


@_r.add(f"WITH {_SCORES} SELECT question_id, {_STATUS} AS status, count(*) AS n FROM s GROUP BY 1, 2")
def status_by_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each status among those that share a word with the question."""
    found = scores(spark, folder).select("question_id", C.status(F.col("usable_evidence")).alias("status"))
    return found.groupBy("question_id", "status").agg(F.count("*").alias("n"))


@_r.add("SELECT source AS id, upper(left(source, 1)) || lower(source[2:]) AS name, 'corpus' AS family, count(*) AS n_documents FROM documents GROUP BY source")
def source_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Every source with documents."""
    return registry(table(spark, folder, "documents"))


_ROUTES = f"{_SCORES}, r AS (SELECT s.question_id, d.source AS source_id, max(p) AS route FROM s JOIN documents d ON d.doc_id = s.id GROUP BY 1, 2)"


@_r.add(f"WITH {_ROUTES} SELECT question_id, source_id, round(route, 9) AS route, route >= 0.15 AS selected, route >= 0.4 AS fetch_now FROM r")
def route_union_max(spark: SparkSession, folder: str) -> DataFrame:
    """Best score of each source for each question, and whether it is selected and fetched."""
    found = scores(spark, folder).join(_docs(spark, folder).select("id", "source_id"), "id")
    found = found.groupBy("question_id", "source_id").agg(F.max("usable_evidence").alias("route"))
    return found.select("question_id", "source_id", F.round("route", 9).alias("route"), (F.col("route") >= 0.15).alias("selected"), (F.col("route") >= 0.4).alias("fetch_now"))


@_r.add(r"SELECT doc_id, len(w) AS n_tokens, array_to_string(w[1:5], ' ') AS first_tokens FROM (SELECT doc_id, " + _TOK.format("text").replace("list_distinct", "") + " AS w FROM documents)")
def keyword_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document and the first five."""
    found = table(spark, folder, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w"))
    return found.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.array_join(F.slice("w", 1, 5), " ").alias("first_tokens"))


_CUT = "CASE WHEN m >= n THEN n WHEN left(hex(array_slice(raw, m + 1, m + 1)), 1) NOT IN ('8','9','A','B') THEN m WHEN left(hex(array_slice(raw, m, m)), 1) NOT IN ('8','9','A','B') THEN m - 1 WHEN left(hex(array_slice(raw, m - 1, m - 1)), 1) NOT IN ('8','9','A','B') THEN m - 2 ELSE m - 3 END"
CHUNK_ROWS = (
    f"c(id, raw, n, chunk, s, e) AS (SELECT id, raw, n, 0, 0, {_CUT} FROM (SELECT doc_id AS id, encode(coalesce(text, '')) AS raw, strlen(coalesce(text, '')) AS n, least({SIZE}, strlen(coalesce(text, ''))) AS m FROM documents) WHERE n > 0 "
    f"UNION ALL SELECT id, raw, n, chunk + 1, e, {_CUT} FROM (SELECT id, raw, n, chunk, e, least(e + {SIZE}, n) AS m FROM c WHERE e < n))"
)


@_r.add(f"WITH RECURSIVE {CHUNK_ROWS} SELECT id AS doc_id, CAST(chunk AS INT) AS chunk, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM c")
def chunk_byte_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Byte ranges of each text."""
    return D.chunks(_docs(spark, folder), SIZE).select(F.col("id").alias("doc_id"), "chunk", "s", "e")


_BY_CHUNK = (
    f"{CHUNK_ROWS}, a AS (SELECT question_id, len(w) AS n, unnest(w) AS word FROM (SELECT item_id AS question_id, " + _TOK.format("text") + " AS w FROM benchmark)), "
    "h AS (SELECT id, chunk, unnest(" + _TOK.format("decode(array_slice(raw, s + 1, e))") + ") AS word FROM c), "
    "v AS (SELECT question_id, id, chunk, CAST(count(*) AS DOUBLE) / a.n AS p FROM a JOIN h USING (word) GROUP BY question_id, id, chunk, a.n)"
)


@_r.add(f"WITH RECURSIVE {_BY_CHUNK} SELECT question_id, id AS doc_id, round(max(p), 9) AS probability, round(list_avg(list_reverse_sort(list(p))[1:2]), 9) AS top2_mean, CAST(arg_max(chunk, (p, -chunk)) AS INT) AS best_chunk, count(*) AS n_chunks FROM v GROUP BY 1, 2")
def chunk_signal_max(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each document from those of its chunks: the largest, the mean of the two largest, the best chunk."""
    found = D.by_chunk(_questions(spark, folder), D.dealt(_docs(spark, folder).select("id", "text")), SIZE)
    return found.select("question_id", F.col("id").alias("doc_id"), F.round("probability", 9).alias("probability"), F.round("top2_mean", 9).alias("top2_mean"), "best_chunk", "n_chunks")


@_r.add(f"WITH {_DOCS} SELECT id AS doc_id, min(id) OVER (PARTITION BY url, title, digest) AS representative, left(digest, 12) AS digest12 FROM d")
def exact_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first document with the same URL, title and text."""
    found = D.exact_dedupe(_docs(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "representative", F.left("digest", F.lit(12)).alias("digest12"))


@_r.add(f"WITH {_SCORES}, {_DOCS}, k AS (SELECT id, min(id) OVER (PARTITION BY url, title, digest) AS representative FROM d) SELECT question_id, k.id AS doc_id, round(p, 9) AS probability, CASE WHEN k.id <> representative THEN representative END AS copied_from FROM s JOIN k ON s.id = k.representative")
def dedupe_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of representatives copied to their duplicates."""
    docs = D.exact_dedupe(_docs(spark, folder))
    best = docs.where("id = representative")
    scored = D.lexical_scores(_questions(spark, folder), D.dealt(best.select("id", "text"), table(spark, folder, "documents").count()))
    found = D.fan_out(docs.select("id", "representative"), scored).where("question_id is not null")
    return found.select("question_id", F.col("id").alias("doc_id"), F.round("usable_evidence", 9).alias("probability"), "copied_from")


_TURNS = "t AS (SELECT source AS source_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents), p AS (SELECT *, row_number() OVER (ORDER BY turn, source_id) AS place FROM t)"


@_r.add(f"WITH {_TURNS} SELECT source_id, id AS doc_id, turn, place FROM p WHERE place <= 400")
def round_robin_admission(spark: SparkSession, folder: str) -> DataFrame:
    """The 400 documents admitted, one of each source in turn."""
    found = D.admission(_docs(spark, folder), 400)
    return found.select("source_id", F.col("id").alias("doc_id"), F.col("turn").cast("bigint").alias("turn"), F.col("place").cast("bigint").alias("place"))


@_r.add(f"WITH {_TURNS} SELECT source_id, 'document_limit' AS stage, count(*) AS n_omitted FROM p WHERE place > 400 GROUP BY source_id")
def omitted_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source that were not admitted."""
    docs = _docs(spark, folder)
    return D.omitted(docs, D.admission(docs, 400)).select("source_id", F.lit("document_limit").alias("stage"), "n_omitted")


@_r.add("WITH q AS (SELECT doc_id AS id, source AS source_id, coalesce(quality, 0) * 0.5 AS p, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents LEFT JOIN labels USING (doc_id)), b AS (SELECT source_id, max(p) AS best FROM q WHERE turn <= 12 GROUP BY 1) SELECT source_id, CASE WHEN turn <= 12 THEN 'first' WHEN best >= 0.15 THEN 'tail' ELSE 'deferred' END AS decision, count(*) AS n FROM q JOIN b USING (source_id) GROUP BY 1, 2")
def score_depth_split(spark: SparkSession, folder: str) -> DataFrame:
    """Documents scored first, in the tail, and deferred, of each source; the label of quality stands for a score."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    docs = D.turns(_docs(spark, folder).select("id", "source_id")).join(labels, "id", "left")
    rows = docs.select("source_id", "turn", (F.coalesce("quality", F.lit(0)) * 0.5).alias("probability"), F.lit(0.0).alias("route"))
    return D.depth_split(rows, 12).groupBy("source_id", "decision").agg(F.count("*").alias("n"))


_SIZES = "z AS (SELECT doc_id AS id, source AS url, strlen(coalesce(text, '')) AS bytes, lang AS scope FROM documents)"


@_r.add(f"WITH {_SIZES}, k AS (SELECT url, bytes, scope, min(id) AS companion, row_number() OVER (PARTITION BY url ORDER BY bytes DESC, scope) AS k FROM z GROUP BY 1, 2, 3), j AS (SELECT z.id, companion, row_number() OVER (PARTITION BY z.id ORDER BY k) AS place FROM z JOIN k ON z.url = k.url AND (z.bytes <> k.bytes OR z.scope <> k.scope)) SELECT id AS doc_id, companion, place FROM j WHERE place <= 2")
def same_url_companions(spark: SparkSession, folder: str) -> DataFrame:
    """The two largest other documents of the same source, of another size or language."""
    docs = table(spark, folder, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), F.col("lang").alias("scope"))
    return D.companions(rows).select(F.col("id").alias("doc_id"), "companion", F.col("place").cast("bigint").alias("place"))


@_r.add(r"WITH t AS (SELECT doc_id, regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\p{L}\p{N}]', '', 'g') AS k FROM documents) SELECT doc_id, k AS title_key, min(doc_id) OVER (PARTITION BY k) AS first_doc, count(*) OVER (PARTITION BY k) AS n_copies FROM t WHERE length(k) >= 12")
def title_key_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The first document with the same title key, and how many have it."""
    rows = _docs(spark, folder).select("id", C.title_key(F.col("title")).alias("title_key")).where("title_key is not null")
    sums = rows.groupBy("title_key").agg(F.min("id").alias("first_doc"), F.count("*").alias("n_copies"))
    return rows.join(sums, "title_key").select(F.col("id").alias("doc_id"), "title_key", "first_doc", "n_copies")


@_r.add("SELECT doc_id, left(text, 400) AS excerpt, strlen(text) > strlen(left(text, 400)) AS truncated FROM documents")
def excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """The first 400 characters of each text, and whether there is more."""
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", C.excerpt(text).alias("excerpt"), (F.octet_length(text) > F.octet_length(C.excerpt(text))).alias("truncated"))


@_r.add("SELECT doc_id, source, strlen(coalesce(text, '')) AS bytes, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, CAST(coalesce(sum(len(string_split(coalesce(text, ''), chr(10)))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_line FROM documents")
def bundle_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document starts when those of a source are bundled by id."""
    from lodesift.operators.rollups import line_offsets

    rows = line_offsets(table(spark, folder, "documents"), "source", "doc_id", "text")
    return rows.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"), "n_lines", "first_line")


@_r.add(f"WITH {_SCORES} SELECT question_id AS claim_id, id AS doc_id, round(p, 9) AS supports, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY p DESC, id) AS place FROM s WHERE p >= 0.5) WHERE place <= 5")
def claim_hits_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five documents that support a claim best, at 0.5 or more."""
    found = R.top(scores(spark, folder, 0.5), 5, F.desc("usable_evidence"), "id")
    return found.select(F.col("question_id").alias("claim_id"), F.col("id").alias("doc_id"), F.round("usable_evidence", 9).alias("supports"), F.col("place").cast("bigint").alias("place"))


@_r.add(f"WITH {_SCORES} SELECT question_id AS claim_id, round(max(p), 9) AS best, arg_max(id, (p, -id)) AS witness, count(*) FILTER (p >= 0.5) AS n_hits FROM s GROUP BY 1")
def claim_maxima(spark: SparkSession, folder: str) -> DataFrame:
    """The best support of each claim, its first witness, and hits at 0.5 or more."""
    found = scores(spark, folder).groupBy("question_id").agg(F.max("usable_evidence").alias("best"), F.max(F.struct("usable_evidence", (-F.col("id")).alias("o"))).alias("w"), F.count_if(F.col("usable_evidence") >= 0.5).alias("n_hits"))
    return found.select(F.col("question_id").alias("claim_id"), F.round("best", 9).alias("best"), (-F.col("w.o")).alias("witness"), "n_hits")


@_r.add(f"WITH {_SCORES} SELECT d.source AS source_id, count(p) AS n_scored, count(*) FILTER (p >= 0.4) AS n_selected, round(max(p), 9) AS best FROM s JOIN documents d ON d.doc_id = s.id GROUP BY 1")
def pool_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Scored and selected pairs of each source and the best score."""
    from lodesift.operators.rollups import pool_stats as stats

    rows = scores(spark, folder).join(_docs(spark, folder).select("id", "source_id"), "id").select("source_id", F.col("usable_evidence").alias("probability"))
    return stats(rows).withColumn("best", F.round("best", 9))


@_r.add()
def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Visible text of each page and the scope it was read from."""
    from lodesift.functions.html import article_text

    found = article_text(table(spark, folder, "pages").select("page_id", "html"), "html")
    return found.select("page_id", "scope", C.scope_rank(F.col("scope")).alias("scope_rank"), F.col("visible_text"))

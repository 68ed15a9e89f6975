"""Queries on the plans of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import planner
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql



def _plans(spark: SparkSession, folder: str) -> DataFrame:
    """The plans of all questions of `benchmark`, as they are."""
    return table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"), planner.planned(F.col("text")).alias("plan"))


_TOKENS = "SELECT item_id, unnest(regexp_split_to_array(trim(text), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(trim(text), '\\s+'), 1) AS i FROM benchmark WHERE strlen(text) <= 2000"
_BARE = "regexp_replace(regexp_replace(w, '^[\"“”‘’''(\\[{<¿¡`]+', ''), '[\"“”‘’'')\\]}>.,;:!?`]+$', '')"


@_r.add(f"SELECT item_id, count(*) AS n_tokens, string_agg(b, ' ' ORDER BY i) AS tokens FROM (SELECT item_id, i, {_BARE} AS b FROM ({_TOKENS})) WHERE regexp_matches(b, '[\\p{{L}}\\p{{N}}]') GROUP BY 1")
def plan_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each question as its plan has them."""
    return _plans(spark, folder).select("item_id", F.size("plan.tokens").cast("bigint").alias("n_tokens"), F.array_join("plan.tokens", " ").alias("tokens")).where("n_tokens > 0")


@_r.add()
def plan_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every variant of every question, with its kind."""
    return _plans(spark, folder).select("item_id", F.posexplode("plan.variants").alias("place", "v")).select("item_id", "place", "v.kind", "v.text")


# Questions that name things: sentences around words of every row, of which one engine makes a plan and the other what it must hold.
# a, b and c are words of the row, each with an ending of its own.
_WORD = "coalesce(get(regexp_extract_all(lower(text), '([a-z]{{4,}})', 1), {0}), 'none')"
_NAMES = (("a", 0, "'axq'"), ("b", 1, "'bxq'"), ("c", 2, "'cxq'"))
_SENTENCES = (
    "'Please compare ' || a || 'Kit v' || item_id || '.1 with ' || upper(substr(b, 1, 1)) || substr(b, 2) || ' Store ' || item_id || ', and their upgrade ' || c || '.'",
    "'¿Dónde está la ' || a || ' de ' || b || ' y ' || c || '?'",
    "'Find \"' || a || ' ' || b || '\" notes as of 2025-' || substr(CAST(101 + item_id % 12 AS STRING), 2) || '-04. Do not list old ' || c || '.'",
    "'What is ' || a || '?'",
)
_ASKED = "CASE item_id % 4 " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(_SENTENCES)) + " END"
_ROWS = "(SELECT item_id, " + ", ".join(f"coalesce(regexp_extract_all(lower(text), '[a-z]{{4,}}')[{i + 1}], 'none') || {end} AS {n}" for n, i, end in _NAMES) + " FROM benchmark)"
_FORM = f"(SELECT *, upper(substr(b, 1, 1)) || substr(b, 2) AS bb, item_id % 4 AS f, {_ASKED} AS q FROM {_ROWS})"


def _worded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", "text", *[F.expr(_WORD.format(i) + f" || {end}").alias(n) for n, i, end in _NAMES])


def _named(spark: SparkSession, folder: str) -> DataFrame:
    rows = _worded(spark, folder).withColumn("question", F.expr(_ASKED))
    return rows.select("item_id", "question", planner.planned(F.col("question")).alias("plan"))


def _each(lists: dict[int, str], column: str) -> str:
    """SQL of one row for each element of the list that a sentence's form has."""
    arms = " ".join(f"WHEN {i} THEN [{x}]" for i, x in lists.items())
    return f"SELECT item_id, unnest(CASE f {arms} END) AS {column} FROM {_FORM} WHERE f IN ({', '.join(map(str, lists))})"


# The whole text of every row, of any length, with its sentence behind it; a row whose id gives no sentence is its text alone.
_WHOLE = f"(SELECT item_id, concat_ws(' ', text, {_ASKED}) AS q FROM {_ROWS.replace('SELECT item_id, ', 'SELECT item_id, text, ')})"


@_r.add(f"SELECT item_id, b AS date FROM (SELECT item_id, {_BARE} AS b FROM (SELECT item_id, unnest(regexp_split_to_array(trim(q), '\\s+')) AS w FROM {_WHOLE})) WHERE regexp_matches(b, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')")
def plan_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates that questions name, in their whole texts and in the sentences around their words."""
    rows = _worded(spark, folder).select("item_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.expr(_ASKED)).alias("question"))
    return rows.select("item_id", F.explode(planner.named_dates(F.col("question"))).alias("date"))


@_r.add(_each({0: "a || 'Kit', 'v' || item_id || '.1', bb || ' Store ' || item_id"}, "entity"))
def plan_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The names in questions."""
    return _named(spark, folder).select("item_id", F.explode("plan.entities").alias("entity"))


@_r.add(_each({
    0: "'Please compare ' || a || 'Kit v' || item_id || '.1 with ' || bb || ' Store ' || item_id, 'their upgrade ' || c", 1: "'Dónde está la ' || a || ' de ' || b, c",
    2: "regexp_replace(split_part(q, '. Do not', 1), '\"', '', 'g')", 3: "'What is ' || a",
}, "facet"))
def plan_facets(spark: SparkSession, folder: str) -> DataFrame:
    """The clauses with content of questions."""
    return _named(spark, folder).select("item_id", F.explode("plan.facets").alias("facet"))


@_r.add(f"SELECT item_id, CASE f WHEN 0 THEN 'keyword_terms' ELSE 'instruction_clause' END AS stage, CASE f WHEN 0 THEN c ELSE 'Do not list old ' || c END AS text FROM {_FORM} WHERE f IN (0, 2)")
def plan_omissions(spark: SparkSession, folder: str) -> DataFrame:
    """What the plans of questions leave out, and why."""
    return _named(spark, folder).select("item_id", F.explode("plan.omissions").alias("o")).select("item_id", "o.stage", "o.text")


@_r.add(f"SELECT item_id, CASE f WHEN 0 THEN a || 'Kit v' || item_id || '.1 ' || bb || ' Store ' || item_id || ' upgrade' WHEN 1 THEN a || ' ' || b || ' ' || c WHEN 2 THEN a || ' ' || b || ' notes' ELSE a END AS keywords FROM {_FORM}")
def plan_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The keyword text of questions."""
    return _named(spark, folder).select("item_id", planner.keyword_text(F.col("plan")).alias("keywords"))


@_r.add(_each({
    0: "'Please compare ' || a || 'Kit v' || item_id || '.1 with ' || bb || ' Store ' || item_id, 'their upgrade ' || c", 1: "'Dónde está la ' || a || ' de ' || b, c",
    2: "a || ' ' || b || ' notes'", 3: "a",
}, "query"))
def plan_facet_queries(spark: SparkSession, folder: str) -> DataFrame:
    """What a documentation search is asked: a query for each facet, or the keywords."""
    return _named(spark, folder).select("item_id", F.explode(planner.facet_queries(F.col("plan"), 2, 12)).alias("query"))


@_r.add(_each({
    0: "a || 'Kit', 'v' || item_id || '.1', bb || ' Store ' || item_id, bb, 'Store', CAST(item_id AS VARCHAR), 'upgrade'", 1: "a, b, c", 2: "a || ' ' || b", 3: "a",
}, "query"))
def plan_jobs_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Substring queries of a listing: quoted phrases, else names and words."""
    return _named(spark, folder).select("item_id", F.explode(planner.jobs_queries(F.col("plan"), F.col("question"))).alias("query"))


@_r.add(f"SELECT item_id, CASE f WHEN 1 THEN a || ' ' || b || ' ' || c WHEN 0 THEN a || 'Kit v' || item_id || '.1 ' || bb || ' Store ' || item_id || ' upgrade' WHEN 2 THEN a || ' ' || b || ' notes' ELSE a END AS site_query FROM {_FORM}")
def plan_site_queries(spark: SparkSession, folder: str) -> DataFrame:
    """What a keyword index in English is asked: names of a question in another language, else keywords."""
    return _named(spark, folder).select("item_id", planner.site_query(F.col("plan"), F.lit(True)).alias("site_query"))


@_r.add("SELECT o_orderkey, o_orderkey % 30 + (400 - o_orderkey % 30) // greatest(o_orderkey % 4, 1) AS ceiling FROM orders")
def facet_ceilings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that may be held after each facet's query."""
    return table(spark, folder, "orders").select("o_orderkey", planner.facet_ceiling(F.lit(400), F.col("o_orderkey") % 30, F.col("o_orderkey") % 4).alias("ceiling"))


@_r.add(f"SELECT item_id, n, CAST(f AS BIGINT) AS f FROM (SELECT count(DISTINCT q) AS n, min(f) AS f, min(item_id) AS item_id FROM {_FORM} GROUP BY q)")
def plan_json(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of equal questions are equal texts and plans of others aren't: for each text of a plan, its first question, how many different questions have it, and the question's form."""
    rows = _named(spark, folder).select("item_id", "question", planner.stable_json(F.col("plan")).alias("j"))
    again = rows.repartition(3, "question").unionByName(rows)
    found = again.groupBy("j").agg(F.count_distinct("question").alias("n"), F.min("item_id").alias("item_id"))
    return found.select("item_id", "n", (F.col("item_id") % 4).alias("f"))

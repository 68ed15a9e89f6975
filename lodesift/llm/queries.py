"""The numbered queries, each a thin layer over its operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.llm import bpe, decontaminate, itq, kdtree, language, merkle, mixing, oracles, quality, quotes, simhash, toxicity, training_order, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word SimHash of every document, and the components of links at four or fewer bits."""
    found = simhash.groups(simhash.fingerprints(_table(spark, sf_dir, "documents"), features=((4, False),)), most=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document mixed to weights 1, 2, 3 of its source, none more than three times."""
    found = mixing.mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "repeats")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the tokenised documents, with its slot in the training order and its place in the shards."""
    found = training_order.materialise(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("ids", "doc_ids").withColumnRenamed("crc", "tokens_crc32")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdicts of low quality and then toxicity for every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    found = toxicity.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), "p_low_quality", F.col("is_low_quality").alias("low_quality"), "p_toxic", F.col("is_toxic").alias("toxic"))


def op5_byte_pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.98 or more between embeddings of a label, and their components."""
    found = itq.near(_table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, its declared language and its source."""
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text", "lang", "source"), language.fit(docs), "text", "lang", "source")
    return found.select("doc_id", "language", "probability", "text_language", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its visible text, its html tag, its address suffix and its host."""
    html = F.col("html")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", language.visible(html).alias("text"), language.declared_in_markup(html).alias("lang"))
    found = language.identify(pages, language.fit(pages), "text", "lang", "url")
    return found.select("page_id", "language", "probability", "text_language", "kept")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and failure bits of every document, and the verdict of policy v2."""
    found = quality.ledger(_table(spark, sf_dir, "documents"))
    base, full = quality.POLICIES
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(F.col("id").alias("doc_id"), *names, (~quality.verdict(base)).alias("base_failed"), quality.verdict(full).alias("kept"), "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy and rule: rows that fail it, rows dropped for it alone, rows kept without it."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents")))


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes."""
    found = kdtree.shard(_table(spark, sf_dir, "documents"), shards=16)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with the message that it replies to and its place in its conversation."""
    found = quotes.chat(quotes.linked(_table(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("conv", "conv_id").drop("body")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the trees of its source and of all sources, checked against texts without line ends."""
    docs = _table(spark, sf_dir, "documents")
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(altered, merkle.leaf(*columns(F.replace("text", F.lit("\n"), F.lit("")))))
    return merkle.manifest(docs, merkle.leaf(*columns(F.col("text"))), changed).withColumnRenamed("id", "doc_id")


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten words of a benchmark item."""
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as 16 indexes into codebooks of 64 entries, with its error and that of its label."""
    found = yinyang.compress(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


_ALL = (
    op1_simhash_near_dedup, op2_source_mixing, op3_training_order, op4_toxicity_chain, op5_byte_pair_codec, op6_embedding_near_dedup, op7_language_id, language_id_pages,
    op8_quality_ledger, quality_ablation, op9_kd_tree_shards, op10_quotation_linking,
    op11_merkle_manifest, op12_benchmark_decontamination, op13_vector_codes,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORD = r"[^\x20\x09-\x0D]+"
#: The ledger: words of a window of eight are compared as words, not by hashes as the operator does.
_LEDGER = (
    f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), w AS (SELECT doc_id, t, r, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d), "
    "p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), "
    "k AS (SELECT r, i, concat_ws(' ', x, " + ", ".join(f"lead(x, {n}) OVER o" for n in range(1, 8)) + ") AS v, lead(x, 7) OVER o AS z FROM p WINDOW o AS (PARTITION BY r ORDER BY i)), "
    "m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM k WHERE z IS NOT NULL) WHERE n > 1), "
    "c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM m) GROUP BY r), "
    "q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, "
    r"coalesce(c.n, 0) AS n_repeat_words, CAST(len(regexp_extract_all(t, '\p{L}+')) AS BIGINT) AS n_letter_runs FROM w LEFT JOIN c USING (r)), "
    "b AS (SELECT *, " + " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(quality.RULES)) + " AS failed FROM q)"
)
_RULE_ROWS = ", ".join(f"('{p.version}', '{name}', {p.mask()}, {1 << i})" for p in quality.POLICIES for i, (name, _) in enumerate(quality.RULES) if name in p.rules)

SQL: dict[str, str] = {
    "op8_quality_ledger": f"{_LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.POLICIES[0].mask()} <> 0 AS base_failed, failed & {quality.POLICIES[1].mask()} = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM b",
    "quality_ablation": f"{_LEDGER}, v AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS v(version, rule, mask, bit)) SELECT version, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only, count(*) FILTER (failed & mask IN (0, bit)) AS n_kept_without FROM b CROSS JOIN v GROUP BY 1, 2",
    "op11_merkle_manifest": oracles.MERKLE,
    "op12_benchmark_decontamination": oracles.LEAKS,
    "op13_vector_codes": oracles.CODES,
}

"""Queries on recorded listings, batches, fitted ranges, reservations, versions of sessions, bodies and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodesift.functions import bodies as B
from lodesift.functions import columns as C
from lodesift.functions.fitting import fitted
from lodesift.operators import ranking as R
from lodesift.operators.packing import packed
from lodesift.operators.reservations import reservations
from lodesift.operators.running import spans
from lodesift.plans.registry import Registry
from lodesift.sources import listing as L
from lodesift.sources import states
from lodesift.sources.shared import scratch
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql

# Recorded listings. One listing says that it has 120 rows, one repeats its ids from the second page on, the others end at the page limit.
PAGE, PAGES = 100, 6
#: Pages of a folder: 25,600 rows, about 2 MB.
FOLDER_PAGES = 256
_LISTED = (
    f"l AS (SELECT o_orderpriority AS listing, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders), "
    f"i AS (SELECT listing, pos // {PAGE} AS page, CAST(pos % {PAGE} AS INT) AS place, CASE WHEN listing = '3-MEDIUM' THEN 'r' || pos % {PAGE} ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN listing = '2-HIGH' THEN 120 END AS matched, o_custkey FROM l), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY listing, id ORDER BY page, place) = 1 AS new FROM i), g AS (SELECT listing, page, bool_or(new) AS new, max(matched) AS m FROM f GROUP BY 1, 2), "
    f"k AS (SELECT *, coalesce(bool_and(new AND (m IS NULL OR m > (page + 1) * {PAGE})) OVER (PARTITION BY listing ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AND page < {PAGES} AS ok FROM g)"
)


@_r.add(f"WITH {_LISTED} SELECT listing, CAST(page AS BIGINT) AS page, place, id, o_custkey AS customer FROM f JOIN (SELECT listing, page FROM k WHERE ok) USING (listing, page) WHERE new")
def recorded_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders recorded as the pages of listings by priority, and read again page by page by the data source."""
    name = F.col("o_orderpriority")
    at = F.row_number().over(Window.partitionBy(name).orderBy("o_orderkey")) - 1
    ident = F.when(name == "3-MEDIUM", F.concat(F.lit("r"), (at % PAGE).cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    rows = table(spark, folder, "orders").select(name.alias("priority"), "o_orderkey", ident.alias("id"), "o_custkey")
    path = scratch(spark, "listings")
    L.record(rows, path, "priority", F.col("o_orderkey"), "id", PAGE, F.when(F.col("priority") == "2-HIGH", 120), FOLDER_PAGES)
    pages = L.listings(spark, path).where(F.col("offset") < PAGE * PAGES)
    found = L.followed(pages, PAGES)
    return found.select("listing", F.col("page").cast("bigint").alias("page"), "place", "id", F.get_json_object("row", "$.o_custkey").cast("bigint").alias("customer"))


# Batches of one key.
_OPENS = "r.n >= 8 OR r.total + e.bytes > 20000"


@_r.add(f"WITH RECURSIVE e AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, row_number() OVER (ORDER BY doc_id) AS i FROM documents), r AS (SELECT doc_id, bytes, i, CAST(0 AS BIGINT) AS batch, 1 AS n, 700 + bytes AS total FROM e WHERE i = 1 UNION ALL SELECT e.doc_id, e.bytes, e.i, r.batch + CASE WHEN {_OPENS} THEN 1 ELSE 0 END, CASE WHEN {_OPENS} THEN 1 ELSE r.n + 1 END, CASE WHEN {_OPENS} THEN 700 + e.bytes ELSE r.total + e.bytes END FROM r JOIN e ON e.i = r.i + 1) SELECT doc_id, bytes, batch FROM r")
def document_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into calls in the order of their ids, as one key."""
    rows = table(spark, folder, "documents").select(F.lit(0).alias("key"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    return packed(rows, "key", "doc_id", "bytes", base=700, most=8, limit=20_000).drop("key")


# Ranges that fit as JSON. Half of the texts are full of quotes, backslashes and control characters.
LIMIT, SMALLEST = 2_500, 256
_SIZE = r"(strlen({0}) + len(regexp_extract_all({0}, '[\"\\\\\x08\t\n\f\r]')) + 5 * len(regexp_extract_all({0}, '[\x00-\x07\x0B\x0E-\x1F]')) + 2)"
_PIECE = "decode(array_slice(raw, s + 1, e))"
_LEAD = "left(hex(array_slice(raw, {0} + 1, {0} + 1)), 1) NOT IN ('8', '9', 'A', 'B')"
_HALF = "CASE WHEN h >= e OR " + _LEAD.format("h") + " THEN h WHEN " + _LEAD.format("(h + 1)") + " THEN h + 1 WHEN " + _LEAD.format("(h + 2)") + " THEN h + 2 ELSE h + 3 END"


@_r.add(
    "WITH RECURSIVE d AS (SELECT doc_id, encode(t) AS raw, strlen(t) AS n, 18 + " + _SIZE.format("title") + " AS frame FROM (SELECT *, split_part(t, chr(10), 1) AS title FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aei', '\"\\' || chr(1)) ELSE text END AS t FROM documents WHERE text IS NOT NULL))), "
    f"p AS (SELECT doc_id, raw, frame, 0::BIGINT AS s, n::BIGINT AS e, n < 2 * {SMALLEST} OR frame + " + _SIZE.format("decode(raw)") + f" <= {LIMIT} AS done FROM d "
    f"UNION ALL SELECT doc_id, raw, frame, s, e, e - s < 2 * {SMALLEST} OR frame + " + _SIZE.format(_PIECE) + f" <= {LIMIT} FROM (SELECT doc_id, raw, frame, unnest([s, m]) AS s, unnest([m, e]) AS e FROM (SELECT *, {_HALF} AS m FROM (SELECT *, s + (e - s) // 2 AS h FROM p WHERE NOT done)))) "
    "SELECT doc_id, s, e FROM p WHERE done"
)
def fitted_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Each text cut until its pieces fit a call as JSON beside the title."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aei", '"\\\x01')).otherwise(F.col("text"))
    docs = table(spark, folder, "documents").select("doc_id", text.alias("text"))
    ranges = fitted(C.title_of(F.col("text")), F.col("text"), LIMIT, SMALLEST)
    return docs.select("doc_id", F.explode(ranges).alias("r")).select("doc_id", F.col("r.s").cast("bigint").alias("s"), F.col("r.e").cast("bigint").alias("e"))


# Reservations. An event reserves at its time and ends after as many minutes as its value says; without a value it stays open.
_BUDGET, _RESERVED = 1_500_000, 65_536
_ENDS = "CASE event_id % 8 WHEN 0 THEN 'release' WHEN 1 THEN 'retain' WHEN 2 THEN 'retain' ELSE 'settle' END"
_OF = "OVER (PARTITION BY event_type ORDER BY tm, step, event_id ROWS UNBOUNDED PRECEDING)"


@_r.add(
    f"WITH v AS (SELECT event_type, event_id, epoch_us(ts) AS tm, 1 AS step, 'reserve' AS kind, 0 AS cost FROM events UNION ALL SELECT event_type, event_id, epoch_us(ts) + 60000000 * CAST(floor(value) AS BIGINT), 0, {_ENDS}, CAST(floor(value * 900) AS BIGINT) FROM events WHERE value IS NOT NULL), "
    f"s AS (SELECT *, sum(CASE WHEN kind = 'reserve' THEN {_RESERVED} ELSE -{_RESERVED} END) {_OF} AS open, sum(CASE WHEN kind = 'settle' THEN cost ELSE 0 END) {_OF} AS settled, sum(CASE WHEN kind = 'retain' THEN {_RESERVED} ELSE 0 END) {_OF} AS retained, sum(CASE WHEN kind = 'reserve' THEN 1 ELSE -1 END) {_OF} AS in_flight FROM v), "
    "e AS (SELECT *, sum(CASE WHEN kind = 'settle' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY tm, step, event_id ROWS UNBOUNDED PRECEDING) AS g FROM v WHERE kind IN ('settle', 'retain')), "
    "u AS (SELECT *, sum(CASE WHEN kind = 'retain' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, g ORDER BY tm, step, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM e), "
    f"c AS (SELECT event_type, (tm, step, event_id) AS place, CASE WHEN kind = 'reserve' THEN 'refused' ELSE 'overspent' END AS why FROM s WHERE kind IN ('reserve', 'settle') AND open + settled + retained > {_BUDGET} UNION ALL SELECT event_type, (tm, step, event_id), 'unresolved' FROM u WHERE streak >= 3), "
    "f AS (SELECT event_type, min((place, why)) AS first FROM c GROUP BY 1) "
    "SELECT event_type, event_id, kind, CAST(open AS BIGINT) AS open, CAST(settled AS BIGINT) AS settled, CAST(retained AS BIGINT) AS retained, CAST(in_flight AS BIGINT) AS in_flight, CAST(open + settled + retained AS BIGINT) AS accounted, "
    "CASE WHEN first IS NULL OR (tm, step, event_id) < first[1] THEN 'open' WHEN (tm, step, event_id) = first[1] THEN first[2] ELSE 'stopped' END AS state FROM s LEFT JOIN f USING (event_type)"
)
def ledger_reservations(spark: SparkSession, folder: str) -> DataFrame:
    """What is open, settled and retained after each step of each provider's calls, and where it stops; a type stands for a provider."""
    events = table(spark, folder, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    begun = events.select("event_type", "event_id", "at", F.lit(1).alias("step"), F.lit("reserve").alias("kind"), F.lit(0).cast("bigint").alias("cost"))
    until = F.col("at") + F.floor("value") * 60_000_000
    ended = events.where("value is not null").select("event_type", "event_id", until.alias("at"), F.lit(0).alias("step"), F.expr(_ENDS).alias("kind"), F.floor(F.col("value") * 900).alias("cost"))
    rows = begun.unionByName(ended).withColumn("reserved", F.lit(_RESERVED)).withColumn("time", F.timestamp_micros("at"))
    found = reservations(rows, "event_type", ("at", "step", "event_id"), "kind", "reserved", "cost", _BUDGET, bucket=spans("time", 86_400))
    return found.select("event_type", "event_id", "kind", "open", "settled", "retained", "in_flight", "accounted", "state")


# Versions of sessions. The first call finds the small parts of each brand; brands with an even number then ask for more.
_SEEN = "SELECT p_brand AS question_id, p_partkey AS id, p_retailprice AS relevance, CAST(p_partkey % 365 AS DOUBLE) AS recency FROM part"
_EVEN = "CAST(right(p_brand, 1) AS INT) % 2 = 0"


def _ranked_sql(where: str) -> str:
    fused = "1.0::DOUBLE / (10 + rank() OVER (PARTITION BY question_id ORDER BY relevance DESC)) + 0.6::DOUBLE / (10 + rank() OVER (PARTITION BY question_id ORDER BY recency DESC))"
    return f"SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, id) AS place FROM (SELECT *, {fused} AS fused FROM ({_SEEN} WHERE {where}))"


def _calls(spark: SparkSession, folder: str) -> str:
    """Stores two calls of every session, and gives the table's folder."""
    part = table(spark, folder, "part")
    rows = part.select(F.col("p_brand").alias("question_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("relevance"), (F.col("p_partkey") % 365).cast("double").alias("recency"), "p_size", F.expr(_EVEN).alias("even"))
    path = scratch(spark, "sessions")
    states.save(rows.where("p_size <= 25").drop("p_size", "even"), path, "question_id", 1)
    more = rows.where("p_size > 25 and even").drop("p_size", "even")
    states.save(states.continued(states.load(spark, path, "question_id").drop("call"), more, "question_id", "id"), path, "question_id", 2)
    return path


def _placed(rows: DataFrame) -> DataFrame:
    found = R.fused(rows.select("question_id", "id", "relevance", "recency"), ("relevance", "recency"), (1.0, 0.6)).withColumn("bucket", F.lit(2))
    return R.final_order(found).select("question_id", "id", F.col("place").cast("bigint").alias("place"))


@_r.add(_ranked_sql(f"p_size <= 25 OR {_EVEN}"))
def continued_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The order of each session's documents after a first call and one that asks for more: as that of one call with all of them."""
    return _placed(states.load(spark, _calls(spark, folder), "question_id"))


@_r.add(_ranked_sql("p_size <= 25"))
def replayed_session(spark: SparkSession, folder: str) -> DataFrame:
    """The order after the first call, read again once the second one has been stored."""
    return _placed(states.load(spark, _calls(spark, folder), "question_id", upto=1))


# Bodies: some with a NUL, some with a broken character, some declared as Markdown or plain text.
_TYPE = "CASE WHEN page_id % 7 = 0 THEN 'text/markdown; charset=utf-8' WHEN page_id % 7 = 1 THEN 'Text/Plain' WHEN page_id % 7 = 2 THEN NULL ELSE 'text/html' END"


@_r.add(
    f"WITH b AS (SELECT page_id, {_TYPE} AS type, coalesce(html, '') AS t, encode(coalesce(html, '')) || CASE WHEN page_id % 5 = 0 THEN '\\x00'::BLOB WHEN page_id % 5 = 1 THEN '\\xC3\\x28'::BLOB ELSE ''::BLOB END AS raw FROM pages), "
    "k AS (SELECT *, CASE WHEN lower(type) LIKE 'text/html%' THEN 'html' WHEN lower(type) LIKE 'text/markdown%' THEN 'markdown' ELSE 'text' END AS kind FROM b) "
    "SELECT page_id, kind, CASE WHEN page_id % 5 = 1 THEN 'not UTF-8 text' WHEN page_id % 5 = 0 THEN 'binary data' WHEN kind = 'markdown' AND regexp_matches(t, '^\\s*(?i:<!doctype html|<html)') THEN 'a page and no Markdown' END AS refused, sha256(raw) AS sha256, octet_length(raw) AS bytes, CASE WHEN kind = 'text' AND page_id % 5 > 1 AND trim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' THEN sha256(trim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) END AS plain_sha256 FROM k"
)
def page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as bytes: what each is read as, why it is refused, its hash and size, and the hash of plain texts. Texts without words count as read here."""
    raw = F.expr("concat(encode(coalesce(html, ''), 'UTF-8'), CASE WHEN page_id % 5 = 0 THEN X'00' WHEN page_id % 5 = 1 THEN X'C328' ELSE X'' END)")
    found = table(spark, folder, "pages").select("page_id", B.body(F.expr(_TYPE), raw).alias("b"))
    plain = F.when((F.col("b.kind") == "text") & F.col("b.refused").isNull(), F.sha2(F.col("b.text").cast("binary"), 256))
    return found.select("page_id", "b.kind", F.nullif(F.col("b.refused"), F.lit("empty")).alias("refused"), "b.sha256", "b.bytes", plain.alias("plain_sha256"))


@_r.add()
def folder_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes of each table's folder, from the names and sizes of files alone."""
    files = states.inventory(spark, folder)
    name = F.regexp_extract("path", r"/(\w+)\.parquet(?:/|$)", 1)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"))


# Replies as JSON, some with a key twice: at the top, deep inside, or written in two ways.
_REPLY = (
    "CASE o_orderkey % 6 WHEN 0 THEN '{\"a\":' || o_custkey || ',\"b\":{\"c\":[{\"x\":1,\"x\":' || o_custkey || '}]}}' WHEN 1 THEN '{\"a\":1,\"' || lower(o_orderstatus) || '\":2,\"a\":' || o_custkey || '}' "
    "WHEN 2 THEN '{\"a\":[' || o_custkey || '}' WHEN 3 THEN '{\"a\":' || o_custkey || ',\"b\":[1,2,{\"a\":3}]}' WHEN 4 THEN '{\"' || lower(o_orderstatus) || '\":1,\"o\":{\"o\":2}}' ELSE '{\"k' || o_custkey % 3 || '\":1,\"k1\":{\"a\":1,\"{0}\":2}}' END"
)


@_r.add(
    f"WITH b AS (SELECT o_orderkey, {_REPLY.replace('{0}', chr(92) + 'u0061')} AS body FROM orders), v AS (SELECT o_orderkey, body FROM b WHERE json_valid(body)), "
    "t AS (SELECT o_orderkey FROM v, json_tree(body) AS j WHERE j.key IS NOT NULL GROUP BY o_orderkey, j.parent, j.key HAVING count(*) > 1) "
    "SELECT o_orderkey, json_valid(body) AND o_orderkey NOT IN (SELECT o_orderkey FROM t) AS valid FROM b"
)
def strict_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Whether replies are JSON with no key twice, at any depth."""
    body = F.expr(_REPLY.replace("{0}", "\\\\u0061"))
    return table(spark, folder, "orders").select("o_orderkey", B.strict_json(body).alias("valid"))


# Addresses: all over the range, and right beside the ends of the ranges that are not public.
_ENDS_4 = (0, 1 << 24, 10 << 24, 11 << 24, 1681915904, 1686110208, 2130706432, 2147483648, 2851995648, 2852061184, 2886729728, 2887778304, 3221225472, 3221225728, 3221225984, 3221226240, 3232235520, 3232301056, 3323068416, 3323199488, 3325256704, 3325256960, 3405803776, 3405804032, 3758096384, 4026531840)
_N = f"CASE WHEN event_id % 2 = 0 THEN (event_id * 2654435761) % 4294967296 ELSE (list_extract([{', '.join(map(str, _ENDS_4))}]::BIGINT[], CAST((event_id // 2) % {len(_ENDS_4)} + 1 AS INT)) - (event_id // 64) % 2 + 4294967296) % 4294967296 END"
_A = "(event_id * 40503) % 65536"
_FIRST = f"CASE event_id % 3 WHEN 0 THEN {_A} WHEN 1 THEN 8193 ELSE 64768 + event_id % 768 END"
_OCTETS = "a = n // 16777216 AND b = (n // 65536) % 256"


@_r.add(
    f"WITH e AS (SELECT event_id, CAST({_N} AS BIGINT) AS n, CAST({_FIRST} AS BIGINT) AS s0, CAST((event_id // 3) % 3000 AS BIGINT) AS s1 FROM events), o AS (SELECT *, n // 16777216 AS a, (n // 65536) % 256 AS b, (n // 256) % 256 AS c FROM e) "
    "SELECT event_id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS public_4, "
    "NOT (s0 & 65024 = 64512 OR s0 & 65472 = 65152 OR s0 & 65472 = 65216 OR s0 & 65280 = 65280 OR s0 & 65520 = 16368 OR s0 = 8194 OR (s0 = 8193 AND s1 IN (0, 3512)) OR (s0 = 0 AND s1 = 0)) AS public_6, public_4 AS public_mapped FROM o"
)
def public_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Which addresses made of events are public: as IPv4, as IPv6, and as IPv4 inside IPv6."""
    spark_n = _N.replace("list_extract([", "element_at(array(").replace("]::BIGINT[],", "),").replace("//", "div")
    e = table(spark, folder, "events").select("event_id", F.expr(f"cast({spark_n} as bigint)").alias("n"), F.expr(f"cast({_FIRST} as bigint)").alias("s0"), F.expr("cast((event_id div 3) % 3000 as bigint)").alias("s1"))
    dotted = F.concat_ws(".", *[F.expr(f"cast((n div {1 << s}) % 256 as string)") for s in (24, 16, 8, 0)])
    colons = F.concat(F.lower(F.hex("s0")), F.lit(":"), F.lower(F.hex("s1")), F.lit("::"), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("1")))
    return e.select("event_id", B.public_address(dotted).alias("public_4"), B.public_address(colons).alias("public_6"), B.public_address(F.concat(F.lit("::ffff:"), dotted)).alias("public_mapped"))


@_r.add(
    "SELECT event_id, '{\"user\":' || user_id || ',\"Session-Token\":\"[REDACTED]\",\"log\":[{\"' || event_type || '\":{\"API_KEY\":\"[REDACTED]\",\"at\":[[' || event_id || ']]}},\"kept\"],\"cookies\":\"[REDACTED]\"}' AS body, "
    "'https://h.example/p/' || user_id || '?q=' || event_type || '&access_token=%5BREDACTED%5D&api%5Fkey=%5BREDACTED%5D&page=' || event_id AS url FROM events"
)
def redacted_records(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies and addresses of calls without what their secret keys and parameters hold."""
    body = "concat('{\"user\":', user_id, ',\"Session-Token\":\"s3cr3t-', event_id, '\",\"log\":[{\"', event_type, '\":{\"API_KEY\":[\"s3cr3t\",{\"k\":1}],\"at\":[[', event_id, ']]}},\"kept\"],\"cookies\":{\"a\":\"s3cr3t\"}}')"
    url = "concat('https://h.example/p/', user_id, '?q=', event_type, '&access_token=s3cr3t', event_id, '&api%5Fkey=s3cr3t&page=', event_id, '#token=s3cr3t')"
    return table(spark, folder, "events").select("event_id", B.safe_json(F.expr(body)).alias("body"), B.safe_url(F.expr(url)).alias("url"))

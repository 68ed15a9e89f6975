"""Queries that apply the functions on addresses, texts, replies and dates to values of whole tables.

Each text is made of a row's own values by an expression that both engines read; the SQL then computes the result from that text
with string functions of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import dates, html, records, replies, texts
from lodesift.plans.registry import Registry
from lodesift.sources.tables import table

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


def _over(out: str, key: str, name: str, doc: str, given: str, made: Callable[[Column], Column], result: str, kind: str | None = None) -> None:
    """Registers `made` over the text `given` of each row of a table; `result` is SQL over that text, x, and the row's columns."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, out).withColumn("x", F.expr(given))
        found = made(F.col("x"))
        return rows.select(key, (found.cast(kind) if kind else found).alias("found"))

    query.__name__, query.__doc__ = name, doc
    _r.add(f"SELECT {key}, {result} AS found FROM (SELECT *, {given} AS x FROM {out})")(query)


# Addresses of pages

_PATH = "regexp_replace(url, '^https?://[^/]*', '')"
_PLAIN = f"split_part(split_part({_PATH}, '?', 1), '#', 1)"
_over(
    "pages", "page_id", "docs_paths", "Paths of sections as pages of a site, from the paths of all pages.",
    f"CASE page_id % 6 WHEN 0 THEN {_PATH} WHEN 1 THEN '/' || {_PLAIN} WHEN 2 THEN {_PLAIN} || '/' WHEN 3 THEN {_PLAIN} || '/index' WHEN 4 THEN url ELSE replace({_PLAIN}, '/en/', '/en%2F') END",
    lambda p: records.docs_url(p, "d.example"),
    "CASE WHEN ltrim(trim(x), '/') = '' OR regexp_matches(ltrim(trim(x), '/'), '://|[?#]|\\\\|%2[fF]|%5[cC]') THEN NULL ELSE 'https://d.example' || coalesce(nullif(regexp_replace(rtrim('/' || ltrim(trim(x), '/'), '/'), '/index$', ''), ''), '/') END",
)

_HOSTS = ("therst.example.net", "blog.tionsh.example.com", "tiontion.example.net", "tionble.example.org", "ththan.example.com")
_ODD = "CASE page_id % 7 WHEN 0 THEN replace(url, 'example', 'EXAMPLE') WHEN 1 THEN replace(url, '://', '://u:p@') WHEN 2 THEN replace(url, '/en/', '/en%2f') WHEN 3 THEN replace(url, '.example.net/', '.example.net:8443/') WHEN 4 THEN replace(url, '.example.com/', '.example.com:443/') WHEN 5 THEN '  ' || replace(url, 'http://', 'https://') || ' ' ELSE url END"
_GROUP = "regexp_extract(trim(x), '^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\\d+))?([^?#]*)(\\?[^#]*)?', {})"
_SECURE = f"lower({_GROUP.format(1)}) = 'https' AND {_GROUP.format(2)} = '' AND {_GROUP.format(4)} IN ('', '443')"
_over(
    "pages", "page_id", "canonical_pages", "Which addresses are pages of some hosts: by HTTPS, without user, port or hidden separator.", _ODD, lambda u: records.canonical_page(u, _HOSTS),
    f"{_SECURE} AND lower({_GROUP.format(3)}) IN {_HOSTS} AND NOT regexp_matches(lower({_GROUP.format(5)}), '\\\\|%2f|%5c')",
)
_over(
    "pages", "page_id", "normalized_urls", "The identity of each page's address; some are numbers or of other schemes.",
    f"CASE page_id % 9 WHEN 7 THEN 'https://10.0.' || page_id % 256 || '.1' || {_PATH} WHEN 8 THEN 'mailto:' || page_id ELSE {_ODD} END", records.normalized_url,
    f"CASE WHEN {_SECURE} AND {_GROUP.format(3)} <> '' AND NOT regexp_matches({_GROUP.format(3)}, '^\\d+(\\.\\d+){{3}}$') THEN 'https://' || lower({_GROUP.format(3)}) || coalesce(nullif({_GROUP.format(5)}, ''), '/') || {_GROUP.format(6)} END",
)
_over(
    "pages", "page_id", "same_host_moves", "Where redirects lead that stay on the host of the page.",
    f"CASE page_id % 6 WHEN 0 THEN {_PATH} WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN url WHEN 3 THEN replace(url, 'example', 'elsewhere') WHEN 4 THEN '/' || {_PATH} ELSE replace(url, '://', '://u@') END",
    lambda t: records.same_host_move(F.col("url"), t),
    "CASE WHEN starts_with(x, '/') AND NOT starts_with(x, '//') THEN 'https://' || lower(split_part(split_part(url, '://', 2), '/', 1)) || x WHEN " + _SECURE + f" AND lower({_GROUP.format(3)}) = lower(split_part(split_part(url, '://', 2), '/', 1)) THEN x END",
)
_over(
    "pages", "page_id", "index_flags", "What the names of indexes say: hosts and languages of pages make the names.",
    "replace(split_part(split_part(url, '://', 2), '/', 1), '.example.', CASE page_id % 5 WHEN 0 THEN '_PROD_' WHEN 1 THEN '_es_' WHEN 2 THEN '-spanish-' WHEN 3 THEN '_prod_date_' ELSE '_best_' END) || CASE page_id % 4 WHEN 0 THEN '_asc' WHEN 1 THEN '_desc' WHEN 2 THEN '-es' ELSE '' END",
    lambda n: F.concat_ws(" ", *[F.when(records.index_flags(n)[k], F.lit(k)) for k in ("production", "spanish", "replica")]),
    "concat_ws(' ', CASE WHEN contains(lower(x), 'prod') THEN 'production' END, CASE WHEN contains(lower(x), 'spanish') OR regexp_matches(lower(x), '(^|[_-])es([_-]|$)') THEN 'spanish' END, CASE WHEN suffix(lower(x), '_asc') OR suffix(lower(x), '_desc') THEN 'replica' END)",
)

# Texts

_over(
    "documents", "doc_id", "index_notices", "Texts without the notice that they begin with; other quotes stay.",
    "CASE doc_id % 3 WHEN 0 THEN '> Documentation Index of ' || source || chr(10) || '> in ' || lang || chr(10) || chr(10) || text WHEN 1 THEN '> ' || lang || chr(10) || chr(10) || text ELSE text END", texts.without_notice,
    "CASE WHEN starts_with(x, '> Documentation Index') AND regexp_replace(text, '^([ \t]*\n)*', '') <> '' THEN regexp_replace(text, '^([ \t]*\n)*', '') ELSE x END",
)
_over(
    "documents", "doc_id", "fence_themes", "Texts in code fences without the names of themes.", "'```' || lang || ' theme={' || source || '}' || chr(10) || text || chr(10) || '```'", texts.without_themes,
    "regexp_replace(x, '^(```[^ ]*) theme=[^\n]*', '\\1')",
)
_over(
    "documents", "doc_id", "section_headings", "The headings of sections: first lines of texts, marked in several ways.",
    "repeat('#', CAST(doc_id % 4 AS INT)) || ' ' || split_part(text, chr(10), 1) || CASE doc_id % 3 WHEN 0 THEN ' ##' WHEN 1 THEN '#' ELSE '' END || chr(10) || text", texts.heading,
    "nullif(trim(regexp_replace(regexp_extract(x, '^\\s*#+ ([^\n]*)', 1), '(^|\\s)#+\\s*$', '')), '')",
)
_RAW, _MOST = "encode(x)", 61
_INSIDE = "left(hex(array_slice({0}, {1}, {1})), 1) IN ('8', '9', 'A', 'B')"
_over(
    "documents", "doc_id", "byte_prefixes", "The longest start of each text with 61 bytes at most.", "text", lambda t: texts.utf8_prefix(t, _MOST),
    f"CASE WHEN strlen(x) <= {_MOST} THEN x WHEN NOT {_INSIDE.format(_RAW, _MOST + 1)} THEN decode(array_slice({_RAW}, 1, {_MOST})) WHEN NOT {_INSIDE.format(_RAW, _MOST)} THEN decode(array_slice({_RAW}, 1, {_MOST - 1})) WHEN NOT {_INSIDE.format(_RAW, _MOST - 1)} THEN decode(array_slice({_RAW}, 1, {_MOST - 2})) ELSE decode(array_slice({_RAW}, 1, {_MOST - 3})) END",
)

_over(
    "documents", "doc_id", "decoded_entities", "Texts with entities decoded; names that are unknown or too long stay.",
    "replace(replace(replace(replace(text, '&', '&amp;'), 'o', '&#111;'), 'i', '&#x69;'), ' ', '&nbsp;') || '&lt;&copy;&averyverylongname;&#xD800;&#1114112;&;& &&gt;'", html.decoded_text,
    "replace(text, chr(8203), '') || '<&copy;&averyverylongname;&#xD800;&#1114112;&;& &>'",
)

# Replies

_DAY = "substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10)"
_CLOCK = "lpad(CAST(o_orderkey % 26 AS STRING), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')"
_over(
    "orders", "o_orderkey", "utc_seconds", "Times of orders as seconds, where they are written as UTC and lie in the calendar.",
    f"CASE o_orderkey % 5 WHEN 0 THEN substr({_DAY}, 1, 8) || '31' ELSE {_DAY} END || CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE 'T' END || {_CLOCK} || CASE o_custkey % 4 WHEN 0 THEN '+01:00' ELSE 'Z' END", replies.utc_seconds,
    "CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') THEN CAST(epoch(try_strptime(x, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) END", "bigint",
)
_NOW = 800_000_000
_MONTH = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * CAST(substr({_DAY}, 6, 2) AS INT) - 2, 3)"
_over(
    "orders", "o_orderkey", "retry_waits", "Waits that headers ask for: numbers, dates of orders around a time in 1995, and words.",
    f"CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN ' ' || CAST(o_custkey * 7 AS STRING) || ' ' WHEN 2 THEN lower(o_orderpriority) WHEN 3 THEN '-' || CAST(o_custkey AS STRING) ELSE 'Sat, ' || CASE o_orderkey % 3 WHEN 0 THEN '09 May 1995 06:1' || o_custkey % 10 || ':20' ELSE substr({_DAY}, 9, 2) || ' ' || {_MONTH} || ' ' || substr({_DAY}, 1, 4) || ' 10:20:30' END || ' GMT' END",
    lambda h: replies.retry_after(h, F.lit(_NOW)),
    f"CASE WHEN regexp_full_match(trim(x), '\\d+') THEN least(CAST(trim(x) AS BIGINT), 600) WHEN starts_with(x, 'Sat, ') THEN CAST(least(greatest(epoch(strptime(substr(x, 6, 20), '%d %b %Y %H:%M:%S')) - {_NOW}, 0), 600) AS BIGINT) END", "bigint",
)
_FAILS = (("operation timed out after", "timeout"), ("DNS error: cannot resolve", "dns"), ("certificate expired of", "tls"), ("connection refused by", "refused"), ("broken pipe to", "reset"), ("no route to", "unreachable"), ("too many redirects from", "redirect"), ("unexpected EOF of", "body"), ("tcp connect error at", "connect"), ("strange answer of", "invalid_response"))
_over(
    "events", "event_id", "failure_causes", "Why reads failed: a status or a message on an event, or nothing.",
    "CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(190 + event_id % 320 AS STRING) END || '|' || CASE WHEN event_id % 4 = 0 THEN '' ELSE CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(_FAILS)) + " END || ' ' || event_type END",
    lambda t: replies.failure_class(F.nullif(F.split(t, r"\|")[0], F.lit("")).cast("int"), F.nullif(F.split(t, r"\|")[1], F.lit(""))),
    "CASE WHEN try_cast(split_part(x, '|', 1) AS INT) NOT BETWEEN 200 AND 299 THEN 'http_' || split_part(x, '|', 1) " + " ".join(f"WHEN starts_with(split_part(x, '|', 2), '{m}') THEN '{c}'" for m, c in _FAILS) + " END",
)
_BODY = "CASE event_id % 6 WHEN 0 THEN '{\"hits\":[' || event_id || ']}' WHEN 1 THEN '{\"hits\":[],\"user\":' || user_id || '}' WHEN 2 THEN '{\"error\":\"No results for ' || event_type || '\"}' WHEN 3 THEN '{\"error\":\"' || event_type || ' is gone\"}' WHEN 4 THEN '{\"hits\":[' || event_id ELSE '{\"rows\":[' || user_id || ']}' END"
_over(
    "events", "event_id", "reply_classes", "Whether replies have rows, none, are malformed or failed.", f"CASE WHEN event_id % 5 = 0 THEN '404' WHEN event_id % 7 = 0 THEN '503' ELSE '200' END || '|' || {_BODY}",
    lambda t: replies.reply_class(F.split(t, r"\|")[0].cast("int"), F.split(t, r"\|")[1]),
    "(WITH r AS (SELECT split_part(x, '|', 1) AS s, CASE WHEN json_valid(split_part(x, '|', 2)) THEN split_part(x, '|', 2) END AS b) SELECT CASE WHEN s = '404' AND contains(lower(coalesce(json_extract_string(b, '$.error'), '')), 'no results') THEN 'empty' WHEN s <> '200' THEN 'failed' WHEN b IS NULL OR json_extract(b, '$.hits') IS NULL THEN 'malformed' WHEN json_array_length(b, '$.hits') = 0 THEN 'empty' ELSE 'rows' END FROM r)",
)
_CODES = "CASE event_id % 5 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'payment_required' ELSE event_type END"
_DATA = "CASE event_id % 7 WHEN 0 THEN '{\"content\":[{\"text\":\"{' || chr(92) || '\"user' || chr(92) || '\":' || user_id || '}\"}]}' WHEN 1 THEN '{\"content\":[{\"text\":\"' || event_type || '\"}]}' WHEN 2 THEN '{\"text\":\"' || event_type || '\"}' WHEN 3 THEN 'null' WHEN 4 THEN '{\"content\":[{\"text\":\"{}\"},{\"text\":\"{}\"}]}' ELSE '{\"rows\":[' || event_id || ']}' END"
_STATUS = "CASE WHEN event_id % 11 = 0 THEN 429 WHEN event_id % 11 = 1 THEN 500 ELSE 200 END"
_over(
    "events", "event_id", "search_envelopes", "What search replies in envelopes hold: rows, a message, a failure, or a stop.",
    "'{\"success\":' || CASE WHEN event_id % 3 = 0 THEN 'false' ELSE 'true' END || ',\"code\":\"' || " + _CODES + " || '\",\"meta\":{\"format\":\"' || CASE WHEN event_id % 2 = 0 THEN 'blocks' ELSE 'plain' END || '\"},\"data\":' || " + _DATA + " || '}'",
    lambda b: F.concat_ws(" ", replies.envelope(F.expr(_STATUS), b)["outcome"], replies.envelope(F.expr(_STATUS), b)["data"]),
    f"(WITH r AS (SELECT {_STATUS} = 200 AND json_extract_string(x, '$.success') = 'true' AS ok, {_STATUS} = 429 OR json_extract_string(x, '$.code') IN ('rate_limited', 'payment_required') AS stop, json_extract_string(x, '$.meta.format') = 'blocks' AND coalesce(json_array_length(x, '$.data.content'), 0) = 1 AS one), "
    "d AS (SELECT *, CASE WHEN one THEN CASE WHEN json_valid(json_extract_string(x, '$.data.content[0].text')) THEN json_extract_string(x, '$.data.content[0].text') END ELSE CAST(json_extract(x, '$.data') AS VARCHAR) END AS data FROM r) "
    "SELECT CASE WHEN NOT ok AND stop THEN 'stop' WHEN NOT ok THEN 'failed' WHEN data IS NULL OR data = 'null' OR json_exists(data, '$.text') OR json_type(data, '$.content') = 'ARRAY' THEN 'notice' ELSE 'rows ' || data END FROM d)",
)
_over(
    "events", "event_id", "search_statuses", "What statuses of search replies mean for the source's run.", "CAST(196 + event_id % 310 AS STRING)", lambda t: replies.decoded_status(t.cast("int"), F.col("user_id") % 3 > 0),
    "CASE WHEN x IN ('401', '402', '403', '429') THEN 'stop' WHEN NOT starts_with(x, '2') THEN 'failed' WHEN user_id % 3 = 0 THEN 'invalid' ELSE 'rows' END",
)
_over(
    "part", "p_partkey", "content_scopes", "What parts' texts are by their provenance as JSON.",
    "'{\"row\":{\"synthetic\":' || CASE WHEN p_size % 5 = 0 THEN 'true' ELSE 'false' END || '},\"size\":' || p_size || CASE p_partkey % 3 WHEN 0 THEN ',\"content_scope\":\"' || p_brand || '\"' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN ',\"content_kind\":\"' || p_type || '\"' ELSE '' END || '}'", records.content_scope,
    "CASE WHEN json_extract_string(x, '$.row.synthetic') = 'true' THEN 'synthetic_record' ELSE coalesce(json_extract_string(x, '$.content_scope'), json_extract_string(x, '$.content_kind'), 'unknown') END",
)

# Dates

_over(
    "orders", "o_orderkey", "url_date_kinds", "The kind of a date that a document of the same URL lends.", "CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'observed' ELSE lower(o_orderpriority) END", dates.url_date_kind,
    "CASE WHEN o_orderstatus IN ('F', 'O') THEN x ELSE 'modified' END",
)
_TAG = "CASE o_orderkey % 4 WHEN 0 THEN '<time datetime=\"' || " + _DAY + " || 'T10:00:00Z\" itemprop=\"dateModified\"></time>' WHEN 1 THEN '<META name=\"datePublished\" content=\"' || " + _DAY + " || '\">' WHEN 2 THEN '<meta content=\"' || " + _DAY + " || '\" property=\"article:published_time\"><script>{\"dateModified\": \"1999-' || substr(" + _DAY + ", 6, 5) || 'T00:00\"}</script>' ELSE '<p>' || " + _DAY + " || '</p>' END"
_over(
    "orders", "o_orderkey", "page_metadata_dates", "The dates that pages state in their tags or data, pages made of orders.", f"'<html><head><title>' || o_orderpriority || '</title>' || {_TAG} || '<meta name=\"datePublished\" content=\"1980-01-01\"></head></html>'",
    lambda t: F.concat_ws("|", F.coalesce(dates.page_dates(t)["modified"], F.lit("-")), F.coalesce(dates.page_dates(t)["published"], F.lit("-"))),
    "CASE WHEN contains(x, '<time') THEN regexp_extract(x, 'datetime=\"([^\"]*)\"', 1) WHEN contains(x, 'dateModified') THEN regexp_extract(x, 'dateModified\": \"([^\"]*)\"', 1) ELSE '-' END || '|' || regexp_extract(x, '<(?:meta|META) [^>]*content=\"([^\"]*)\"', 1)",
)
_LABEL = "CASE o_orderkey % 4 WHEN 0 THEN 'Intro. Last updated on ' WHEN 1 THEN 'Published: ' WHEN 2 THEN 'Last updated: soon. Then much later and further on still: Published ' ELSE 'In ' END"
_over(
    "orders", "o_orderkey", "text_label_dates", "The first labelled date of a text, texts made of orders.", f"{_LABEL} || {_DAY} || ' by ' || o_orderpriority",
    lambda t: F.concat_ws(" ", dates.labelled(t)["kind"], dates.labelled(t)["days"].cast("string")),
    "CASE o_orderkey % 4 WHEN 0 THEN 'modified ' || date_diff('day', DATE '1970-01-01', CAST(regexp_extract(x, '\\d{4}-\\d{2}-\\d{2}') AS DATE)) WHEN 3 THEN '' ELSE 'published ' || date_diff('day', DATE '1970-01-01', CAST(regexp_extract(x, '\\d{4}-\\d{2}-\\d{2}') AS DATE)) END",
)

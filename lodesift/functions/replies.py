"""Replies of services as data: waits, limits, causes of failure, what a search says beside its rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest wait that is honoured, and the number from which a reset is a time and not a wait.
LONGEST_WAIT, ABSOLUTE_FROM = 600, 1_000_000_000


def utc_seconds(text: Column) -> Column:
    """Seconds of a text like 2026-02-03T04:05:06Z; null for any other form or a time that isn't in the calendar."""
    form = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(form, F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss "))))


def http_date_seconds(text: Column) -> Column:
    """Seconds of a text like Tue, 03 Feb 2026 04:05:06 GMT."""
    bare = F.regexp_extract(text, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    return F.when(bare != "", F.unix_timestamp(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss"))))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait, from a number or a date in the header, from 0 to 600; null if it is neither."""
    wait = F.coalesce(F.when(F.trim(header).rlike(r"^\d+$"), F.trim(header).try_cast("bigint")), http_date_seconds(F.trim(header)) - now)
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0)), F.lit(LONGEST_WAIT))).cast("bigint")


def reset_wait(reset: Column, now: Column, instance_scoped: Column) -> Column:
    """Seconds until a limit starts anew: large numbers are times, small ones waits; what only one instance counts says nothing."""
    wait = F.when(reset > ABSOLUTE_FROM, F.greatest(reset - now, F.lit(0))).otherwise(reset)
    return F.when(~F.coalesce(instance_scoped, F.lit(False)), wait)


def failure_class(status: Column, error: Column) -> Column:
    """Why a read failed: its HTTP status, or the kind of transport error that its message names."""
    found = F.when(status.isNotNull() & ~status.between(200, 299), F.concat(F.lit("http_"), status.cast("string")))
    for name, words in (
        ("timeout", "timed? ?out|deadline"), ("dns", "dns|resolve|name or service"), ("tls", "tls|ssl|certificate"), ("refused", "refused"), ("reset", "reset|broken pipe"),
        ("unreachable", "unreachable|no route"), ("redirect", "redirect"), ("body", "body|decod|truncated|eof"), ("connect", "connect"),
    ):
        found = found.when(F.lower(error).rlike(words), name)
    return found.when(error.isNotNull(), "invalid_response")


def decoded_status(status: Column, envelope_ok: Column) -> Column:
    """What a search reply is: `stop` for codes that end a source's run, else `failed`, `invalid` or `rows`."""
    return F.when(status.isin(401, 402, 403, 429), "stop").when(~status.between(200, 299), "failed").when(~F.coalesce(envelope_ok, F.lit(False)), "invalid").otherwise("rows")


#: Codes of a reply that end a source's run, like the statuses 401, 402, 403 and 429 do.
STOP_CODES = ("unauthorized", "insufficient_scope", "payment_required", "rate_limited")


def envelope(status: Column, body: Column) -> Column:
    """(outcome, data) of a search reply in an envelope: `rows` with its data as JSON, `stop`, `failed`, or `notice` for a message in
    place of rows.

    A reply counts if its status and its own `success` say so. Where its format is blocks and there is one, the block's text is the data, if it
    is JSON. Data with a `text`, a list as `content`, or none at all is a message.
    """
    ok = F.coalesce(status.between(200, 299) & (F.get_json_object(body, "$.success") == "true"), F.lit(False))
    stop = status.isin(401, 402, 403, 429) | F.coalesce(F.get_json_object(body, "$.code").isin(*STOP_CODES), F.lit(False))
    text = F.get_json_object(body, "$.data.content[0].text")
    one = (F.get_json_object(body, "$.meta.format") == "blocks") & text.isNotNull() & F.get_json_object(body, "$.data.content[1]").isNull()
    data = F.when(F.coalesce(one, F.lit(False)), F.when(F.try_parse_json(text).isNotNull(), text)).otherwise(F.get_json_object(body, "$.data"))
    told = F.array_contains(F.json_object_keys(data), "text") | F.coalesce(F.get_json_object(data, "$.content").startswith("["), F.lit(False))
    message = data.isNull() | (data == "null") | F.coalesce(told, F.lit(False))
    outcome = F.when(~ok & stop, "stop").when(~ok, "failed").when(message, "notice").otherwise("rows")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "rows", data).alias("data"))


def reply_class(status: Column, body: Column, path: str = "$.hits", none: str = "no results") -> Column:
    """`rows`, `empty` (also a 404 that says so), `malformed` or `failed`."""
    missing = F.get_json_object(body, path).isNull()
    parsed = F.try_parse_json(body).isNotNull()
    said = F.lower(F.coalesce(F.get_json_object(body, "$.error"), F.lit(""))).contains(none)
    return F.when((status == 404) & said, "empty").when(~status.between(200, 299), "failed").when(~parsed | missing, "malformed").when(F.get_json_object(body, path) == "[]", "empty").otherwise("rows")


def matched_count(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.counts.matched"), F.get_json_object(body, "$.counts.total")).try_cast("bigint")


def notices(body: Column, keys: tuple[str, ...] = ("warning", "notice", "degraded"), limits: tuple[str, ...] = ("degraded",)) -> Column:
    """(stage, message) for each of `keys` that a reply has: `search_limit` for those in `limits`, `upstream` for the others."""
    each = [F.struct(F.lit("search_limit" if k in limits else "upstream").alias("stage"), F.get_json_object(body, f"$.{k}").alias("message")) for k in keys]
    return F.filter(F.array(*each), lambda x: x["message"].isNotNull())


def annotations(body: Column) -> Column:
    """(stage, message) for what a search says of its own rows; `_note` is a limit, the others are remarks."""
    keys = ("__truncated", "_weak_match", "_note", "hint", "note")
    each = [F.struct(F.lit("search_limit" if k == "_note" else "search_annotation").alias("stage"), F.concat(F.lit(f"{k}: "), F.get_json_object(body, f"$.{k}")).alias("message")) for k in keys]
    return F.filter(F.array(*each), lambda x: x["message"].isNotNull())


#: Fixed value: matches that a paged search can show at most.
SHOWN = 1_000


def count_notices(body: Column) -> Column:
    """(stage, message) on the count that a search gives: that it is missing, above what its pages can show, or approximate."""
    total = F.get_json_object(body, "$.nbHits").try_cast("bigint")
    missing = total.isNull() | F.get_json_object(body, "$.nbPages").try_cast("bigint").isNull()
    says_no = lambda path: F.coalesce(F.get_json_object(body, path) == "false", F.lit(False))
    rough = says_no("$.exhaustiveNbHits") | says_no("$.exhaustive.nbHits")
    each = [(missing, "search_notice", "count missing"), (F.coalesce(total > SHOWN, F.lit(False)), "limit", "more than can be shown"), (rough, "limit", "approximate count")]
    return F.flatten(F.array(*[F.when(c, F.array(F.struct(F.lit(s).alias("stage"), F.lit(m).alias("message")))).otherwise(F.array().cast("array<struct<stage:string,message:string>>")) for c, s, m in each]))


def failure_stage(stage: Column, after_stop: Column) -> Column:
    """The stage of a failure row: what was refused only because its client had stopped has a stage of its own."""
    return F.when(F.coalesce(after_stop, F.lit(False)), "not_assessed_after_stop").otherwise(stage)


def read_report(status: Column, error: Column, wait: Column, trace: Column) -> Column:
    """One line on a read that failed: cause, the wait that was asked for, and the trace it belongs to."""
    return F.concat_ws("; ", failure_class(status, error), F.when(wait.isNotNull(), F.concat(F.lit("retry after "), wait.cast("string"), F.lit(" s"))), F.when(F.coalesce(trace, F.lit("")) != "", F.concat(F.lit("trace "), trace)))

"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of dates that say how recent a document is.
RECENCY_KINDS = ("published", "modified", "observed")
#: Thresholds of the status.
SELECTED, UNCERTAIN = 0.4, 0.15
#: Reports whose last dotted part is one of these count as a loss.
LOSS_STAGES = (
    "registry", "route", "intent", "host_state", "fetch", "fetch_deadline", "http", "parse", "search", "auth",
    "authentication", "document_limit", "document_score", "currentness", "not_assessed_after_stop", "original_lost", "content",
)
#: How much of a document its content scope shows; what is not named has rank 0.
SCOPE_RANKS = {
    4: ("structured_roster", "published_markdown_main_content", "article_visible_text", "main_visible_text", "skill_markdown_entrypoint", "stored_editorial_body", "stored_application_body", "stored_source_body", "published_plain_text"),
    3: ("structured_record_with_detail", "research_chunk", "transcript_excerpt"),
    2: ("structured_record", "ai_summary"),
    1: ("indexed_sections_or_metadata", "catalog_metadata", "project_metadata", "job_catalog_metadata"),
}
#: How dates in texts name the months.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Scopes that no source has written itself.
MADE_SCOPES = ("ai_summary", "synthetic_record")


def tokens(text: Column) -> Column:
    """The distinct words of a text: runs of letters and digits in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def title_of(text: Column) -> Column:
    """The first line of a text."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def title_key(title: Column) -> Column:
    """Letters and digits of a title in lower case; null if there are fewer than twelve."""
    key = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "")
    return F.when(F.char_length(key) >= 12, key)


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def excerpt(text: Column, most: int = 400) -> Column:
    return F.left(text, F.lit(most))


def status(probability: Column, selected: float = SELECTED, uncertain: float = UNCERTAIN) -> Column:
    """selected, uncertain or rejected; without a probability a document is uncertain."""
    return F.when(probability >= selected, "selected").when(probability.isNull() | (probability >= uncertain), "uncertain").otherwise("rejected")


def host(url: Column) -> Column:
    """The host of a URL in lower case without `www.`; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(found != "", found)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?", 1)


def authority_tier(url: Column, scope: Column, rules: tuple[tuple[str, str, int], ...], default: int = 3) -> Column:
    """1 (official) to 4, from (host, path prefix, tier) rules in order; made-up scopes are always 4."""
    found = F.when(scope.isin(*MADE_SCOPES), 4)
    for name, prefix, tier in rules:
        found = found.when((host(url) == name) & F.startswith(url_path(url), F.lit(prefix)), tier)
    return found.otherwise(default)


def scope_rank(scope: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for rank, names in SCOPE_RANKS.items():
        found = found.when(scope.isin(*names), rank)
    return found.otherwise(0)


def days(date: Column) -> Column:
    """Days since 1970-01-01 of a text like 2026-02-03; null if that day is not in the calendar."""
    return F.unix_date(F.try_to_date(date, "yyyy-MM-dd"))


def first_date(text: Column) -> Column:
    """The first date in a text, as days, among its first 2026-02-03, first February 3, 2026 and first 3/2/2026.

    The last form counts only if one of its first two fields is above 12, and is day, month, year. Years are 1990 to 2100.
    """
    iso, named, slashed = (r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})", rf"\b({'|'.join(MONTHS)})[a-z]*[.]? ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}})\b", r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\b")
    part = lambda p, i: F.regexp_extract(text, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    month = two(F.floor((F.instr(F.lit("".join(MONTHS)), part(named, 1)) + 2) / 3).cast("string"))
    clear = (part(slashed, 1).try_cast("int") > 12) | (part(slashed, 2).try_cast("int") > 12)
    at = lambda p: F.regexp_instr(text, F.lit(p))
    found = [
        F.when(at(iso) > 0, F.struct(at(iso).alias("at"), days(part(iso, 0)).alias("d"))),
        F.when(at(named) > 0, F.struct(at(named).alias("at"), days(F.concat_ws("-", part(named, 3), month, two(part(named, 2)))).alias("d"))),
        F.when((at(slashed) > 0) & clear, F.struct(at(slashed).alias("at"), days(F.concat_ws("-", part(slashed, 3), two(part(slashed, 2)), two(part(slashed, 1)))).alias("d"))),
    ]
    low, high = 7305, 47846  # 1990-01-01 and 2100-12-31
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull() & x["d"].between(low, high)))["d"]


def _ranges(raw: Column, size: int) -> Column:
    n = F.octet_length(raw)
    steps = F.sequence(F.lit(0), F.ceil(n / max(size - 3, 1)).cast("int"))
    digit = lambda at: F.substr(F.hex(F.substr(raw, at + 1, F.lit(1))), F.lit(1), F.lit(1))

    def step(found: Column, _: Column) -> Column:
        start = F.coalesce(F.get(found, F.size(found) - 1)["e"], F.lit(0))
        end = F.least(start + size, n)
        inside = lambda k: digit(end - k).isin("8", "9", "A", "B")
        back = F.when(end >= n, 0).when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
        first = digit(start)
        whole = F.when(first.isin("C", "D"), 2).when(first == "E", 3).when(first == "F", 4).otherwise(1)
        return F.when(start < n, F.concat(found, F.array(F.struct(start.alias("s"), F.greatest(end - back, start + whole).alias("e"))))).otherwise(found)

    return F.aggregate(steps, F.array().cast("array<struct<s:int,e:int>>"), step)


def byte_chunks(text: Column, size: int = 12_000, pieces: bool = False) -> Column:
    """Ranges (s, e) of at most `size` UTF-8 bytes that cut no character, with their `piece` of the text if wanted; none for an
    empty text. A character larger than `size` is a range of its own. The text is encoded once, and each step reads four bytes."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    piece = lambda r, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.decode(F.substr(r, x["s"] + 1, x["e"] - x["s"]), "UTF-8").alias("piece"))
    found = lambda r: F.transform(_ranges(r, size), lambda x: piece(r, x)) if pieces else _ranges(r, size)
    return F.transform(F.array(raw), found)[0]


def cost_nanos(used: Column, nanos_per_10: Column) -> Column:
    """Price of tokens, in whole nanos, rounded up."""
    return F.floor((used * nanos_per_10 + 9) / 10).cast("bigint")


def backoff_seconds(attempt: Column) -> Column:
    """2, 4, 8, ... seconds, 90 at most."""
    return F.least(F.lit(2.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(90.0))


def is_loss(stage: Column) -> Column:
    return F.element_at(F.split(stage, r"\."), -1).isin(*LOSS_STAGES)

"""Bodies of pages by their content type, strict JSON, public addresses, redaction."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions import html, texts

# Bodies


def media_type(header: Column) -> Column:
    """A content type without its parameters, in lower case; empty for none."""
    return F.lower(F.trim(F.split(F.coalesce(header, F.lit("")), ";")[0]))


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:<!doctype html|<html)")


def body(content_type: Column, raw: Column, markdown_first: Column | None = None) -> Column:
    """A body of bytes as (kind, refused, sha256, bytes, scope, text): what it is read as, and its text if it isn't refused.

    Kinds are markdown, html and text, by the type that is declared. Bytes that are no UTF-8 or hold a NUL are refused. Where Markdown was
    asked for (`markdown_first`), a body that turns out to be a page is refused, and the page itself is read next. Only what is
    valid of a kind goes through that kind's reader; a body without text is refused as empty.
    """
    held = raw.cast("string")
    asked = F.lit(False) if markdown_first is None else F.coalesce(markdown_first, F.lit(False))
    named = media_type(content_type)
    kind = F.when((named == "text/html") & ~asked, "html").when((named == "text/markdown") | asked, "markdown").otherwise("text")
    why = F.when(raw.isNull(), "no body").when(~F.is_valid_utf8(held), "not UTF-8 text").when(F.contains(held, F.lit("\0")), "binary data")
    why = why.when((kind == "markdown") & looks_like_html(held), "a page and no Markdown")
    of = lambda k: F.when(why.isNull() & (kind == k), held)
    page, plain = html.visible_text(of("html")), F.regexp_replace(of("text"), r"^\s+|\s+$", "")
    text = F.coalesce(page["text"], texts.scoring_text(of("markdown")), plain)
    refused = F.coalesce(why, F.when(F.coalesce(text, F.lit("")) == "", "empty"))
    scope = F.when(refused.isNull(), F.when(kind == "html", page["scope"]).when(kind == "markdown", "published_markdown_main_content").otherwise("published_plain_text"))
    return F.struct(kind.alias("kind"), refused.alias("refused"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("bigint").alias("bytes"), scope.alias("scope"), F.when(refused.isNull(), text).alias("text"))


def first_body(tries: Column) -> Column:
    """Of the bodies that were tried for a page, Markdown before HTML, the first that is not refused, as `body` has it; null if none is."""
    return F.get(F.filter(tries, lambda x: x["refused"].isNull()), F.lit(0))


# JSON


def strict_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more, with no key twice in an object, at any depth; false for null."""
    # As the one element of a list, so that nothing may follow the value.
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(held.isNotNull() & F.try_variant_get(held, "$[1]", "variant").isNull() & text.rlike(r"\S"), F.lit(False))


# Addresses


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


#: What no public host has, by the first address and the length of the prefix.
NOT_PUBLIC_4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
NOT_PUBLIC_6 = (
    ("::", 96), ("64:ff9b:1::", 48), ("2001::", 32), ("2001:db8::", 32), ("2002::", 16), ("3ff0::", 12), ("fc00::", 7), ("fe80::", 10), ("fec0::", 10), ("ff00::", 8),
)
#: IPv6 prefixes of 96 bits whose last 32 are an IPv4 address.
_MAPPED = ("00000000000000000000ffff", "0064ff9b0000000000000000")


def _ranges(networks: tuple) -> list[tuple[str, str]]:
    """Sorted (first, last) of networks as hex digits; neighbours and networks inside others are merged."""
    import ipaddress

    found = []
    for n in ipaddress.collapse_addresses(ipaddress.ip_network(f"{a}/{bits}") for a, bits in networks):
        digits = n.max_prefixlen // 4
        found.append((f"{int(n.network_address):0{digits}x}", f"{int(n.broadcast_address):0{digits}x}"))
    return sorted(found)


def ipv4_digits(address: Column) -> Column:
    """Eight hex digits of a dotted address; null if it is none. A leading zero is not allowed, as some read it as octal."""
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    ok = address.rlike(rf"^{part}(?:\.{part}){{3}}$")
    each = F.transform(F.split(address, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0"))
    return F.when(ok, F.array_join(each, ""))


def ipv6_digits(address: Column) -> Column:
    """32 hex digits of an address with colons, `::` and a dotted end included; null if it is none."""
    low = F.lower(address)
    dotted = F.regexp_extract(low, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    plain = lambda four: F.concat(F.regexp_replace(low, r"\d+\.\d+\.\d+\.\d+$", ""), F.left(four, F.lit(4)), F.lit(":"), F.right(four, F.lit(4)))
    whole = F.when(dotted == "", low).otherwise(_bind(ipv4_digits(dotted), plain))
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def filled(x: Column) -> Column:
        missing = 8 - F.size(x["front"]) - F.size(x["back"])
        fine = F.when(x["n"] == 2, missing >= 1).otherwise(F.size(x["front"]) == 8)
        every = F.when(x["n"] == 2, F.concat(x["front"], F.array_repeat(F.lit("0"), missing), x["back"])).otherwise(x["front"])
        return F.when(fine, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    def read(w: Column) -> Column:
        parts = F.split(w, "::")
        ok = w.rlike(r"^[0-9a-f:]+$") & ~w.rlike(r":::|^:[^:]|[^:]:$|[0-9a-f]{5}") & w.contains(":") & (F.size(parts) <= 2)
        held = F.struct(groups(F.get(parts, F.lit(0))).alias("front"), groups(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("back"), F.size(parts).alias("n"))
        return F.when(ok, _bind(held, filled))

    return _bind(whole, read)


def _inside(digits: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a number is in one of the sorted ranges, by bisection: as many comparisons as the logarithm of their number."""
    if len(ranges) == 1:
        return digits.between(*ranges[0])
    half = len(ranges) // 2
    return F.when(digits < ranges[half][0], _inside(digits, ranges[:half])).otherwise(_inside(digits, ranges[half:]))


def public_address(address: Column) -> Column:
    """Whether an address is a public unicast one; null for what is no address. IPv4 inside IPv6 is judged as IPv4."""
    four, six = _ranges(NOT_PUBLIC_4), _ranges(NOT_PUBLIC_6)

    def judged(x: Column) -> Column:
        inner = F.when(F.left(x["six"], F.lit(24)).isin(*_MAPPED), F.right(x["six"], F.lit(8)))
        outside = lambda digits, ranges: ~_bind(digits, lambda d: _inside(d, ranges))
        short = F.coalesce(x["four"], inner)
        return F.when(short.isNotNull(), outside(short, four)).when(x["six"].isNotNull(), outside(x["six"], six))

    return _bind(F.struct(ipv4_digits(address).alias("four"), ipv6_digits(address).alias("six")), judged)


# Redaction

#: A key that holds one of these, in any case, names a secret.
SECRET_KEYS = ("authorization", "cookie", "secret", "token", "password", "api-key", "api_key", "apikey", "credential")
REDACTED = "[REDACTED]"


def secret_key(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SECRET_KEYS))


def safe_url(url: Column) -> Column:
    """A URL whose parameters of secret names have their values replaced, without its fragment. Names are judged decoded."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)

    def safe(pair: Column) -> Column:
        name = F.split(pair, "=", 2)[0]
        told = F.coalesce(F.try_url_decode(name), name)
        return F.when(secret_key(told), F.concat(name, F.lit("=%5BREDACTED%5D"))).otherwise(pair)

    pairs = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), safe), "&")
    return F.when(query != "", F.concat(head, F.lit("?"), pairs)).otherwise(head)


def _safe(value):
    if isinstance(value, dict):
        return {k: REDACTED if any(s in k.lower() for s in SECRET_KEYS) else _safe(v) for k, v in value.items()}
    return [_safe(v) for v in value] if isinstance(value, list) else value


def _safe_json(value: str | None) -> str | None:
    try:
        return None if value is None else json.dumps(_safe(json.loads(value)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None  # what can't be read can't be shown to be free of secrets


def safe_json(value: Column) -> Column:
    """A JSON value with the values of secret keys replaced at every depth; null for what is no JSON."""

    def run(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in rows:
            yield pa.array([_safe_json(x) for x in b.to_pylist()], pa.string())

    run.__annotations__ = {"rows": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(value)

"""Splitting byte ranges of a text until each piece fits as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: pieces are never split below this many bytes.
SMALLEST = 1_024
#: Characters that JSON writes as two, and control characters that it writes as six.
_TWO, _SIX = r'["\\\x08\t\n\f\r]', r"[\x00-\x07\x0B\x0E-\x1F]"


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def json_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as a JSON string, quotes included; characters beyond ASCII are written as they are."""
    return F.octet_length(text) + F.regexp_count(text, F.lit(_TWO)) + 5 * F.regexp_count(text, F.lit(_SIX)) + 2


def _middle(raw: Column) -> Column:
    """The first character boundary at or after the middle of UTF-8 bytes."""
    half = F.floor(F.octet_length(raw) / 2).cast("int")
    inside = lambda k: F.hex(F.substr(raw, half + (1 + k), F.lit(1))).rlike("^[89AB]")
    return half + F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)


def fitted(title: Column, text: Column, limit: int, smallest: int = SMALLEST) -> Column:
    """The byte ranges (s, e) of a text, in order, each of which fits in `limit` bytes as JSON with the title, or can't be split.

    A range that is too large is cut at the character boundary at or after its middle, again and again; one of under twice
    `smallest` bytes is left as it is. All ranges of a text are looked at once a level, and there are as many levels as a text of its
    length can need, so the work is its length times the logarithm of it; rows stay where they are. A null text has no ranges.
    """
    frame = F.octet_length(F.to_json(F.struct(F.lit("").alias("title"), F.lit("").alias("text")))) - 4 + json_bytes(F.coalesce(title, F.lit("")))

    def halves(x: Column) -> Column:
        def cut(m: Column) -> Column:
            left = F.struct(x["s"].alias("s"), F.substr(x["raw"], F.lit(1), m).alias("raw"), F.lit(False).alias("done"))
            right = F.struct((x["s"] + m).alias("s"), F.substr(x["raw"], m + 1, F.octet_length(x["raw"]) - m).alias("raw"), F.lit(False).alias("done"))
            return F.when(m < F.octet_length(x["raw"]), F.array(left, right)).otherwise(F.array(F.struct(x["s"].alias("s"), x["raw"].alias("raw"), F.lit(True).alias("done"))))

        fits = x["done"] | (F.octet_length(x["raw"]) < 2 * smallest) | (room >= json_bytes(F.decode(x["raw"], "UTF-8")))
        whole = F.array(F.struct(x["s"].alias("s"), x["raw"].alias("raw"), F.lit(True).alias("done")))
        return F.when(fits, whole).otherwise(_bind(_middle(x["raw"]), cut))

    room = F.lit(limit) - frame
    raw = F.encode(text, "UTF-8")
    levels = F.ceil(F.log2(F.greatest(F.octet_length(raw) / smallest, F.lit(1.0)))).cast("int") + 1
    start = F.array(F.struct(F.lit(0).alias("s"), raw.alias("raw"), F.lit(False).alias("done")))
    found = F.aggregate(F.sequence(F.lit(1), levels), start, lambda rs, _: F.flatten(F.transform(rs, halves)))
    return F.when(text.isNotNull(), F.transform(found, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.octet_length(x["raw"])).alias("e"))))

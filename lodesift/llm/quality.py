"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger holds what was measured and one bit for each rule that failed. Policies are
versioned masks over these bits, so that a new policy, or an ablation of an old one, needs no text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import SPACE, words

#: Words in a window that counts as repeated when it occurs again in the text.
WINDOW = 8

#: (name, condition under which a text fails) over the ledger's measurements; a rule's place is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "n_symbols > 0.5 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("no_letters", "2 * n_letter_runs < n_words"),
)
#: The rules that every policy holds to.
BASE = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of the keep decision: a text is kept if none of the rules named fails."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules=RULES) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(rules)}
        return sum(bits[r] for r in dict.fromkeys(self.rules))


POLICIES = (Policy("v1", BASE), Policy("v2", tuple(name for name, _ in RULES)))


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more; windows are told apart by 64-bit hashes.

    Texts without a repeated window, most of them, cost one hash for each word. In the others the windows are sorted
    by hash, those with an equal neighbour are kept, and what they cover is summed in the order of their places.
    """

    def covered(places: Column) -> Column:
        gap = lambda x, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), x - F.get(places, i - 1)))
        return F.aggregate(F.transform(places, gap), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def among(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return _bind(F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"])), covered)

    def found(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _bind(placed, among)).otherwise(F.lit(0).cast("bigint"))

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return _bind(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])), found)

    return F.when(F.size(tokens) > width, _bind(F.transform(tokens, lambda x: F.xxhash64(x)), hashed)).otherwise(F.lit(0).cast("bigint"))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with a struct `_m` of measurements of each whole text; a null text is measured as an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("bigint")

    def measures(w: Column) -> Column:
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
            _bind(full, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("lines"),
            repeat_words(w).alias("n_repeat_words"),
            long(F.regexp_count(text, F.lit(r"\p{L}+"))).alias("n_letter_runs"),
        )

    return df.withColumn("_m", _bind(words(text), measures))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_runs, failed) of each row.

    Words are runs without ASCII white space, lines are split at \\n and count if they hold a word. A text without words
    has zero everywhere and fails `too_few_words`. Rows are independent: repeated ids give a row each.
    """
    m = F.col("_m")
    names = ("n_words", "word_chars", "n_symbols")
    out = measured(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select(
        "id", *[m[c].alias(c) for c in names], m["lines"]["n"].alias("n_lines"), m["lines"]["d"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), m["n_letter_runs"].alias("n_letter_runs")
    )
    return out.withColumn("failed", bits(rules))


def bits(rules=RULES) -> Column:
    """The failure bits from columns of measurements."""
    found = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(rules):
        found = found.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return found


def kept(df: DataFrame, policy: Policy, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of `df` that a policy keeps, with their columns.

    A row travels as one struct, so that its columns may have any name and type. A null, empty or blank text has no words and is
    measured as such; repeated rows get the same verdict; an empty table gives an empty one.
    """
    own = [F.col("_row").getField(c).alias(c) for c in df.columns]
    m = F.col("_m")
    found = measured(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("text")), "text")
    found = found.select("_row", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_letter_runs")], m["lines"]["n"].alias("n_lines"), m["lines"]["d"].alias("n_dup_lines"))
    return found.withColumn("failed", bits(rules)).where(verdict(policy, rules)).select(*own)


def verdict(policy: Policy, rules=RULES, failed: str = "failed") -> Column:
    """Whether a row of a ledger is kept by a policy."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablation(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """(version, rule, n_failed, n_only, n_kept_without) of each policy and each of its rules.

    `n_only` counts the rows that the policy drops for this rule alone: what leaving it out would add. The ledger is
    first summed by its bits, of which there are few, so every policy reads those sums and not the rows.
    """
    sums = rows.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(p.version).alias("version"), F.lit(p.mask(rules)).cast("bigint").alias("mask"), F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for p in policies for i, (name, _) in enumerate(rules) if name in p.rules]
    each = sums.select("failed", "n", F.explode(F.array(*pairs)).alias("p")).select("failed", "n", "p.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("version", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_only"),
        count((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )

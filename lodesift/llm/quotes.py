"""Quotation linking: who replies to whom, read from quoted passages.

A message's lines are parsed into quote levels. Each run of lines at one level is a passage; its normalised text is
hashed and joined to the latest earlier message of the conversation that holds it as its own words. Messages follow the
thread of the message that they quote, and quotes are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.common import cut, global_index

#: Lines that only introduce a quote; they go with it.
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
_MARKS = r"^((?:[ \t]*>)+)"


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))


def _lines(text: Column) -> Column:
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS + " ?", "").alias("text"))

    return F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n", -1), line)


def parsed(df: DataFrame) -> DataFrame:
    """(conv, turn, role, body, passages) of (conv, turn, role, text).

    `body` is the message without quotes and without the lines that introduce them; `passages` holds (level, text) for
    each run of lines of one level above 0, blank ones left out.
    """

    def own(lines: Column) -> Column:
        led = lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False)))
        return F.array_join(F.transform(F.filter(lines, led), lambda x: x["text"]), "\n")

    def passages(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

        def runs(s: Column) -> Column:
            def run(at: Column, k: Column) -> Column:
                length = F.coalesce(F.get(s, k + 1), F.size(lines)) - at
                inner = F.transform(F.slice(lines, at + 1, length), lambda x: x["text"])
                return F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(inner, "\n").alias("text"))

            return F.filter(F.transform(s, run), lambda p: (p["level"] > 0) & (F.trim(p["text"]) != ""))

        return _bind(starts, runs)

    quoted = F.coalesce(F.col("text"), F.lit("")).rlike("(?m)" + _MARKS)
    full = _bind(_lines(F.col("text")), lambda x: F.struct(own(x).alias("body"), passages(x).alias("passages")))
    plain = F.struct(F.coalesce(F.col("text"), F.lit("")).alias("body"), F.array().cast("array<struct<level:int,text:string>>").alias("passages"))
    found = df.withColumn("_p", F.when(quoted, full).otherwise(plain))
    trimmed = F.regexp_replace(F.col("_p")["body"], r"(?U)^\s+|\s+$", "")
    return found.select("conv", "turn", "role", trimmed.alias("body"), F.col("_p")["passages"].alias("passages"))


def _parts(text: Column) -> list[Column]:
    """What is compared of a text, from the whole to the smallest: it, its paragraphs, its lines, its sentences; normalised.

    Sentences end at `.`, `!` or `?` before white space, both in paragraphs, whatever their line breaks, and in lines.
    """
    paragraphs = F.transform(F.split(text, r"\n[ \t]*\n"), normalised)
    lines = F.transform(F.split(text, r"\n"), normalised)
    sentences = F.flatten(F.transform(F.concat(paragraphs, lines), lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return [F.array(normalised(text)), paragraphs, lines, sentences]


def _pieces(body: Column) -> Column:
    """Hashes of what a later message may quote: the body, its paragraphs, its lines and its sentences."""
    return F.array_distinct(F.transform(F.filter(F.concat(*_parts(body)), lambda x: x != ""), lambda x: F.md5(x)))


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_turn, n_linked) of the messages (from `parsed`) with a quote whose original is found.

    A passage is looked up whole; where it is not found, by paragraph, then by line, then by sentence. Of the originals found at the lowest
    quote level, the message replies to the latest. Each hash of a conversation is one ordered run of originals and
    quotes, so that a line said a thousand times makes no pairs.
    """
    quotes = messages.where(F.size("passages") > 0).select("conv", "turn", F.posexplode("passages").alias("no", "p"))
    parts = F.array(*[F.transform(F.array_distinct(x), lambda t, k=k: F.struct(F.lit(k).alias("part"), t.alias("t"))) for k, x in enumerate(_parts(F.col("p.text")))])
    asked = quotes.select("conv", "turn", "no", "p.level", F.explode(F.flatten(parts)).alias("x")).select("conv", "turn", "no", "level", "x.part", "x.t")
    asked = asked.where("t <> ''").select("conv", "turn", "no", "level", "part", F.md5("t").alias("h"))
    asked = cut(asked.where("conv is not null and turn is not null"))
    said = messages.where("conv is not null and turn is not null").select("conv", "turn", F.explode(_pieces(F.col("body"))).alias("h"))
    said = said.join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi")
    both = asked.withColumn("origin", F.lit(None).cast(messages.schema["turn"].dataType)).unionByName(
        said.select("*", F.col("turn").alias("origin")), allowMissingColumns=True
    )
    # Rows of one turn come after the originals before it: a message never replies to itself.
    order = Window.partitionBy("conv", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("reply", F.max("origin").over(order)).where("level is not null and reply is not null")
    passage = found.groupBy("conv", "turn", "no", "level").agg(F.coalesce(*[F.max(F.when(F.col("part") == k, F.col("reply"))) for k in range(4)]).alias("reply"))
    return passage.groupBy("conv", "turn").agg(F.max_by("reply", F.struct(-F.col("level"), F.col("reply"))).alias("reply_turn"), F.count("*").alias("n_linked"))


def roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root_turn): where the chain of replies from each message ends. Chains halve with each round."""
    at = cut(replies.select("conv", "turn", F.col("reply_turn").alias("root_turn")))
    while True:
        onward = at.select("conv", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"))
        moved = cut(at.join(onward, ["conv", "root_turn"], "left").select("conv", "turn", F.coalesce("further", "root_turn").alias("root_turn"), F.col("further").isNotNull().alias("moved")))
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def linked(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, position, reply_turn, root_turn, n_passages, n_linked, body) of each message.

    `position` counts from 0 in each conversation: threads in the order of their first message, messages of a thread by
    turn (null turns last), rows equal in that by their text. A message without a linked quote starts a thread, so a
    conversation without quotes keeps its order. A null text is an empty body. Rows with a null conversation or turn
    are kept and link to nothing; repeated rows of a turn share its link.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    messages = cut(parsed(rows))
    replies = cut(links(messages))
    tops = roots(replies)
    out = messages.join(replies.join(tops, ["conv", "turn"]), ["conv", "turn"], "left")
    out = out.withColumn("root_turn", F.coalesce("root_turn", "turn"))
    out = out.withColumn("_r", F.coalesce("root_turn", F.lit((1 << 63) - 1))).withColumn("_t", F.coalesce("turn", F.lit((1 << 63) - 1)))
    out = global_index(out, "conv", "_r", "_t", "role", "body")
    first = cut(out.groupBy("conv").agg(F.min("index").alias("first"))).select(F.col("conv").alias("_c"), "first")
    out = out.join(first, F.col("conv").eqNullSafe(F.col("_c")))
    return out.select("conv", "turn", "role", (F.col("index") - F.col("first")).alias("position"), "reply_turn", "root_turn", F.size("passages").cast("bigint").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "body")


def chat(rows: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """`rows` (from `linked`) with `formatted`: the message in chat markup; read in the order of `position`.

    A marker that a body or a role holds is written with a backslash before its last character, and so are markers that have such
    backslashes already, one more: no message can end itself or begin another, and what was written can be read back.
    """

    def inert(text: Column) -> Column:
        for mark in (start, end):
            head, last = re.escape(mark[:-1]), re.escape(mark[-1])
            text = F.regexp_replace(text, rf"({head}\\*)({last})", r"$1\\$2")
        return text

    role = F.regexp_replace(inert(F.coalesce("role", F.lit("user"))), r"\s+", " ")
    return rows.withColumn("formatted", F.concat(F.lit(start), role, F.lit("\n"), inert(F.col("body")), F.lit(end + "\n")))


def unmarked(text: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A body as it was before `chat` wrote it."""
    for mark in (end, start):
        text = F.regexp_replace(text, rf"({re.escape(mark[:-1])}\\*)\\({re.escape(mark[-1])})", "$1$2")
    return text

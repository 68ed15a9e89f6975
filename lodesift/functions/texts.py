"""Texts of pages and sections: Markdown for scoring, notices, headings, word starts, prefixes by bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of HTML in Markdown that are no text.
DROPPED = ("head", "script", "style", "nav", "aside", "footer")
_FENCE, _OPEN = re.compile(r"\s*(`{3,}|~{3,})"), re.compile(r"\s*<(" + "|".join(DROPPED) + r")\b", re.I)
_COMPONENT = re.compile(r"<[A-Z]|import |export ")


def markdown_for_scoring(text: str | None) -> str | None:
    """Markdown without blocks of page furniture; nothing if components are left to be filled in, or if no text stays."""
    out, fence, waiting = [], "", ""
    for line in (text or "").split("\n"):
        mark = _FENCE.match(line)
        if waiting:
            waiting = "" if f"</{waiting}" in line.lower() else waiting
            continue
        if fence:
            closes = mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0])
            fence = "" if closes else fence
        elif mark:
            fence = mark[1]
        elif block := _OPEN.match(line):
            name = block[1].lower()
            waiting = "" if f"</{name}" in line.lower() else name
            continue
        elif _COMPONENT.match(line.lstrip()):
            return None
        out.append(line)
    found = "\n".join(out).strip()
    return found or None


def scoring_text(markdown: Column) -> Column:
    """`markdown_for_scoring` in Arrow batches."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([markdown_for_scoring(t.as_py()) for t in batch], pa.string())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(markdown)


def without_notice(text: Column, notice: str = "Documentation Index") -> Column:
    """A text without the block quote that it starts with, if the quote's first line holds the notice and more text follows."""
    rest = F.regexp_replace(text, r"^\s*(?:[ \t]*>[^\n]*(?:\n|$))+(?:[ \t]*\n)*", "")
    notes = F.coalesce(F.regexp_extract(text, r"^\s*>([^\n]*)", 1).contains(notice), F.lit(False))
    return F.when(notes & (rest != ""), rest).otherwise(text)


def without_themes(text: Column) -> Column:
    """A text whose code fences don't name themes."""
    return F.regexp_replace(text, r"(?m)^([ \t]*```[^\n]*?) theme=\{[^\n]*$", "$1")


def heading(text: Column) -> Column:
    """The heading that a text starts with, without the marks around it; null if it starts with none."""
    line = F.regexp_extract(text, r"^\s*#+ ([^\n]*)", 1)
    found = F.trim(F.regexp_replace(line, r"(?:^|\s)#+\s*$", ""))
    return F.when(found != "", found)


def word_starts(text: Column) -> Column:
    """A text as its words in lower case, each with a space before it."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def section_terms(query: Column, corpus: str = "") -> Column:
    """Terms of a query, each word whole and by its parts: of three characters or with a digit, and not the corpus's own word."""
    bare = F.transform(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: F.trim(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", " ")))
    each = F.flatten(F.transform(bare, lambda w: F.concat(F.array(w), F.split(w, " "))))
    return F.array_distinct(F.filter(each, lambda t: (t != corpus) & ((F.char_length(t) >= 3) | t.rlike("[0-9]")) & (t != "")))


def mentions(terms: Column, title: Column, path: Column, content: Column) -> Column:
    """Whether a section holds a term at a word's start in its title, its path after the first part, or its text; or there are no terms."""
    tail = F.regexp_replace(F.coalesce(path, F.lit("")), r"^/*[^/]*/?", "")
    text = word_starts(F.concat_ws(" ", title, tail, content))
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(text, F.concat(F.lit(" "), t)))


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest start of a text with at most `most` UTF-8 bytes that cuts no character."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.hex(F.substr(raw, F.lit(most + 1 - k), F.lit(1))).rlike("^[89AB]")
    back = F.when(F.octet_length(raw) <= most, 0).when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.decode(F.substr(raw, F.lit(1), F.lit(most) - back), "UTF-8")


def serialized_bytes(title: Column, text: Column) -> Column:
    """UTF-8 bytes of a title and a text as JSON."""
    return F.octet_length(F.to_json(F.struct(title.alias("title"), text.alias("text"))))

"""Visible text of web pages: a small event handler over the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens a line, what is never shown, what has no end tag.
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "br", "tr", "section", "table", "article"}
HIDDEN = {"nav", "aside", "footer", "head", "svg", "button", "form"}
SKIPPED = {"script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN_CLASSES = {"sr-only", "visually-hidden", "table-of-contents", "theme-doc-toc-mobile"}
SCOPES = ("article", "main", "body")
MOST_OPEN, MOST_TAGS = 4_096, 250_000
#: The named entities that are decoded; all others stay as they are written.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…"}
#: Stands for `&` while a page is parsed, so that the parser decodes nothing; no text has this noncharacter.
_MARK = "\ufdd0"
_ENTITY = re.compile(f"{_MARK}([^;{_MARK}]{{0,15}});")


def _entity(found: re.Match) -> str:
    name, whole = found[1], "&" + found[0][1:]
    if len(name.encode()) > 15:
        return whole
    if name in ENTITIES:
        return ENTITIES[name]
    digits = re.fullmatch(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))", name)
    code = int(digits[1], 16) if digits and digits[1] else int(digits[2]) if digits else -1
    return chr(code) if 0 <= code < 0xD800 or 0xDFFF < code < 0x110000 else whole


def decoded(text: str, mark: str = "&") -> str:
    """A text with its entities decoded: nine names, and numbers, each of at most 15 bytes; zero-width spaces go."""
    return _ENTITY.sub(_entity, text.replace(mark, _MARK)).replace(_MARK, "&").replace("\u200b", "")


def decoded_text(text: Column) -> Column:
    """`decoded` in Arrow batches."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if x is None else decoded(x) for x in batch.to_pylist()], pa.string())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


class _TooLarge(Exception):
    pass


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)  # what it could convert is hidden from it
        self.open: list[tuple[str, bool]] = []
        self.hidden, self.tags, self.scopes = 0, 0, dict.fromkeys(SCOPES, 0)
        self.time: str | None = None  # the value of a time that has shown no text so far
        self.found: dict[str, list[str]] = {s: [] for s in SCOPES}

    def _add(self, text: str) -> None:
        if not self.hidden:
            for s in SCOPES:
                if self.scopes[s]:
                    self.found[s].append(text)

    def _is_hidden(self, tag: str, attrs: dict) -> bool:
        style = (attrs.get("style") or "").replace(" ", "").lower()
        outer = tag == "header" and not (self.scopes["article"] or self.scopes["main"])
        return (
            tag in HIDDEN or tag in SKIPPED or outer or "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true"
            or "display:none" in style or "visibility:hidden" in style or bool(HIDDEN_CLASSES & set((attrs.get("class") or "").split()))
        )

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.tags > MOST_TAGS or len(self.open) >= MOST_OPEN:
            raise _TooLarge
        if tag in BLOCKS:
            self._add("\n")
        if tag in VOID:
            return
        if tag == "time":
            self.time = dict(attrs).get("datetime")
        hidden = self._is_hidden(tag, dict(attrs))
        self.open.append((tag, hidden))
        self.hidden += hidden
        if tag in self.scopes:
            self.scopes[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._add("\n")
        if tag == "time" and self.time:
            self._add(f" {self.time} ")
            self.time = None
        if any(t == tag for t, _ in self.open):
            while self.open:
                name, hidden = self.open.pop()
                self.hidden -= hidden
                if name in self.scopes:
                    self.scopes[name] -= 1
                if name == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            self.time = None
        self._add(data)


def visible(html: str | None) -> tuple[str | None, str | None]:
    """Text and scope of a page, from its article, main part or body; nothing for pages past the limits."""
    page = _Page()
    try:
        page.feed((html or "").replace("&", _MARK))
        page.close()
    except _TooLarge:
        return None, None
    for s in SCOPES:
        lines = [x.strip() for x in decoded("".join(page.found[s]), _MARK).split("\n")]
        if text := "\n".join(x for x in lines if x):
            return text, f"{s}_visible_text"
    return None, None


def visible_text(html: Column) -> Column:
    """(text, scope) of a page's HTML, in Arrow batches; no other column leaves the JVM."""

    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.field("text", pa.string()), pa.field("scope", pa.string())]
        for batch in pages:
            found = [visible(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], fields=kinds)

    run.__annotations__ = {"pages": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "text string, scope string")(html)


def article_text(df: DataFrame, column: str) -> DataFrame:
    """`df` with visible_text and scope in place of its HTML."""
    found = df.withColumn("_page", visible_text(F.col(column)))
    return found.select(*[c for c in df.columns if c != column], F.col("_page.text").alias("visible_text"), F.col("_page.scope").alias("scope"))

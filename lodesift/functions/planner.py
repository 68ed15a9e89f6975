"""Plans of questions: clauses, facets, entities and keyword variants, as one small function run in Arrow batches.

A question's words are tagged once; clauses, entity runs and keyword sets are then lists of places in these words, so every
variant is a part of the question in its own order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.questions import LONGEST, SPANISH, SPANISH_FUNCTION

#: Words without content in a question, words that ask, and words that name a kind of source.
FUNCTION = (
    "a", "an", "the", "of", "on", "in", "for", "to", "from", "with", "without", "by", "at", "as", "into", "about", "and", "or", "but", "if",
    "than", "then", "so", "that", "this", "these", "those", "there", "here", "is", "are", "was", "were", "be", "been", "being", "am", "do",
    "does", "did", "done", "have", "has", "had", "can", "could", "should", "would", "will", "may", "might", "must", "not", "no", "i", "me",
    "my", "we", "our", "us", "you", "your", "it", "its", "they", "them", "their", "how", "what", "where", "when", "who", "whom", "whose",
    "which", "why", "while", "whether", "any", "all", "also", "both", "each", "other", "some", "such", "only", "more", "most", "very",
    "already", "use", "uses", "used", "using", "call", "calls", "called", "including", "versus", "vs", "plus",
)
REQUEST = ("find", "show", "list", "give", "get", "locate", "search", "look", "need", "want", "tell", "please", "help", "explain", "explains", "describe", "describes", "compare")
SOURCE_TYPE = ("source", "sources", "documentation", "docs", "records", "information", "info", "material", "materials", "references", "links", "resources")
#: What parts clauses, in English and Spanish questions; words that stand for an earlier one.
COORDINATORS, SPANISH_COORDINATORS = ("and", "or", "versus", "vs", "including", "plus"), ("y", "o", "e")
PRONOUNS = ("their", "its", "it", "them", "they")
#: The most facets, facet, keyword and entity variants, words of a keyword set, and words of a quote that is no data.
FACETS, VARIANTS, KEYWORDS, QUOTED = 6, 3, 6, 4

_LEAD, _TRAIL = "\"“”‘’'([{<¿¡`", "\"“”‘’')]}>.,;:!?`"
_TECHNICAL = re.compile(r"[^\W_][-_./:+#][^\W_]")
_DATE, _NUMBER = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII), re.compile(r"[0-9.,]*[0-9][0-9.,]*")
KIND = "tokens array<string>, facets array<string>, entities array<string>, dates array<string>, non_english boolean, variants array<struct<kind: string, text: string, places: array<int>>>, omissions array<struct<stage: string, text: string>>"


class Word(NamedTuple):
    text: str
    closes: bool = False
    colon: bool = False
    quoted: bool = False
    data: bool = False

    @property
    def low(self) -> str:
        return self.text.lower()

    @property
    def date(self) -> bool:
        return bool(_DATE.fullmatch(self.text))

    @property
    def technical(self) -> bool:
        t = self.text
        return bool(_TECHNICAL.search(t)) or any(c.isupper() for c in t[1:]) or (any(c in "0123456789" for c in t) and any(c.isalpha() for c in t))

    @property
    def capitalized(self) -> bool:
        return self.text[0].isupper() and any(c.islower() for c in self.text[1:])


def split(question: str) -> tuple[list[Word], list[tuple[str, str]]]:
    """The words of a question, and quotes of more than four words, which are data and no words to search for."""
    words, dropped, start = [], [], None
    for raw in question.split():
        inner = raw.lstrip(_LEAD)
        text = inner.rstrip(_TRAIL)
        lead, tail = raw[: len(raw) - len(inner)], inner[len(text) :]
        ends = any(c in ".,;:!?" for c in tail)
        if not any(c.isalnum() for c in text):
            if words and (ends or "—" in raw or "–" in raw):
                words[-1] = words[-1]._replace(closes=True)
            continue
        if start is None and ('"' in lead or "“" in lead):
            start = len(words)
        words.append(Word(text, ends, ":" in tail))
        if start is not None and ('"' in tail or "”" in tail):
            long = len(words) - start > QUOTED
            words[start:] = [w._replace(quoted=True, data=long) for w in words[start:]]
            if long:
                dropped.append(("quoted_data", " ".join(w.text for w in words[start:])))
            start = None
    return words, dropped


def _negative(clause: list[str]) -> bool:
    while clause and clause[0] in ("please", "but", "then", "also"):
        clause = clause[1:]
    return clause[:1] in (["don't"], ["don’t"], ["never"]) or clause[:2] == ["do", "not"]


def _clauses(words: list[Word], spanish: bool) -> tuple[list[list[int]], list[tuple[str, str]]]:
    """Places of each clause, without those that only instruct or introduce data."""
    parts: list[list[int]] = [[]]
    data_after = set()
    for i, w in enumerate(words):
        joins = w.low in COORDINATORS or (spanish and w.low in SPANISH_COORDINATORS)
        if w.data:
            if i and words[i - 1].colon and not words[i - 1].data:
                data_after.add(i - 1)
            parts.append([])
        elif joins and not w.quoted:
            parts.append([])
        else:
            parts[-1].append(i)
            if w.closes:
                parts.append([])
    kept, dropped = [], []
    for p in filter(None, parts):
        said = " ".join(words[i].text for i in p)
        if p[-1] in data_after:
            dropped.append(("quoted_data", said))
        elif _negative([words[i].low for i in p]):
            dropped.append(("instruction_clause", said))
        else:
            kept.append(p)
    return kept, dropped


def _runs(words: list[Word], clause: list[int], stop) -> list[list[int]]:
    """Places of the names in a clause: capitalised words in a row, or one technical word, with a number after them."""
    runs, open_run, plain = [], False, False
    for i in clause:
        w = words[i]
        sharp = not w.date and w.technical and any(c.isupper() or c.isdigit() for c in w.text)
        named = w.capitalized and not (stop(w) and (i == clause[0] or len(w.text) == 1))
        if sharp:
            runs.append([i])
            open_run, plain = True, False
        elif named and not w.date:
            if open_run and plain:
                runs[-1].append(i)
            else:
                runs.append([i])
            open_run = plain = True
        else:
            if open_run and _NUMBER.fullmatch(w.text):
                runs[-1].append(i)
            open_run = False
        if w.closes:
            open_run = False
    return runs


def plan(question: str | None, corpus: str = "") -> dict:
    """The plan of a question; `corpus` is a word that every document of the corpus has, which tells none apart."""
    question = (question or "").strip()
    if len(question.encode()) > LONGEST:
        return dict(tokens=[], facets=[], entities=[], dates=[], non_english=False, variants=[("natural", question, [])], omissions=[("question_length", question)])
    words, omitted = split(question)
    spanish = "¿" in question or "¡" in question or sum(w.low in SPANISH for w in words) > 1
    stops = {*FUNCTION, *REQUEST, *SOURCE_TYPE, *((*SPANISH, *SPANISH_FUNCTION) if spanish else ())}
    stop = lambda w: w.low in stops
    clauses, dropped = _clauses(words, spanish)
    omitted += dropped
    say = lambda places: " ".join(words[i].text for i in places)
    runs = [r for c in clauses for r in _runs(words, c, stop) if say(r).lower() != corpus]
    named = {i for r in runs for i in r}
    kept = {i for i, w in enumerate(words) if not w.data and not w.date and (w.technical or w.quoted or i in named)}
    bears = lambda i: not words[i].data and not words[i].date and (i in kept or not (stop(words[i]) or words[i].low == corpus))

    facets, sets, anchor = [], [], []
    for c in clauses:
        content = [i for i in c if bears(i)] or [i for i in c if corpus and words[i].low == corpus]
        if not content:
            continue
        if len(facets) == FACETS:
            omitted.append(("facet_cap", say(c)))
            continue
        carried = anchor if facets and any(words[i].low in PRONOUNS for i in c) else []
        own = [i for i in content if i in kept]
        anchor = own or carried or content[:3]
        facets.append(c)
        full = sorted({*carried, *content})
        few = sorted([*[i for i in full if i in kept], *[i for i in full if i not in kept]][:KEYWORDS])
        omitted += [("keyword_terms", words[i].text) for i in full if i not in few]
        sets.append(few)

    variants, seen = [], set()

    def add(kind: str, places: list[int], text: str | None = None) -> bool:
        text = say(places) if text is None else text
        if (kind, text.lower()) in seen:
            return False
        seen.add((kind, text.lower()))
        variants.append((kind, text, places))
        return True

    add("natural", list(range(len(words))), question)
    if not (len(facets) == 1 and len(facets[0]) == len(words)):
        for k, c in enumerate(facets):
            if k < VARIANTS:
                add("facet", c)
            else:
                omitted.append(("semantic_facet_cap", say(c)))
    made = 0
    for few in sets:
        if made == VARIANTS:
            omitted.append(("keyword_variant_cap", say(few)))
        else:
            made += add("keywords", few)
    if len(sets) == 1 and len(sets[0]) > 3:
        half = -(-len(sets[0]) // 2)
        for part in (sets[0][:half], sets[0][half:]):
            add("keywords", part)
    distinct = list({say(r).lower(): r for r in reversed(runs)}.values())[::-1]
    variants += [("entity", say(r), r) for r in distinct[:VARIANTS]]
    omitted += [("entity_variant_cap", say(r)) for r in distinct[VARIANTS:]]
    return dict(tokens=[w.text for w in words], facets=[say(c) for c in facets], entities=[say(r) for r in distinct], dates=[w.text for w in words if w.date and not w.data], non_english=spanish, variants=variants, omissions=omitted)


def planned(question: Column, corpus: str = "") -> Column:
    """The plan of each question as a struct (`KIND`); a null question is planned as an empty one."""
    part = lambda names, kinds: pa.list_(pa.struct([pa.field(n, k) for n, k in zip(names, kinds)]))
    kinds = {"variants": part(("kind", "text", "places"), (pa.string(), pa.string(), pa.list_(pa.int32()))), "omissions": part(("stage", "text"), (pa.string(), pa.string())), "non_english": pa.bool_()}
    names = ("tokens", "facets", "entities", "dates", "non_english", "variants", "omissions")

    def run(questions: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in questions:
            found = [plan(q.as_py(), corpus) for q in batch]
            rows = {n: [f[n] for f in found] for n in names}
            for n in ("variants", "omissions"):
                keys = ("kind", "text", "places") if n == "variants" else ("stage", "text")
                rows[n] = [[dict(zip(keys, x)) for x in r] for r in rows[n]]
            yield pa.StructArray.from_arrays([pa.array(rows[n], kinds.get(n, pa.list_(pa.string()))) for n in names], names=list(names))

    run.__annotations__ = {"questions": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, KIND)(question)


def named_dates(text: Column) -> Column:
    """ISO dates among the words of a text of any length, in their order, repeats and those in quotes included."""
    lead, trail = (f"[{re.escape(c)}]*+" for c in (_LEAD, _TRAIL))
    return F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\S){lead}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){trail}(?!\S)"), F.lit(1))


def keyword_text(plan_: Column) -> Column:
    """All keywords of a plan in their order in the question; the question itself where there are none."""
    of = lambda kind: F.filter(plan_["variants"], lambda v: v["kind"] == kind)
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(of("keywords"), lambda v: v["places"]))))
    text = F.array_join(F.transform(places, lambda i: F.get(plan_["tokens"], i)), " ")
    return F.when(F.size(places) > 0, text).otherwise(F.get(of("natural"), 0)["text"])


def site_query(plan_: Column, english_index: Column) -> Column:
    """What a keyword index is asked: the names in a question of another language than the index, else its keywords."""
    names = F.array_join(plan_["entities"], " ")
    return F.when(plan_["non_english"] & english_index & (names != ""), names).otherwise(keyword_text(plan_))


def facet_queries(plan_: Column, max_pages: int, max_documents: int) -> Column:
    """One query for each facet if there are two or more and the limits allow as many, else the one of `site_query`."""
    return F.when((F.size(plan_["facets"]) > 1) & F.lit(min(max_pages, max_documents) > 1), F.slice(plan_["facets"], 1, min(max_pages, max_documents))).otherwise(F.array(site_query(plan_, F.lit(True))))


def facet_ceiling(most: Column, kept: Column, remaining: Column) -> Column:
    """Documents that may be held after a facet's query, when `remaining` facets, this one included, share what is left."""
    return (kept + F.floor((most - kept) / F.greatest(remaining, F.lit(1)))).cast("bigint")


def jobs_queries(plan_: Column, question: Column, nouns: tuple[str, ...] = ("job", "jobs", "role", "roles", "position", "positions")) -> Column:
    """Queries of a listing that is searched by substring: quoted phrases, else names and then words with content."""
    quoted = F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit('["“]([^"”]+)["”]'), F.lit(1)), lambda q: F.size(F.split(F.trim(q), r"\s+")) <= QUOTED)
    stops = F.array(*[F.lit(x) for x in sorted({*FUNCTION, *REQUEST, *SOURCE_TYPE, *nouns})])
    words = F.filter(F.split(keyword_text(plan_), r"\s+"), lambda w: ~F.array_contains(stops, F.lower(w)))
    every = F.concat(F.filter(plan_["entities"], lambda e: ~F.array_contains(stops, F.lower(e))), words)
    first = F.filter(every, lambda w, i: F.array_position(F.transform(every, lambda x: F.lower(x)), F.lower(w)) == i + 1)
    return F.when(F.size(quoted) > 0, F.array_distinct(quoted)).otherwise(first)


def stable_json(plan_: Column) -> Column:
    """The plan as text that is equal for equal plans."""
    return F.to_json(plan_)

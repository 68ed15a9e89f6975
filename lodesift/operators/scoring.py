"""The scorer seam: whoever scores gets chunks and gives signals; what follows is the same for every scorer.

A scorer is a function of a DataFrame with `question` and `text` that adds one column for each signal. The lexical scorer
below runs in the JVM; a model would be one `mapInArrow` with a client for each partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.columns import tokens

SIGNALS = ("usable_evidence", "relevant", "contradicts", "injection")
#: What the scorer for tests says of everything.
FIXTURE = {"route": 0.85, "document": 0.8, "currentness": 0.5, "supports": 0.5}
#: Kinds of intent in their order; the last of equal ones counts.
INTENTS = ("current", "comparative", "versioned", "timeless")
Scorer = Callable[[DataFrame], DataFrame]


def overlap(question: Column, text: Column) -> Column:
    """The share of a question's words that a text holds."""
    asked = tokens(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(0.0).cast("double")


def lexical(markers: dict[str, tuple[str, ...]] | None = None) -> Scorer:
    """Signals by words: usable_evidence and relevant by overlap, the others by the share of their marker words in the text."""
    marked = markers or {"contradicts": ("not", "never", "no"), "injection": ("ignore", "instructions", "prompt")}

    def score(rows: DataFrame) -> DataFrame:
        share = lambda name: F.size(F.array_intersect(tokens(F.col("text")), F.array(*[F.lit(w) for w in marked[name]]))) / float(len(marked[name]))
        base = overlap(F.col("question"), F.col("text"))
        return rows.withColumns({"usable_evidence": base, "relevant": F.sqrt(base), "contradicts": share("contradicts"), "injection": share("injection")})

    return score


def fixture(rows: DataFrame) -> DataFrame:
    """The scorer for tests: the same for every text."""
    return rows.withColumns({"usable_evidence": F.lit(FIXTURE["document"]), "relevant": F.lit(FIXTURE["document"]), "contradicts": F.lit(0.0), "injection": F.lit(0.0)})


def valid(value: Column) -> Column:
    """Whether a score is a finite number from 0 to 1."""
    return F.coalesce(value.between(0.0, 1.0) & ~F.isnan(value), F.lit(False))


def route_lens(turn: Column) -> Column:
    """What a routing pass asks: even ones for direct evidence, odd ones for what complements it."""
    return F.when(turn % 2 == 0, "direct").otherwise("complementary")


def document_scores(chunks: DataFrame, by: tuple[str, ...], chunk: str, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(by, signals, top2_mean, best_chunk, n_chunks): the largest of each signal over a document's chunks, each on its own.

    A chunk's number is its own in its document. The mean of the two largest values of the first signal comes from two maxima, so
    no group is collected.
    """
    first = signals[0]
    best = F.max_by(F.struct(chunk, first), F.struct(F.col(first), (-F.col(chunk)).alias("o")))
    found = chunks.groupBy(*by).agg(*[F.max(s).alias(s) for s in signals], best.alias("_b"), F.count("*").alias("n_chunks"))
    rest = chunks.join(found.select(*by, F.col("_b")[chunk].alias("_c")), list(by)).where(F.col(chunk) != F.col("_c")).groupBy(*by).agg(F.max(first).alias("_second"))
    found = found.join(rest, list(by), "left")
    mean = F.when(F.col("_second").isNull(), F.col(first)).otherwise((F.col(first) + F.col("_second")) / 2)
    return found.select(*by, *signals, mean.alias("top2_mean"), F.col("_b")[chunk].alias("best_chunk"), "n_chunks")


def intent(answers: DataFrame, by: str, names: tuple[str, ...] = INTENTS) -> DataFrame:
    """(by, kind, confidence): the kind with the largest answer, the last one on ties; without answers the last kind with none."""
    each = F.array(*[F.struct(F.coalesce(F.col(n), F.lit(0.0)).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("kind")) for i, n in enumerate(names)])
    best = F.array_max(each)
    return answers.select(by, best["kind"].alias("kind"), best["v"].alias("confidence"))


def intent_by_words(question: Column, words: dict[str, tuple[str, ...]]) -> list[Column]:
    """A rule scorer of intent: for each kind the share of its marker words in the question."""
    asked = tokens(question)
    return [(F.size(F.array_intersect(asked, F.array(*[F.lit(x) for x in w]))) / float(len(w))).alias(k) for k, w in words.items()]


def currentness(days: Column, today: Column, half: float = 365.0) -> Column:
    """A rule scorer of currentness: halves with each `half` days of age; 0.5 where a document has no date."""
    age = F.greatest(today - days, F.lit(0))
    return F.when(days.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / half))


def claim_judgments(claims: DataFrame, chunks: DataFrame, least_shared: int = 1) -> DataFrame:
    """(claim_id, id, supports, contradicts, qualifies, chunk): claims met with the chunks that share a word with them.

    `claims` are (claim_id, claim), a handful for a question, and `chunks` (id, chunk, text). Words join them, so that a chunk
    without a word of a claim costs nothing: its judgment would be 0.
    """
    asked = claims.select("claim_id", "claim", F.size(tokens(F.col("claim"))).alias("n"), F.explode(tokens(F.col("claim"))).alias("word"))
    held = chunks.select("id", "chunk", F.explode(tokens(F.col("text"))).alias("word"))
    pairs = held.join(F.broadcast(asked) if _few(claims) else asked, "word").groupBy("claim_id", "id", "chunk", "n").agg(F.count("*").alias("m"), F.count_if(F.col("word").isin("not", "never", "no")).alias("neg"))
    pairs = pairs.where(F.col("m") >= least_shared)
    share = F.col("m") / F.col("n").cast("double")
    scored = pairs.select("claim_id", "id", "chunk", share.alias("supports"), (share * F.least(F.col("neg"), F.lit(1))).alias("contradicts"), (share * (1 - share)).alias("qualifies"))
    return judged(scored)


def judged(scored: DataFrame) -> DataFrame:
    """The largest of each judgment of a claim over a document's chunks, with the first chunk that gives most support."""
    best = F.max_by("chunk", F.struct(F.col("supports"), (-F.col("chunk")).alias("o")))
    return scored.groupBy("claim_id", "id").agg(F.max("supports").alias("supports"), F.max("contradicts").alias("contradicts"), F.max("qualifies").alias("qualifies"), best.alias("chunk"))


def _few(claims: DataFrame, most: int = 1_000) -> bool:
    return claims.limit(most + 1).count() <= most


def failed_documents(chunks: DataFrame, calls: DataFrame, by: str = "id", call: str = "call") -> DataFrame:
    """(by, cause, call): documents of which a chunk was in a call that failed; a failure of its own counts before a refusal after a stop.

    `calls` are (call, outcome, cause) with outcome `ok`, `failed` or `refused`.
    """
    bad = chunks.join(calls.where("outcome <> 'ok'"), call)
    rank = F.struct((F.col("outcome") == "refused").alias("r"), F.col(call).alias("c"))
    return bad.groupBy(by).agg(F.min_by("cause", rank).alias("cause"), F.min_by(call, rank).alias(call))


def coverage(planned: DataFrame, answered: DataFrame, by: str = "id", chunk: str = "chunk") -> DataFrame:
    """(by, planned, answered, complete, missing_first): which of a document's chunks have been answered."""
    found = planned.select(by, chunk).join(answered.select(by, chunk, F.lit(1).alias("_a")).distinct(), [by, chunk], "left")
    return found.groupBy(by).agg(F.count("*").alias("planned"), F.count("_a").alias("answered"), (F.count("*") == F.count("_a")).alias("complete"), F.min(F.when(F.col("_a").isNull(), F.col(chunk))).alias("missing_first"))


def flattened(answers: DataFrame, by: str, ident: str, options: str, confidence: str) -> DataFrame:
    """(by, key, value): the answers of choice questions as `id=option` and `id#confidence`, as single probabilities are read."""
    each = F.transform(F.map_entries(options), lambda e: F.struct(F.concat(F.col(ident), F.lit("="), e["key"]).alias("key"), e["value"].alias("value")))
    more = F.array(F.struct(F.concat(F.col(ident), F.lit("#confidence")).alias("key"), F.col(confidence).alias("value")))
    return answers.select(by, F.explode(F.concat(each, more)).alias("e")).select(by, "e.*")


def response_validity(answers: DataFrame, expected: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, n, valid): a reply is valid if it has each expected key once, no other, and only finite numbers from 0 to 1.

    Answers and expected keys are counted side by side by key and then by reply, so neither is joined with the other or held for its distinct keys.
    """
    told = answers.where(F.col(by).isNotNull()).select(by, key, F.lit(1).alias("_a"), F.lit(0).alias("_e"), (~valid(F.col(value))).cast("int").alias("_bad"))
    both = told.unionByName(expected.select(by, key, F.lit(0).alias("_a"), F.lit(1).alias("_e"), F.lit(0).alias("_bad")))
    each = both.groupBy(by, key).agg(F.sum("_a").alias("_a"), F.max("_e").alias("_e"), F.sum("_bad").alias("_bad"))
    # A null key is expected by nobody and never known.
    wrong = F.when(F.col(key).isNull(), F.col("_a") > 0).otherwise(F.col("_a") != F.col("_e"))
    found = each.groupBy(by).agg(F.sum("_a").alias("n"), F.max("_e").alias("_e"), F.count_if(wrong | (F.col("_bad") > 0)).alias("_wrong"))
    # A reply that nobody expects has no row.
    return found.where("_e > 0").select(by, "n", ((F.col("n") > 0) & (F.col("_wrong") == 0)).alias("valid"))

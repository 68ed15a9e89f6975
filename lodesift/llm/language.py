"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text are added as logarithms: its byte trigrams under each language's model, the language
that its markup declares, the suffix of its address, and a prior of its host, smoothed from host to domain to all
rows. Host and suffix counts are grouped sums of what the texts alone say, each row's own vote left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.common import cut, hinted, per_text, slices

#: Buckets of hashed byte trigrams.
GRAMS = 1 << 16
#: Distinct texts of each declared language from which its trigram model is fitted, at most: a documented bound.
SAMPLE_ROWS = 1_000
#: A declared value is a language if at least one in so many distinct declared texts bears it, so that there are no more languages than
#: that at any size; rarer ones are noise of the column unless they are named.
RAREST = 1_000
#: Trigrams after which more text adds no more certainty; neighbouring trigrams depend on each other.
CERTAIN = 200
#: What a text is called that no language explains.
UNKNOWN = "und"

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint32)
_BLOCK = 1 << 20


def _grams(raw: bytes) -> np.ndarray:
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    x = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


def _texts(column):
    for t in column:
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def fit(df: DataFrame, text_col: str = "text", declared_col: str = "lang", languages: tuple | None = None, sample_rows: int = SAMPLE_ROWS, alpha: float = 0.1) -> tuple[tuple[str, ...], np.ndarray]:
    """Languages and their log probabilities of trigram buckets, shape (GRAMS, languages).

    Every language that one in `RAREST` of the declared texts bears (or every one of `languages`, if they are given) has a model,
    fitted on the `sample_rows` of its texts with the lowest hash, or on all if it has fewer. Executors count trigrams, so that only sums
    of a fixed size for each language reach the driver.
    """
    rows = df.select(F.lower(F.trim(F.col(declared_col).cast("string"))).alias("l"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where("l <> '' and t is not null")
    if languages is not None:
        rows = rows.where(F.col("l").isin(*languages))
    # Each language's threshold is its hash at the bound; rows of equal text and language share a hash and enter as one.
    rows = rows.select("l", "t", F.xxhash64("t", "l").alias("h"))
    each = cut(rows.select("l", "h").distinct())
    counts = cut(each.groupBy("l").agg(F.count("*").alias("n")))
    if languages is None:
        every = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts = counts.where(F.col("n") * RAREST >= every)
    if counts.isEmpty():
        return (), np.zeros((GRAMS, 0), np.float32)
    # A bound on hashes first leaves some 1.5 times the sample, so that no language is sorted whole.
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    low = each.join(hinted(counts), "l").where(share * F.col("n") <= 1.5 * sample_rows + 100)
    order = Window.partitionBy("l").orderBy("h")
    low = low.withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample_rows).groupBy("l").agg(F.max("h").alias("most"))
    chosen = rows.join(hinted(cut(low)), "l").where("h <= most").dropDuplicates(["h"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for name, raw in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                into = sums.setdefault(name, np.zeros(GRAMS, np.int64))
                for i in range(0, max(0, len(raw) - 2), _BLOCK):
                    into += np.bincount(_grams(raw[i : i + _BLOCK + 2]), minlength=GRAMS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["l", "g", "n"])

    sums = chosen.select("l", "t").mapInArrow(count, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(languages if languages is not None else sums["l"].unique()))
    counts = np.zeros((GRAMS, len(names)))
    known = sums[sums["l"].isin(names)]
    counts[known["g"].to_numpy(np.int64), [names.index(x) for x in known["l"]]] = known["n"]
    return names, (np.log(counts + alpha) - np.log(counts.sum(0) + alpha * GRAMS)).astype(np.float32)


def likelihoods(model):
    """A column function of texts: the tempered log likelihood of each language, and last of none: all buckets alike.

    Null without trigrams. Only the text is sent to Python.
    """
    table = np.hstack([model[1], np.full((GRAMS, 1), -np.log(GRAMS), np.float32)])

    def score(raw: bytes):
        if len(raw) < 3 or not raw.strip():
            return None
        total, n = np.zeros(table.shape[1]), len(raw) - 2
        for i in range(0, n, _BLOCK):
            total += table[_grams(raw[i : i + _BLOCK + 2])].sum(0, dtype=np.float64)
        return (total * min(1.0, CERTAIN / n)).tolist()

    def make():
        return lambda texts: pa.array([score(raw) for raw in _texts(texts)], pa.list_(pa.float64())), lambda: None

    return per_text(make, "array<double>")


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _address(address: Column) -> list[Column]:
    """Host, domain and suffix: of `https://a.b.example.org:80/x` these are a.b.example.org, example.org and org."""
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(address.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.|\.$", ""))
    parts = F.split(host, r"\.")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return [host.alias("host"), domain.alias("domain"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("suffix")]


def _grouped(votes: DataFrame, key: str) -> DataFrame:
    return votes.groupBy(key, "vote").agg(F.sum("c").alias("c"))


def _spread(n: int) -> Column:
    """The counts `c` of a group's votes as an array by language."""
    held = F.map_from_entries(F.collect_list(F.struct("vote", "c")))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0)))


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _evidence(n: int, shares: Column, names: Column, strength: float, trust: float, unknown: float) -> Column:
    """The logarithm of each language's evidence for a row with lik, vote, nh, nd, ns, suffix and declared.

    Counts leave the row's own vote out. A host's share of a language leans on its domain's, as far as `strength` rows go, and that on the share in
    all rows.
    """
    k, zero = strength, F.array_repeat(F.lit(0).cast("bigint"), n)
    own = lambda c: F.transform(F.coalesce(F.col(c), zero), lambda x, i: F.greatest(x - F.when(i == F.col("vote"), 1).otherwise(0), F.lit(0)).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    with_suffix = (F.col("suffix") != "") & F.col("ns").isNotNull()

    def summed(c: Column) -> Column:
        return F.struct(*[c[x].alias(x) for x in ("h", "d", "s")], *[total(c[x]).alias(f"t{x}") for x in ("h", "d", "s")])

    def each(c: Column) -> Column:
        def one(base: Column, i: Column) -> Column:
            domain = (F.get(c["d"], i) + k * base) / (c["td"] + k)
            prior = (F.get(c["h"], i) + k * domain) / (c["th"] + k)
            # P(suffix | language) against P(suffix): what the suffix says beyond the share of the language.
            suffix = (F.get(c["s"], i) + k * base) / (c["ts"] + k) / base
            said = F.when(F.col("declared") == F.get(names, i), trust).when(F.array_contains(names, F.col("declared")), (1 - trust) / max(1, n - 1)).otherwise(1.0)
            # The domain's rows lie in the suffix too, so the prior takes half of what the suffix says.
            return F.get(F.col("lik"), i) + F.log(said) + F.log(prior * (1 - unknown)) + F.when(with_suffix, 0.5 * F.log(suffix)).otherwise(0.0)

        return F.transform(shares, one)

    return _bind(F.struct(own("nh").alias("h"), own("nd").alias("d"), own("ns").alias("s")), lambda c: _bind(summed(c), each))


def identified(
    df: DataFrame,
    model,
    text_col: str = "text",
    declared_col: str | None = "lang",
    address_col: str | None = "source",
    trust: float = 0.9,
    strength: float = 10.0,
    least: float = 0.5,
    unknown: float = 0.01,
) -> DataFrame:
    """(row, found) of each row of `df`: the row as one struct, and a struct of language, probability, text_language, kept.

    trust: how often a declared language is right; strength: rows that a wider group counts for in a narrower one's
    prior; unknown: the prior of no language. A row is kept if its language is known with probability `least` or more.
    A null, empty or blank text, or one under three bytes, is `und` and not kept; a null address or declaration, or a
    declared language without a model, adds nothing. Without any language in the model every row is `und`. Texts are read whole,
    however long. Repeated rows get the same verdict and stay as many as they are; a tie goes to the first language by name.
    Columns of `df` may have any name and type, as they travel inside `row`.
    """
    names, n = model[0], len(model[0])
    carried = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    if not n:
        none = F.struct(F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), F.lit(UNKNOWN).alias("text_language"), F.lit(False).alias("kept"))
        return df.select(carried, none.alias("found"))
    address = F.col(address_col) if address_col else F.lit(None).cast("string")
    declared = F.lower(F.trim(F.col(declared_col).cast("string"))) if declared_col else F.lit(None).cast("string")
    said_by = likelihoods(model)
    # First the votes of the texts alone, summed by host; a second pass over the texts is cheaper than keeping them.
    evidence = [F.col(text_col).cast("string").alias("text"), *_address(address), declared.alias("declared")]
    votes = df.select(*evidence).select("host", "domain", "suffix", said_by("text").alias("lik"))
    votes = votes.select("host", "domain", "suffix", _argmax(F.col("lik")).alias("vote")).where(F.col("vote") < n)
    votes = cut(votes.groupBy("host", "domain", "suffix", "vote").agg(F.count("*").alias("c")))
    hosts = votes.groupBy("host", "domain", "suffix").agg(_spread(n).alias("nh"))
    domains, suffixes = (_grouped(votes, key).groupBy(key).agg(_spread(n).alias(name)) for key, name in (("domain", "nd"), ("suffix", "ns")))
    sums = dict(votes.groupBy("vote").agg(F.sum("c")).collect())  # one number a language
    known = cut(hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "nh", "nd", "ns"))

    scored = df.select(carried, *evidence).select("row", "host", "suffix", "declared", said_by("text").alias("lik"))
    scored = scored.withColumn("vote", _argmax(F.col("lik"))).join(hinted(known), "host", "left")
    whole = float(sum(sums.values()))
    shares = F.array(*[F.lit((sums.get(i, 0) + 1.0) / (whole + n)) for i in range(n)])
    logits = _evidence(n, shares, F.array(*[F.lit(x) for x in names]), strength, trust, unknown)
    # Where no language explains the text, the declared one says nothing: 1 / n is the mean over the languages.
    nothing = F.col("lik")[n] + F.log(F.lit(unknown)) + F.when(F.col("declared").isin(*names), F.log(F.lit(1.0 / n))).otherwise(0.0)
    scored = scored.select("row", "vote", F.concat(logits, F.array(nothing)).alias("logits")).withColumn("best", _argmax(F.col("logits")))
    top = F.array_max("logits")
    share = 1.0 / F.aggregate(F.transform("logits", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    label = lambda c: F.coalesce(F.get(F.array(*[F.lit(x) for x in (*names, UNKNOWN)]), F.col(c)), F.lit(UNKNOWN))
    told = scored.select("row", label("best").alias("language"), F.coalesce(share, F.lit(0.0)).alias("probability"), label("vote").alias("text_language"))
    kept = (F.col("language") != UNKNOWN) & (F.col("probability") >= least)
    return told.select("row", F.struct("language", "probability", "text_language", kept.alias("kept")).alias("found"))


def identify(df: DataFrame, model, *args, **settings) -> DataFrame:
    """`df` with language, probability, text_language and kept, as `identified` finds them; columns of these names are replaced."""
    new = ("language", "probability", "text_language", "kept")
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in new]
    return identified(df, model, *args, **settings).select(*own, *[F.col("found")[c].alias(c) for c in new])


def known_only(df: DataFrame, model, *args, **settings) -> DataFrame:
    """The rows of `df` that `identified` keeps, with all their columns as they are."""
    found = identified(df, model, *args, **settings).where("found.kept")
    return found.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def declared_in_markup(html: Column) -> Column:
    """The language that a page's `html` tag declares, without a region; null if none."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1)
    return F.when(found != "", F.lower(found))


def visible(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    inner = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"&[A-Za-z#0-9]+;|\s+", " ")

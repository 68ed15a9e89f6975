"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of test windows, scanned over whole texts.

The set has two parts. A bitmap of hashes, one value of at most 2 MiB whatever the benchmark's size, drops nearly all windows
of a text where they stand, inside one array expression; a window that passes becomes a row with its words and is verified
against the windows themselves. Only those rows and one narrow row for each text are grouped; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, hinted

#: Words of a window; an item of fewer is one window of all its words.
WINDOW = 10
#: What separates words once A-Z are lower case: every ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same before lower-casing.
_ASIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: The bitmap's bits for each window, and its largest size as a power of two.
SPARSE, MOST_BITS = 64, 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Lower-case words; none for a null text."""
    return F.filter(F.split(lowered(text), BETWEEN + "+"), lambda w: w != "")


def _bind(value: Column, use) -> Column:
    """`use` applied to `value`, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _hash(tokens: Column, at: Column, length: Column) -> Column:
    """The hash of a window of word hashes."""
    return F.xxhash64(F.slice(tokens, at, length))


def _told(tokens: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(tokens, at, length), " ")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(gram, length, hash, set_no) of every distinct window, and (set_no, items): the sorted ids that have it, as strings.

    Windows that the same items hold share one list, so that repeated items make no longer rows. A null id counts as none.
    """
    known = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0 and item is not null")
    length = F.least(F.size("w"), F.lit(width))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    placed = known.select("item", "w", length.alias("length"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), starts.alias("at"))
    grams = placed.select("item", "length", _told(F.col("w"), F.col("at"), F.col("length")).alias("gram"), _hash(F.col("h"), F.col("at"), F.col("length")).alias("hash"))
    grams = grams.groupBy("gram", "length", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    grams = cut(grams.withColumn("set_no", F.md5(F.to_json("items").cast("binary"))))
    return grams.drop("items"), cut(grams.select("set_no", "items").dropDuplicates(["set_no"]))


def bitmap(grams: DataFrame) -> tuple[DataFrame, int]:
    """One row with `bits`, an array of longs, and the number of bits as a power of two (14 to 24).

    Its size follows from the number of windows up to 2 MiB; beyond it more windows pass the bitmap and are verified.
    """
    power = min(MOST_BITS, max(14, (grams.count() * SPARSE).bit_length()))
    place = F.col("hash").bitwiseAND((1 << power) - 1)
    held = grams.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    held = held.groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    every = grams.sparkSession.range(1 << (power - 6)).withColumnRenamed("id", "cell").join(F.broadcast(held), "cell", "left")
    longs = every.agg(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("bit", F.lit(0)).alias("bit")))).alias("x"))
    return longs.select(F.col("x.bit").alias("bits")), power


def _passing(tokens: Column, lengths: list[int], bits: Column, power: int) -> Column:
    """(at, length) of every window whose hash has its bit in the bitmap."""

    def passes(hashes: Column, length: int) -> Column:
        def holds(at: Column) -> Column:
            cell = lambda h: F.get(bits, F.shiftright(h.bitwiseAND((1 << power) - 1), 6).cast("int"))
            bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))
            return F.exists(F.array(_hash(hashes, at, F.lit(length))), lambda h: cell(h).bitwiseAND(bit(h)) != 0)

        starts = F.filter(F.sequence(F.lit(1), F.size(hashes) - length + 1), holds)
        found = F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(length).alias("length")))
        return F.when(F.size(hashes) >= length, found).otherwise(F.array().cast("array<struct<at:int,length:int>>"))

    each = lambda hashes: F.concat(*[passes(hashes, n) for n in lengths]) if lengths else F.array().cast("array<struct<at:int,length:int>>")
    return _bind(F.transform(tokens, lambda x: F.xxhash64(x)), each)


def spans(hits: Column) -> Column:
    """Places (at, length) as sorted spans (at, end) that neither overlap nor touch; `end` is the first word after one."""

    def runs(at: Column) -> Column:
        starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) < x - 1, F.lit(True)))
        ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b + 1).alias("end")))

    covered = F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))
    return _bind(F.array_sort(F.array_distinct(covered)), runs)


def scan(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, digest, n_words, spans, n_hit, n_items, items_sha256, contaminated) of each row of `df`.

    `spans` are the hit words as (at, end) from 1, `digest` the MD5 of the text. A null or empty text has no words and no hit;
    of an empty benchmark, or items without words, nothing is hit. Repeated rows and ids are told apart by row. Rows come as many as
    `df` has, whatever else it holds.
    """
    grams, sets = windows(benchmark, item_col, item_text, width)
    lengths = [r[0] for r in grams.select("length").distinct().orderBy("length").collect()]  # at most `width` numbers
    bits, power = bitmap(grams)
    base = df.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("digest"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # The bitmap is one row of bounded size; as a scalar subquery it is one value of the plan, without a join. The optimizer
    # merges this projection with the next one, so that no row holds it.
    base = base.select("id", "digest", "row", words(F.col("text")).alias("w"), bits.scalar().alias("bits"))

    def told(both: Column) -> Column:
        w = both["w"]
        found = _passing(w, lengths, both["bits"], power)
        return F.struct(F.size(w).cast("bigint").alias("n"), F.transform(found, lambda p: F.struct(p["at"].alias("at"), p["length"].alias("length"), _told(w, p["at"], p["length"]).alias("gram"))).alias("p"))

    near = base.select("id", "digest", "row", _bind(F.struct("w", "bits"), told).alias("t"))
    near = near.select("id", "digest", "row", F.col("t.n").alias("n_words"), F.explode_outer("t.p").alias("p"))
    known = grams.select(F.col("gram").alias("_gram"), "set_no")
    met = near.join(hinted(known), F.col("p.gram") == F.col("_gram"), "left")
    hit = F.when(F.col("set_no").isNotNull(), F.struct(F.col("p.at").alias("at"), F.col("p.length").alias("length")))
    found = met.groupBy("row", "id", "digest", "n_words").agg(F.collect_set(hit).alias("hits"), F.array_sort(F.collect_set("set_no")).alias("sets"))
    found = cut(found.select("id", "digest", "n_words", _bind(F.col("hits"), spans).alias("spans"), "sets"))
    # Documents that hold the same windows share one list of items.
    lists = found.where("size(sets) > 0").select("sets").distinct()
    ids = lists.select("sets", F.explode("sets").alias("set_no")).join(hinted(sets), "set_no").select("sets", F.explode("items").alias("item"))
    ids = ids.groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ids = cut(ids.select(F.col("sets").alias("_sets"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")))
    out = found.join(hinted(ids), F.col("sets") == F.col("_sets"), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["at"])
    return out.select(
        "id", "digest", "n_words", "spans", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _without(text: Column, cuts: Column) -> Column:
    """The text without the words of `cuts` and what stands before them; the rest is as it was, letter by letter."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{_ASIDE}]*[^{_ASIDE}]+"), 0)

    def kept(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda s: s["end"]))
        ends = F.concat(F.transform(cuts, lambda s: s["at"]), F.array(F.size(p) + 1))
        words = F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(p, a, F.greatest(b - a, F.lit(0))))), "")
        tail = F.call_function("substring", text, F.aggregate(p, F.lit(1), lambda n, x: n + F.length(x)))
        return F.concat(words, tail)

    return _bind(pieces, kept)


def clean(df: DataFrame, found: DataFrame, by: str = "spans", text_col: str = "text") -> DataFrame:
    """`df` without what `found` (of `scan` over it) has hit: whole documents, or by="spans" the hit words alone.

    All other rows, columns and characters stay. A document of which no word is left stays as what stood between its words.
    """
    hits = found.where("contaminated").select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans")).dropDuplicates(["_digest"])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).cast("string").alias("_text"))
    digest = F.md5(F.coalesce("_text", F.lit("")).cast("binary"))
    if by == "documents":
        rows = rows.join(hinted(cut(hits)), digest == F.col("_digest"), "left_anti")
        return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
    if by != "spans":
        raise ValueError("by is 'spans' or 'documents'")
    rows = rows.join(hinted(cut(hits)), digest == F.col("_digest"), "left")
    text = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(_without(F.col("_text"), F.col("_spans")))
    return rows.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns])

"""Near-dedup at an exact Jaccard similarity of 0.8 over distinct five-word shingles.

Candidates come from two searches. The first is the SimHash operator: fingerprints of the shingle sets, the inverted index of
positional bytes and its count filter (`simhash.links`) find the close copies, and with them most of what large groups of
copies hold. Its guarantee ends at four bits of 64, though, and two sets at 0.8 differ in ten bits on average, where no
number of shared bytes is certain any more. So the second search adds what the first can't promise: prefixes (Chaudhuri
et al., 2006; Xiao et al., 2008). With each set in one common order, two sets at 0.8 or more share a shingle among the first
fifth of each, so no pair is missed. Rare shingles come first in the order; how rare is estimated on a sample, which
decides only the cost, as any common order gives the same pairs. Each set has a bitmap, the parities of its shingles by hash:
two bitmaps differ in no more bits than the sets in shingles, so that a pair whose bitmaps differ too much is none (Sandes et al.,
2017). Every candidate that this leaves is verified on whole sets, only verified pairs link, and what the first search
has linked makes no candidates in the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from lodesift.llm.common import cut, hinted, slices
from lodesift.llm.components import connected
from lodesift.llm.simhash import fingerprint, links, shingle_hashes

WIDTH = 5
#: Sets whose shingles are counted for the common order, and the counts that are kept: bounds on cost, not on results.
ORDER_ROWS, ORDER_COUNTS = 5_000, 1 << 17
#: Rows of a posting up to which all of its pairs are candidates at once, and from which it is compared in pairs of blocks.
_NEAR, _SPLIT = 8, 4_096
_BLOCK = 1 << 15


def least_shared(n):
    """The shingles that a set of `n` shares with any set at a similarity of 0.8 or more, at least."""
    return (4 * n + 4) // 5


def _may(na, pa_, nb, pb):
    """Whether sets of `na` and `nb`, whose first common shingle is at these places, can be at 0.8: sizes and what is left."""
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * np.minimum(na - pa_, nb - pb) >= 4 * (na + nb))


def _class(hashes: np.ndarray) -> int:
    """A set's name: 64 bits over its sorted hashes."""
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of a set's shingles in the smallest power of two of places that is twice their number, at least 64."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    at = (hashes & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width) & 1, bitorder="little").tobytes()


def folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps, a row of 64-bit words each, at half of their width."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def _words(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)[None]


def alike(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    """Whether sets of these bitmaps and sizes can be at 0.8: they differ in a ninth of their sizes' sum at most."""
    a, b = sorted((_words(x), _words(y)), key=lambda w: w.shape[1])
    while b.shape[1] > a.shape[1]:
        b = folded(b)
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= nx + ny


def classes_of(rows: DataFrame) -> DataFrame:
    """(key, cls, fp, bits, n) of (key, text): the set of shingles of each row, by name, its fingerprint, bitmap and size; null as an empty text."""

    def each(batches):
        for b in slices(batches):
            found = []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), WIDTH, True)
                found.append((_class(h), fingerprint(h), bitmap(h), len(h)))
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32())
            fp = np.array(columns[1], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], kinds[0]), pa.array(fp), *(pa.array(columns[k], kinds[k]) for k in (2, 3))], names=["key", "cls", "fp", "bits", "n"])

    return rows.mapInArrow(each, f"key {rows.schema['key'].dataType.simpleString()}, cls long, fp long, bits binary, n int")


def close(classes: DataFrame) -> DataFrame:
    """(a, b): candidates among `classes` (cls, fp) by their fingerprints, a forest that joins what the fingerprints link."""
    low = cut(classes.groupBy("fp").agg(F.min("cls").alias("low")))
    same = classes.join(low, "fp").where("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    apart = links(low.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    for end, name in (("x", "a"), ("y", "b")):
        apart = apart.join(low.select(F.col("fp").alias(end), F.col("low").alias(name)), end)
    return same.unionByName(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _each_set(batches, seen: set):
    """(cls, sorted hashes) of the texts, each set once in a task."""
    for b in batches:
        for t in b.column(0):
            h = shingle_hashes(t.as_py(), WIDTH, True)
            c = _class(h)
            if len(h) and c not in seen:
                seen.add(c)
                yield c, h


def sets(texts: DataFrame) -> DataFrame:
    """(cls, hashes) of each distinct set among the texts."""

    def each(batches):
        seen: set = set()
        for b in slices(batches):
            found = list(_each_set([b], seen))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], names=["cls", "hashes"])

    return texts.mapInArrow(each, "cls long, hashes array<bigint>").dropDuplicates(["cls"])


def counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of the texts, sorted, and in how many sets each is."""
    found = sets(texts).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(ORDER_COUNTS).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(h)
    return h[at], found["n"].to_numpy(np.int64)[at]


def postings(texts: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, cls, pos, n) of the prefix of each set: its first shingles in the common order, enough to meet all at 0.8."""
    common, counts = order

    def prefix(h: np.ndarray) -> np.ndarray:
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
        return h[: len(h) - least_shared(len(h)) + 1]

    def each(batches):
        seen: set = set()
        for b in slices(batches):
            found = [(c, prefix(h), len(h)) for c, h in _each_set([b], seen)]
            if found:
                k = [len(p) for _, p, _ in found]
                columns = [np.concatenate([p for _, p, _ in found]).view(np.int64), np.repeat(np.array([c for c, _, _ in found], np.int64), k), np.concatenate([np.arange(x, dtype=np.int32) for x in k]), np.repeat(np.array([n for _, _, n in found], np.int32), k)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cls", "pos", "n"])

    return texts.mapInArrow(each, "token long, cls long, pos int, n int")


def _groups(batches):
    """Whole postings, several at once: the columns as arrays, sorted by token, and where each posting starts."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        starts = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
        tail = len(held[0]) if batch is None else int(starts[-1])
        if tail:
            yield [c[:tail] for c in held], starts[starts < tail]
            held = [c[tail:] for c in held]


def _with_end(batches):
    yield from batches
    yield None


def _table(kind: int, a: list, b: list, pos: list | None = None, n: list | None = None) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    zero = np.zeros(len(a), np.int32)
    pos, n = (np.concatenate(x) if x else zero for x in (pos, n))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(pos), pa.array(n)], names=["kind", "a", "b", "pos", "n"])


def _first(batches):
    """(0, cls, cls) for candidates: all of a small posting, and of a large one each row with three of its rows.

    (1, token, cls, pos, n) for the rows of large postings, whose other pairs wait until it is known what links.
    """
    for (token, cls, pos, n), _ in _groups(batches):
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])  # sets named by several tasks
        token, cls, pos, n = token[fresh], cls[fresh], pos[fresh].astype(np.int64), n[fresh].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        a, b = [], []
        small = np.repeat(sizes <= _NEAR, sizes)
        for d in range(1, _NEAR):
            i = np.flatnonzero(small[:-d] & (token[:-d] == token[d:]))
            if not len(i):
                break
            i = i[_may(n[i], pos[i], n[i + d], pos[i + d])]
            a, b = [*a, cls[i]], [*b, cls[i + d]]
        large = ~small
        for s, m in zip(starts[sizes > _NEAR].tolist(), sizes[sizes > _NEAR].tolist()):
            for hub in (s, s + m // 2, s + m - 1):
                i = np.arange(s, s + m)
                i = i[(i != hub) & _may(n[s : s + m], pos[s : s + m], n[hub], pos[hub])]
                a, b = [*a, np.minimum(cls[i], cls[hub])], [*b, np.maximum(cls[i], cls[hub])]
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield _table(0, [pairs[0]], [pairs[1]])
        if large.any():
            yield _table(1, [token[large]], [cls[large]], [pos[large].astype(np.int32)], [n[large].astype(np.int32)])


def _rest(batches):
    """(0, cls, cls) for all candidates of a posting, or of two blocks of it, between sets that nothing links so far."""
    for (token, left, right, block, cls, pos, n, root, bits), _ in _groups(batches):
        # One posting can be several groups: pairs of blocks.
        order = np.lexsort((n, right, left, token))
        key = np.stack([token, left, right], 1)[order]
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cls)]):
            at = order[s:e]
            if (root[at] == root[at[0]]).all():
                continue
            yield from _pairs(cls[at], pos[at].astype(np.int64), n[at].astype(np.int64), root[at], block[at], bits[at], left[at[0]] != right[at[0]])


def _pairs(c, p, k, r, block, bits, across: bool):
    """Candidates among sets in the order of their sizes; only between different blocks if `across`."""
    # Bitmaps by width, each also at half of it: sets that can be at 0.8 differ in width by one step at most.
    wide = np.array([len(x) for x in bits])
    held, place = {}, np.zeros(len(c), np.int64)
    for w in np.unique(wide):
        own = np.flatnonzero(wide == w)
        place[own] = np.arange(len(own))
        held[w] = np.frombuffer(b"".join(bits[own]), np.uint64).reshape(len(own), -1)
    # The larger set of a pair is in reach of both bounds of the smaller one.
    ends = np.searchsorted(k, np.minimum(5 * k // 4, 9 * (k - p) // 4 - k), "right")
    a, b, size = [], [], 0
    for i, end in enumerate(ends.tolist()):
        if end > i + 1:
            j = np.arange(i + 1, end)
            j = j[(r[j] != r[i]) & _may(k[j], p[j], k[i], p[i])]
            if across:
                j = j[block[j] != block[i]]
            mine = held[wide[i]][place[i]]
            for w in np.unique(wide[j]):
                own = j[wide[j] == w]
                theirs = held[w][place[own]]
                while theirs.shape[1] > len(mine):
                    theirs = folded(theirs)
                own = own[9 * np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64) <= k[own] + k[i]]
                a, b, size = [*a, np.minimum(c[own], c[i])], [*b, np.maximum(c[own], c[i])], size + len(own)
        if size > _BLOCK:
            yield _table(0, a, b)
            a, b, size = [], [], 0
    if size:
        yield _table(0, a, b)


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of sets whose bitmaps allow a similarity of 0.8."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([alike(*row) for row in zip(*(x.to_pylist() for x in columns))], pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    both = pairs
    for end, x, n in (("a", "x", "nx"), ("b", "y", "ny")):
        both = both.join(classes.select(F.col("cls").alias(end), F.col("bits").alias(x), F.col("n").alias(n)), end)
    return both.where(F.arrow_udf(run, "boolean")("x", "y", "nx", "ny")).select("a", "b")


def _verified(pairs: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of sets whose similarity is 0.8 or more, counted on the whole sets where bitmaps allow it."""
    pairs = cut(_alike(pairs, classes))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("low.x", "low.y"))
    held = cut(sets(named.join(hinted(wanted), ["x", "y"], "left_semi").select("text")))
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _holds_map(kind) -> bool:
    return isinstance(kind, MapType | VariantType) or any(map(_holds_map, [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []))


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, x, y): each row as one struct, with 128 bits over all of its columns."""
    every = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(*every).alias("x"), F.xxhash64(F.lit(1), *every).alias("y"))


def _rooted(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """`rows` with the root of the set in `column`: the set itself where nothing links it."""
    return rows.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each group of near copies: the one with the smallest id (a null id is smallest).

    Groups are the components of pairs at a similarity of 0.8 or more. Null, empty and blank texts, which have no words, are
    one group; texts of fewer than five words are one shingle each. Of rows with the same set and id, one stays; rows that are equal
    in every column count once. Texts are read whole, however long. Columns may have any name and type: a row travels as one
    struct, and what stays is as it was. An empty table gives an empty one.
    """
    named = _named(df, id_col, text_col)
    classes = cut(classes_of(named.select(F.struct("id", "x", "y").alias("key"), "text")).groupBy("cls").agg(F.min("key").alias("low"), F.min("fp").alias("fp"), F.any_value("bits").alias("bits"), F.any_value("n").alias("n")))
    found = cut(_verified(cut(close(classes.select("cls", "fp"))), named, classes))
    every = -(-classes.count() // ORDER_ROWS)
    some = classes.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, every))) == 0).select("low.x", "low.y")
    order = counted(named.join(F.broadcast(some), ["x", "y"], "left_semi").select("text"))
    schema = "kind int, a long, b long, pos int, n int"
    met = cut(postings(named.select("text"), order).repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_first, schema))
    roots = hinted(cut(connected(found)))
    pairs = _rooted(_rooted(met.where("kind = 0").select("a", "b").distinct(), roots, "a", "x"), roots, "b", "y")
    pairs = cut(pairs.where("x <> y").select("a", "b"))
    found = cut(found.unionByName(_verified(pairs, named, classes)))
    large = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cls"), "pos", "n")
    if not large.isEmpty():
        large = cut(_rooted(large, hinted(cut(connected(found))), "cls", "root").select("token", "cls", "pos", "n", "root"))
        mixed = large.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("r"), F.max("root").alias("q")).where("r <> q")
        large = large.join(mixed.select("token", F.ceil(F.col("m") / _SPLIT).cast("int").alias("parts")), "token").join(classes.select("cls", "bits"), "cls")
        large = large.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
        large = large.select("token", F.explode(others).alias("g"), "block", "cls", "pos", "n", "root", "bits").select("token", "g.left", "g.right", "block", "cls", "pos", "n", "root", "bits")
        more = large.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right").mapInArrow(_rest, schema).select("a", "b").distinct()
        more = cut(more.join(pairs, ["a", "b"], "left_anti"))
        found = cut(found.unionByName(_verified(more, named, classes)))
    nodes = connected(found).withColumnRenamed("node", "cls")
    # What stays: the lowest row of each set that links to no other, and of each component.
    reached = classes.join(nodes, "cls", "left").select(F.coalesce("root", "cls").alias("root"), "low")
    stays = reached.groupBy("root").agg(F.min("low").alias("low")).select("low.x", "low.y")
    kept = named.join(cut(stays), ["x", "y"], "left_semi").dropDuplicates(["x", "y"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])

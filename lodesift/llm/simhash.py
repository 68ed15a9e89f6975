"""SimHash near-dedup over an inverted index of positional bytes.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in d bits differ in at most d bytes, so
they share at least 8 - d of them. With d = 4 the index has a posting for each choice of three of the first seven
bytes, as two fingerprints that share four of eight bytes share three of any seven (or for each choice of four of all
eight, for very many fingerprints). In each posting the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum fall away, and the others are verified by
their Hamming distance. A posting yields a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, slices
from lodesift.llm.components import connected

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingle hashes that are held at once while a fingerprint is summed.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z in lower case, joined by one space; fewer words: one run."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]).tolist()
    starts, n = [0, *ends[:-1]], len(w) - width + 1
    h = xxhash.xxh64_intdigest
    found = [h(joined, 42)] if n < 1 else [h(joined[a : b - 1], 42) for a, b in zip(starts[:n], ends[width - 1 :])]
    out = np.array(found, np.uint64)
    return np.unique(out) if distinct else out


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 without hashes. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: tuple = ((4, False),)) -> DataFrame:
    """(id, fp0, fp1, ...): one fingerprint for each (words in a shingle, distinct shingles only) of `features`.

    A null text counts as one without words. The id keeps its type; other columns are not carried.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, names = rows.schema["id"].dataType.simpleString(), [f"fp{i}" for i in range(len(features))]

    def each(batches):
        for b in slices(batches):
            texts = b.column(1)
            found = [[fingerprint(shingle_hashes(t.as_py(), w, d)) for w, d in features] for t in texts]
            columns = np.array(found, np.int64).reshape(-1, len(features)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns)], names=["id", *names])

    return rows.mapInArrow(each, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def _byte(fp, i: int):
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def _positions(probe: int) -> list[tuple[int, ...]]:
    return list(combinations(range(4 + probe), probe))


def _index(fps: DataFrame, probe: int) -> DataFrame:
    """(key, fp): a row for each choice of `probe` of the first `4 + probe` bytes."""
    keys = []
    for n, at in enumerate(_positions(probe)):
        key = F.lit(n).cast("bigint")
        for i in at:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), i))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(v: np.ndarray, least: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the links among `v` connect, found by a breadth-first walk."""
    out, left = [], v
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            differs = left ^ x
            shared = (differs.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            hit = (shared >= least) & (np.bitwise_count(differs) <= most)
            if hit.any():
                new, left = left[hit], left[~hit]
                out.append((np.full(len(new), x, np.uint64), new))
                stack.extend(new)
    return out


def _rows(a, b, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.uint64).view(np.int64)) for x in (a, b, key)], names=["a", "b", "key"])


def _links(batches, least: int, most: int, limit: int):
    """Links (a, b, 0) of postings that arrive in key order; rows (fp, fp, key) of postings over `limit`."""
    keys, fps, over = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
    for b in (*batches, None):
        if b is not None:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(keys):
            continue
        if over is not None:
            n = int((keys == over).sum())
            if n:
                yield _rows(fps[:n], fps[:n], keys[:n])
                keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            over = None
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        if b is not None:  # the last posting may go on in the next batch
            tail, starts, sizes = int(starts[-1]), starts[:-1], sizes[:-1]
        else:
            tail = len(keys)
        found = []
        two = starts[sizes == 2]
        if len(two):
            x, y = fps[two], fps[two + 1]
            d = x ^ y
            z = ((d.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= least) & (np.bitwise_count(d) <= most)
            found.append((x[z], y[z]))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if n <= limit:
                found += _forest(fps[s : s + n], least, most)
            else:
                yield _rows(fps[s : s + n], fps[s : s + n], keys[s : s + n])
        if found and sum(len(x) for x, _ in found):
            x, y = (np.concatenate(c) for c in zip(*found))
            yield _rows(x, y, np.zeros(len(x), np.uint64))
        keys, fps = keys[tail:], fps[tail:]
        if len(keys) > limit:
            over = keys[0]
            yield _rows(fps, fps, keys)
            keys, fps = keys[:0], fps[:0]


def _finer(batches, probe: int):
    """Keys of an oversize posting made longer: one more shared byte, then four shared half bytes of the other bytes.

    What is left free are 16 bits, so that such a posting holds 65,536 fingerprints at most.
    """
    nibbles = list(combinations(range(8), 4))
    for b in batches:
        fp, key = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        combo = (key >> np.uint64(8 * probe)).astype(int)
        for n in np.unique(combo).tolist():
            f, k = fp[combo == n], key[combo == n]
            rest = [i for i in range(8) if i not in _positions(probe)[n]]
            choices = list(combinations(rest, 4 - probe))
            for c, more in enumerate(choices):
                k1 = np.zeros(len(f), np.uint64) + np.uint64(c)
                for i in more:
                    k1 = (k1 << np.uint64(8)) | ((f >> np.uint64(8 * i)) & np.uint64(255))
                free = [h for i in rest if i not in more for h in (8 * i, 8 * i + 4)]
                for m, at in enumerate(nibbles):
                    k2 = np.zeros(len(f), np.uint64) + np.uint64(m)
                    for j in at:
                        k2 = (k2 << np.uint64(4)) | ((f >> np.uint64(free[j])) & np.uint64(15))
                    arrays = [pa.array(x.view(np.int64)) for x in (k, k1, k2, f)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["k0", "k1", "k2", "fp"])


def links(fps: DataFrame, most: int = 4, probe: int = 3, limit: int = 32_768) -> DataFrame:
    """(a, b): enough links between distinct fingerprints `fp` at `most` or fewer bits to connect all that they connect.

    `most` is 4 at most, and `probe` the bytes in an index key, 3 or 4: three suit up to about a thousand million
    fingerprints, four (twice the rows) more. Postings over `limit` fingerprints are split by longer keys, exactly.
    """
    if not 0 <= most <= 4 or probe not in (3, 4):
        raise ValueError("most must be 0 to 4 and probe 3 or 4")
    least, schema = 8 - most, "a bigint, b bigint, key bigint"
    rows = _index(fps, probe).repartition("key").sortWithinPartitions("key")
    found = cut(rows.mapInArrow(lambda it: _links(it, least, most, limit), schema))
    out = found.where("a <> b").select("a", "b")
    over = found.where("a = b").select(F.col("a").alias("fp"), "key")
    if not over.isEmpty():
        finer = over.mapInArrow(lambda it: _finer(it, probe), "k0 bigint, k1 bigint, k2 bigint, fp bigint")
        finer = finer.select(F.xxhash64("k0", "k1", "k2").alias("key"), "fp").distinct()
        rows = finer.repartition("key").sortWithinPartitions("key")
        out = out.unionByName(rows.mapInArrow(lambda it: _links(it, least, most, 1 << 62), schema).select("a", "b"))
    return out.distinct()


def groups(prints: DataFrame, column: str = "fp0", most: int = 4, probe: int = 3, limit: int = 32_768) -> DataFrame:
    """(id, fp, component): each row of `prints` (from `fingerprints`) with the smallest id that links reach.

    Equal fingerprints are one node of the link graph. Rows with a null id keep it; the component is null only
    where no row reached has an id.
    """
    prints = cut(prints.select("id", F.col(column).alias("fp")))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("low")))
    nodes = connected(links(classes.select("fp"), most, probe, limit))
    reached = nodes.join(classes, nodes.node == classes.fp).groupBy("root").agg(F.min("low").alias("lowest"))
    moved = nodes.join(reached, "root").select(F.col("node").alias("fp"), "lowest")
    # A table of its own, so that the join below is one that Spark can split at a hot fingerprint.
    known = cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component")))
    return prints.join(known, "fp").select("id", "fp", "component")

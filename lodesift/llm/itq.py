"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation that brings vectors near to binary codes is learned on a bounded sample (Gong and Lazebnik, 2011), about the origin, as
the cosine is: vectors of close directions have close codes, whatever mean they have in common. Codes are split into
substrings, one Hamming table for each (Norouzi et al., 2012). Vectors that share a substring meet in a cell of its table and
are compared by their original components; a pair is counted in the first table where it meets.

Length and number of substrings follow from the number of vectors and from the recall that the sample shows at each run; where no
tables show enough, all vectors of a label are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, hinted
from lodesift.llm.components import connected

#: Vectors on which the rotation is learned, at most: a documented bound.
SAMPLE = 10_000
#: Rows of a cell that are compared in one block; larger cells are split into pairs of blocks.
BLOCK = 2_048
#: (bits of a substring, tables) that are tried in turn; the first needs as many vectors as a table of it has cells.
LAYOUTS = ((16, 12), (12, 10), (8, 8))
#: The recall on the sample that ends the search for more tables, and the least with which a layout is used.
ENOUGH, LEAST = 0.995, 0.95
#: Vectors of the sample whose pairs are judged.
JUDGED = 3_000


def learn(sample: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Projection (dimensions, bits): the codes are the signs of x @ projection.

    Principal directions about the origin, then rotations that bring the projections nearest to their signs. Where there are
    fewer dimensions than bits, random orthogonal turns of the directions fill the rest.
    """
    d, rng = sample.shape[1], np.random.default_rng(seed)
    _, directions = np.linalg.eigh(sample.T @ sample if len(sample) else np.eye(d))
    k, parts = min(bits, d), []
    directions = directions[:, ::-1][:, :k]
    for _ in range(-(-bits // k)):
        turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
        v = sample @ directions
        for _ in range(rounds if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        parts.append(directions @ turn)
    return np.hstack(parts)[:, :bits]


def substrings(x: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """(rows, tables) of 16-bit numbers: the code of each row in substrings of `width` bits."""
    bits = (x @ projection >= 0).reshape(len(x), -1, width)
    return (bits << np.arange(width)[None, None, :]).sum(2).astype(np.uint16)


def _shares(x: np.ndarray, y: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """For each number of tables the share of the pairs (x, y) that have met in them."""
    met = substrings(x, projection, width) == substrings(y, projection, width)
    return np.logical_or.accumulate(met, axis=1).mean(0) if len(met) else np.zeros(met.shape[1])


def _judged(sample: np.ndarray, least: float, most: int = JUDGED, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to judge recall by: those of the sample that link, if there are enough, and made ones right at the threshold."""
    rng = np.random.default_rng(seed)
    x = sample[:most]
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    pairs = [(x, least * x + np.sqrt(1 - least**2) * aside / np.where(length > 0, length, 1))] if least < 1 else []
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    if len(a) >= 200:
        some = rng.permutation(len(a))[:100_000]
        pairs.append((x[a[some]], x[b[some]]))
    return pairs


def layout(sample: np.ndarray, count: int, least: float, layouts=LAYOUTS) -> tuple[int, int, np.ndarray | None, float]:
    """(bits of a substring, tables, projection, recall on the sample); no bits if the blocks of a label are to be compared whole."""
    pairs = _judged(sample, least)
    for width, tables in layouts:
        if (1 << width) > max(count, 256) and (width, tables) != layouts[-1]:
            continue
        projection = learn(sample, width * tables)
        recall = np.min([_shares(*p, projection, width) for p in pairs], axis=0) if pairs else np.ones(tables)
        some = np.flatnonzero(recall >= ENOUGH)
        n = int(some[0]) + 1 if len(some) else tables
        if recall[n - 1] >= LEAST:
            return width, n, projection[:, : n * width], float(recall[n - 1])
    return 0, 1, None, 1.0


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _key() -> F.Column:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    # The class of a vector and its label; 128 bits tell any number of classes apart.
    return F.when(usable, F.md5(F.to_json(F.struct("label", "v")).cast("binary")))


def _sampled(part: DataFrame, most: int) -> np.ndarray:
    """The vectors of the lowest keys, at most `most`; all if there are no more.

    Keys are digests, so a bound on them takes the share that is wanted. A sort with a limit would send the driver as
    many vectors from every partition.
    """
    n = part.count()
    low = "%08x" % int(0.95 * most / n * (1 << 32)) if n > most else "g"
    found = sorted(part.where(F.col("key") < low).select("key", "v").collect())
    return np.array([r.v for r in found[:most]], np.float64)


def _cells(rows: DataFrame, width: int, tables: int, projection, d: int) -> DataFrame:
    """(cell, t, label, key, n, code, vec): a row for each class and table; cells of different labels and widths are apart."""

    def code(batches):
        for b in batches:
            x = np.array(b.column(3).to_pylist(), np.float64).reshape(-1, d)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            codes = substrings(x, projection, width) if width else np.zeros((len(x), 1), np.uint16)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["key", "label", "n", "s", "code", "vec"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.select("key", "label", "n", "v").mapInArrow(code, f"key string, label {kind}, n bigint, s array<int>, code binary, vec binary")
    return coded.select("key", "label", "n", "code", "vec", F.posexplode("s").alias("t", "s")).select(F.xxhash64("label", "t", "s").alias("cell"), "t", "label", "key", "n", "code", "vec")


def _within(keys, n, code, x, block, t: int, least: float, left: int, right: int):
    """Links inside one block (left = right) or between two: (counts by row, chosen links as row numbers)."""
    rows = np.arange(len(keys))
    a, b = rows[block == left], rows[block == right]
    if not len(a) or not len(b):
        return np.zeros(len(keys), np.int64), []
    near = x[a] @ x[b].T >= least
    if left == right:
        np.fill_diagonal(near, False)
    for earlier in range(t):  # met before: counted there
        near &= code[a, earlier][:, None] != code[b, earlier][None, :]
    counts = np.zeros(len(keys), np.int64)
    counts[a] += near @ n[b]
    if left != right:
        counts[b] += near.T @ n[a]
    # A spanning forest of the links is enough for the components.
    chosen, open_a, open_b = [], np.ones(len(a), bool), np.ones(len(b), bool)
    for start in range(len(a)):
        if not open_a[start] or not near[start].any():
            continue
        stack = [(0, start)]
        open_a[start] = False
        if left == right:
            open_b[start] = False
        while stack:
            side, i = stack.pop()
            hit = np.flatnonzero(near[i] & open_b) if side == 0 else np.flatnonzero(near[:, i] & open_a)
            (open_b if side == 0 else open_a)[hit] = False
            if left == right:
                (open_a if side == 0 else open_b)[hit] = False
            mine = a[i] if side == 0 else b[i]
            chosen += [(mine, (b if side == 0 else a)[j]) for j in hit]
            stack += [(0 if left == right else 1 - side, j) for j in hit.tolist()]
    return counts, chosen


def _compared(batches, d: int, tables: int, least: float):
    """Rows (a, b, 0) for links and (key, null, n) for counts, from rows sorted by cell and pair of blocks."""
    held = None
    for b in (*batches, None):
        if b is not None:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held is None or not held.num_rows:
            continue
        group = np.stack([held.column(c).to_numpy() for c in ("cell", "left", "right", "t")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
        ends = np.append(starts[1:], len(group))
        if b is not None:  # the last group may go on in the next batch
            tail, starts, ends = int(starts[-1]), starts[:-1], ends[:-1]
        else:
            tail = len(group)
        out_a, out_b, out_n = [], [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s < 2:
                continue
            part = held.slice(s, e - s)
            keys, n = part.column("key").to_pylist(), part.column("n").to_numpy()
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint16).reshape(-1, tables)
            names, labels = np.array(keys, object), part.column("label_key").to_numpy()
            block = part.column("block").to_numpy()
            for one in np.unique(labels) if len(labels) > 1 and (labels != labels[0]).any() else labels[:1]:
                at = labels == one
                counts, chosen = _within(names[at], n[at], code[at], _matrix(part.column("vec"), d)[at], block[at], int(group[s, 3]), least, int(group[s, 1]), int(group[s, 2]))
                some = np.flatnonzero(counts)
                out_a += names[at][some].tolist() + [names[at][i] for i, _ in chosen]
                out_b += [None] * len(some) + [names[at][j] for _, j in chosen]
                out_n += counts[some].tolist() + [0] * len(chosen)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.string()), pa.array(out_b, pa.string()), pa.array(out_n, pa.int64())], names=["a", "b", "n"])
        held = held.slice(tail)


def near(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, layouts: tuple = LAYOUTS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component, kept) of each row.

    Rows link where labels are equal and the cosine, in double precision, is `least` or more; n_links counts the other
    rows linked directly, component is the smallest id that links reach. Rows without a label link with nothing,
    nor do vectors that are null or zero or hold a null or a component that is not finite; equal vectors of a label
    are one class. Rows with a null id count as linked rows; where no id is reached the component is null. Vectors of
    different lengths never link. Pairs are found if they agree in one substring of their codes (see `layout`); cells
    are compared whole, however large, in pairs of blocks. An empty table gives none.
    """
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: x.cast("double") + 0.0).alias("v")).withColumn("key", _key()))
    known = cut(rows.where("key is not null").groupBy("key", "label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    lengths = [r[0] for r in known.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]  # one number for each length
    found = None
    for d in lengths:
        part = known.where(F.size("v") == d)
        x = _sampled(part, sample).reshape(-1, d)
        x = x / np.abs(x).max(1, keepdims=True)
        width, tables, projection, _ = layout(x / np.linalg.norm(x, axis=1, keepdims=True), part.count(), least, layouts)
        cells = _cells(part, width, tables, projection, d).withColumn("label_key", F.xxhash64("label")).drop("label")
        sizes = cells.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
        large = cut(sizes.where(F.col("m") > block).select("cell", F.ceil(F.col("m") / block).alias("parts")))
        # Large cells hold over `block` rows each, so there are few of them.
        cells = cells.join(hinted(large), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        cells = cells.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")))
        others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
        cells = cells.select("*", F.explode(others).alias("p")).select("cell", "p.left", "p.right", "t", "label_key", "key", "n", "code", "block", "vec")
        cells = cells.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right", "t")
        out = cells.mapInArrow(lambda it, d=d, tables=tables: _compared(it, d, tables, least), "a string, b string, n bigint")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    nodes = connected(found.where("b is not null"))
    reached = nodes.join(known.select(F.col("key").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("lowest"))
    moved = nodes.join(reached, "root").select(F.col("node").alias("key"), "lowest")
    told = known.select("key", "n", "low").join(counts, "key", "left").join(moved, "key", "left")
    told = cut(told.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component")))
    out = rows.select("id", "key").join(told, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))

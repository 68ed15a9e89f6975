"""Vector code compression: product codebooks by Lloyd's rounds with Yinyang bounds (Ding et al., 2015), in whole numbers.

Vectors are cut into equal consecutive parts; each part position has a codebook of its own, and a vector becomes one index
a part. A row keeps, for each part, its entry and one lower bound for each group of entries. In the next round a group is scanned
only if its bound, lowered by the group's largest drift, no longer exceeds the distance to the row's own entry. Bounds are
rounded down; whatever they can't decide is scanned in whole numbers, so ties go to the lower index exactly.

A round is one pass over rows without a shuffle, and sums by part and entry, 1,024 rows a task. Only codebooks reach the
driver, whose size is fixed by the number of entries and dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, hinted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a group, about.
GROUP = 8
#: Components whose whole numbers reach this are out of range: squared distances would not fit in 64 bits.
LIMIT = 1 << 26


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or empty, holds a null or a component that is not
    finite, or one whose whole number reaches 2^26."""
    doubles = F.transform(vector, lambda x: x.cast("double") * scale)
    fits = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LIMIT)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fits, F.transform(doubles, lambda x: F.floor(x).cast("int")))


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group's number for each entry of a codebook: a few plain rounds over the entries themselves."""
    centres = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(float)
    for _ in range(rounds):
        own = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(own):
            centres[g] = entries[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) in whole numbers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def _down(squared: np.ndarray) -> np.ndarray:
    """Distances of squared ones, rounded down to 32 bits."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(-1))


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, own=None, bounds=None, drift=None, told=None):
    """(entry, squared distance, bounds) of each row of one part: `own` and `bounds` are those of the round before and `drift`
    the way that each entry has gone since; without them every group is scanned. `told` gets the rows scanned of each group.

    A bound is below the distance of every entry of its group but the row's own. A group is passed over only if its lowered
    bound exceeds the distance to the present entry, rounded up; all else is compared as (squared distance, index).
    """
    n, groups = len(x), int(group.max()) + 1
    if own is None:
        own, bounds = np.zeros(n, np.int64), np.zeros((n, groups), np.float32)
        scan = np.ones((n, groups), bool)
    else:
        own, bounds = own.astype(np.int64), bounds.copy()
        gone = np.array([drift[group == g].max() for g in range(groups)])
        bounds = np.nextafter((bounds - gone[None]).astype(np.float32), np.float32(-np.inf))
        scan = None
    best = ((x - entries[own]) ** 2).sum(1)
    first, first_best = own.copy(), best.copy()
    if scan is None:
        scan = bounds <= np.nextafter(np.sqrt(best.astype(np.float64)).astype(np.float32), np.float32(np.inf))[:, None]
    seconds = {}
    for g in range(groups):
        rows, members = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
        if told:
            told(g, len(rows), len(members))
        if not len(rows):
            continue
        squares = _squares(x[rows], entries[members])
        seconds[g] = rows, members, squares
        at = squares.argmin(1)  # the lowest index of the nearest
        near, index = squares[np.arange(len(rows)), at], members[at]
        better = (near < best[rows]) | ((near == best[rows]) & (index < own[rows]))
        best[rows[better]], own[rows[better]] = near[better], index[better]
    far = np.iinfo(np.int64).max
    for g, (rows, members, squares) in seconds.items():
        others = np.where(members[None] == own[rows, None], far, squares).min(1)
        bounds[rows, g] = np.where(others == far, np.float32(np.inf), _down(others))
    # The entry that a row has left is one of its group's others from now on.
    moved = np.flatnonzero(own != first)
    left = group[first[moved]]
    bounds[moved, left] = np.minimum(bounds[moved, left], _down(first_best[moved]))
    return own, best, bounds


def _ints(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


class _Model:
    """Codebooks (parts, entries, width) of one length of vectors, the groups of entries, and the last drift."""

    def __init__(self, seeds: np.ndarray, parts: int):
        self.books = np.stack(np.split(seeds, parts, axis=1)).astype(np.int64)
        groups = max(1, -(-len(seeds) // GROUP))
        self.groups = [grouped(b, groups) for b in self.books]
        self.width = max(int(g.max()) + 1 for g in self.groups)
        self.drift = None

    def move(self, sums: list) -> None:
        """Entries become the floored means of (part, entry, count, sum of components)."""
        old = self.books.copy()
        for part, entry, count, total in sums:
            self.books[part, entry] = [t // count for t in total]
        # Rounded up, so that a lowered bound stays a bound.
        self.drift = np.nextafter(np.sqrt(((self.books - old) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12), np.inf)

    def told(self) -> str:
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _round(models: dict[int, _Model], parts: int):
    """Rows (key columns, d, x, own, bounds) through one assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths):
                part = b.filter(pa.array(lengths == d))
                model, x = models[int(d)], _ints(part.column("x"), np.int32, int(d)).astype(np.int64)
                width, n = int(d) // parts, part.num_rows
                old = None if part.column("own").null_count else _ints(part.column("own"), np.uint8, parts)
                held = None if old is None else _ints(part.column("bounds"), np.float32, parts * model.width).reshape(n, parts, model.width)
                own, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                bounds = np.full((n, parts, model.width), np.inf, np.float32)
                for p in range(parts):
                    given = (None, None, None) if old is None else (old[:, p], held[:, p, : int(model.groups[p].max()) + 1], model.drift[p])
                    entry, squared, low = assign(x[:, p * width : (p + 1) * width], model.books[p], model.groups[p], *given)
                    own[:, p], bounds[:, p, : low.shape[1]] = entry, low
                    error += squared
                at = {name: part.column(name) for name in ("id", "label", "d", "x")}
                at |= {"own": _binary(own), "bounds": _binary(bounds.reshape(n, -1)), "error": pa.array(error)}
                yield pa.RecordBatch.from_arrays(list(at.values()), names=list(at))

    return run


def _sums(parts: int):
    """One row for each length, part and entry that a task has met: rows and sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in map(int, np.unique(lengths)):
                part = b.filter(pa.array(lengths == d))
                x, own, width = _ints(part.column("x"), np.int32, d).astype(np.int64), _ints(part.column("own"), np.uint8, parts), d // parts
                counts, totals = held.setdefault(d, (np.zeros((parts, 256), np.int64), np.zeros((parts, 256, width), np.int64)))
                for p in range(parts):
                    np.add.at(counts[p], own[:, p], 1)
                    np.add.at(totals[p], own[:, p], x[:, p * width : (p + 1) * width])
        for d, (counts, totals) in held.items():
            at = np.argwhere(counts)
            rows = [totals[p, e].tolist() for p, e in at]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[at[:, 0], at[:, 1]]), pa.array(rows, pa.list_(pa.int64()))], names=["d", "part", "entry", "n", "total"])

    return run


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row whose vector can be coded (see `whole`).

    Codebooks start as the parts of the vectors with the `entries` smallest ids (null ones last, ties by components, repeated rows
    each for itself; all there are if there are fewer). Vectors whose length is no multiple of `parts` are not coded. Vectors of each
    length have codebooks of their own. An empty table has no rows. `label_error` sums over equal labels, nulls together.
    """
    if entries > 256:
        raise ValueError("an entry's index is one byte: 256 entries at most")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole(F.col(vector_col)).alias("v")).where(f"v is not null and size(v) % {parts} = 0")
    rows = cut(rows.select("id", "label", F.size("v").alias("d"), "v"))
    models = {}
    for (d,) in rows.select("d").distinct().collect():  # one number a length
        seeds = rows.where(F.col("d") == d).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        models[d] = _Model(np.array([r.v for r in seeds]), parts)
    names = {n: t for n, t in rows.dtypes}
    schema = f"id {names['id']}, label {names['label']}, d int, x binary, own binary, bounds binary, error bigint"
    state = rows.select("id", "label", "d", "v", F.lit(None).cast("binary").alias("own"), F.lit(None).cast("binary").alias("bounds"))
    state = state.mapInArrow(_packed, "id {id}, label {label}, d int, x binary, own binary, bounds binary".format(**names))
    for _ in range(rounds):
        state = cut(state.mapInArrow(_round(models, parts), schema))
        sums = state.select("d", "x", "own").mapInArrow(_sums(parts), "d int, part int, entry int, n bigint, total array<bigint>")
        width = max((d // parts for d in models), default=1)
        # At most parts * entries rows for each length reach the driver.
        sums = sums.groupBy("d", "part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(width)]).alias("total")).collect()
        for d, model in models.items():
            model.move([(r.part, r.entry, r.n, r.total[: d // parts]) for r in sums if r.d == d])
    state = state.mapInArrow(_round(models, parts), schema)
    told = F.create_map(*[F.lit(x) for d, m in models.items() for x in (d, m.told())]) if models else F.lit(None).cast("map<int,string>")
    found = cut(state.select("id", "label", F.lower(F.hex("own")).alias("code"), "error", told[F.col("d")].alias("codebooks_sha256")))
    labels = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = found.join(hinted(cut(labels)), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("id", "label", "code", "error", "label_error", "codebooks_sha256")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The array of components as one binary value of 32-bit numbers."""
    for b in batches:
        v = b.column("v")
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = np.cumsum(np.concatenate([[0], b.column("d").to_numpy()]))
        x = pa.array([flat[i:j].tobytes() for i, j in zip(sizes, sizes[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("d"), x, b.column("own"), b.column("bounds")], names=["id", "label", "d", "x", "own", "bounds"])

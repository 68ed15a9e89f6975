"""Merkle manifest of a dataset: a hash tree for each group of rows, a tree over the groups, and every row's proof.

Leaves are hashed in the JVM; texts are never shuffled. The ordered leaves of a group are cut into aligned blocks of 3^5. A
block is one bounded task-local unit: a traversal in the manner of Merkle and Szydlo (2004) goes over it leaf by leaf, and one
treehash stack a level prepares the siblings that the next run of that level will need, so that a path is at hand at each
leaf while the nodes held grow with the logarithm of the block. Roots of blocks are the leaves of the next tier, blocks of
3^5 again, up to the root of the group and then of the dataset. What lies above a block is one path that all of its leaves
share; it is computed once and appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, global_index, hinted, slices

ARITY = 3
#: Levels of a block, and so 243 leaves.
HEIGHT = 5
_PATH = "array<struct<l:string,r:string>>"


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each `-` if null, else its UTF-8 byte count, a colon and itself as a string."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def joined(digests) -> str:
    """The hash of hex digests, concatenated as text."""
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels between n nodes and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class _Treehash:
    """The nodes of one run of a level, made from the leaves below it in their order; its stack has few nodes a level."""

    def __init__(self, level: int, run: int, leaves: list[str]):
        width = ARITY ** (level + 1)
        self.level, self.leaves, self.next = level, leaves, run * width
        self.end = min((run + 1) * width, len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    @property
    def tail(self) -> int:
        """The level of the lowest node on the stack; an empty stack counts as its own level."""
        return next((k for k, held in enumerate(self.stack[:-1]) if held), self.level)

    def step(self) -> None:
        """One more leaf; full runs fold upwards, and after the last leaf of all those that are short do too."""
        self.stack[0].append(self.leaves[self.next])
        self.next += 1
        last = self.next == len(self.leaves)
        for k in range(self.level):
            if len(self.stack[k]) == ARITY or last and self.stack[k]:
                self.stack[k + 1].append(joined(self.stack[k]))
                self.stack[k] = []

    def held(self) -> int:
        return sum(map(len, self.stack))


def traverse(leaves: list[str], levels: int, seen=None) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn its path: what stands left and right of it, level by level.

    Each step pays one leaf to the stacks for every level, to the one whose tail is lowest, so that few stacks are partly
    built at a time. `seen`, if given, is told the number of nodes held after each step.
    """
    now, ahead = [], []
    for k in range(levels):
        first = _Treehash(k, 0, leaves)
        while first.next < first.end:
            first.step()
        now.append(first.stack[-1])
        ahead.append(_Treehash(k, 1, leaves))
    for i in range(len(leaves)):
        for k in range(levels if i else 0):
            if i % ARITY ** (k + 1):
                break
            ready = ahead[k]
            while ready.next < ready.end:  # what the schedule still owes
                ready.step()
            now[k], ahead[k] = ready.stack[-1], _Treehash(k, i // ARITY ** (k + 1) + 1, leaves)
        path = []
        for k in range(levels):
            own = i // ARITY**k % ARITY
            path.append(("".join(now[k][:own]), "".join(now[k][own + 1 :])))
        yield path
        for _ in range(levels):
            busy = [t for t in ahead if t.next < t.end]
            if not busy:
                break
            min(busy, key=lambda t: (t.tail, t.level)).step()
        if seen:
            seen(sum(map(len, now)) + sum(t.held() for t in ahead))


def folded(digest: str, path) -> str:
    """The root that follows from a leaf and its path."""
    for left, right in path:
        digest = joined((left, digest, right))
    return digest


def _levels(n: int, high: int) -> int:
    """Levels inside a block of a tree of n leaves: all of a tree that is one block, else those of a full block."""
    return height(n) if n <= ARITY**high else high


def _udf(each, kind: str, width: int, high: int):
    """`each(*values, high)` for every row of `width` columns, in Arrow batches."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = []
            for part in slices([pa.RecordBatch.from_arrays(list(columns), names=[f"c{k}" for k in range(width)])], 16):
                out += [each(*row, high) for row in zip(*(c.to_pylist() for c in part.columns))]
            yield pa.array(out, to_arrow[kind])

    run.__annotations__ = {"batches": Iterator[tuple[(pa.Array,) * width]] if width > 1 else Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


_PROOF = "array<struct<proof:string,folded:string>>"
_pairs = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
to_arrow = {"string": pa.string(), _PROOF: _pairs("proof", "folded"), f"array<{_PATH}>": pa.list_(_pairs("l", "r"))}


def _top(digests: list[str], n: int, high: int) -> str:
    for _ in range(_levels(n, high)):
        digests = [joined(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
    return digests[0]


def _block_paths(digests: list[str], n: int, high: int) -> list:
    return [[{"l": a, "r": b} for a, b in path] for path in traverse(digests, _levels(n, high))]


def _proofs(digests: list[str], changed: list, n: int, upper: list, high: int) -> list:
    above = [(x["l"], x["r"]) for x in upper]
    shared = "".join(a + b for a, b in above)
    out = []
    for own, other, path in zip(digests, changed, traverse(digests, _levels(n, high))):
        proof = joined([*(a + b for a, b in path), shared])
        out.append({"proof": proof, "folded": folded(folded(other or own, path), above)})
    return out


def _blocks(nodes: DataFrame, high: int, *more: str) -> DataFrame:
    """(g, n, b, items, top): one row for each block of (g, n, pos, h, more); items are in the order of pos."""
    item = F.struct("pos", "h", *more)
    out = nodes.groupBy("g", "n", F.expr(f"pos div {ARITY**high}").alias("b")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return cut(out.withColumn("top", _udf(_top, "string", 2, high)("items.h", "n")))


def _above(blocks: DataFrame, high: int) -> tuple[DataFrame, DataFrame]:
    """(g, b, upper) for blocks that have something above them, and (g, top) of every tree."""
    single = blocks.where(f"n <= {ARITY**high}").select("g", "top")
    large = blocks.where(f"n > {ARITY**high}").select("g", F.col("b").alias("pos"), F.col("top").alias("h"), F.ceil(F.col("n") / ARITY**high).alias("n"))
    if large.isEmpty():
        return blocks.select("g", "b", F.lit(None).cast(_PATH).alias("upper")).limit(0), single
    paths, tops = _paths(large, high)
    return paths.withColumnRenamed("pos", "b").withColumnRenamed("path", "upper"), single.unionByName(tops)


def _with_upper(blocks: DataFrame, above: DataFrame) -> DataFrame:
    return blocks.join(hinted(above), ["g", "b"], "left").withColumn("upper", F.coalesce("upper", F.array().cast(_PATH)))


def _paths(nodes: DataFrame, high: int) -> tuple[DataFrame, DataFrame]:
    """(g, pos, path) of every node of (g, n, pos, h), and (g, top) of every tree; the number of tiers is logarithmic."""
    blocks = _blocks(nodes, high)
    above, tops = _above(blocks, high)
    own = _with_upper(blocks, above).withColumn("own", _udf(_block_paths, f"array<{_PATH}>", 2, high)("items.h", "n"))
    each = own.select("g", "upper", F.explode(F.arrays_zip(F.col("items.pos").alias("pos"), "own")).alias("x"))
    return cut(each.select("g", F.col("x.pos").alias("pos"), F.concat("x.own", "upper").alias("path"))), tops


def manifest(df: DataFrame, leaf_hash: Column, changed: Column, id_col: str = "doc_id", group_col: str = "source", high: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    `leaf_hash` is the row's digest and `changed` that of the row as it is found now, null where nothing is known of it. In a
    group, leaves ascend by id, a null one first, then by digest (rows equal in both are interchangeable); groups ascend
    bytewise, null first. Rows of equal content are leaves of their own. A group of one leaf has it as its root, and a dataset of
    one group that group's. Blocks have `high` levels. An empty table has no rows. Only digests, ids and groups travel, whatever else the table holds.
    """
    rows = df.select(F.col(group_col).alias("s"), F.col(id_col).alias("id"), leaf_hash.alias("h"), changed.alias("t"))
    placed = cut(global_index(rows, "s", "id", "h", "t"))
    groups = cut(placed.groupBy("s").agg(F.min("index").alias("g"), F.count("*").alias("n")))
    placed = placed.join(hinted(groups.withColumnRenamed("s", "_s")), F.col("s").eqNullSafe(F.col("_s")))
    blocks = _blocks(placed.select("g", "n", (F.col("index") - F.col("g")).alias("pos"), "h", "t", "id"), high, "t", "id")
    above, tops = _above(blocks, high)
    tops = cut(tops)
    # The trees of groups are the leaves of the last one; a group's g is its first place, so it has their order.
    last = global_index(tops, "g")
    count = tops.count()
    paths, root = _paths(last.select(F.lit(0).cast("bigint").alias("g"), F.lit(count).cast("bigint").alias("n"), F.col("index").alias("pos"), F.col("top").alias("h")), high)
    shared = last.select("g", F.col("top").alias("subroot"), F.col("index").alias("pos")).join(hinted(paths.select("pos", "path")), "pos").drop("pos")
    top = root.select("top").first()  # one value
    whole = _with_upper(blocks, above).drop("top").join(hinted(cut(shared)), "g")
    whole = whole.withColumn("proofs", _udf(_proofs, _PROOF, 4, high)("items.h", "items.t", "n", F.concat("upper", "path")))
    each = whole.select("subroot", F.explode(F.arrays_zip("items", "proofs")).alias("x"))
    root_hash = F.lit(top.top if top else None).cast("string")
    out = each.select(
        F.col("x.items.id").alias("id"), F.col("x.items.h").alias("leaf"), "subroot", root_hash.alias("root"),
        F.col("x.proofs.proof").alias("proof_sha256"), F.col("x.proofs.folded").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

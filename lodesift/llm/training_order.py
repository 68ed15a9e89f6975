"""Token ids as binary shards in training order.

Texts are encoded and packed into sequences of a fixed number of tokens. A keyed Feistel permutation with cycle-walking
gives each of the N sequences its slot in 0..N-1, and ranges of slots are written as shards of fixed stride, so that
training reads them in order and resumes at any slot by arithmetic.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.bpe import codec, default_path
from lodesift.llm.common import hinted, shared_dir, slices, tidy

#: Tokens of a sequence, the id after each text and in what is left over, and slots of a shard.
LENGTH, END, SLOTS = 2_048, 50_256, 4_096
#: Ends a record of a shard; two bytes keep 16-bit ids aligned.
MARK = "\n\n"
#: Parts in which shards are written, so that what is on the way takes little disk.
PARTS = 4
_ROUNDS, _STEPS = 6, 128


def permuted(index: Column, n: int, key: int) -> Column:
    """The slot of each index below `n`: a bijection on 0..n-1 chosen by `key`.

    The network works on the smallest power of two at or above n (4 at least), less than twice n; a value of n or more is permuted
    again until it falls below. Each step leaves half of the values at most, so 128 steps are as good as never too few; a value
    that they do leave is an error, not a slot.
    """
    bits = max(2, (n - 1).bit_length())
    high, low = bits // 2, bits - bits // 2

    def rounds(x: Column, k: int = 0) -> Column:
        if k == _ROUNDS:
            return x
        a, b = (high, low) if k % 2 == 0 else (low, high)
        left, right = F.shiftrightunsigned(x, b), x.bitwiseAND((1 << b) - 1)
        new = left.bitwiseXOR(F.xxhash64(right, F.lit(key).cast("bigint"), F.lit(k)).bitwiseAND((1 << a) - 1))
        return F.transform(F.array(F.shiftleft(right, a).bitwiseOR(new)), lambda y: rounds(y, k + 1))[0]

    steps = F.sequence(F.lit(1), F.lit(_STEPS))
    left = F.aggregate(steps, rounds(index.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.transform(F.array(left), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle-walking did not end")).cast("bigint")))[0]


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Writes and returns (part, no, n_tokens, ids, tokens): the sequences of each input partition, packed in its order.

    A text is followed by `end`; the last sequence of a partition is filled up with it and tells its `n_tokens`. `ids`
    are the rows that a sequence has tokens of. A null text has no tokens but its `end`. Ids of tokens are 16-bit
    numbers, low byte first; a vocabulary with more ids is an error. A sequence's number, and so its slot, follows from the order of
    the rows in the input's partitions: reruns agree over the same files with the same settings of splits.
    """
    tokenizer = tokenizer or default_path()
    if codec(tokenizer).width != "H" or not 0 <= end < 1 << 16:
        raise ValueError("token ids must be below 65,536")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["part", "no", "n_tokens", "ids", "tokens"]

    def each(batches):
        part, no, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0
        id_type = None
        for b in (*slices(batches), None):
            out = []
            if b is not None:
                id_type = b.column(0).type
                for name, coded in zip(b.column(0), codec(tokenizer).encode_all(b.column(1))):
                    tokens = np.append(coded.astype("<u2"), np.array([end], "<u2"))
                    at = 0
                    while at < len(tokens):
                        take = tokens[at : at + length - n]
                        held.append(take)
                        ids.append(name.as_py())
                        n, at = n + len(take), at + len(take)
                        if n == length:
                            out.append((no, n, ids, b"".join(x.tobytes() for x in held)))
                            no, held, ids, n = no + 1, [], [], 0
            elif n:
                rest = np.full(length - n, end, "<u2")
                out.append((no, n, ids, b"".join(x.tobytes() for x in (*held, rest))))
            if out:
                at, size, lists, raw = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(lists, pa.list_(id_type)), pa.array(raw, pa.binary())], names=names)

    packed = rows.mapInArrow(each, f"part int, no bigint, n_tokens int, ids array<{kind}>, tokens binary")
    packed.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def slotted(packed: DataFrame, key: int, slots: int = SLOTS, length: int = LENGTH) -> tuple[DataFrame, int]:
    """`packed` with slot, shard and byte_offset, and the number of sequences."""
    counts = packed.groupBy("part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each input partition.
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    n = packed.count()
    rows = packed.join(hinted(starts), "part").withColumn("slot", permuted(F.col("start") + F.col("no"), max(n, 1), key))
    stride = 2 * length + len(MARK)
    rows = rows.withColumn("shard", F.expr(f"cast(slot div {slots} as int)")).withColumn("byte_offset", F.col("slot") % slots * stride)
    return rows.drop("start"), n


def write(rows: DataFrame, n: int, path: str, slots: int = SLOTS, parts: int = PARTS) -> None:
    """Writes each shard as one file `shard=<k>/part-*.txt` of fixed-stride records in slot order.

    Slots are dealt to partitions by range, one shard each, so that a task holds one shard whatever the input's size. Spark's own
    writer commits the files, so that a lost task leaves no half shard. Shards are written in `parts` ranges; the shuffle
    files of a range are removed before the next begins.
    """
    spark, shards = rows.sparkSession, -(-n // slots)
    each = max(1, -(-shards // parts))
    with tidy(spark):
        for first in range(0, shards, each):
            some = rows.where(F.col("shard").between(first, first + each - 1)).select("shard", "slot", F.col("tokens").cast("string").alias("value"))
            some = some.repartitionById(each, F.col("shard") - first).sortWithinPartitions("shard", "slot")
            some.drop("slot").write.mode("append").partitionBy("shard").option("lineSep", MARK).text(path)


def read(raw: bytes, length: int = LENGTH, first: int = 0) -> np.ndarray:
    """The sequences of a shard's bytes from record `first` on, shape (records, length)."""
    stride = length + len(MARK) // 2
    return np.frombuffer(raw, "<u2", offset=2 * stride * first).reshape(-1, stride)[:, :length]


def digests(spark, path: str, slots: int = SLOTS, length: int = LENGTH) -> DataFrame:
    """(slot, crc) of each record that lies in the shards: the CRC-32 of its token bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    files = files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint").alias("shard"), "content")

    def each(batches):
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1)):
                found = [zlib.crc32(x.tobytes()) for x in read(raw.as_py(), length)]
                slot = np.arange(len(found)) + shard * slots
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(found, pa.int64())], names=["slot", "crc"])

    return files.mapInArrow(each, "slot bigint, crc bigint")


def materialise(df: DataFrame, path: str | None = None, key: int = 20_240_229, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END, slots: int = SLOTS) -> DataFrame:
    """Writes the shards of `df` under `path` and returns (slot, shard, byte_offset, n_tokens, ids, crc) of each sequence.

    Without a path they go to a new folder of the shared one. An empty table writes nothing. Repeated rows are encoded
    as often as they come. `crc` is read from the shards.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    rows, n = slotted(pack(df, f"{path}/packed", id_col, text_col, tokenizer, length, end), key, slots, length)
    index = rows.select("slot", "shard", "byte_offset", "n_tokens", F.array_distinct("ids").alias("ids"))
    if not n:
        return index.withColumn("crc", F.lit(None).cast("bigint"))
    write(rows, n, f"{path}/shards", slots)
    return index.join(digests(spark, f"{path}/shards", slots, length), "slot")

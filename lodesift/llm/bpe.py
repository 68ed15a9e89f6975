"""Byte-pair encoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so a text may be cut there and its
fragments encoded on their own. The cuts used are those that the word splitting before the merges can't feel either:
before ASCII white space, or after another ASCII character unless an apostrophe follows (which could start a
contraction). Every such cut is made. A fragment is encoded on its own and held for its next places, and the ids of a text are those of
its fragments one after another.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import per_text

#: Distinct fragments whose ids a worker holds at a time, some 30 MB; with more, the held ones are dropped and made again where they recur.
_HELD = 131_072


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Fragments(dict):
    """The ids of the fragments that a worker has met, as bytes of numbers."""

    def __init__(self, encoded):
        self.encoded = encoded

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= _HELD:
            self.clear()
        found = self[raw] = self.encoded(raw)
        return found


class Codec:
    """A byte-level tokenizer file with its forced boundaries."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        flags = any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word", "normalized"))
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or flags:
            raise ValueError(f"{path}: not a byte-level tokenizer of plain added tokens, to which these boundaries apply")
        added = {t["id"]: t["content"] for t in spec.get("added_tokens", ())}
        byte_of, pairs = _byte_of_letter(), np.zeros((256, 256), bool)
        self.pieces = {i: t.encode() for i, t in added.items()}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if i not in added:
                raw = bytes(byte_of[c] for c in token)
                self.pieces[i] = raw
                ranks[raw] = i
                for a, b in zip(raw, raw[1:]):
                    pairs[a, b] = True
        space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        word = (np.arange(256) < 128) & ~space & ~np.isin(np.arange(256), [28, 29, 30, 31])
        quote = np.arange(256) == ord("'")
        safe = space[None, :] | (word[:, None] & ~quote[None, :])
        self.cuts = (safe & ~pairs).ravel()
        self.added = {t: i for i, t in added.items()}
        # Of the added tokens that a text writes out, the leftmost counts, and there the longest.
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.width = "H" if max(self.pieces) < 1 << 16 else "i"
        made = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [bytes(byte_of[c] for c in a + b) for a, b in made]
        self.ordinary = self._ordinary(ranks, made)

    @cached_property
    def model(self):
        """The tokenizers library with the same file, opened only where it is needed."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        return model

    def _ordinary(self, ranks: dict[bytes, int], made: list[bytes]):
        """What encodes a fragment: merging by rank where ids are in the order of the merges, else the library itself."""
        if sorted(ranks.values()) == list(range(len(ranks))) and [ranks.get(m) for m in made] == list(range(256, len(ranks))):
            import tiktoken
            from public_tokenizers import PATTERN

            held = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            # ASCII letters, after a blank or none, are one word to the splitting before the merges, which is then left out.
            return lambda raw: held._encode_single_piece(raw) if (raw[1:] if raw[:1] == b" " else raw).isalpha() else held.encode_ordinary(raw.decode())
        return lambda raw: self.model.encode(raw.decode(), add_special_tokens=False).ids

    def fragments(self, raw: bytes) -> list[bytes]:
        """UTF-8 bytes cut at every forced boundary."""
        b = np.frombuffer(raw, np.uint8).astype(np.uint16)
        marks = (np.flatnonzero(self.cuts[(b[:-1] << 8) | b[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *marks], [*marks, len(raw)])]

    @cached_property
    def held(self) -> Fragments:
        return Fragments(lambda raw: array(self.width, self.ordinary(raw)).tobytes())

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids; added tokens written out in the text count as those tokens."""
        of, parts = self.held.__getitem__, self.marks.split(text or "") if self.marks else [text or ""]
        found = [array(self.width, [self.added[x]]).tobytes() if i % 2 else b"".join(map(of, self.fragments(x.encode()))) for i, x in enumerate(parts)]
        return np.frombuffer(b"".join(found), self.width)

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow array."""
        return [self.encode(t.as_py()) for t in texts]

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; ids outside the vocabulary add nothing, as in the library."""
        return b"".join(map(self.pieces.get, ids, [b""] * len(ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)))


def _open(path: str, each):
    """What `per_text` opens: `each` over the codec; there is nothing to close."""

    def make():
        held = codec(path)
        return lambda column: each(held, column), lambda: None

    return make


def _decoded(held: Codec, ids) -> pa.Array:
    return pa.array([held.decode(x) for x in ids], pa.string())


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`df` with the token ids of its text, as the tokenizers library gives them without special tokens added.

    A null text has no ids, like an empty one. Added tokens written out in a text count as those tokens. A column named
    `ids_col` is replaced; all others stay as they are, whatever their names and types, as only the text is sent to Python.
    Rows are independent: repeated rows are encoded as often as they come, an empty table gives an empty one.
    """
    run = per_text(_open(path or default_path(), lambda held, texts: _lists(held.encode_all(texts))), "array<int>")
    return df.withColumn(ids_col, run(F.col(text_col).cast("string")))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`df` with the text of its token ids; null ids count as none, bytes that are no UTF-8 become U+FFFD."""
    run = per_text(_open(path or default_path(), lambda held, ids: _decoded(held, [x.values.to_pylist() if x.is_valid else [] for x in ids])), "string")
    return df.withColumn(text_col, run(F.col(ids_col).cast("array<int>")))


def recode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`encode` and then `decode` in one pass, so that a task has one worker and one codec."""

    def both(held: Codec, texts) -> pa.Array:
        found = held.encode_all(texts)
        return pa.StructArray.from_arrays([_lists(found), _decoded(held, [x.tolist() for x in found])], names=["ids", "decoded"])

    run = per_text(_open(path or default_path(), both), "ids array<int>, decoded string")
    held = df.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text")).select("row", run("text").alias("coded"))
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in (ids_col.lower(), decoded_col.lower())]
    return held.select(*own, F.col("coded.ids").alias(ids_col), F.col("coded.decoded").alias(decoded_col))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, decoded again, and both hashed.

    The ids are hashed as decimal numbers joined by commas. One pass; ids and texts stay in their task.
    """

    def each(held: Codec, texts) -> pa.Array:
        found = []
        for x in held.encode_all(texts):
            ids = x.tolist()
            text = held.decode(ids).encode()
            found.append((len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text).hexdigest()))
        n, a, d = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    run = per_text(_open(path or default_path(), each), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return df.select(F.col(id_col).alias("id"), run(F.col(text_col).cast("string")).alias("d")).select("id", "d.*")

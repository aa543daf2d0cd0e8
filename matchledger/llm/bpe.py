"""BPE encoding and decoding (operator 6).

``encode`` adds the ids of a text, ``decode`` the text of ids; both run the merges themselves. A word's
symbols stand in a doubly linked list, and a heap holds the pairs that can merge by rank and place; an entry
whose symbols have changed meanwhile is stale and is skipped. Decoding concatenates vocabulary strings.

Null or empty text: no ids, and an empty string comes back. Rows, ties and repeats are kept as they are; other
columns pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Encoded words that a worker remembers; then it forgets them all and starts again.
REMEMBERED = 600_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for
    itself, the other bytes for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Merges and vocabulary of one file, with the words met lately."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.special = special
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left, self.right, self.made = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]
        self.rank = {a << 32 | b: rank for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.chunks = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self.apart = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(special, key=len, reverse=True))).split if special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. An entry of the heap is one number: rank, then place."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        rank, left, right, push, pop = self.rank.get, self.left, self.right, heapq.heappush, heapq.heappop
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            x = pop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if ids[i] != left[r] or j >= n or ids[j] != right[r]:
                continue  # stale
            made = ids[i] = self.made[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(made << 32 | ids[k])) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 32 | made)) is not None:
                push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def chunk(self, text: str) -> tuple[int, ...]:
        merge = self.merge
        if text.isalpha() or (text[0] == " " and text[1:].isalpha()):  # one piece, as the pattern takes letters together
            return tuple(merge(text.encode()))
        return tuple(chain.from_iterable(merge(p.encode()) for p in self.pieces(text)))

    def ordinary(self, text: str) -> Iterator[tuple[int, ...]]:
        known, out = self.known, []
        for c in self.chunks(text):
            ids = known.get(c)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.chunk(c)
                if len(c) <= 64:
                    known[c] = ids
            out.append(ids)
        return chain.from_iterable(out)

    def encode(self, text: str) -> list[int]:
        if self.apart is None or not any(t in text for t in self.special):
            return list(self.ordinary(text))
        out: list[int] = []
        for part in self.apart(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self.ordinary(part))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add a column of ids (array<int>)."""
    path = path or vocabulary_path()
    schema = _with(df.schema, ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, text):
            got = pa.array([own.encode(t or "") for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([got if f.name == ids else batch.column(f.name) for f in schema], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of a column of ids; null ids give an empty text, and broken UTF-8 gives U+FFFD."""
    path = path or vocabulary_path()
    schema = _with(df.schema, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            got = pa.array([own.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([got if f.name == text else batch.column(f.name) for f in schema], schema.names)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, then decoded from the ids, in
    one pass, so that no ids leave the worker."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        name = own.text_of.__getitem__
        for batch in slices(batches):
            counts, coded, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))

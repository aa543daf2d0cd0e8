"""Harmonic packing of token sequences (operator 2).

Lengths fall into classes by reciprocal capacity: a class with count k takes lengths in (C/(k+1), C/k], and each
of its bins gets exactly k documents, so that no bin needs a search. Each worker fills the bins of all classes by
itself, in one pass without a shuffle.

Documents may be cut. Whole capacities go first, and the rest of a document, shorter than C, stays in one piece in a bin of
its class. k pieces leave at most C/(k+1) of a bin free; the start of the next document fills that, so that full bins hold
no padding. At its end a worker cuts the pieces of its bins that aren't full into powers of two and lays them in falling
order, which leaves at most log2(C) sequences shorter than C, each as long as a power of two.

A null or empty text is one piece with the end id alone. Rows with equal ids are separate documents; a null
doc_id stays null; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_path
from .common import slices, table

CAPACITY = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of texts, equal to those of the tokenizers library. Where the vocabulary of a byte-level file numbers its tokens in
    the order of their merges, they serve as ranks for tiktoken, which merges faster; other files, and a text that it
    fails on, go to the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ranked = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["pre_tokenizer"]["type"] == "ByteLevel" and made == list(range(256, 256 + len(made))):
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> np.ndarray:
        (coded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded.ids, "<u4")

    def of(self, text: str) -> np.ndarray:
        if self.ranked is None:
            return self.whole(text)
        try:
            return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except (ValueError, RuntimeError):
            return self.whole(text)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


class Bins:
    """The open bins of one worker. A piece is (document, start, length, ids, document's length)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.waiting: list[tuple] = []  # a bin with all its documents, and room for the start of another one
        self.room = 0
        self.done: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length, ids, total in pieces:
            self.done.append((doc, start, length, zlib.crc32(ids), total, self.next_id, offset))
            offset += length
        self.next_id += 1

    def put(self, piece: tuple) -> None:
        """Lay a piece shorter than the capacity into its class."""
        k = self.capacity // piece[2]
        bin_ = self.open[k]
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            room = self.capacity - sum(p[2] for p in bin_)
            if room:
                self.waiting, self.room = bin_, room
            else:
                self.close(bin_)

    def add(self, doc, ids: bytes) -> None:
        """Cut a document and lay down its pieces."""
        total = len(ids) // 4
        at = min(self.room, total)
        if at:
            self.waiting.append((doc, 0, at, ids[: 4 * at], total))
            self.room -= at
            if not self.room:
                self.close(self.waiting)
                self.waiting = []
        while total - at >= self.capacity:
            self.close([(doc, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        if at < total:
            self.put((doc, at, total - at, ids[4 * at :], total))

    def finish(self) -> None:
        """Empty the open bins without padding."""
        left = [p for pieces in (*self.open.values(), self.waiting) for p in pieces]
        self.open.clear()
        self.waiting, self.room = [], 0
        parts = []
        for doc, start, length, ids, total in left:
            at = 0
            while at < length:
                n = 1 << ((length - at).bit_length() - 1)
                parts.append((doc, start + at, n, ids[4 * at : 4 * (at + n)], total))
                at += n
        parts.sort(key=lambda p: -p[2])
        held, room = [], sum(p[2] for p in parts)
        size = self.capacity
        for p in parts:
            if not held:
                while size > room:
                    size //= 2
            held.append(p)
            room -= p[2]
            if sum(x[2] for x in held) == size:
                self.close(held)
                held = []

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece (see PIECES). capacity is a power of two; sequence ids are unique, and carry the number of the
    task that filled the sequence in their upper bits."""
    path = path or vocabulary_path()
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = [c.split()[0] for c in PIECES.split(", ")]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*bins.take(), strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                bins.add(doc, own.of(text or "").tobytes() + end)
            yield rows()
        bins.finish()
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

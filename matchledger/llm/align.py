"""Cross-tokenizer alignment (operator 12): two tokenizers' cuts of the same bytes, laid side by side.

A text's tokens by A (a byte-level BPE) and B (a sentencepiece model) each end at a byte offset. One merge of the two rising lists of
ends inside mapInPandas cuts the text where both end (groups), and every stretch between neighbouring ends of either belongs to one token
of A and one of B that overlap there (links). A pair of ids counts the documents that hold it linked; Spark's groupBy sums the
counts that tasks have gathered, the highest count of each A id is joined to them, and both go back to the documents.

On the way back a document's distinct pairs are cut into ``BUCKETS`` parts by hash, packed as arrays, and each part travels to the
task that reads the counts of its bucket, several tasks a bucket: no pair or token, however common, makes a task larger than others, a
task holds the counts of one bucket at a time, and documents stream past them. Only sums come back.

Texts null, empty, or whose joined token bytes by A or B differ from space + text have no tokens: zeros, and an empty digest. Rows are kept
as they are, repeated doc_ids and texts too (each row is a document when pairs are counted); an empty table gives no rows. Very
long texts are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .common import mix64, slices, staged, table
from .packing import Tokens

#: Parts of all pairs by hash (a task holds the counts of one: |A| * |B| / BUCKETS at most), and tasks a part at least.
BUCKETS, SPREAD = 64, 4
#: Distinct pairs that a task gathers before it hands its counts on.
GATHERED = 2_000_000

_BASE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class Ordinary(Tokens):
    """Ids of texts in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True

    def of(self, text: str) -> np.ndarray:
        if self.ranked is None:
            return self.whole(text)
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        except (ValueError, RuntimeError):
            return self.whole(text)


@lru_cache(maxsize=2)
def pieces(path: str):
    """A sentencepiece model and the bytes of its ids: a piece in UTF-8 with the space mark as a space, a byte piece as its byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def digits(n: int, marks: str) -> np.ndarray:
    """For each mark in turn, the decimals of 0..n-1 with it behind them, padded with zero bytes."""
    width = len(str(max(n - 1, 0))) + 1
    return np.array([f"{i}{mark}".encode() for mark in marks for i in range(n)], f"S{width}")


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, (self.b, self.b_bytes) = Ordinary(a_path), pieces(b_path)
        known = codec(a_path).bytes_of
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        if len(self.a_bytes) * self.width >= 1 << 32:
            raise ValueError("pairs of these vocabularies don't fit 32 bits")
        # a token's digits with what follows it: a comma inside a group, else the mark that closes its side
        self.a_names, self.b_names = digits(len(self.a_bytes), ",|"), digits(self.width, ",;")
        kind = np.result_type(self.a_names, self.b_names)
        self.a_names, self.b_names = self.a_names.astype(kind), self.b_names.astype(kind)

    def cuts(self, text: str | None):
        """(A ids, B ids, A ends, B ends), or None for a text without tokens."""
        if not text:
            return None
        whole = b" " + text.encode()
        a = self.a.of(" " + text)
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole:
            return None
        b = np.array(b, np.int64)
        a = a.astype(np.int64)
        return a, b, np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])

    def of(self, text: str | None):
        """(n_a, n_b, n_groups, n_links, digest, distinct pairs, how often each): ends merged in order, tokens without bytes left out of
        the links."""
        got = self.cuts(text)
        if got is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        a, b, a_ends, b_ends = got
        at = np.searchsorted(b_ends, a_ends)
        common = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends
        shared = a_ends[common]
        ends = np.sort(np.concatenate([a_ends, b_ends[~np.isin(b_ends, shared, assume_unique=True)]]), kind="stable")
        linked = a[np.searchsorted(a_ends, ends)] * self.width + b[np.searchsorted(b_ends, ends)]
        pairs, times = np.unique(linked.astype(np.uint32), return_counts=True)
        return len(a), len(b), len(shared), len(ends), self.digest(a, b, a_ends, b_ends, shared), pairs, times.astype(np.uint32)

    def digest(self, a, b, a_ends, b_ends, shared) -> str:
        """Lowercase hex of ``a1,a2|b1;a3|b2,b3``."""
        a_stops, b_stops = np.searchsorted(a_ends, shared) + 1, np.searchsorted(b_ends, shared) + 1
        words = np.empty(len(a) + len(b), self.a_names.dtype)
        for ids, names, stops, size, before in ((a, self.a_names, a_stops, len(self.a_bytes), b_stops - np.diff(b_stops, prepend=0)), (b, self.b_names, b_stops, self.width, a_stops)):
            codes = ids.copy()
            codes[stops - 1] += size
            words[np.arange(len(ids)) + np.repeat(before, np.diff(stops, prepend=0))] = names[codes]
        flat = words.view(np.uint8)
        return hashlib.sha256(flat[flat != 0][:-1].tobytes()).hexdigest()


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The figures of each row that need no other, with its distinct pairs (uint32: A id * size of B + B id) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = aligner(a_path, b_path), [x.split()[0] for x in _BASE.split(", ")]
        for batch in slices(batches, most=1 << 21):
            done = [own.of(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array([d[i] for d in done], pa.int64()) for i in range(4)), pa.array([d[4] for d in done], pa.string())]
            columns += [pa.array([d[i].astype("<u4").tobytes() for d in done], pa.binary()) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BASE)


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, numbers) of a column of packed uint32."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.diff(offsets) // 4, np.frombuffer(flat.tobytes(), "<u4")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the documents that hold them, summed within the task as far as GATHERED allows."""
    pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def merged():
        keys, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (pairs[:0], counts[:0])
        both = np.concatenate([pairs, keys])
        out, at = np.unique(both, return_inverse=True)
        return out, np.bincount(at, np.concatenate([counts, n]), len(out)).astype(np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    held = 0
    for batch in batches:
        waiting.append(_arrays(batch.column("pairs"))[1])
        held += len(waiting[-1])
        if held > GATHERED:
            pairs, counts = merged()
            waiting, held = [], 0
            if len(pairs) > GATHERED:
                yield rows()
                pairs, counts = pairs[:0], counts[:0]
    pairs, counts = merged()
    yield rows()


def pair_counts(base: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, n, best): how many rows hold a pair linked, and whether no pair of its A id is in more."""
    counted = base.select("pairs").mapInArrow(_gather, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = staged(counted.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n"), "pair_counts")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _bucket(pairs: np.ndarray) -> np.ndarray:
    return (mix64(pairs.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch], spread: int) -> Iterator[pa.RecordBatch]:
    """Cut the pairs of each row into buckets: a packed array for each bucket that it has pairs in, rows of a slice together."""
    for batch in slices(batches, "pairs", 1 << 22):
        sizes, pairs = _arrays(batch.column("pairs"))
        times = _arrays(batch.column("times"))[1]
        row = np.repeat(batch.column("row").to_numpy(), sizes)
        order = np.argsort(_bucket(pairs), kind="stable")
        bucket, row, pairs, times = _bucket(pairs)[order], row[order], pairs[order], times[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = {"bucket": [], "spread": [], "rows": [], "pairs": [], "times": []}
        for lo, hi in zip(cuts.tolist(), [*cuts.tolist()[1:], len(bucket)], strict=True):
            out["bucket"].append(int(bucket[lo]))
            out["spread"].append(int(row[lo] >> 7 ^ row[lo]) % spread)
            runs = lo + np.flatnonzero(np.diff(row[lo:hi], prepend=row[lo] - 1))
            out["rows"].append(np.concatenate([row[runs], np.diff(runs, append=hi)]).astype("<i8").tobytes())
            out["pairs"].append(pairs[lo:hi].astype("<u4").tobytes())
            out["times"].append(times[lo:hi].astype("<u4").tobytes())
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds, strict=True)], list(out))


def _pack_counts(batches: Iterator[pa.RecordBatch], spread: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs as packed arrays, one a bucket and batch, for each of its tasks."""
    for batch in batches:
        pairs, n, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        bucket = _bucket(pairs)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out = []
        for part in np.split(order, cuts[1:]) if len(order) else []:
            packed = (np.zeros(0).tobytes(), pairs[part].astype("<u4").tobytes(), (n[part] * 2 + best[part]).astype("<i8").tobytes())
            out += [(int(bucket[part[0]]), k, *packed) for k in range(spread)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "spread", "rows", "pairs", "times"])


def _meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, n_best, count_sum) of every part. A bucket's counts come before its parts and are sorted when the first part arrives."""
    key, waiting, known, counts = None, [], None, None
    for frame in frames:
        out = []
        for bucket, spread, kind, rows, pairs, times in zip(*(frame[c] for c in ("bucket", "spread", "kind", "rows", "pairs", "times")), strict=True):
            if (bucket, spread) != key:
                key, waiting, known = (bucket, spread), [], None
            if kind == 0:
                waiting.append((np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<i8")))
                continue
            if known is None:
                known, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
                order = np.argsort(known)
                known, counts, waiting = known[order], counts[order], []
            ids, sizes = np.frombuffer(rows, "<i8").reshape(2, -1)
            found = counts[np.searchsorted(known, np.frombuffer(pairs, "<u4"))]
            times = np.frombuffer(times, "<u4").astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            out.append((ids, np.add.reduceat(times * (found & 1), starts), np.add.reduceat(times * (found >> 1), starts)))
        if out:
            yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("row", "n_best", "count_sum"), zip(*out, strict=True), strict=True)})


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and the figures of every row's two tokenisations."""
    a_path, b_path = a_path or vocabulary_path(), b_path or vocabulary_path("piece_bpe_32k.model")
    base = staged(aligned(docs, a_path, b_path), "aligned")
    counts = pair_counts(base, len(pieces(b_path)[1]))
    kinds = "bucket long, spread long, rows binary, pairs binary, times binary"
    spread = max(SPREAD, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    parts = base.filter("n_links > 0").select("row", "pairs", "times").mapInArrow(lambda x: _deal(x, spread), kinds).withColumn("kind", F.lit(1))
    both = counts.select("pair", "n", "best").mapInArrow(lambda x: _pack_counts(x, spread), kinds).withColumn("kind", F.lit(0)).unionByName(parts)
    met = both.repartition("bucket", "spread").sortWithinPartitions("bucket", "spread", "kind").mapInPandas(_meet, "row long, n_best long, count_sum long")
    sums = met.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    kept = base.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))

"""Suffix-array dedup (operator 7): longest previous factors over the repeated parts of a corpus.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts earlier: in a document of smaller doc_id, or
earlier in the same one. Strings are judged on the input, and overlaps count.

No suffix array of the whole corpus is sorted. A window (``LENGTH`` bytes) owns the least hash among its ``GRAM``-byte
strings; neighbouring windows with the same least hash form a run. Equal windows have equal least hashes, so only runs
whose hash occurs twice can hold repeats. A run that may repeat inside itself (periodic text) loses its own repeats first,
by longest previous factors within it. Of the others, runs equal as a whole (by 95 bits of hashes and their length) leave
their first and go entirely; what is left to compare are the first runs of those hashes that have several different ones.
Their bytes are sorted into suffix arrays, many hashes to a batch; for each suffix the previous and next smaller
positions in suffix order are the earlier suffixes nearest to it, and the longer of the matches with them is its longest
previous factor. Different runs of one hash with more than ``CROWDED`` bytes together are too much for one task: their
windows are spread by 128-bit hashes instead, which give the same answer through partial minima and a join.

Null text counts as empty. Texts shorter than ``LENGTH`` bytes lose nothing; a text longer than a slice is read in
overlapping segments. A document is known by doc_id, 64 bits of a hash of its text, and its length: rows with equal doc_id
and different texts are separate documents, in the order of these, and a row that repeats doc_id and text gets the result
of the first. Rows without doc_id come first, each text by itself. Other columns are ignored, and an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUES, SLICE_BYTES, mix64, powers, slices, staged, table, texts

LENGTH = 100
GRAM = 32
#: Bytes of the different runs of one hash that go to one task.
CROWDED = 1 << 20
#: Bytes of runs that a worker sorts at once.
SORTED = 256 << 10
_PRIME = (1 << 31) - 1
_PRIME_BASE = 1_103_515_245
_PRIME_VALUES = BYTE_VALUES % np.uint64(_PRIME)


def _slide(a: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``size`` values."""
    have = 1
    while 2 * have <= size:
        a = pick(a[:-have], a[have:])
        have *= 2
    rest = size - have
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def runs(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, window after the last, least hash, whether it may repeat inside), as places in data."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    n = len(data)
    if n < length:
        return empty
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    grams = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    span = length - gram + 1
    least = _slide(grams, span, np.minimum)  # least[p]: of the window that starts at p
    sizes = np.diff(offsets)
    has = np.maximum(sizes - length + 1, 0)
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(has)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long] + has[long], -1)
    valid = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    begin = valid.copy()
    begin[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begin[offsets[long]] = True
    first = np.flatnonzero(begin)
    if not len(first):
        return empty
    doc = np.searchsorted(offsets, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], n), offsets[doc] + has[doc])
    # A run that holds its least hash twice can repeat inside itself: some neighbours among the chosen grams are equal.
    chosen = np.flatnonzero(grams[span - 1 : len(least)] == _slide(least, span, np.maximum)) + span - 1 if len(least) >= span else np.zeros(0, np.int64)
    edge = np.concatenate([np.arange(min(span - 1, len(grams))), chosen, np.arange(max(len(least), span - 1), len(grams))])
    values = grams[edge]
    order = np.lexsort((edge, values))
    values, edge = values[order], edge[order]
    twice = edge[1:][(values[1:] == values[:-1]) & (np.diff(edge) <= span)]
    marks = np.zeros(len(grams) + 1, np.int64)
    np.add.at(marks, twice + 1, 1)
    marks = np.cumsum(marks)
    inner = marks[np.minimum(stop - 1 + span, len(grams))] > marks[first]
    return doc, first, stop, least[first], inner


def _prime_powers(n: int, base: int) -> np.ndarray:
    """base**i modulo the prime for i < n."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, _PRIME))
        part = out[have : 2 * have]
        part[:] = out[: len(part)] * step % np.uint64(_PRIME)
        have *= 2
    return out


def contents(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of two different hashes of data[first:end]."""
    n, prime = len(data), np.uint64(_PRIME)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    one = mix64((sums[end] - sums[first]) * down[first])
    np.cumsum(_PRIME_VALUES[data] * _prime_powers(n, _PRIME_BASE) % prime, out=sums[1:])
    back = _prime_powers(n + 1, pow(_PRIME_BASE, -1, _PRIME))[first]
    return one, (sums[end] - sums[first]) % prime * back % prime


def suffix_levels(data: np.ndarray, bounds: np.ndarray, group: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 7, 14, 28, ... bytes, the last of them by all. Row i is data[bounds[i]:bounds[i + 1]], and
    a suffix ends with its row; of two with one more byte, the shorter comes first. With groups, suffixes of different ones
    have different ranks."""
    n = len(data)
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(n)
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(8)) | np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
    ranks = np.unique(key, return_inverse=True)[1].astype(np.int64)
    if group is not None:
        ranks = np.unique((np.repeat(group, sizes).astype(np.int64) << 32) | ranks, return_inverse=True)[1]
    have, levels = 7, [(7, ranks.astype(np.int32))]
    longest = int(sizes.max(initial=0))
    while have < longest:
        second = np.zeros(n, np.int64)
        more = np.flatnonzero(left > have)
        second[more] = ranks[more + have] + 1
        names, ranks = np.unique((ranks << 32) | second, return_inverse=True)
        have *= 2
        levels.append((have, ranks.astype(np.int32)))
        if len(names) == n:
            break
    return levels


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, or -1. Values are different and not negative."""
    own = np.concatenate([[-1], values])
    near = np.arange(len(own)) - 1
    up = np.arange(1, len(own))
    for _ in range(12):  # most are found by following what is known of their neighbours
        up = up[own[near[up]] > own[up]]
        if not len(up):
            return near[1:] - 1
        near[up] = near[near[up]]
    minima = [own]  # the others climb a tree of minima, and go down again where one is smaller
    while len(minima[-1]) > 1:
        m = minima[-1]
        if len(m) % 2:
            m = minima[-1] = np.append(m, np.iinfo(m.dtype).max)
        minima.append(np.minimum(m[::2], m[1::2]))
    value, at = own[up], up.copy()
    level, node = np.full(len(up), -1), np.zeros(len(up), np.int64)
    for k in range(len(minima) - 1):
        hit = np.flatnonzero((level < 0) & (at % 2 == 1) & (minima[k][at - 1] < value))
        level[hit], node[hit] = k, at[hit] - 1
        at //= 2
    for k in range(len(minima) - 2, 0, -1):
        down = np.flatnonzero(level >= k)
        right = 2 * node[down] + 1
        node[down] = np.where(minima[k - 1][right] < value[down], right, right - 1)
    near[up] = node
    return near[1:] - 1


def previous_factors(data: np.ndarray, bounds: np.ndarray, length: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, factors): the places with ``length`` bytes of their row after them, and for each the length of its longest match
    with an earlier one of them (within its group)."""
    levels = suffix_levels(data, bounds, group)
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(data))
    starts = np.flatnonzero(left >= length)
    order = np.argsort(levels[-1][1][starts], kind="stable")
    before = nearest_smaller(order)  # previous and next smaller position in suffix order
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    out = np.zeros(len(starts), np.int64)
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < len(order)))
        one, two = starts[order[has]], starts[order[near[has]]]
        same = np.zeros(len(has), np.int64)
        live = np.arange(len(has))
        for size, ranks in reversed(levels):
            i, j = one[live] + same[live], two[live] + same[live]
            agree = ranks[i] == ranks[j]
            same[live] += np.where(agree, np.minimum(size, left[i]), 0)
            live = live[(left[one[live]] > same[live]) & (left[two[live]] > same[live])]
        for _ in range(6):  # less than 7 bytes are left to compare
            live = live[data[one[live] + same[live]] == data[two[live] + same[live]]]
            same[live] += 1
            live = live[(left[one[live]] > same[live]) & (left[two[live]] > same[live])]
        if group is not None:
            rows = np.searchsorted(bounds, np.stack([one, two]), side="right") - 1
            same[group[rows[0]] != group[rows[1]]] = 0
        np.maximum.at(out, order[has], same)
    return starts, out


def _pieces(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the stretches of neighbouring numbers in a rising array, as indexes."""
    first = np.flatnonzero(np.diff(kept, prepend=-2) != 1)
    return first, np.append(first[1:], len(kept))


def apart(data: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs that may repeat inside themselves, cut: (run, first, stop, whether its windows occur earlier in the run)."""
    out: list[tuple] = []
    k = 0
    while k < len(first):
        size = np.cumsum(stop[k:] - first[k:] + length - 1)
        m = k + max(1, int(np.searchsorted(size, SORTED, side="right")))
        sizes = stop[k:m] - first[k:m] + length - 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        joined = np.concatenate([data[i : j + length - 1] for i, j in zip(first[k:m], stop[k:m], strict=True)])
        starts, factors = previous_factors(joined, bounds, length, np.arange(m - k))
        for gone in (False, True):
            own = starts[(factors >= length) == gone]
            row = np.searchsorted(bounds, own, side="right") - 1
            a, b = _pieces(own + row)  # windows of two rows never stand next to each other
            r = row[a]
            begin = first[k:m][r] + own[a] - bounds[r]
            out.append((k + r, begin, begin + b - a, np.full(len(a), gone)))
        k = m
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


RUNS = "h long, c long, d int, doc_id long, tie long, size int, at int, n int, gone boolean"
OWN = ("doc_id", "tie", "size")


def _runs(docs: DataFrame, length: int, gram: int, only_hash: bool) -> DataFrame:
    """Runs of all windows; in those that are gone, every window occurs earlier in its run."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches):
            offsets, data = texts(batch.column("text"))
            for base in range(0, max(len(data), 1), SLICE_BYTES) if batch.num_rows == 1 else (0,):
                part = data[base : base + SLICE_BYTES + length - 1] if batch.num_rows == 1 else data
                yield batch, (np.array([0, len(part)]) if batch.num_rows == 1 else offsets), part, base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, data, base in segments(batches):
            with np.errstate(over="ignore"):
                doc, first, stop, key, inner = runs(offsets, data, length, gram)
                if only_hash:  # one that may repeat inside counts twice
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, key[inner]]).view(np.int64))], ["h"])
                    continue
                gone = np.zeros(len(first), bool)
                if inner.any():
                    which = np.flatnonzero(inner)
                    r, begin, end, gone = apart(data, first[which], stop[which], length)
                    plain = ~inner
                    doc, key = (np.concatenate([x[plain], x[which][r]]) for x in (doc, key))
                    first, stop = np.concatenate([first[plain], begin]), np.concatenate([stop[plain], end])
                    gone = np.concatenate([np.zeros(int(plain.sum()), bool), gone])
                c, d = contents(data, first, stop + length - 1) if len(first) else (key, key)
            took = pa.array(doc)
            columns = [pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d.astype(np.int32)), *(batch.column(x).take(took) for x in OWN)]
            columns += [pa.array(first - offsets[doc] + base, pa.int32()), pa.array(stop - first, pa.int32()), pa.array(gone)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "d", *OWN, "at", "n", "gone"])

    return docs.mapInArrow(run, "h long" if only_hash else RUNS)


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, tie, size, text, wanted) to one row per wanted run, with its bytes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["h", *OWN, "at", "n", "crowded", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, tie, size, text, wanted in zip(*(batch.column(c).to_pylist() for c in (*OWN, "text", "wanted")), strict=True):
                data = text.encode()
                out.extend((w["h"], doc, tie, size, w["at"], w["n"], w["crowded"], data[w["at"] : w["at"] + w["n"] + length - 1]) for w in wanted)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return joined.mapInArrow(run, "h long, doc_id long, tie long, size int, at int, n int, crowded boolean, bytes binary")


SPANS = "doc_id long, tie long, size int, at int, n int"


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Covered spans, from suffix arrays over batches of whole hashes. Rows come grouped by h."""

    def batch_spans(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: ((r[1] is not None, r[1] or 0), *r[2:5]))  # a place in the batch tells what is earlier
        base = np.concatenate([[0], np.cumsum([len(r[6]) for r in rows])])
        starts, factors = previous_factors(np.frombuffer(b"".join(r[6] for r in rows), np.uint8), base, length)
        found = starts[factors >= length]
        row = np.searchsorted(base, found, side="right") - 1
        first, stop = _pieces(found + row)
        own = row[first].tolist()
        at = np.array([rows[i][4] for i in own], np.int64) + found[first] - base[row[first]]
        columns = [pa.array([rows[i][k] for i in own], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int32()), pa.array(stop - first + length - 1, pa.int32())], [*OWN, "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("h", *OWN, "at", "n", "bytes")), strict=True):
                if held > SORTED and r[0] != rows[-1][0]:
                    yield batch_spans(rows)
                    rows, held = [], 0
                rows.append((*r[:5], r[5], r[6]))
                held += len(r[6])
        if rows:
            yield batch_spans(rows)

    grouped = contexts.select("h", *OWN, "at", "n", "bytes").repartition("h").sortWithinPartitions("h")
    return grouped.mapInArrow(run, SPANS)


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """Covered spans of crowded hashes: their windows, by 128 bits of their content."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            for doc, tie, size, at, n, data in zip(*(batch.column(c).to_pylist() for c in (*OWN, "at", "n", "bytes")), strict=True):
                for k in range(0, n, 1 << 14):
                    many = min(n - k, 1 << 14)
                    digests = b"".join(hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(k, k + many))
                    w = np.frombuffer(digests, np.int64).reshape(many, 2)
                    columns = [w[:, 0], w[:, 1], [doc] * many, [tie] * many, [size] * many, at + k + np.arange(many)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["w1", "w2", *OWN, "at"])

    each = contexts.mapInArrow(run, "w1 long, w2 long, doc_id long, tie long, size int, at int")
    place = F.struct(*OWN, "at")
    firsts = each.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("many")).filter("many > 1")
    later = each.join(firsts, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select(*OWN, "at", F.lit(length).alias("n"))


def _key(text) -> list:
    """What tells texts of one doc_id apart."""
    return [F.xxhash64(text).alias("tie"), F.octet_length(text).alias("size")]


def _numbered(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", *_key("text"), "text")


def _same(docs: DataFrame, spans: DataFrame):
    """Join condition of documents and rows about them."""
    return docs["doc_id"].eqNullSafe(spans["_sa_doc"]) & (docs["tie"] == spans["_sa_tie"]) & (docs["size"] == spans["_sa_size"])


_NAMES = {"doc_id": "_sa_doc", "tie": "_sa_tie", "size": "_sa_size"}


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, tie, size, at, n): stretches of bytes that earlier strings cover; they may overlap."""
    docs = _numbered(docs)
    twice = staged(_runs(docs, length, gram, True).groupBy("h").count().filter("count > 1").select("h"), "hashes")
    met = staged(_runs(docs, length, gram, False).join(twice, "h"), "runs")
    place, same = F.struct(*OWN, "at"), ["h", "c", "d", "n"]
    wide = (F.col("n") + length - 1).alias("n")
    inside = met.filter("gone").select(*OWN, "at", wide)
    met = met.filter("NOT gone")
    firsts = staged(met.groupBy(*same).agg(F.min(place).alias("first")), "firsts")
    whole = met.join(firsts, same).filter(~place.eqNullSafe(F.col("first"))).select(*OWN, "at", wide)
    several = firsts.groupBy("h").agg(F.count("*").alias("many"), F.sum(F.col("n").cast("long") + length - 1).alias("bytes")).filter("many > 1")
    open_ = firsts.join(several, "h").select("first.*", F.struct("h", "first.at", "n", (F.col("bytes") > crowded).alias("crowded")).alias("w"))
    wanted = open_.groupBy(*OWN).agg(F.collect_list("w").alias("wanted")).withColumnsRenamed(_NAMES)
    joined = docs.join(wanted, _same(docs, wanted)).select(*OWN, "text", "wanted")
    contexts = staged(_contexts(joined, length).dropDuplicates(["h", *OWN, "at"]), "contexts")
    found = _compare(contexts.filter("NOT crowded"), length).union(_windows(contexts.filter("crowded"), length))
    return staged(inside.union(whole).union(found), "spans")


def _cut(joined: DataFrame) -> DataFrame:
    """Rows (doc_id, text, found) to the digest columns and the bytes kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, gone, counts, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found"), strict=True):
                data = text.encode()
                sizes.append(len(data))
                if not found.is_valid or not len(found):
                    gone.append(0)
                    counts.append(0)
                    kept.append(data)
                    continue
                part = found.values.flatten()
                at, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in part)
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + n, -1)
                covered = np.cumsum(edges[:-1]) > 0
                gone.append(int(covered.sum()))
                counts.append(int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept, for every row."""
    found = spans(docs, length, gram, crowded).groupBy(*OWN).agg(F.collect_list(F.struct("at", "n")).alias("found")).withColumnsRenamed(_NAMES)
    docs = _numbered(docs)
    joined = docs.join(found, _same(docs, found), "left")
    return _cut(joined.select("doc_id", "text", "found"))


def deduped(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with their texts reduced, all columns as they were. Bytes of a character that was cut go with it; a text
    that nothing is left of goes as a whole. Null and empty texts stay."""
    found = spans(docs, length).groupBy(*OWN).agg(F.collect_list(F.struct("at", "n")).alias("_sa_found")).withColumnsRenamed(_NAMES)
    tie, size = _key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_sa_doc"]) & (tie == found["_sa_tie"]) & (size == found["_sa_size"]), "left")
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, keep = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_sa_found").to_pylist(), strict=True):
                if gone:
                    data = np.frombuffer(text.encode(), np.uint8)
                    left = np.ones(len(data), bool)
                    for g in gone:
                        left[g["at"] : g["at"] + g["n"]] = False
                    text = data[left].tobytes().decode("utf-8", "ignore")
                out.append(text)
                keep.append(not gone or bool(text.strip()))
            arrays = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep, pa.bool_()))

    return joined.select(*names, "_sa_found").mapInArrow(run, schema)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_strings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""MinHash near-dedup (operator 9): one-permutation hashing, densification, banded buckets, star edges.

A text's words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; its set holds the distinct runs of ``shingle``
words, or, with fewer words, the whole sequence as one. One pass hashes each shingle once: the hash's upper bits
name one of ``BINS`` bins, which keeps its least hash, and an empty bin takes the value of a full one that a
random sequence of its own visits first (optimal densification). Runs of ``ROWS`` bins are the bands.

Texts with equal sets fold into one set first, by a 128-bit fingerprint. In a bucket every member
is paired with the bucket's smallest only, so a bucket of n gives n - 1 pairs. Pairs are confirmed on full sets.
Further rounds look at buckets whose members are still in different components: ``CENTRES`` random members become the
bucket's centres, drawn alike in all buckets, and members of other components are held against them. The
share of similar pairs tells how many a set still has in the largest bucket; rounds end when these are ``FEW`` or less. An exact
join then finishes what is left: the sets of all buckets that still hold several components meet on their rarest
shingles (prefix and length filters, the exact bound for each pair), parity bitmaps drop pairs that differ too much, and
the rest is confirmed on full sets. So every similar pair that shares a bucket is found or in one component. At a
similarity of 0.8 two sets miss all 32 bands with a probability of 5e-8.

Null text counts as empty; a text without words has an empty set and is linked with nothing, as is a row
without doc_id (component_id null, kept true). Rows that repeat a doc_id share its component, and the sets of their texts are all
held against others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices, staged, table, texts, words
from .graphs import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
THRESHOLD = 0.8
#: Centres of a bucket in each further round.
CENTRES = 3
#: Similar sets of other components that a set may still have in the largest bucket, by the last round's share, when the exact join takes over.
FEW = 20
#: Upper bits of a shingle's hash that name its counter in the order of rarity; any order gives the same pairs.
SLOT_BITS = 20
#: Rows of one shingle that meet in one task; of a hot shingle, parts of so many rows meet each other.
HOT = 1000


def shingles(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the shingles of text i are hashes[bounds[i]:bounds[i + 1]], repeats included."""
    docs, hashes, _ = words(offsets, data)
    n = len(offsets) - 1
    counts = np.bincount(docs, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    joined = hashes.copy()
    odd = np.uint64(0x9E3779B97F4A7C15)
    m = len(hashes)
    length = np.minimum(counts, size)[docs]  # words in the shingle that starts at this word
    place = np.arange(m) - first[docs]
    valid = place + length <= counts[docs]
    for j in range(1, size):
        more = np.flatnonzero(valid & (length > j))
        joined[more] = mix64(joined[more] * odd + hashes[more + j])
    joined = mix64(joined + length.astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(docs[valid], minlength=n))])
    return bounds, joined[valid]


def densify(sketch: np.ndarray, full: np.ndarray) -> None:
    """Fill the empty bins of each row that has a full one."""
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    bins, attempt = np.arange(BINS, dtype=np.uint64), 0
    filled = full[rows]
    had = filled.copy()
    while len(rows):
        attempt += 1
        source = (mix64(bins * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        take = ~filled & had[:, source]
        r, b = np.nonzero(take)
        sketch[rows[r], b] = sketch[rows[r], source[b]]
        filled |= take
        rest = ~filled.all(axis=1)
        if not rest.all():
            rows, filled, had = rows[rest], filled[rest], had[rest]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a fingerprint of the set (k1, k2) and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            with np.errstate(over="ignore"):
                bounds, hashes = shingles(*texts(batch.column("text")), shingle)
                n = batch.num_rows
                counts, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sketch, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
                for i in np.flatnonzero(np.diff(bounds)):
                    own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                    counts[i] = len(own)
                    k1[i], k2[i] = mix64(own).sum(dtype=np.uint64), mix64(own ^ np.uint64(0xABCDEF0123456789)).sum(dtype=np.uint64)
                    bins = (own >> np.uint64(57)).astype(np.int64)
                    lead = np.flatnonzero(np.diff(bins, prepend=-1))
                    sketch[i, bins[lead]], full[i, bins[lead]] = own[lead], True
                densify(sketch, full)
                bands = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r::ROWS])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(counts), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), rows], ["doc_id", "t", "n_shingles", "k1", "k2", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n_shingles long, k1 long, k2 long, bands array<long>")


def similar(pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Of rows (u, v, a, b) with two texts, the (u, v) whose full sets are similar enough."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a"):
            with np.errstate(over="ignore"):
                sides = [shingles(*texts(batch.column(c)), shingle) for c in "ab"]
            keep = []
            for i in range(batch.num_rows):
                one, two = (np.unique(h[s[i] : s[i + 1]]) for s, h in sides)
                both = len(one) + len(two)
                common = both - len(np.unique(np.concatenate([one, two])))
                keep.append(100 * common >= percent * (both - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "u long, v long")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches):
        with np.errstate(over="ignore"):
            bounds, hashes = shingles(*texts(batch.column("text")), shingle)
        yield batch, [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(batch.num_rows)]


def rarity(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each counter occur: what reaches the driver is one row a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for _, sets in _sets(batches, shingle):
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots])], ["slot", "k"])

    summed = docs.select("text").mapInArrow(run, "slot int, k long").groupBy("slot").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[summed.column("slot").to_numpy()] = summed.column("k").to_numpy()
    return out


def unlike(one: bytes, two: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has, from their parity bitmaps."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (one, two)), key=len)
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def prefixes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rep, c and n of each set with its rarest shingles, at their places, and a bitmap of the parity of its shingles. The
    longer set of a similar pair has a common shingle among these, the shorter one among those marked brief."""
    order = docs.sparkSession.sparkContext.broadcast(rarity(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, shingle):
            rows, bits = [], []
            for own in sets:
                n = len(own)
                rare = own[np.lexsort((own, order.value[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))]
                brief = n + (-2 * percent * n) // (100 + percent)
                rows.append([{"h": h, "place": i, "brief": i <= brief} for i, h in enumerate(rare[: n + (-percent * n) // 100 + 1].view(np.int64).tolist())])
                wide = max(256, 1 << (2 * n - 1).bit_length())
                odd = np.bincount((mix64(own) & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
                bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            kind = pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int32()), ("brief", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "c", "n")), pa.array(rows, kind), pa.array(bits, pa.binary())], ["rep", "c", "n", "rare", "bits"])

    return docs.mapInArrow(run, "rep long, c long, n int, rare array<struct<h long, place int, brief boolean>>, bits binary")


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different components whose sizes, rarest shingles and bitmaps allow a similarity of so many percent."""
    rows = sets.select("rep", "c", "n", F.inline("rare"))
    of = rows.groupBy("h", "c").agg(F.count("*").alias("k"), F.count_if("brief").alias("b")).groupBy("h")
    shared = of.agg(F.max_by("c", "k").alias("main"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.count("*").alias("kinds")).filter("kinds > 1 AND b > 0")
    cut = lambda k: F.ceil(F.col(k) / HOT).cast("int")
    rows = staged(rows.join(shared.select("h", "main", cut("k").alias("longs"), cut("b").alias("briefs")), "h"), "rare")
    own = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
    each = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    main = F.col("c") == F.col("main")
    # The largest component of a shingle meets the others in a lane of its own, and never itself.
    one = rows.filter("brief").select("h", main.cast("int").alias("lane"), own("briefs").alias("i"), F.explode(each("longs")).alias("j"), F.struct("rep", "c", "n", "place").alias("x"))
    two = rows.select("*", F.explode(F.when(main, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("lane"))
    two = two.select("h", "lane", F.explode(each("briefs")).alias("i"), own("longs").alias("j"), F.struct("rep", "c", "n", "place").alias("y"))
    fits = (
        "x.c != y.c AND (x.n < y.n OR x.n = y.n AND x.rep < y.rep) AND 100L * x.n >= {p}L * y.n "
        "AND least(x.n - x.place, y.n - y.place) >= ({p} * (0L + x.n + y.n) + 99 + {p}) div (100 + {p})"
    ).format(p=percent)
    pairs = one.join(two, ["h", "lane", "i", "j"]).filter(fits).select(F.greatest("x.rep", "y.rep").alias("u"), F.least("x.rep", "y.rep").alias("v")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "p"):
            n, p, q = batch.column("both").to_pylist(), batch.column("p").to_pylist(), batch.column("q").to_pylist()
            most = [b - 2 * -(-percent * b // (100 + percent)) for b in n]
            keep = [unlike(a, b) <= m for a, b, m in zip(p, q, most, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("rep").alias(k), F.col("n").alias(m), F.col("bits").alias(b)) for k, m, b in (("u", "n", "p"), ("v", "m", "q")))
    sides = pairs.join(left, "u").join(right, "v").select("u", "v", (F.col("n") + F.col("m")).cast("long").alias("both"), "p", "q")
    return sides.mapInArrow(run, "u long, v long")


def same_ids(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) that link the sets of each doc_id that has several, as a star."""
    key = F.struct("k1", "k2")
    several = signed.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo < hi").select("doc_id")
    reps = signed.join(several, "doc_id").select("doc_id", "k1", "k2").distinct().join(sets.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("v"))
    return reps.join(least, "doc_id").filter("rep > v").select(F.col("rep").alias("u"), "v")


def groups(docs: DataFrame, shingle: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row. Each different set has a number of its own (rep), by which it goes through the rounds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(signatures(docs, shingle), "signed")
    worded = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = worded.groupBy("k1", "k2").agg(F.min_by(F.struct("n_shingles", "bands", "doc_id", "t"), F.struct("doc_id", "t")).alias("s"))
    sets = sets.select("k1", "k2", "s.doc_id", "s.t", F.col("s.n_shingles").cast("int").alias("n"), "s.bands")
    # numbered in the order of doc_id: the first text of a group is often the one that the others were made from, and so the best centre
    sets = sets.repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t").withColumn("rep", F.monotonically_increasing_id())
    sets = staged(sets, "sets")
    each = sets.select(F.posexplode("bands").alias("band", "hash"), "rep", "n")
    shared = each.groupBy("band", "hash").agg(F.count("*").alias("c"), F.min("rep").alias("centre"), F.min_by("n", "rep").alias("m")).filter("c > 1").drop("c")
    members = staged(each.join(shared, ["band", "hash"]), "members")

    def close(n, m):
        return F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - 1e-9

    held = sets.join(members.select("rep").distinct(), "rep").select("rep", "doc_id", "t")
    held = staged(docs.withColumn("t", F.xxhash64("text")).join(held, ["doc_id", "t"]).select("rep", "text").dropDuplicates(["rep"]), "held")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(held.select(F.col("rep").alias("u"), F.col("text").alias("a")), "u").join(held.select(F.col("rep").alias("v"), F.col("text").alias("b")), "v")
        return similar(sides.select("u", "v", "a", "b"), shingle, threshold)

    tested = staged(members.filter((F.col("rep") != F.col("centre")) & close(F.col("n"), F.col("m"))).select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct(), "pairs")
    links = components(staged(confirmed(tested).union(same_ids(worded, sets)), "found"))
    turn = 0
    while True:
        turn += 1
        named = members.select("band", "hash", "rep", "n").join(links.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        picks = [F.min_by(F.struct("rep", "n", "c"), F.xxhash64("rep", F.lit(turn), F.lit(i))) for i in range(CENTRES)]
        split = named.groupBy("band", "hash").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.array_distinct(F.array(*picks)).alias("picks")).filter("low < high").select("band", "hash", "size", "picks")
        members = staged(named.join(split, ["band", "hash"]), "members")  # buckets of one component stay out from now on
        each = members.groupBy("rep", "n", "c").agg(F.array_distinct(F.flatten(F.collect_set("picks"))).alias("picks"))
        far = each.withColumn("x", F.explode(F.filter("picks", lambda x: (F.col("c") != x["c"]) & close(F.col("n"), x["n"]))))
        fresh = far.select(F.greatest("rep", "x.rep").alias("u"), F.least("rep", "x.rep").alias("v")).distinct()
        fresh = staged(fresh.join(tested, ["u", "v"], "left_anti"), "pairs")
        found = staged(confirmed(fresh), "found")
        tested = tested.union(fresh)
        if found.count() * (members.agg(F.max("size")).first()[0] or 0) <= FEW * fresh.count():
            break
        links = components(links.union(found))
    percent = round(threshold * 100)
    rest = members.select("rep", "n", "c").distinct()
    rest = staged(prefixes(held.join(rest, "rep").select("rep", "c", "n", "text"), shingle, percent), "rest")
    fresh = staged(candidates(rest, percent).join(tested, ["u", "v"], "left_anti"), "pairs")
    found = staged(confirmed(fresh).union(found), "found")  # with the last round's
    if not found.isEmpty():
        links = components(links.union(found))
    named = sets.select("k1", "k2", "rep", "doc_id").join(links.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("least"))  # the smallest doc_id of a component
    named = named.join(least, "c").select("k1", "k2", F.col("least").alias("c"))
    alone = F.col("n_shingles") == 0
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("c")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), shingle=2)

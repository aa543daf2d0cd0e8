"""Phrase collocation mining by Suffix-sigma (operator 11).

A text, A-Z lower-cased, is cut into pieces at punctuation and line ends, and pieces into words. Every word starts a suffix of its piece,
truncated to ``max_n`` words. Tasks count equal suffixes of a slice and send each once, to the partition of its language and first word. There
suffixes are sorted in falling order, so that longer ones come before their own beginnings, and one stack counts all prefixes in a single
pass: an entry a depth, closed when a suffix no longer shares it. Sorting is Spark's (it spills), the stack holds ``max_n`` entries, and
runs inside a batch are summed as arrays. A first word's suffixes are dealt over ``SPREAD`` partitions by the second word, so that a word that
starts a third of all suffixes makes no task large: counts of two words and more are whole in one task, those of single words are summed
afterwards.

Candidates are phrases of 2 to max_n words that occur min_count times. Their parts occur at least as often, so only counts from min_count on
are kept, and each candidate meets the counts of its parts by joins. Scores are exact (decimals of 38 digits: counts up to 10**15).

Null texts are empty, a null language is ``und``, repeated rows count each, ties go by count and then by the phrase's UTF-8 bytes; an empty
table gives no rows. Very long texts are counted whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BYTE_VALUES, mix64, powers, slices, staged, table, texts

MAX_N, MIN_COUNT, TOP = 3, 10, 2000
#: Partitions that a first word's suffixes are dealt over.
SPREAD = 16
#: Bytes of text whose suffixes are counted together before they are sent.
SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, their texts, their pieces) of a slice."""
    data = _LOWER[data]
    cut, inside = _CUT[data], ~(_GAP[data] | _CUT[data])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[1:-1]
    at = at[at < len(data)]
    begins[at] |= inside[at]
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(cut)[starts] + doc  # rises where a cut or another text lies between two words
    compact = np.cumsum(inside, dtype=np.int64)
    bounds = np.concatenate([compact[starts] - 1, compact[-1:]]) if len(starts) else np.zeros(1, np.int64)
    held = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    return words, doc, piece


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; it places words only, and never stands for them."""
    offsets, data = _flat(words)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]])


def _suffixes(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    """(place, suffix, n): the different suffixes of each slice. A suffix is language, then words, joined by tabs, which no word
    holds; bytes below the tab are lifted above it, so that order by bytes is order by words."""
    for batch in slices(batches, most=SLICE):
        offsets, data = texts(batch.column("text"))
        words, doc, piece = _words(offsets, data)
        if not len(words):
            continue
        coded = words.dictionary_encode()
        known, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lang = batch.column("lang").cast(pa.large_binary()).dictionary_encode()
        langs, lang = lang.dictionary, lang.indices.to_numpy()[doc].astype(np.int64)
        size = len(known) + 1
        columns = [ids + 1]  # 0: the piece has ended
        for k in range(1, max_n):
            following = np.zeros(len(ids), np.int64)
            following[:-k] = np.where(piece[k:] == piece[:-k], ids[k:] + 1, 0) if k < len(ids) else following[:-k]
            columns.append(following)
        code, width = lang, max(len(langs), 1)
        for c in columns:
            if width > (1 << 62) // size:
                seen, code = np.unique(code, return_inverse=True)
                width = len(seen)
            code, width = code * size + c, width * size
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        lifted, lang_names = _lifted(known), _lifted(langs)
        second = columns[1][first] if max_n > 1 else np.zeros(len(first), np.int64)
        hashes = np.concatenate([np.zeros(1, np.uint64), _hashes(known)])
        place = mix64(_hashes(langs)[lang[first]] ^ mix64(hashes[columns[0][first]] + hashes[second] % np.uint64(SPREAD)))
        parts = [lang_names.take(pa.array(lang[first]))] + [lifted.take(pa.array(np.where(c[first] > 0, c[first] - 1, 0), mask=c[first] == 0)) for c in columns]
        suffix = pc.binary_join_element_wise(*parts, pa.scalar(b"\t", pa.large_binary()), null_handling="skip")
        yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(33)).astype(np.int32)), suffix.cast(pa.binary()), pa.array(n.astype(np.int64))], ["place", "suffix", "n"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_binary column without nulls."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _lifted(words: pa.Array) -> pa.Array:
    """Words with bytes 0 to 9 and 11 as 11 and that byte + 48, and the empty one as 11 alone: all their bytes are above the tab."""
    offsets, data = _flat(words)
    if not ((data < 12) & (data != 10)).any() and (np.diff(offsets) > 0).all():
        return words
    lifts = {b: bytes([11, b + 48]) for b in (*range(10), 11)}
    return pa.array([b"".join(lifts.get(b, bytes([b])) for b in w) or b"\x0b" for w in words.to_pylist()], pa.large_binary())


def _lowered(lifted: bytes) -> bytes:
    """What ``_lifted`` made from it, where words stand with spaces between them."""
    first, *rest = lifted.split(b"\x0b")
    return first + b"".join(bytes([p[0] - 48]) + p[1:] if p else b"" for p in rest)


def _between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of some bytes from starts to ends, in rising order, as an array that shares them."""
    bounds = np.append(np.column_stack([starts, ends]).ravel(), len(data))
    return pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).take(pa.array(np.arange(len(starts)) * 2))


class Stack:
    """The prefixes of the suffix read last, each with the count of the suffixes that shared it: an entry for its language (depth 0) and for
    each of its words. ``push`` reads suffixes in falling order and closes the entries that the next suffix doesn't share."""

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.last: bytes | None = None
        self.counts = np.zeros(max_n + 1, np.int64)

    def push(self, suffixes: pa.Array, n: np.ndarray, final: bool = False) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
        """(depth, languages, phrases, counts) of the prefixes that close; with ``final`` all of them do. Runs that open and
        close inside the batch are summed without a step a row."""
        if self.last is not None:  # the open suffix, so that what follows is held against it
            suffixes, n = pa.concat_arrays([pa.array([self.last], pa.large_binary()), suffixes]), np.append(0, n)
        if not len(suffixes):
            return
        offsets, data = _flat(suffixes)
        offsets, data = np.ascontiguousarray(offsets), np.ascontiguousarray(data)
        tabs = np.flatnonzero(data == 9)
        row = np.searchsorted(offsets, tabs, side="right") - 1
        depth = np.bincount(row, minlength=len(suffixes))
        ends = np.tile(offsets[1:], (self.max_n + 1, 1))  # of the prefix of each depth
        ends[np.arange(len(tabs)) - np.repeat(np.cumsum(depth) - depth, depth), row] = tabs
        spaced = np.where(data == 9, np.uint8(32), data)
        sums = np.append(0, np.cumsum(n))
        fresh = np.ones(len(suffixes), bool)  # rows that don't share the prefix of this depth with the row before
        for d in range(self.max_n + 1):
            has = depth >= d
            prefix = _between(data, offsets[:-1], ends[d])
            same = pc.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False) & has[1:] & has[:-1]
            fresh[1:] = (fresh[1:] | ~same) if d else ~same
            at = np.flatnonzero(fresh)
            counts = np.diff(sums[np.append(at, len(suffixes))])
            if self.last is not None:
                counts[0] += self.counts[d]
            keep = has[at]
            if not final:
                self.counts[d] = counts[-1] if keep[-1] else 0
                keep[-1] = False
            at, counts = at[keep], counts[keep]
            begin = np.minimum(ends[0][at] + 1, ends[d][at])
            yield d, _between(data, offsets[at], ends[0][at]), _between(spaced, begin, ends[d][at]), counts
        self.last = suffixes[-1].as_py()


def _counted(batches: Iterator[pa.RecordBatch], max_n: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, f) of all prefixes of one partition's sorted suffixes: those of two words and more that occur
    min_count times; those of one word, and of none (all words of a language), in part."""
    stack = Stack(max_n)

    def rows(closed):
        for d, langs, phrases, f in closed:
            if d > 1:
                often = pa.array(f >= min_count)
                langs, phrases, f = langs.filter(often), phrases.filter(often), f[f >= min_count]
            if not len(f):
                continue
            if any((_flat(x)[1] == 11).any() for x in (langs, phrases)):
                langs, phrases = (pa.array([_lowered(x) for x in c.to_pylist()], pa.large_binary()) for c in (langs, phrases))
            columns = [langs.cast(pa.binary()), phrases.cast(pa.binary()), pa.array(np.full(len(f), d, np.int32)), pa.array(f)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "f"])

    for batch in batches:
        yield from rows(stack.push(batch.column("suffix").cast(pa.large_binary()), batch.column("n").to_numpy()))
    yield from rows(stack.push(pa.array([], pa.large_binary()), np.zeros(0, np.int64), final=True))


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f): phrases of 1 to max_n words with at least min_count occurrences; the empty phrase has the
    number of all words of its language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    sent = rows.mapInArrow(lambda x: _suffixes(x, max_n), "place int, suffix binary, n long")
    falling = sent.repartition("place").select("suffix", "n").sortWithinPartitions(F.desc("suffix"))
    closed = falling.mapInArrow(lambda x: _counted(x, max_n, min_count), "lang binary, phrase binary, words int, f long")
    whole = closed.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("words") == 0))
    return whole.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "words", "f")


def _scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every candidate, by its lowest-scoring cut."""
    part = lambda name: counts.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias(name))
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    met = cuts.withColumn("part", F.expr("substring_index(phrase, ' ', k)")).join(part("l"), ["lang", "part"])
    met = met.withColumn("part", F.expr("substring_index(phrase, ' ', k - words)")).join(part("r"), ["lang", "part"])
    whole = lambda c: f"cast({c} AS decimal(15, 0))"
    score = F.expr(f"(cast(1000000 AS decimal(7, 0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    best = met.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def _inner(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer candidate that holds the phrase's words side by side."""
    words = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    held = counts.filter("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f")
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    counts = staged(phrase_counts(docs, max_n, min_count), "phrase_counts")
    kept = _scored(counts).join(_inner(counts), ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (SELECT lang, d, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p
                FROM (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(
                        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]') AS ps FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT lang, d, p, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT lang, d, p, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces)),
runs AS (SELECT lang, w1, lead(w1) OVER w AS w2, lead(w1, 2) OVER w AS w3 FROM worded WINDOW w AS (PARTITION BY d, p ORDER BY i)),
grams AS (SELECT lang, 1 AS n, w1 AS phrase FROM runs UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
          UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, n AS words, phrase, lang || '|' || phrase AS key, count(*) AS f FROM grams GROUP BY ALL),
parts AS MATERIALIZED (SELECT key, f FROM counts WHERE f >= 10),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE words > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.words, c.f AS a, k, lang || '|' || array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS head,
                lang || '|' || array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS tail FROM candidates c, unnest(range(1, CAST(words AS BIGINT))) AS u(k)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cuts JOIN parts x ON x.key = head JOIN parts y ON y.key = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, max(f) AS longer FROM (
           SELECT lang, f, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase FROM candidates WHERE words = 3
           UNION ALL SELECT lang, f, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM candidates WHERE words = 3) GROUP BY lang, phrase),
kept AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
         FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""

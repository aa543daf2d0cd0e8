"""LM scoring with a hidden Markov model (operator 1).

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Counts of all training tokens are summed
over the cluster. A state emits a class: each of the ``CLASSES`` most frequent words and the end are classes of their
own, and other words fall into ``ENDINGS`` classes by their last three bytes; within such a class a word has the
probability (c + 0.5) / (n + 0.5 * (v + 1)), with the class's n tokens and v words in training. So every text has one
exact probability, and what a state must hold is bounded, however many words the corpus has.

Baum-Welch runs over all training texts: each task sums its expected counts in numpy, Spark sums those of the tasks by
class, and the driver gets one row for each class and state. For training, texts are cut into stretches of ``STRETCH``
tokens; scoring runs the scaled forward recursion over whole texts. Counts of up to ``LOOKUP`` of the most frequent words go to
the tasks as a table of that size; those of all other words meet their texts in a join.

Null text counts as empty: one end token. A row without doc_id is scored and counts as training. Repeated rows are
scored each by itself. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table

STATES = 8
ROUNDS = 8
CLASSES = 8192
ENDINGS = 4096
LOOKUP = 65536
STRETCH = 256
LANES = 1024
#: Expected counts start from this many tokens of the corpus's own distribution of classes.
PRIOR = 20.0


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # on bytes, lower() and split() know ASCII only


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(tokens(text))
            if len(counts) > 500_000:
                yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(vocabulary: DataFrame) -> list[tuple[str, int]]:
    """Up to LOOKUP words with their counts, most frequent first. Steps of 2**(1/64) in the count decide how far
    down the words go, so that no task sends more of them than are wanted in all."""
    step = F.floor(F.log2("c") * 64)
    sizes = sorted(((r[0], r[1]) for r in vocabulary.groupBy(step).count().collect()), reverse=True)  # at most 4096 rows
    total, least = 0, None
    for level, n in sizes:
        total += n
        if total > LOOKUP:
            break
        least = level
    if least is None:  # too many words of the largest count: the first by name
        return [tuple(r) for r in vocabulary.orderBy(F.desc("c"), "word").limit(LOOKUP).collect()]
    return sorted((tuple(r) for r in vocabulary.filter(step >= least).collect()), key=lambda r: (-r[1], r[0].encode()))


class Lexicon:
    """What tasks know of words: classes and counts of frequent ones, and sums of the classes by ending."""

    def __init__(self, frequent: list[tuple[str, int]], classes: list[tuple[int, int, int]], end: int):
        self.end_class = CLASSES
        self.size = CLASSES + 1 + ENDINGS
        sums = np.zeros((ENDINGS, 2))
        for k, n, v in classes:
            sums[k] = n, v
        own = frequent[:CLASSES]
        self.within = np.concatenate([np.zeros(CLASSES + 1), np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1))])  # denominators
        self.share = np.zeros(self.size)
        self.share[: len(own)] = [c for _, c in own]
        self.share[self.end_class] = end
        self.share[CLASSES + 1 :] = sums[:, 0]
        self.share = (self.share + 0.5) / (self.share + 0.5).sum()
        self.number = {w.encode(): i for i, (w, _) in enumerate(frequent)}
        self.code = np.array([i if i < CLASSES else CLASSES + 1 + ending(w.encode()) for i, (w, _) in enumerate(frequent)], np.int64)
        self.value = np.log10(np.array([c for _, c in frequent], np.float64) + 0.5)
        self.more = np.where(self.code > CLASSES, self.value - self.within[self.code], 0.0)  # beside the class's probability
        self.end = math.log10(end + 0.5), int(end > 0)


CODED = "row long, doc_id long, held_out boolean, n_tokens long, codes binary, known long, base double, inside double, rare array<struct<word:string,n:int>>"


def encode(docs: DataFrame, lexicon) -> DataFrame:
    """Texts as 16-bit classes, with the sums that need no join, and the words that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        get, stop = lex.number.get, lex.end_class.to_bytes(2, "little")
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            rare_words: list[bytes] = []
            rare_counts: list[int] = []
            bounds = [0]
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                off = np.flatnonzero(found < 0)
                rare = Counter(words[i] for i in off.tolist())
                code = {w: CLASSES + 1 + ending(w) for w in rare}
                codes = np.empty(len(words), "<u2")
                known = found[found >= 0]
                codes[found >= 0] = lex.code[known]
                codes[off] = own = np.fromiter((code[words[i]] for i in off.tolist()), np.int64, len(off))
                inside = lex.more[known].sum() - lex.within[own].sum()
                for column, x in zip(columns, (len(words) + 1, codes.tobytes() + stop, len(known) + lex.end[1], lex.value[known].sum() + lex.end[0], inside), strict=True):
                    column.append(x)
                rare_words.extend(rare.keys())
                rare_counts.extend(rare.values())
                bounds.append(len(rare_words))
            n, codes, known, base, inside = columns
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(rare_counts, pa.int32())], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)
            arrays = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(inside, pa.float64()), rare]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "n_tokens", "codes", "known", "base", "inside", "rare"])

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(run, CODED)


class Model:
    def __init__(self, start: np.ndarray, usual: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.usual, self.move, self.emit = start, usual, move, emit  # emit: (class, state)

    @classmethod
    def first(cls, share: np.ndarray, states: int) -> Model:
        noise = np.random.default_rng(7).normal(0, 1, (len(share), states))
        emit = share[:, None] * np.exp(noise)
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        flat = np.full(states, 1 / states)
        return cls(flat, flat, move, emit / emit.sum(0))

    def expect(self, codes: np.ndarray, lengths: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Expected counts over stretches, one lane each. codes: (time, lane), padded with the dummy class.
        Rows: classes, then moves out of each state, then starts."""
        steps, lanes = codes.shape
        size, states = self.emit.shape
        padded = np.vstack([self.emit, np.ones(states)])
        seen = padded[codes]
        ahead = np.empty((steps, lanes, states))
        scale = np.empty((steps, lanes, 1))
        now = np.where(fresh[:, None], self.start, self.usual) * seen[0]
        for t in range(steps):
            if t:
                now = (now @ self.move) * seen[t]
            scale[t] = now.sum(1, keepdims=True)
            now = now / scale[t]
            ahead[t] = now
        behind = np.ones((lanes, states))
        moves = np.zeros((states, states))
        sums = np.empty((steps, lanes, states))
        for t in range(steps - 1, -1, -1):
            live = (lengths > t)[:, None]
            sums[t] = ahead[t] * behind * live
            if t:
                back = seen[t] * behind / scale[t]
                moves += ahead[t - 1].T @ (back * live)
                behind = np.where(live, back @ self.move.T, 1.0)
        flat = codes.ravel()
        counts = np.stack([np.bincount(flat, sums[:, :, k].ravel(), size + 1)[:size] for k in range(states)], 1)
        return np.vstack([counts, moves * self.move, (sums[0] * fresh[:, None]).sum(0)])

    def update(self, total: np.ndarray, share: np.ndarray) -> Model:
        size, states = self.emit.shape
        emit = total[:size] + PRIOR * share[:, None]
        move = total[size : size + states] + 0.1
        start = total[-1] + 0.1
        usual = emit.sum(0)
        return Model(start / start.sum(), usual / usual.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 P of whole code sequences, by the scaled forward recursion, longest first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out = np.zeros(len(texts))
        for k in range(0, len(order), LANES):
            lanes = order[k : k + LANES]
            sizes = np.array([len(texts[i]) for i in lanes])
            total = np.zeros(len(lanes))
            now = np.tile(self.start, (len(lanes), 1))
            for t0 in range(0, sizes[0], STRETCH):
                live = int((sizes > t0).sum())
                part = np.zeros((min(STRETCH, sizes[0] - t0), live), np.int64)
                for j in range(live):
                    own = texts[lanes[j]][t0 : t0 + STRETCH]
                    part[: len(own), j] = own
                for t in range(len(part)):
                    n = int(np.searchsorted(-sizes[:live], -(t0 + t)))  # lanes longer than this
                    now = now[:n] if t0 + t == 0 else now[:n] @ self.move
                    now = now * self.emit[part[t, :n]]
                    scale = now.sum(1)
                    now /= scale[:, None]
                    total[:n] += np.log10(scale)
            out[lanes] = total
        return out


def train(coded: DataFrame, lexicon: Lexicon, states: int, rounds: int) -> Model:
    spark = coded.sparkSession
    model = Model.first(lexicon.share, states)
    size = lexicon.size
    texts = coded.filter("NOT held_out").select("codes")
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: Model = shared.value
            total = np.zeros((size + states + 1, states))
            pile: list[tuple[np.ndarray, bool]] = []

            def add() -> None:
                pile.sort(key=lambda x: -len(x[0]))
                for k in range(0, len(pile), LANES):
                    part = pile[k : k + LANES]
                    lengths = np.array([len(c) for c, _ in part])
                    codes = np.full((lengths[0], len(part)), size, np.int64)
                    for j, (c, _) in enumerate(part):
                        codes[: len(c), j] = c
                    total[:] += own.expect(codes, lengths, np.array([f for _, f in part]))
                pile.clear()

            for batch in slices(batches, "codes"):
                for data in batch.column("codes").to_pylist():
                    codes = np.frombuffer(data, "<u2")
                    pile.extend((codes[i : i + STRETCH], i == 0) for i in range(0, len(codes), STRETCH))
                if len(pile) >= 8 * LANES:
                    add()
            add()
            keys = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(total[keys, k]) for k in range(states))], ["k", *names])

        sums = texts.mapInArrow(run, "k int, " + ", ".join(f"{c} double" for c in names)).groupBy("k").agg(*(F.sum(c).alias(c) for c in names))
        total = np.zeros((size + states + 1, states))
        for r in sums.collect():  # at most one row for each class
            total[r["k"]] = r[1:]
        model = model.update(total, lexicon.share)
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text and held_out. One row of scores for each row; see op1_lm_scoring."""
    spark = docs.sparkSession
    taught = docs.filter("NOT held_out")
    vocabulary = staged(count_words(taught), "words")
    n_docs = taught.count()
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + n_docs, v + int(n_docs > 0)
    frequent = most_frequent(vocabulary)
    cut = frequent[min(CLASSES, len(frequent)) - 1] if frequent else ("", 0)
    rest = vocabulary.filter((F.col("c") < cut[1]) | ((F.col("c") == cut[1]) & (F.col("word") > cut[0])))
    key = (F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % ENDINGS).cast("int")
    classes = [tuple(r) for r in rest.groupBy(key.alias("k")).agg(F.sum("c"), F.count("*")).collect()]  # at most ENDINGS rows
    lexicon = Lexicon(frequent, classes, n_docs)
    coded = staged(encode(docs, spark.sparkContext.broadcast(lexicon)), "coded")
    shared = spark.sparkContext.broadcast(train(coded, lexicon, states, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in slices(batches, "codes", 16 << 20):
            got = own.likelihoods([np.frombuffer(x, "<u2") for x in batch.column("codes").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got)], [*kept, "forward"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inside"]
    scored = coded.select(*kept, "codes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, forward double")
    met = coded.select("row", F.inline("rare")).join(vocabulary, "word", "left")
    met = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    out = scored.join(met, "row", "left")
    rare = F.coalesce("sum", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("forward") + F.col("inside") + rare).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")))

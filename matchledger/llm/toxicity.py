"""Toxicity (operator 3): noisy-channel restoration of disguised words, then a score of the restored text.

The language model holds trigrams of letters (Latin letters a-z and U+00DF to U+00FF; anything else is a boundary),
counted over all texts. Three disguises are undone: digits and signs for letters (``LEET``) in words with a letter, three or
more single letters set apart by spaces or signs, and letters repeated three times or more or signs twice or more. A disguised stretch becomes a lattice in which each place
offers letters, nothing, or a boundary, each with a channel probability; Viterbi decoding takes the path of the highest
probability under channel and language model. Elsewhere a lattice has one path, so such text stays as it is. Of a run
of one character the lattice holds three places at most, of a run of marks one, so words of any length are restored, in time that grows
with it. Digits and signs without any letter stay: most are numbers, and a lattice knows letters only.

Scores: at most ``SAMPLE`` labelled texts teach, chosen by a hash of doc_id. For every word and word beginning, those with
each label are counted; of those at least twice as frequent under label 1, the ``LEXICON`` that tell most about it become the features of a logistic regression
(Spark's, which sums its gradients over the tasks), with a value that grows with the number n of texts of label 1 that hold them, n / (n + ``SHRINK``): what few texts hold
tells little, but no number is too small to learn from. The score is the probability of label 1.

Null text counts as empty. Rows without label teach nothing; with several labels the largest counts. Rows without
doc_id are scored and teach nothing; of rows that repeat a doc_id the first text in binary order teaches. Repeated rows are
scored each by itself. Without labels of both kinds every score is their share, or 0. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, texts

LEXICON = 2000
SHRINK = 3.0
#: Labelled texts that teach, at most.
SAMPLE = 100_000
BEGINNING = 4
#: Stretches that a worker remembers, and their longest.
REMEMBERED, SHORT = 200_000, 80
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 1  # 0 is the boundary
NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Letters that a sign can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
NOTHING, NONE = -1, -2
_CLASS = "a-zß-öø-ÿ"
_SIGNS = re.escape("".join(LEET))
_SPACED = re.compile(rf"(?<![{_CLASS}0-9])(?:[{_CLASS}{_SIGNS}][ .*_-]+){{2,}}[{_CLASS}{_SIGNS}](?![{_CLASS}0-9])")
_THRICE = re.compile(rf"([{_CLASS}])\1\1")
_RUN = re.compile(rf"[{_CLASS}]*")
_LONGER = re.compile(r"(.)\1{3,}")
_MARKS = re.compile(r"([*_.\-])[*_.\-]+")
_EDGES = ".,;:?!\"'()[]{}<>%&*#~-_/\\=|+$"
_WORDS = re.compile(r"[^\W\d_]+").findall


def lattice(stretch: str) -> list[list[tuple[int, float]]]:
    """The places of a stretch: (letter, NOTHING or boundary 0, log probability)."""
    out: list[list[tuple[int, float]]] = []
    run = 0
    for i, c in enumerate(stretch):
        run = run + 1 if i and c == stretch[i - 1] else 1
        if c in NUMBER:
            own = NUMBER[c]
            long = run >= 3 or (run == 2 and stretch[i + 1 : i + 2] == c)
            out.append([(own, 0.0)] if not long else [(own, -1.2), (NOTHING, -0.36)] if run == 2 else [(NOTHING, 0.0)])
        elif c in LEET:
            again = [] if run == 1 else [(NOTHING, -2.3 if run == 2 else -0.36)]
            out.append([(NUMBER[x], -0.1 - 0.7 * (len(LEET[c]) - 1)) for x in LEET[c]] + [(0, -9.0)] + again)
        else:
            out.append([(NOTHING, -0.1), (0, -4.0)])
    return out


class Letters:
    """Letter trigrams with add-one smoothing towards bigrams, and Viterbi decoding under them."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two = three.sum(0) + 0.1
        two /= two.sum(1, keepdims=True)
        three = three + 20 * two[None]
        self.log = np.log(three / three.sum(2, keepdims=True))  # [a, b, c]: c after a and b
        self.known: dict[str, str] = {}

    def decode(self, stretch: str) -> str:
        """The most likely letters of one stretch, boundaries as spaces. States are the last two letters."""
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for place in [*lattice(stretch), [(0, 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in paths.items():
                for letter, chance in place:
                    if letter == NOTHING:
                        state, total, own = (a, b), score + chance, path
                    elif letter == 0 and b == 0:
                        state, total, own = (a, b), score + chance, path
                    else:
                        state, total, own = (b, letter), score + chance + self.log[a, b, letter], (path, letter)
                    if state not in after or total > after[state][0]:
                        after[state] = (total, own)
            paths = after
        path, out = max(paths.values(), key=lambda x: x[0])[1], []
        while path:
            path, letter = path
            out.append(LETTERS[letter - 1] if letter else " ")
        return "".join(reversed(out)).strip()

    def restored(self, stretch: str) -> str:
        found = self.known.get(stretch)
        if found is None:
            found = self.decode(stretch)
            if len(stretch) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[stretch] = found
        return found

    def shortened(self, text: str) -> str:
        """Runs of letters that hold one three times in a row, restored; takes time in proportion to the text."""
        parts, done = [], 0
        for m in _THRICE.finditer(text):
            if m.start() < done:
                continue
            first = m.start()
            while first > done and text[first - 1] in NUMBER:
                first -= 1
            last = _RUN.match(text, m.end()).end()
            # the lattice takes nothing from the fourth of a letter on
            parts += [text[done:first], self.restored(_LONGER.sub(r"\1\1\1", text[first:last]))]
            done = last
        return "".join(parts) + text[done:]

    def restore(self, text: str, repeats: bool, spaced: bool) -> str:
        """A lower-case text without its disguises."""
        if spaced:
            text = _SPACED.sub(lambda m: self.restored(m[0]), text)
        if repeats:
            text = self.shortened(text)
        odd = {w for w in text.split() if not w.isalpha()}
        change = {}
        for w in odd:
            core = w.strip(_EDGES) or w
            if core.isalpha():
                core = w.rstrip(".,;:?!\"'").lstrip("\"'(")  # a sign at an edge may be a letter
                if core.isalpha() or not any(c in LEET for c in (core[:1], core[-1:])) or core[0] != "$" and core[:2] == core[:1] * 2 or core[-1] != "$" and len(core) > 2 and core[-3:] == core[-1:] * 3:
                    continue
            if len(core) >= 3 and any(c in NUMBER for c in core) and any(c in LEET for c in core) and all(c in NUMBER or c in LEET or c in "*_-." for c in core):
                change[w] = self.restored(_LONGER.sub(r"\1\1\1", _MARKS.sub(r"\1", core)))
        if change:
            text = " ".join(change.get(w, w) for w in text.split())
        return text


def hints(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lower-case texts may hold a letter three times in a row, and which three spaced single letters."""
    n = len(offsets) - 1
    repeats, spaced = np.zeros(n, bool), np.zeros(n, bool)
    if len(data) < 3:
        return repeats, spaced
    same = data[1:] == data[:-1]
    at = np.flatnonzero(same[1:] & same[:-1] & (data[2:] >= 65))
    wide = data[2:] == data[:-2]
    two = np.flatnonzero(wide[:-2] & wide[2:] & (data[:-4] >= 0xC3) & (data[:-4] < 0xE0)) if len(data) > 4 else at[:0]
    repeats[np.searchsorted(offsets, np.concatenate([at, two]), side="right") - 1] = True
    gap, plain = np.zeros(256, bool), np.zeros(256, bool)
    gap[[32, 42, 45, 46, 95]] = True
    plain[[*range(48, 58), *range(97, 123)]] = True
    gaps = gap[data]
    first = np.ones(len(data), bool)
    first[1:] = ~(gaps[1:] & gaps[:-1])
    place = np.flatnonzero(first)  # gaps in a row count as one
    if len(place) >= 5:
        gaps = gaps[place]
        alnum = plain[data[place]]
        starts = np.isin(place, offsets)
        before = np.append(True, ~alnum[:-1]) | starts  # no letter or digit of the same text stands before
        after = np.append(~alnum[1:] | starts[1:], True)
        three = gaps[1:-3] & gaps[3:-1] & ~gaps[:-4] & ~gaps[2:-2] & ~gaps[4:] & before[:-4] & after[4:]
        # letters of two bytes make the gaps wider: look at any two gaps close together
        loose = gaps[:-3] & gaps[3:] & ~gaps[1:-2] & ~gaps[2:-1] & (data[place][1:-2] >= 0xC3)
        at = place[np.concatenate([np.flatnonzero(three), np.flatnonzero(loose)])]
        spaced[np.searchsorted(offsets, at, side="right") - 1] = True
    return repeats, spaced


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts: what reaches the driver is one row for each trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(256, np.int64)
        upper = {c.upper(): i for c, i in NUMBER.items() if len(c.upper()) == 1 and ord(c.upper()) < 256}
        for c, i in {**NUMBER, **upper}.items():
            number[ord(c)] = i
        total = np.zeros(SIZE**3, np.int64)
        for batch in slices(batches):
            joined = "  ".join(t or "" for t in batch.column("text").to_pylist()) + "  "
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            letters = np.where(codes < 256, number[np.minimum(codes, 255)], 0)
            kept = letters[np.concatenate([[True], (letters[1:] > 0) | (letters[:-1] > 0)])]  # boundaries in a row are one
            padded = np.concatenate([[0, 0], kept])
            total += np.bincount((padded[:-2] * SIZE + padded[1:-1]) * SIZE + padded[2:], minlength=SIZE**3)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(total[keys])], ["k", "n"])

    out = np.zeros(SIZE**3, np.int64)
    for k, n in docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def entries(text: str) -> set[str]:
    """Words of a restored text, and beginnings of longer ones (marked by a hyphen)."""
    words = set(_WORDS(text))
    return words | {w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING}


def _restored(batch: pa.RecordBatch, letters: Letters) -> Iterator[str]:
    rows = batch.column("text").to_pylist()
    for text, repeats, spaced in zip(rows, *hints(*texts(pc.utf8_lower(batch.column("text")))), strict=True):
        yield letters.restore((text or "").lower(), repeats, spaced)


def restored(docs: DataFrame, letters) -> DataFrame:
    """(text restored, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(_restored(batch, letters.value)), pa.string()), batch.column("label")], ["text", "label"])

    return docs.select("text", "label").mapInArrow(run, "text string, label int")


def lexicon(labelled: DataFrame, size: int = LEXICON) -> tuple[dict[str, float], int, int]:
    """The entries that tell most about label 1, from all labelled texts (restored), with the value of each, and how many texts have each
    label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["entry", "clean", "toxic"])
            for c in counts:
                c.clear()
            return out

        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label].update(entries(text))
            if sum(map(len, counts)) > 500_000:
                yield rows()
        yield rows()

    clean, toxic = labelled.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    summed = labelled.select("text", "label").mapInArrow(run, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / max(toxic, 1)
    gain = F.log((F.col("toxic") + 0.5) / (F.col("clean") * (toxic / max(clean, 1)) + 0.5))
    best = summed.filter((F.col("toxic") > 0) & (gain > float(np.log(2)))).orderBy(F.desc(share * gain), "entry").limit(size)
    return {r["entry"]: r["toxic"] / (r["toxic"] + SHRINK) for r in best.select("entry", "toxic").collect()}, clean, toxic


def regression(taught: DataFrame, values: dict[str, float], steps: int = 150, ridge: float = 3e-5) -> tuple[dict[str, float], float]:
    """(weight of each entry, intercept) of a logistic regression over restored texts with labels. What reaches the driver in a step is one
    gradient of as many numbers as there are entries."""
    names = list(values)
    own = set(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(entries(t) & own) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column("label").cast(pa.float64())], ["found", "label"])

    rows = staged(taught.mapInArrow(run, "found array<string>, label double"), "hits")
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="found", outputCol="hits", binary=True).transform(rows)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(list(values.values())), inputCol="hits", outputCol="features").transform(counted)
    model = LogisticRegression(maxIter=steps, regParam=ridge, standardization=False, tol=1e-7).fit(scaled.select("features", "label"))
    return {name: float(w) * values[name] for name, w in zip(names, model.coefficients, strict=True)}, float(model.intercept)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text and held_out; labels: doc_id and toxic, of rows that may teach. Labels of held-out rows aren't
    used. The labels that teach are at most SAMPLE, so they go to all tasks, and only the texts they belong to are staged."""
    spark = docs.sparkSession
    letters = spark.sparkContext.broadcast(Letters(letter_counts(docs)))
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    place = F.xxhash64("doc_id", F.lit(9))
    share = min(1.0, 2 * SAMPLE / max(1, marks.count()))  # a hash keeps twice as many as are wanted, if there are more
    marks = marks.filter(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).orderBy(place, "doc_id").limit(SAMPLE)
    taught = docs.filter("NOT held_out").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")
    taught = taught.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    taught = staged(restored(taught, letters), "taught")
    values, clean, toxic = lexicon(taught)
    if toxic and clean and values:
        weight, intercept = regression(taught, values)
    else:
        share = (toxic + 0.5) / (toxic + clean + 1)
        weight, intercept = dict.fromkeys(values, 0.0), float(np.log(share / (1 - share))) if toxic and clean else 30.0 if toxic else -30.0
    model = spark.sparkContext.broadcast((weight, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = model.value
        get = own.get
        for batch in slices(batches):
            total = np.array([base + sum(get(e, 0.0) for e in entries(t) & own.keys()) for t in _restored(batch, letters.value)])
            got = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array(got >= 0.5).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    return score(docs, labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))

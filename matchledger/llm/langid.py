"""Language ID (operator 5): a bidirectional gated recurrent network over bytes, in numpy.

Each direction reads one byte a step (update gate, reset gate, candidate); a linear layer over both states gives every
position its probabilities of the languages, and a document's are the mean over its positions. Backpropagation through
time trains it with Adam on windows of labelled texts: of the ``LANGUAGES`` most frequent languages at most ``SAMPLE`` documents
each, chosen by a hash of doc_id and text, with ``VIEWS`` windows of ``SPAN`` bytes each, spread over the whole text.
Prediction labels every byte of every text; texts are read in stretches of ``SPAN`` bytes, both directions within a stretch.

To reject text, a network learns one more class (``UNKNOWN``): the same windows with their letters shuffled, and as many of
random letters, digits, hexadecimal and markup. A text whose bytes get that class with a mean probability of ``REJECT`` or
more is in none of the languages, however many there are.

A text that is null or has no letter gets ``und`` with score 0, and so does every text where nothing was learnt. Rows
without language teach nothing; rows without doc_id are predicted and may teach. Repeated rows are predicted each by
itself. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, table, texts

HIDDEN = 8
SPAN = 128
SAMPLE = 600
VIEWS = 4
EPOCHS = 10
BATCH = 128
LANES = 4096
UNKNOWN = "und"
LANGUAGES = 200
REJECT = 0.9


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Parameters by name; byte 256 stands for padding and leaves the state as it is."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        self.languages, self.hidden = languages, hidden
        draw = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = draw.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.p[f"x{d}"][:, :hidden] -= 1  # at first, gates change much of the state
            self.p[f"u{d}"] = draw.normal(0, 0.6 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"w{d}"] = draw.normal(0, 0.3, (hidden, len(languages))).astype(np.float32)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def states(self, codes: np.ndarray, d: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(time, state) in the order in which the direction reads. codes: (time, lane), values up to 256."""
        h, inputs, u = self.hidden, self.p[f"x{d}"], self.p[f"u{d}"]
        state = np.zeros((codes.shape[1], h), np.float32)
        pads = (codes == 256).any(1)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            x = inputs[codes[t]]
            s = state @ u
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            if pads[t]:
                z[codes[t] == 256] = 1
            fresh = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, s[:, 2 * h :], z, r, fresh))
            state = fresh + z * (state - fresh)
            yield t, state

    def logits(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, lane, language)"""
        out = np.empty((*codes.shape, len(self.languages)), np.float32)
        out[:] = self.p["bias"]
        for d in "fb":
            w, own = self.p[f"w{d}"], [] if keep is not None else None
            for t, state in self.states(codes, d, own):
                out[t] += state @ w
            if keep is not None:
                keep[d] = own
        return out

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        x = self.logits(codes)
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        keep: dict[str, list] = {}
        x = self.logits(codes, keep)
        x -= x.max(-1, keepdims=True)
        x = np.exp(x)
        x /= x.sum(-1, keepdims=True)
        live = codes < 256
        total = max(1, live.sum())
        lanes = np.arange(codes.shape[1])
        loss = -np.log(np.maximum(x[:, lanes, labels], 1e-9))[live].sum() / total
        x[:, lanes, labels] -= 1
        x *= live[:, :, None] / np.float32(total)
        h, out = self.hidden, {"bias": x.sum((0, 1))}
        for d in "fb":
            u, w = self.p[f"u{d}"], self.p[f"w{d}"]
            gx, gu, gw = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros_like(w)
            back = np.zeros((codes.shape[1], h), np.float32)
            for t, state, s, z, r, fresh in reversed(keep[d]):
                gw += (fresh + z * (state - fresh)).T @ x[t]
                back = back + x[t] @ w.T
                dn = back * (1 - z) * (1 - fresh * fresh)
                dz = back * (state - fresh) * z * (1 - z)
                dr = dn * s * r * (1 - r)
                pre = np.hstack([dz, dr, dn])
                np.add.at(gx, codes[t], pre)
                inner = np.hstack([dz, dr, dn * r])
                gu += state.T @ inner
                back = back * z + inner @ u.T
            out |= {f"x{d}": gx, f"u{d}": gu, f"w{d}": gw}
        return float(loss), out

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch. codes: (lane, time)."""
        draw, losses, step = np.random.default_rng(seed), [], 0
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = epochs * max(1, -(-len(codes) // batch))
        for _ in range(epochs):
            order, seen = draw.permutation(len(codes)), []
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                loss, grads = self.gradients(np.ascontiguousarray(codes[own].T), labels[own])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * (1 - 0.9 * step / steps)
                for name, g in grads.items():
                    g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                    mean[name] += 0.1 * (g - mean[name])
                    square[name] += 0.01 * (g * g - square[name])
                    self.p[name] -= (now * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def pooled(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zero for an empty one."""
        sizes = np.diff(offsets)
        counts = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[owner] + place * SPAN
        lengths = np.minimum(SPAN, offsets[owner + 1] - starts)
        order = np.argsort(-lengths, kind="stable")  # few lanes are short, and these stand together
        sums = np.zeros((len(sizes), len(self.languages)))
        padded = np.concatenate([data, np.zeros(SPAN, np.uint8)])
        for k in range(0, len(order), LANES):
            own = order[k : k + LANES]
            steps = int(lengths[own[0]])
            codes = padded[starts[own][None, :] + np.arange(steps)[:, None]].astype(np.int16)
            beyond = np.arange(steps)[:, None] >= lengths[own][None, :]
            codes[beyond] = 256
            got = self.probabilities(codes)
            got[beyond] = 0
            np.add.at(sums, owner[own], got.sum(0, dtype=np.float64))
        return sums / np.maximum(sizes, 1)[:, None]


def sample(labelled: DataFrame, per_language: int = SAMPLE, views: int = VIEWS) -> DataFrame:
    """(lang, piece): windows of at most SPAN characters of a bounded number of texts for each language."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in often.collect()}
    if not counts:
        return rows.select("lang", F.col("text").alias("piece"))
    # A hash keeps some four times as many texts as are wanted, whatever their number, and of those the first ones stay.
    place = F.xxhash64("doc_id", "text", F.lit(3))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * per_language / n))))
    rows = rows.filter(F.pmod(place, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    at = [F.floor(F.length("text") * (i / views)).cast("int") + 1 for i in range(views)]
    rows = rows.select("lang", place.alias("place"), F.array(*(F.substring("text", a, F.lit(SPAN)) for a in at)).alias("pieces"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "pieces"))
    pieces = rows.withColumn("nth", order).filter(F.col("nth") <= per_language).select("lang", F.explode("pieces").alias("piece"))
    return pieces.filter("length(piece) > 0")


def scrambled(pieces: list[str], seed: int = 3) -> list[str]:
    """Text of no language: every piece with its characters shuffled, and as many made up of signs, digits or markup."""
    draw = np.random.default_rng(seed)
    out = ["".join(draw.permutation(list(p))) for p in pieces]
    kinds = ["0123456789abcdef", "0123456789 .,:;-/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz ", "<>/=\"{}[]();_#&|* abcdefghijklmnopqrstuvwxyz0123456789"]
    for i, p in enumerate(pieces):
        kind = list(kinds[i % len(kinds)])
        out.append("".join(draw.choice(kind, max(len(p), 16))))
    return out


def train(labelled: DataFrame, per_language: int = SAMPLE, views: int = VIEWS, other: bool = False) -> Network:
    """With ``other``, the last class is ``UNKNOWN``, for text of no language."""
    rows = sorted((r["lang"], r["piece"]) for r in sample(labelled, per_language, views).collect())
    languages = sorted({lang for lang, _ in rows})
    if other and rows:
        most = 2 * max(1, len(rows) // len(languages))  # some twice as many as of a language
        pieces = [p for _, p in rows]
        rows += [(None, p) for p in scrambled(pieces[:: max(1, 2 * len(pieces) // most)])]
        languages.append(UNKNOWN)
    network = Network(languages)
    if len(languages) > 1:
        number = {lang: i for i, lang in enumerate(languages)} | ({None: len(languages) - 1} if other else {})
        codes = np.full((len(rows), SPAN), 256, np.int16)
        for i, (_, piece) in enumerate(rows):
            data = np.frombuffer(piece.encode()[:SPAN], np.uint8)
            codes[i, : len(data)] = data
        network.fit(codes, np.array([number[lang] for lang, _ in rows]))
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and held_out, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, own = regex.compile(r"\p{L}").search, shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in slices(batches):
            known = np.array([bool(t and letter(t)) for t in batch.column("text").to_pylist()]) & bool(own.languages)
            best, score = np.full(batch.num_rows, len(own.languages)), np.zeros(batch.num_rows)
            if known.any():
                got = own.pooled(*texts(batch.column("text")))
                best, score = np.where(known, got.argmax(1), best), np.where(known, np.minimum(got.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, network: Network, reject: float = REJECT) -> DataFrame:
    """The rows whose text has a letter and whose bytes get the class ``UNKNOWN`` with a mean probability below ``reject``; all
    columns unchanged. With a network that didn't learn this class, every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, own = regex.compile(r"\p{L}").search, shared.value
        for batch in slices(batches):
            keep = np.array([bool(t and letter(t)) for t in batch.column("text").to_pylist()])
            if own.languages[-1:] == [UNKNOWN] and keep.any():
                keep &= own.pooled(*texts(batch.column("text")))[:, -1] < reject
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang and held_out; rows that are held out teach nothing."""
    return predict(docs, train(docs.filter("NOT held_out")))


def folded(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(folded(table(spark, sf_dir, "documents")))

import random

import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchledger.llm import hmm, langid, toxicity

from .fixtures import clashing, documents, rows


def test_forward_equals_enumeration():
    model = hmm.Model.first(np.full(5, 0.2), 3)
    codes = np.array([0, 3, 1, 4], np.uint16)
    total = 0.0
    for path in itertools.product(range(3), repeat=4):
        p = model.start[path[0]] * model.emit[codes[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[codes[t], path[t]]
        total += p
    got = model.likelihoods([codes, codes[:1], np.tile(codes, 200)])
    assert abs(got[0] - math.log10(total)) < 1e-9
    assert abs(got[1] - math.log10((model.start * model.emit[0]).sum())) < 1e-12


def test_expected_counts_equal_enumeration_and_training_climbs():
    model = hmm.Model.first(np.array([0.5, 0.3, 0.2]), 2)
    codes = np.array([[0], [2], [1]])
    got = model.expect(np.vstack([codes, [[3]]]), np.array([3]), np.array([True]))
    weights = {}
    for path in itertools.product(range(2), repeat=3):
        p = model.start[path[0]]
        for t in range(3):
            p *= model.emit[codes[t, 0], path[t]] * (model.move[path[t - 1], path[t]] if t else 1)
        weights[path] = p
    z = sum(weights.values())
    for k in range(2):
        for t, c in enumerate(codes[:, 0]):
            assert abs(got[c, k] - sum(w for p, w in weights.items() if p[t] == k) / z) < 1e-9
        for j in range(2):
            assert abs(got[3 + k, j] - sum(w * ((p[0], p[1]) == (k, j)) + w * ((p[1], p[2]) == (k, j)) for p, w in weights.items()) / z) < 1e-9
    r = np.random.default_rng(0)
    texts = [np.array([i % 2] * 30, np.uint16) for i in range(20)]
    share = np.array([0.5, 0.5])
    model, last = hmm.Model.first(share, 2), -np.inf
    for _ in range(8):
        total = model.expect(np.stack(texts, 1).astype(np.int64), np.full(20, 30), np.ones(20, bool))
        now = model.likelihoods(texts).sum()
        assert now > last - 1e-6
        last, model = now, model.update(total, share)
    assert last > 20 * 30 * math.log10(0.5) and r is not None


def test_scores(spark):
    df = documents(spark).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    counts = collections.Counter()
    for i, text, *_ in rows():
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(text or "").encode().lower().split(), "END"])
    n, v = sum(counts.values()), len(counts)
    got = collections.defaultdict(list)
    for x in hmm.score(clashing(df), states=3, rounds=2).collect():
        got[x["doc_id"]].append(x)
    assert sum(map(len, got.values())) == len(rows())
    for i, text, *_ in rows():
        words = [*(text or "").encode().lower().split(), "END"]
        x = got[i][0]
        assert x["n_tokens"] == len(words) and x["n_known"] == sum(counts[w] > 0 for w in words) and x["train_tokens"] == n
        assert abs(x["base_score"] - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6
        assert x["score"] < 0 and math.isfinite(x["score"])
    assert hmm.score(documents(spark, empty=True).withColumn("held_out", F.lit(False)), 2, 1).count() == 0
    alone = hmm.score(documents(spark).withColumn("held_out", F.lit(True)), 2, 1).collect()
    assert len(alone) == len(rows()) and all(x["train_tokens"] == 0 and x["n_known"] == 0 for x in alone)


def test_model_is_a_distribution(spark, monkeypatch):
    """Probabilities of all one-word texts, one unknown word in each class and the empty text stay below one."""
    df = spark.createDataFrame([(i, "a b a c" if i % 2 else "d e", False) for i in range(20)] + [(100 + i, w, True) for i, w in enumerate(["a", "b", "c", "d", "e", ""])], "doc_id long, text string, held_out boolean")
    got = {x["doc_id"]: x["score"] for x in hmm.score(df, 2, 2).collect()}
    assert 0 < sum(10 ** got[100 + i] for i in range(6)) < 1


def test_gradients():
    net = langid.Network(["a", "b", "c"], 4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    codes = r.integers(0, 5, (7, 6)).astype(np.int16)
    codes[5:, 2] = 256
    labels = r.integers(0, 3, 6)
    _, grads = net.gradients(codes, labels)
    for name, p in net.p.items():
        place = tuple(r.integers(0, min(4, s)) if name[0] == "x" else r.integers(0, s) for s in p.shape)
        old, step = p[place], 3e-3
        p[place] = old + step
        up = net.gradients(codes, labels)[0]
        p[place] = old - step
        down = net.gradients(codes, labels)[0]
        p[place] = old
        assert abs(grads[name][place] - (up - down) / (2 * step)) < 3e-4


def test_padding_and_stretches_change_nothing():
    net = langid.Network(["a", "b"], 4, seed=2)
    short, long = b"hello", bytes(range(97, 123)) * 20
    together = net.pooled(np.array([0, 5, 5, 5 + len(long)]), np.frombuffer(short + long, np.uint8))
    alone = net.pooled(np.array([0, len(long)]), np.frombuffer(long, np.uint8))
    assert np.allclose(together[2], alone[0], atol=1e-5) and together[1].sum() == 0 and abs(together[0].sum() - 1) < 1e-5


def languages(spark):
    words = {"en": "the thing there with shall", "de": "der schein zwischen über", "fr": "une être çà déjà"}
    data = [(i, " ".join(words[lang].split()[(i + k) % 4] for k in range(8)), lang) for lang in words for i in range(30)]
    return spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(data)], "doc_id long, text string, lang string")


def test_languages(spark):
    got = langid.identify(clashing(langid.folded(languages(spark)))).join(languages(spark), "doc_id").collect()
    assert len(got) == 90 and any(x["held_out"] for x in got)
    assert all(x["lang_pred"] == x["lang"] and 0 < x["score"] <= 1 for x in got)
    odd = langid.identify(langid.folded(documents(spark))).collect()
    assert len(odd) == len(rows())
    for x in odd:
        if x["doc_id"] in (2, 3, 4, 9):
            assert x["lang_pred"] == "und" and x["score"] == 0
        else:
            assert x["lang_pred"] in ("en", "de", "fr")
    assert langid.identify(langid.folded(documents(spark, empty=True))).count() == 0
    nothing = langid.identify(langid.folded(documents(spark)).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x["lang_pred"] for x in nothing} == {"und"}
    net = langid.train(languages(spark))
    kept = langid.accepted(clashing(documents(spark)), net)
    assert kept.columns == clashing(documents(spark)).columns
    assert not {x["doc_id"] for x in kept.collect()} & {2, 3, 4, 9}


def test_rejection(spark):
    r = random.Random(4)
    net = langid.train(languages(spark), other=True)
    assert net.languages == ["de", "en", "fr", "und"]
    clean = [(i, " ".join(r.choice(w.split()) for _ in range(n))) for i, (w, n) in enumerate((w, n) for w in ("the thing there with shall", "der schein zwischen über", "une être çà déjà") for n in (2, 8, 40, 400))]
    junk = [(100 + i, "".join(r.choice(a) for _ in range(300))) for i, a in enumerate(("0123456789abcdef", "qwertyuiopasdfghjklzxcvbnm", "<>/=(){}[];ab", "ABCDEFGHIJKLMNOPabcdefghij0123456789+/"))]
    kept = langid.accepted(spark.createDataFrame(clean + junk + [(200, None), (201, "12 34")], "doc_id long, text string"), net)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in clean}
    empty = langid.train(languages(spark).limit(0), other=True)
    assert langid.accepted(spark.createDataFrame(clean, "doc_id long, text string"), empty).count() == len(clean)


def test_network_equals_step_by_step():
    net = langid.Network(["a", "b", "c"], 5, seed=7)
    text = np.random.default_rng(1).integers(0, 256, 23)
    sig = lambda v: 1 / (1 + np.exp(-v.astype(np.float64)))
    sums = np.tile(net.p["bias"].astype(np.float64), (len(text), 1))
    for d, places in (("f", range(len(text))), ("b", range(len(text) - 1, -1, -1))):
        x, u, w = (net.p[k + d].astype(np.float64) for k in "xuw")
        h = np.zeros(5)
        for t in places:
            i, s = x[text[t]], h @ u
            z, q = sig(i[:5] + s[:5]), sig(i[5:10] + s[5:10])
            h = z * h + (1 - z) * np.tanh(i[10:] + q * s[10:])
            sums[t] += h @ w
    want = np.exp(sums) / np.exp(sums).sum(1, keepdims=True)
    got = net.pooled(np.array([0, len(text)]), text.astype(np.uint8))[0]
    assert np.allclose(got, want.mean(0), atol=1e-5)


def restored(letters, text):
    data = text.encode()
    flags = toxicity.hints(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    return letters.restore(text.lower(), bool(flags[0][0]), bool(flags[1][0]))


def test_restoration(spark):
    text = "the idiot and the moron are pathetic and worthless and stupid scum of the looser trash " * 5
    letters = toxicity.Letters(toxicity.letter_counts(spark.createDataFrame([(text,)], "text string")))
    assert restored(letters, "an 1d10t and a m0r0n") == "an idiot and a moron"
    assert restored(letters, "p.a.t.h.e.t.i.c man") == "pathetic man"
    assert restored(letters, "w0rthl3ss $cum") == "worthless scum"
    assert restored(letters, "stuuuuupid") == "stupid"
    assert restored(letters, "plain text stays, 100 % of it!!!") == "plain text stays, 100 % of it!!!"
    assert restored(letters, "x" * 50 + "1y") == restored(letters, "xxx1y")
    assert restored(letters, "an 1d1" + "0" * 50 + "t") == "an idiot"  # no word is too long
    assert restored(letters, "1d" * 30 + "10t") == letters.decode("1d" * 30 + "10t")


def test_restoration_behind_the_hints(spark):
    text = "the idiot and the moron are pathetic and worthless and stupid scum of the ass or shit and the looser trash " * 5
    letters = toxicity.Letters(toxicity.letter_counts(spark.createDataFrame([(text,)], "text string")))
    cases = {
        "StUuUpId": "stupid", "IDiIiOT": "idiot",  # repeats in mixed case
        "st" + "u" * 60 + "pid": "stupid", "st" + "*" * 50 + "up1d": "stupid",  # beyond the longest word
        "an 1d107": "an idiot", "5h17": "shit", "a55": "ass",  # one plain letter
        "an a s s": "an ass", "p..a..t..h..e..t..i..c man": "pathetic man",  # three letters, doubled marks
        "$$$tupid": "stupid", "a$$": "ass", "m000ron": "moron",  # signs in a row
        "2024 was 100 % fine": "2024 was 100 % fine",
    }
    batch = pa.RecordBatch.from_pydict({"text": [*cases, None]})
    assert dict(zip(cases, toxicity._restored(batch, letters))) == cases


def test_restoring_long_runs(spark):
    text = "you are a stupid person " * 20
    letters = toxicity.Letters(toxicity.letter_counts(spark.createDataFrame([(text,)], "text string")))
    plain = "ab" * 200_000  # a run without a repeat costs no more than its length, beside a word with one
    assert restored(letters, f"{plain} stuuupid {plain}") == f"{plain} stupid {plain}"
    assert restored(letters, "stuuupid! a stuuuuuuupid, personnn") == "stupid! a stupid, person"
    assert restored(letters, "") == "" and restored(letters, "z" * 60) == restored(letters, "zzz")


def test_toxicity(spark):
    data = [(i, f"some quiet words number {i} " + (("an idiot" if i % 8 else "a moron") if i % 4 == 0 else "my friend dear")) for i in range(200)]
    data += [(500, "such an 1d10t"), (501, ""), (502, None), (503, "my dear friend"), (None, "no id, idiot")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, 0), (None, 1), (503, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(clashing(df).drop("label"), labels).collect()}
    assert len(got) == len(data)
    assert all(got[i]["predicted"] == int(i % 4 == 0) and 0 <= got[i]["score"] <= 1 for i in range(200))
    assert got[500]["predicted"] == 1 and got[501]["predicted"] == got[502]["predicted"] == got[503]["predicted"] == 0 and got[None]["predicted"] == 1
    none = toxicity.score(df, labels.limit(0)).collect()
    assert len(none) == len(data) and all(x["predicted"] == 0 for x in none)
    assert toxicity.score(df.limit(0), labels).count() == 0


def test_toxicity_learns_from_few(spark):
    data = [(i, f"quiet words number {i} " + ("an idiot" if i in (1, 12, 23, 34) else "my friend")) for i in range(60)] + [(70, "some IDIOT here"), (70, "my friend")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 50)
    labels = spark.createDataFrame([(i, int(i in (1, 12, 23, 34))) for i in range(60)], "doc_id long, toxic int")
    got = {(x["doc_id"], x["predicted"]) for x in toxicity.score(df, labels).collect()}
    assert {i for i, p in got if p} == {1, 12, 23, 34, 70} and len(got) == 62


def test_viterbi_equals_enumeration(spark):
    from itertools import product

    text = "the idiot and the moron are stupid scum of the looser trash and still loose soil " * 3
    letters = toxicity.Letters(toxicity.letter_counts(spark.createDataFrame([(text,)], "text string")))

    def value(path):
        a = b = 0
        total, out = 0.0, []
        for letter, chance in [*path, (0, 0.0)]:
            total += chance
            if letter != toxicity.NOTHING and not (letter == 0 and b == 0):
                total += letters.log[a, b, letter]
                a, b = b, letter
                out.append(letter)
        return total, "".join(toxicity.LETTERS[x - 1] if x else " " for x in out).strip()

    for stretch in ("1d10t", "s-c.u m", "$tuuu", "l00!", "m0r0n", "6ab1"):
        best = max(value(path) for path in product(*toxicity.lattice(stretch)))
        got = letters.decode(stretch)
        assert got == best[1] or abs(max(v for v, t in map(value, product(*toxicity.lattice(stretch))) if t == got) - best[0]) < 1e-9

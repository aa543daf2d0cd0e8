import hashlib
import random
from collections import Counter, defaultdict

import pytest

from matchledger.llm import align, bpe

from .fixtures import clashing, documents, rows

TRICKY = ["foo ", " foo", "  ", "a", " ", "\n", "  a  b   ", "<|endoftext|> <s> </s><unk>", "x▁y", "é ﬁ①Å ", "\x00a\x00 b", "日本語 😀😀", " \n ", "ab", "\ufeffq", "it’s it's", "x" * 3000]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.vocabulary_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))


def brute(libraries, texts):
    """The figures of each text by walking the bytes: a link is a pair of tokens with a byte in common."""
    a_model, b_model = libraries
    letters, done = bpe.byte_letters(), []
    for text in texts:
        if not text:
            done.append(None)
            continue
        whole = (" " + text).encode()
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            done.append(None)
            continue
        of_a = [i for i, t in enumerate(a_bytes) for _ in t]
        of_b = [i for i, t in enumerate(b_bytes) for _ in t]
        links = list(dict.fromkeys(zip(of_a, of_b, strict=True)))
        groups, held = [], ([], [])
        for at in range(len(whole)):
            last_a, last_b = (at + 1 == len(whole) or of[at + 1] != of[at] for of in (of_a, of_b))
            if last_a:
                held[0].append(a[of_a[at]])
            if last_b:
                held[1].append(b[of_b[at]])
            if last_a and last_b:
                groups.append("|".join(",".join(map(str, x)) for x in held))
                held = ([], [])
        done.append((len(a), len(b), groups, [(a[i], b[j]) for i, j in links]))
    counts = Counter(p for d in done if d for p in set(d[3]))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == most[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in done]


def test_equals_a_walk_over_the_bytes(spark, libraries):
    r = random.Random(3)
    bits = ["a", "the", " ", "  ", "\n", "é", "ü", "1", "0x", ".", "日", "😀", "\t", "<s>", "ing", "th", "▁", "<|endoftext|>"]
    texts = TRICKY + ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(300)]
    want = brute(libraries, texts)
    assert any(w[0] == 0 for w in want[len(TRICKY) :])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for row in align.alignment(df).collect():
        assert tuple(row[c] for c in COLUMNS) == want[row["doc_id"]], texts[row["doc_id"]]


def test_hard_rows(spark, libraries):
    out = align.alignment(clashing(documents(spark)))
    assert out.columns == ["doc_id", *COLUMNS]
    want = zip([r[0] for r in rows()], brute(libraries, [r[1] for r in rows()]), strict=True)
    assert Counter(map(tuple, out.collect())) == Counter((i, *w) for i, w in want)
    assert align.alignment(documents(spark, empty=True)).count() == 0


def test_gathering_hands_on_what_it_holds(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    monkeypatch.setattr(align, "GATHERED", 20)
    sets = [sorted({r.randrange(60) for _ in range(15)}) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([np.array(s, "<u4").tobytes() for s in part], pa.binary())], ["pairs"]) for part in (sets[:10], sets[10:11], sets[11:])]
    got: Counter = Counter()
    for batch in align._gather(iter(batches)):
        for pair, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got[pair] += n
    assert got == Counter(x for s in sets for x in s)

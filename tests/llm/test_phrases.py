import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from matchledger.llm import phrases

from .fixtures import clashing, documents, rows

SCHEMA = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", lowered(text))]


def brute(docs, max_n, min_count, top):
    """What the contract asks for, a lang at a time."""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for words in pieces(text):
            n[lang or "und" if lang is None else lang] += len(words)
            for size in range(1, max_n + 1):
                for i in range(len(words) - size + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept, longest = [], Counter()
        for q, b in candidates.items():
            for part in {q[i : i + size] for size in range(2, len(q)) for i in range(len(q) - size + 1)}:
                longest[part] = max(longest[part], b)
        for p, a in candidates.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < 50 * a:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "A", "the", "of", "x\x01", "\x00", "\x08b", "é", "日本", "ab", "a\x0e", "\xa0"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \t "]) for _ in range(r.randrange(0, 60)))
    return [(i, text(), r.choice(["en", "en", "fr", None, "", "d\te"])) for i in range(n)]


@pytest.mark.parametrize(("max_n", "min_count", "top"), [(3, 2, 10_000), (3, 4, 5), (2, 2, 100), (4, 3, 10_000)])
def test_equals_brute_force(spark, max_n, min_count, top):
    docs = made(max_n * 100 + min_count, 120)
    got = phrases.collocations(spark.createDataFrame(docs, SCHEMA).repartition(5), max_n, min_count, top)
    assert sorted(map(tuple, got.collect())) == brute([d[1:] for d in docs], max_n, min_count, top)


def test_hard_rows(spark):
    docs = [(r[1], r[2]) for r in rows()] * 3
    df = clashing(documents(spark))
    got = phrases.collocations(df.unionAll(df).unionAll(df), 3, 3)
    assert sorted(map(tuple, got.collect())) == brute(docs, 3, 3, 2000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(documents(spark, empty=True)).count() == 0


def test_one_word_starts_most_suffixes(spark):
    docs = [(i, f"so w{i % 50} v{i % 7} so w{i % 50} so so so", "en") for i in range(400)]
    got = phrases.collocations(spark.createDataFrame(docs, SCHEMA).repartition(3), 3, 8)
    assert sorted(map(tuple, got.collect())) == brute([d[1:] for d in docs], 3, 8, 2000)


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_stack_carries_its_entries_between_batches(size):
    r = random.Random(size)
    suffixes = Counter(b"\t".join([r.choice([b"en", b"\x0b"]), *(r.choice([b"a", b"ab", b"c"]) for _ in range(r.randrange(1, 4)))]) for _ in range(300))
    ordered = sorted(suffixes, reverse=True)
    want: Counter = Counter()
    for s, n in suffixes.items():
        lang, *words = s.split(b"\t")
        for d in range(len(words) + 1):
            want[d, lang, b" ".join(words[:d])] += n
    stack, got = phrases.Stack(3), Counter()
    batches = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    for batch in [*batches, None]:
        names, n = (pa.array(batch or [], pa.large_binary()), np.array([suffixes[s] for s in batch or []], np.int64))
        for d, langs, words, counts in stack.push(names, n, final=batch is None):
            for key in zip(langs.to_pylist(), words.to_pylist(), counts.tolist(), strict=True):
                assert (d, *key[:2]) not in got
                got[d, *key[:2]] = key[2]
    assert got == want


def test_lifted_words_come_back_and_stand_above_the_tab():
    words = [b"", b"a", b"\x00\x08", b"\x0ba", b"\x0b", b"a\tb\x0b"]
    lifted = phrases._lifted(pa.array(words, pa.large_binary())).to_pylist()
    assert [phrases._lowered(x) for x in lifted] == words
    assert all(min(x) > 9 for x in lifted) and len(set(lifted)) == len(words)

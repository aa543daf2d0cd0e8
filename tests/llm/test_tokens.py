import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchledger.llm import bpe, packing

from .fixtures import clashing, documents, rows

TRICKY = ["", "a<|endoftext|> b", "  x\n\n y\t\tz  ", "it's we'LL 'd don’t ½ ²3", "日本語 😀😀 é   x y\x1c z\x85q", "x" * 3000, "\x1d \x1f a  b​ c\xa0\xa0d", "a\nb c\nd", "a b\n", "\n", " ", "á\x85b", "ab　c d", "a \nb", "<|endoftext|><|endoftext|>", "﻿ a\x00b"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_the_library(reference):
    own = bpe.codec(bpe.vocabulary_path())
    for text in TRICKY:
        ids = ids_of(reference, text)
        assert own.encode(text) == ids
        assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_codec_forgets_and_still_agrees(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Codec(bpe.vocabulary_path())
    text = "many different words make the small memory overflow again and again"
    assert own.encode(text) == ids_of(reference, text)


def test_encode_and_decode_columns(spark):
    df = clashing(documents(spark))
    out = bpe.decode(bpe.encode(df))
    assert all((r["text"] or "") == r["decoded"] for r in out.collect())
    assert set(df.columns) <= set(out.columns)


def test_round_trip_digests(spark, reference):
    for r in bpe.round_trip(documents(spark)).join(documents(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        ids = ids_of(reference, r["text"])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark)).count() == len(rows())
    assert bpe.round_trip(documents(spark, empty=True)).count() == 0


@pytest.mark.parametrize("ranked", [True, False])
def test_packing_ids_equal_the_library(reference, ranked):
    own = packing.Tokens(bpe.vocabulary_path())
    assert own.ranked is not None
    if not ranked:
        own.ranked = None
    for text in [*TRICKY, " " * 100_000, "é" * 50_001, "1^" * 40_000]:
        assert own.of(text).tolist() == ids_of(reference, text)


def pieces_hold(pieces, reference, texts, capacity=1024):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc, text in texts.items():
        ids = [*ids_of(reference, text), 0]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    waste = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= capacity
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste, sum(p["length"] for p in pieces)


def test_packing(spark, reference):
    texts = {r[0]: r[1] for r in rows() if r[0] not in (None, 12)}
    df = clashing(documents(spark).filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != 12)))
    pieces = packing.pack(df).collect()
    waste, tokens = pieces_hold(pieces, reference, texts)
    assert waste < 0.02 * tokens
    assert packing.pack(documents(spark, empty=True)).count() == 0
    everything = packing.pack(documents(spark)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] // r["t"] for r in everything}[12] == 2


def test_bins_leave_powers_of_two():
    bins = packing.Bins(1024, 0)
    for doc in range(50):
        bins.add(doc, bytes(4 * (doc * 37 % 900 + 1)))
    bins.finish()
    sizes = {}
    for _, _, length, _, _, sequence, _ in bins.take():
        sizes[sequence] = sizes.get(sequence, 0) + length
    assert all(n & (n - 1) == 0 for n in sizes.values()) and list(sizes.values()).count(1024) >= len(sizes) - 10


def test_bins_hold_as_many_documents_as_their_class():
    bins, r = packing.Bins(1024, 0), random.Random(3)
    for doc in range(3000):
        bins.add(doc, bytes(4 * r.randrange(1, 1024)))
    whole = {}
    for _, start, length, _, total, sequence, _ in bins.take():
        if length < 1024 and start + length == total:
            whole.setdefault(sequence, []).append(length)
    # the last piece of each document lies in a bin of its class, or has filled another bin's gap as a whole
    counts = [(max(1024 // n for n in sorted(own, reverse=True)[: len(own)]), len(own)) for own in whole.values()]
    assert sum(k == n for k, n in counts) > 0.6 * len(counts)


def test_capacity_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        packing.pack(None, path="x", capacity=1000)

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchledger.llm import jpeg, topk

from .fixtures import clashing, documents, rows


def brute(vectors, is_query, k=5):
    ready = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in ready:
        if not is_query(q):
            continue
        found = sorted((-sum(a * b for a, b in zip(ready[q], ready[c])), c) for c in ready if c != q)[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(found)}
    return out


@pytest.mark.parametrize("block,shard,part", [(4, 16, 3), (128, 16384, 2048)])
def test_top_k(spark, block, shard, part):
    r = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in r.integers(-3, 4, 6) / 256]) for i in range(120)]  # many ties
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (-5, [0.5] * 6)]
    df = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3))
    got = {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 10 == 0, block=block, shard=shard, part=part).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(vectors, lambda q: q % 10 == 0)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [])], schema), F.col("vec_id") == 0).collect()
    assert sorted(tuple(x) for x in few) == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512), (0, 3, 2, 0)]


@pytest.mark.parametrize("shard", [1, 2, 100])
def test_rows_of_one_id_are_all_candidates_and_queries(spark, shard):
    vectors = [(1, [2.0, 0.0]), (1, [9.0, 9.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") < 3, k=4, block=2, shard=shard).collect()))
    want = []
    for i, (q, a) in enumerate(vectors):
        if q < 3:
            found = sorted((-int(sum(256 * x * 256 * y for x, y in zip(a, b))), c) for j, (c, b) in enumerate(vectors) if j != i)[:4]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    assert got == sorted(want)
    assert {(2, 1, 1, 1179648), (2, 2, 1, 131072)} <= set(got)


def test_top_k_large_components(spark):
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate([[1, 3], [2_000_000, -1], [3, 2], [2.0**45, 0.5], [-(2.0**60), 7], [1e300, 1e-300], [0.001, -0.001], [2.0**52, 2.0**52]])]
    got = {tuple(x) for x in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, block=2, shard=3).collect()}
    exact = {i: [x * 256 // 1 if abs(x) < 2**40 else int(x) * 256 for x in v] for i, v in vectors}
    long = lambda x: max(-(2**63) + 1, min(2**63 - 1, int(x)))
    want = set()
    for q in exact:
        found = sorted((-long(sum(int(a) * int(b) for a, b in zip(exact[q], exact[c]))), c) for c in exact if c != q)[:5]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(found)}
    assert got == want


def test_pruning_skips_blocks_and_stays_exact():
    ids = np.arange(64)
    rows_ = np.zeros((64, 2), np.int64)
    rows_[:, 0] = ids
    blocks = [(ids[i : i + 8], rows_[i : i + 8], rows_[i : i + 8].max(0), rows_[i : i + 8].min(0), ids[i : i + 8]) for i in range(0, 64, 8)]
    who, score = topk.search(np.array([63]), np.array([[1, 0]]), blocks, 3)
    assert who.tolist() == [[62, 61, 60]] and score.tolist() == [[62, 61, 60]]
    seen = []
    topk.search(np.array([63]), np.array([[1, 0]]), blocks, 3, seen=seen)
    topk.search(np.array([99]), np.array([[1, 0]]), blocks, 3, np.array([62]), seen)
    assert seen == [(1, 8), (1, 8)]


def test_payloads_survive():
    for n in (0, 1, 575, 576, 577, 378, 5000, 70_000):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        stored = jpeg.payload_file(data)
        picture = jpeg.Picture(stored)
        assert jpeg.payload_of(picture) == data
        assert picture.rgb().shape == (picture.height, picture.width, 3)
    assert jpeg.payload_of(jpeg.Picture(jpeg.payload_file(bytes([255]) * 2000))) == bytes([255]) * 2000


def test_pictures_grow_wider_before_they_grow_too_high():
    n = 4 * 378 * 70
    for limit in (20, 4095):
        old, jpeg.DOWN = jpeg.DOWN, limit
        try:
            picture = jpeg.Picture(jpeg.payload_file(bytes(n)))
        finally:
            jpeg.DOWN = old
        assert jpeg.payload_of(picture) == bytes(n) and picture.height <= 16 * limit


def photo(spark, pixels, progressive=True):
    """A JPEG from the JVM's own encoder, and its decoder's pixels."""
    jvm = spark._jvm
    height, width, _ = pixels.shape
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    four = lambda n: int(n).to_bytes(4, "little")
    bmp = b"BM" + four(54 + height * row) + bytes(4) + four(54) + four(40) + four(width) + four(height) + b"\1\0\x18\0" + bytes(4) + four(height * row) + bytes(16) + body.tobytes()
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bmp))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(back, "bmp", out)
    raw = bytes(out.toByteArray())
    at = int.from_bytes(raw[10:14], "little")
    return data, np.frombuffer(raw[at:], np.uint8).reshape(height, row)[:, : width * 3].reshape(height, width, 3)[::-1, :, ::-1]


def test_photos_of_another_encoder(spark):
    y, x = np.mgrid[:83, :121]
    grey = np.repeat((128 + 100 * np.sin(x / 17) * np.cos(y / 23)).clip(0, 255).astype(np.uint8)[:, :, None], 3, 2)
    data, want = photo(spark, grey)
    assert np.abs(jpeg.decode_file(data).astype(int) - want).max() <= 1
    colour = np.stack([grey[:, :, 0], (128 + 90 * np.cos(x / 31 + y / 19)).astype(np.uint8), (2 * y + x * 0.3).clip(0, 255).astype(np.uint8)], 2)
    data, want = photo(spark, colour)
    assert np.abs(jpeg.decode_file(data).astype(int) - want).mean() < 2.5  # the other decoder smooths chroma
    media = spark.createDataFrame([(1, data), (2, photo(spark, grey, False)[0]), (3, b"no picture"), (4, None), (5, data[:400])], "id int, media binary")
    got = {r["id"]: r for r in jpeg.to_tensors(media).collect()}
    assert (got[1]["height"], got[1]["width"]) == (83, 121) and len(got[1]["rgb"]) == 83 * 121 * 3
    assert all(got[i]["rgb"] is None for i in (2, 3, 4, 5))


def test_media_digests(spark):
    stored = jpeg.to_media(clashing(documents(spark)))
    got = {}
    for r in jpeg.digests(stored).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows())
    for i, text, *_ in rows():
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[i][0]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert got[6][0]["feature"] == got[7][0]["feature"] and got[6][0]["media_sha256"] == got[7][0]["media_sha256"]
    assert jpeg.digests(jpeg.to_media(documents(spark, empty=True))).count() == 0

import collections
import hashlib

import pytest

import corpus_pipeline

from .fixtures import clashing, documents, prose, rows
from .test_dedup import brute_groups, brute_strings
from .test_tokens import pieces_hold, reference  # noqa: F401


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with repeats, near copies, junk, a row without id, and different texts with one doc_id."""
    data = [(i, prose(i, 120), "en", "a", 0) for i in range(40)]
    lines = prose(7, 30) + "\nsecond line of it\nthird line of it\nfourth line of it"
    data += [(50, lines, "en", "a", 0), (51, prose(99, 20) + "\nsecond line of it\nthird line of it\nfourth line of it", "en", "b", 0)]
    data += [(60, data[3][1].replace("river", "creek", 1), "en", "b", 0), (61, prose(500, 40) + " " + data[4][1][:200] + " " + prose(501, 40), "en", "b", 0)]
    data += [(70, None, "en", "a", 0), (71, "", "en", "a", 0), (72, "12 34 !", "en", "a", 0), (73, "4f9a0c77e1b2" * 30, None, "a", 0)]
    data += [(80, prose(800, 50), "en", "a", 0), (80, prose(801, 50), "en", "a", 0), (80, prose(801, 50), "en", "a", 0), (None, prose(802, 50), "en", "a", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return data, clashing(df.repartition(3))


def test_stages(spark, corpus, reference):  # noqa: F811
    data, docs = corpus
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), "doc_id long, text string, lang string, source string, n_chars long")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = [tuple(x)[:2] for x in docs.collect()]
    first = collections.Counter(kept["language_id"])
    assert first == collections.Counter((r[0], r[1]) for r in data if r[0] not in (70, 71, 72, 73))
    by = dict(kept["line_dedup"])
    assert by[51] == prose(99, 20) and "second" in by[50]
    before, after = kept["line_dedup"], kept["near_dedup"]
    groups = brute_groups([(i, t) for i, t in before if i not in (None, 80)], 5)
    assert {i for i, _ in after} == {i for i, (_, c) in groups.items() if i == c} | {80, None}
    assert len([1 for i, _ in after if i == 80]) == 2 and 60 not in dict(after)
    order = sorted((x for x in after if x[0] not in (None, 80)))
    want = brute_strings(order, 100)
    got = dict(x for x in kept["suffix_dedup"] if x[0] not in (None, 80))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == {i: w[3] for i, w in want.items() if w[2] == 0 or w[1] < w[0]}
    pieces = [x for x in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()]
    waste, _ = pieces_hold(pieces, reference, got)
    assert waste == 0


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    clashing(documents(spark)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    documents(spark, empty=True).write.parquet(f"{tmp_path}/none/documents.parquet")
    found = {x["doc_id"] for x in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert found <= {r[0] for r in rows()} and 5 in found and not found & {2, 3, 4, 9}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_entries(spark, tmp_path):
    """The registered queries on a small table: columns and folds of their contracts."""
    import zlib

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for name, mod, fold, columns in (
        ("op1_lm_scoring", 5, 1, "doc_id held_out n_tokens n_known train_tokens base_score score"),
        ("op3_toxicity", 5, 0, "doc_id held_out score predicted"),
        ("op5_language_id", 4, 2, "doc_id held_out lang_pred score"),
    ):
        got = entry.queries()[name](spark, folder).collect()
        assert set(columns.split()) <= set(got[0].asDict()) and len(got) == len(docs)
        assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % mod == fold) for x in got)
    back = entry.queries()["op8_progressive_jpeg"](spark, folder).collect()
    for x in back:
        data = (docs[x["doc_id"]] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in entry.queries()["op7_suffix_array"](spark, folder).collect()}
    assert got == brute_strings(list(docs.items()), 100)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in entry.queries()["op9_minhash"](spark, folder).collect()}
    assert got == brute_groups(list(docs.items()), 2)

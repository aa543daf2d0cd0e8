"""A corpus from raw documents to packed sequences: five stages, each written and read again before the next.

Language ID drops documents without a letter, and those whose bytes read as text of no language that it learnt; line dedup removes later copies of
three consecutive lines; MinHash near-dedup keeps the smallest doc_id of each group of near copies (five-word shingles,
similarity 0.8); suffix-array dedup removes later copies of 100 bytes; packing cuts what is left into sequences. Documents
that dedup leaves nothing of go. Rows without doc_id stay in near-dedup, and so do different texts of one doc_id that is kept;
equal rows of it leave one. Null texts go in the first stage. An empty table gives no rows, and other columns go. All stages but the last return the columns of ``documents``, with n_chars up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchledger.llm import langid, lines, near, packing, suffixes
from matchledger.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can't express the language model, the tokens or the bytes that the stages work on.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs.select(*COLUMNS), langid.train(docs, other=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(docs.select(*COLUMNS))
    return _columns(kept.filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    kept = near.groups(docs, shingle=5).filter("kept AND doc_id IS NOT NULL").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _columns(named.unionByName(docs.filter("doc_id IS NULL")))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(suffixes.deduped(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Record files: one document a file, read with a fixed schema. What doesn't fit becomes an issue row, never an exception."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def scan(spark: SparkSession, *folders: str, pattern: str = "*.json") -> DataFrame:
    """path and content of the files of some folders (globs are fine); folders inside them are not read. Spark's readers
    skip empty files, which here are records too: their names come from the listing that the driver holds anyway."""
    source = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(folders))
    one = lambda c: F.regexp_replace(c, "^([a-z0-9]+):///(?=[^/])", "$1:/").alias("path")  # noqa: E731  file:///x is file:/x
    path = one("_metadata.file_path")
    names = spark.createDataFrame([(name,) for name in source.inputFiles()], "path string").select(one("path"))
    empty = names.join(source.select(path), "path", "left_anti").select("path", F.lit("").alias("content"))
    return source.select(path, F.col("content").cast("string").alias("content")).unionByName(empty)


def from_yaml(files: DataFrame) -> DataFrame:
    """The same files with their YAML as JSON. Dates stay texts; a file that isn't YAML gets null content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        class Loader(yaml.SafeLoader):
            """Without timestamps."""

        Loader.yaml_implicit_resolvers = {k: [(tag, p) for tag, p in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def converted(content: str | None) -> str | None:
            try:
                return json.dumps(yaml.load(content or "", Loader), ensure_ascii=False)
            except (yaml.YAMLError, TypeError, ValueError):
                return None

        for batch in batches:
            yield batch.assign(content=batch["content"].map(converted))

    return files.select("path", "content").mapInPandas(run, "path string, content string")


def unknown_keys(value: Column, kind: T.DataType, at: str = "") -> Column:
    """Keys of a JSON text that its schema lacks, at any depth, as dotted paths."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        keys = F.coalesce(F.json_object_keys(value), none)
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, kind.names)).cast("array<string>")), lambda k: F.concat(F.lit(at), k))
        deeper = [unknown_keys(F.get_json_object(value, f"$['{f.name}']"), f.dataType, f"{at}{f.name}.") for f in kind if isinstance(f.dataType, T.StructType | T.ArrayType)]
        return F.concat(extra, *deeper)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        items = F.coalesce(F.from_json(value, "array<string>"), none)
        return F.array_distinct(F.flatten(F.transform(items, lambda x: unknown_keys(x, kind.elementType, at))))
    return none


def parsed(files: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records with their path, issues: path, field, message). A file with an issue gives no record."""
    whole = T.StructType([*schema, T.StructField(BROKEN, T.StringType())])
    read = F.from_json("content", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = files.select("path", "content", read.alias("_r"))
    note = lambda field, message: F.struct(field.alias("field"), F.lit(message).alias("message"))
    broken = F.col("_r").isNull() | F.col(f"_r.{BROKEN}").isNotNull() | F.json_object_keys("content").isNull()
    missing = F.array_compact(F.array(*(F.when(F.col(f"_r.{c}").isNull(), note(F.lit(c), "required")) for c in required))) if required else None
    unknown = F.transform(unknown_keys(F.col("content"), schema), lambda k: note(k, "unknown key"))
    found = F.when(broken, F.array(note(F.lit(""), "unreadable")))
    rows = rows.withColumn("_issues", found.otherwise(F.concat(unknown, missing) if required else unknown))
    records = rows.filter(F.size("_issues") == 0).select("path", *(F.col(f"_r.{c}").alias(c) for c in schema.names))
    return records, rows.select("path", F.explode("_issues").alias("_i")).select("path", "_i.field", "_i.message")


def misplaced(records: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Issues of records whose path disagrees with them: the groups of ``pattern`` must equal the columns, in order."""
    wrong = [F.when(~F.regexp_extract("path", pattern, i + 1).eqNullSafe(F.col(c).cast("string")), F.struct(F.lit(c).alias("field"), F.lit("disagrees with its path").alias("message"))) for i, c in enumerate(columns)]
    return records.select("path", F.explode(F.array_compact(F.array(*wrong))).alias("_i")).select("path", "_i.field", "_i.message")


def snapshots(spark: SparkSession, base: str, head: str, schema: T.StructType, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Records of two folders of one shape, with paths inside them, for the audits in ``operators.provenance``."""
    return tuple(parsed(scan(spark, folder, pattern=pattern), schema)[0].withColumn("path", F.regexp_extract("path", "[^/]+$", 0)) for folder in (base, head))

"""JSON-lines tables and small files around them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corvane.operators.joins import last_wins

# Fixed value: the stories taken of the one public data set that is cut.
TINY_STORIES = 500_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system the session knows is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line must parse; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_strict(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_with_errors(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All lines, those that don't parse in a column _corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def indexed(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in file order."""
    return last_wins(df, key, order)


def lookup(df: DataFrame, version: str, key: str, value: str) -> DataFrame:
    """The row of one key in one version; both tests reach the scan."""
    return df.where((F.col("version") == version) & (F.col(key) == value))


def capped(df: DataFrame, text: str, least_chars: int = 50, most: int | None = None) -> DataFrame:
    """A public data set with its short rows left out; of one whose definition has a cap, as ``TINY_STORIES``, at most ``most`` rows are kept."""
    kept = df.where(F.length(F.trim(F.col(text))) >= least_chars)
    return kept if most is None else kept.limit(most)


def replacement_rules(path: str) -> list[tuple[str, str]]:
    """An ordered list of (pattern, replacement) from a JSON object; empty where there is no file."""
    p = Path(path)
    return list(json.loads(p.read_text(encoding="utf-8")).items()) if p.exists() else []


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, lines) of each file."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("lines"))

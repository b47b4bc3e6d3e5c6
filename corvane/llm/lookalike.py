"""Texts that look the same but differ in their characters.

``canonical_text`` brings a text column into one consistent form (see ``codepoints``); ``lookalike_pairs`` lists
rows whose texts look the same without being the same string.

Defined cases: a null text stays null; empty and blank texts come out empty (line breaks stay) and are in no pair; rows delivered
twice (same key, same text) count once; a key is never paired with itself; extra columns pass through untouched;
an empty table gives an empty result. Texts of any length are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.codepoints import canonical_column
from corvane.session import cut, ship, spread

FORM = "canonical_form"


def canonical_text(df: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
    """df with the consistent form of ``text`` in ``out`` (default: in place of ``text``). One pass, no shuffle."""
    ship(df.sparkSession)
    out = out or text
    columns = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = canonical_column(b.column(b.schema.names.index(text)))
            arrays = [b.column(b.schema.names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, form], names=[*columns, out])

    return df.mapInArrow(run, schema).select([out if c == out else c for c in [*df.columns, *([out] if out not in df.columns else [])]])


def lookalike_pairs(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """(key_a, key_b) with key_a < key_b: different rows that look the same but aren't the same string.

    Only two 128-bit digests of a text are shuffled, never the text. Forms with one spelling fall out in an
    aggregation that combines before its shuffle, so copies of one string, however many, meet no join. The join is
    left to skew handling at run time: its output is the listing itself.
    """
    rows = canonical_text(spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull())), "t", FORM)
    digests = cut(rows.where(F.length(F.trim(F.regexp_replace(FORM, "\n", ""))) > 0).select(
        "k", F.unhex(F.md5(FORM)).alias("form"), F.unhex(F.md5("t")).alias("raw")
    ).distinct())  # texts are read once
    several = digests.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    inside = digests.join(several, "form", "left_semi")
    a = inside.select("form", F.col("k").alias("a"), F.col("raw").alias("raw_a"))
    b = inside.select("form", F.col("k").alias("b"), F.col("raw").alias("raw_b"))
    pairs = a.join(b, "form").where("raw_a <> raw_b and a < b")
    return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")).distinct()

"""Lines repeated across the documents of one source: fixed-depth token trees with wildcard slots, merged over partitions.

Every line is brought into the consistent character form, lower-cased and cut into words, and each run of digits
becomes a wildcard slot. A partition parses its lines into trees, one per source: the first level branches on the
number of words, the next ``DEPTH`` levels on the leading words, and a leaf holds the templates below that path with
the number of documents they cover. Trees are merged by path and template: the partial counts are added in an
aggregation that combines before its shuffle, so a source that holds a third of all rows costs no more than others.

A merged count can only be too high (a document delivered twice counts twice), so templates below the thresholds are
out for good; for the few left over the documents are counted exactly. The number of those is bounded per source:
each covers at least ``min_share`` of the documents, so there are at most (lines per document) / min_share of them.
They are joined back by digest; the join is a shuffle unless the optimizer's own size check allows a broadcast.

Defined cases: rows without a source (null or empty array, or null first entry) have no repeated lines and keep their text; null and
empty texts stay as they are but count as documents of their source; a key delivered twice counts once; lines of
fewer than ``min_words`` words are never removed; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.codepoints import FEED, canonical, decode, encode
from corvane.session import ship, spread

DEPTH = 3
MIN_WORDS, MIN_DOCUMENTS, MIN_SHARE = 4, 4, 0.05
FLUSH = 200_000
SLOT = "<*>"
DIGITS = re.compile(r"\d+")


class TokenTree:
    """Templates of one source: word count, then the first words, then the leaf."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.root, self.size = depth, {}, 0

    def leaf(self, words: list[str]) -> dict:
        node = self.root.setdefault(len(words), {})
        for w in words[: self.depth]:
            node = node.setdefault(w, {})
        return node

    def add(self, words: list[str], template: str, document: int) -> None:
        leaf = self.leaf(words)
        seen = leaf.get((template,))
        if seen is None:
            leaf[(template,)] = [1, document]
            self.size += 1
        elif seen[1] != document:  # a line twice in one document covers it once
            seen[0] += 1
            seen[1] = document

    def templates(self) -> Iterator[tuple[str, int]]:
        stack = [self.root]
        while stack:
            for k, v in stack.pop().items():
                if isinstance(k, tuple):
                    yield k[0], v[0]
                else:
                    stack.append(v)


def line_forms(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The lines of all texts in canonical form and lower case, and how many lines each text has. Lines are the pieces between line feeds of the text as stored."""
    points, rows = decode(texts)
    # each line becomes a row of its own, so that separators of other kinds don't shift the numbering
    feed = points == FEED
    count = np.diff(np.concatenate([[0], np.cumsum(feed)])[rows]) + 1
    line_rows = np.sort(np.concatenate([rows[:-1], np.flatnonzero(feed) + 1, rows[-1:]]))
    points, line_rows = canonical(points, line_rows)
    return [x.lower() for x in encode(points, line_rows).to_pylist()], count


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _parsed(texts: pa.Array, min_words: int) -> Iterator[tuple[int, int, list[str], str]]:
    """(row, line number, words, template) of every line with enough words."""
    lines, count = line_forms(texts)
    at = 0
    for row, n in enumerate(count.tolist()):
        for k in range(n):
            words = DIGITS.sub(SLOT, lines[at + k]).split()
            if len(words) >= min_words:
                yield row, k, words, " ".join(words)
        at += n


def repeated_lines(
    df: DataFrame, key: str = "seq", text: str = "text", source: str = "categories",
    min_words: int = MIN_WORDS, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, depth: int = DEPTH,
) -> DataFrame:
    """(key, line_no): lines whose template covers enough documents of their source. An array source counts by its first entry."""
    ship(df.sparkSession)
    is_array = isinstance(df.schema[source].dataType, T.ArrayType)
    first = F.get(source, F.lit(0)) if is_array else F.col(source)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), first.cast("string").alias("s")).where("k is not null and s is not null")
    texts = spread(rows.where("t is not null and t <> ''"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, TokenTree] = {}
        size = document = 0

        def flush() -> pa.RecordBatch:
            out = [(s, _digest(t), n) for s, tree in trees.items() for t, n in tree.templates()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())],
                names=["s", "template", "n"],
            )

        for b in batches:
            sources = b.column("s").to_pylist()
            for row, _, words, template in _parsed(b.column("t"), min_words):
                trees.setdefault(sources[row], TokenTree(depth)).add(words, template, document + row)
            document += len(sources)
            size = sum(t.size for t in trees.values())
            if size > FLUSH:  # bounds a worker's memory; partial trees merge later
                yield flush()
                trees = {}
        yield flush()

    partial = texts.select("k", "t", "s").mapInArrow(parse, "s string, template binary, n bigint")
    per_source = rows.groupBy("s", "k").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count("*").alias("documents"))
    merged = partial.groupBy("s", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents)
    enough = lambda n: (F.col(n) >= min_documents) & (F.col(n) >= min_share * F.col("documents"))
    likely = merged.join(per_source, "s").where(enough("n")).select("s", "template", "documents")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sources = b.column("k"), b.column("s")
            found = [(row, k, _digest(t)) for row, k, _, t in _parsed(b.column("t"), min_words)]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys.take(at), sources.take(at), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())],
                names=["k", "s", "line_no", "template"],
            )

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("s", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("template", T.BinaryType())])
    inside = texts.mapInArrow(places, schema).join(likely, ["s", "template"]).select("k", "s", "line_no", "template", "documents").distinct()
    exact = inside.groupBy("s", "template", "documents").agg(F.count_distinct("k").alias("n")).where(enough("n")).select("s", "template")
    return inside.join(exact, ["s", "template"], "left_semi").select(F.col("k").alias(key), "line_no").distinct()


def without_repeated_lines(df: DataFrame, key: str = "seq", text: str = "text", source: str = "categories", **how) -> DataFrame:
    """df with the repeated lines taken out of ``text``; all else stays, the order of the kept lines too. Rows with a null key are kept as they are."""
    drop = repeated_lines(df, key, text, source, **how).groupBy(key).agg(F.collect_set("line_no").alias("__drop"))
    joined = df.join(drop, key, "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    return joined.withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(kept)).select(*df.columns)

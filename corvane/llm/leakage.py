"""Evaluation passages inside training text: suffix arrays of the training side, searched with every test suffix.

Each shard (a block of documents inside a task) keeps its words as one array of ids and sorts the suffixes of that
array. Every suffix of every test item is looked up by binary search, all of them in lockstep; the run of equal
suffixes gives the places of verbatim matches, which are then extended to the longest match. A suffix that meets a
word no test item has within the shortest passage can't match and isn't sorted; nothing else is left out.

Documents aren't shuffled: the test side goes to them. It is read in blocks of at most ``BLOCK_WORDS`` words, one
pass over the documents per block, so what is broadcast is bounded however many test items there are.

Words are maximal runs of letters and digits, lower-cased. Defined cases: null and empty texts on either side match nothing;
items shorter than the passage length match nothing; test rows with a null key are left out; repeated rows of either
side come out once; an empty side gives an empty result; other columns don't reach the operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.session import ship, spread

WORDS = re.compile(r"[^\W_]+").findall
MIN_WORDS = 12
BLOCK_WORDS = 2_000_000
SHARD_CHARS = 8_000_000


def _suffixes(tokens: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes with at least ``depth`` known words ahead inside their text, sorted by those words."""
    n = len(tokens)
    if n < depth:
        return np.zeros(0, np.int64)
    bad = np.zeros(n + 1, np.int64)
    np.cumsum(tokens == 0, out=bad[1:])
    at = np.arange(n - depth + 1)
    at = at[(bad[at + depth] == bad[at]) & (ends[at] >= at + depth)]
    return at[np.lexsort([tokens[at + k] for k in range(depth - 1, -1, -1)])]


def _bound(tokens: np.ndarray, order: np.ndarray, tests: np.ndarray, starts: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """Binary search of all test suffixes at once in the sorted suffixes."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while (lo < hi).any():
        on = np.flatnonzero(lo < hi)
        mid = (lo[on] + hi[on]) // 2
        a, b = order[mid], starts[on]
        sign = np.zeros(len(on), np.int64)
        for k in range(depth):
            open_ = np.flatnonzero(sign == 0)
            if not len(open_):
                break
            sign[open_] = np.sign(tokens[a[open_] + k] - tests[b[open_] + k])
        down = (sign < 0) | (right & (sign == 0))
        lo[on[down]] = mid[down] + 1
        hi[on[~down]] = mid[~down]
    return lo


def matches(tokens: np.ndarray, ends: np.ndarray, tests: np.ndarray, test_ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (training, test) of verbatim matches that can't be extended to the left, and their full lengths in words."""
    order = _suffixes(tokens, ends, depth)
    starts = np.arange(len(tests))
    starts = starts[test_ends >= starts + depth]
    lo = _bound(tokens, order, tests, starts, depth, False)
    hi = _bound(tokens, order, tests, starts, depth, True)
    size = hi - lo
    b = np.repeat(starts, size)
    a = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
    # left-maximal ones only: the word before differs or one of the texts begins here
    inside = (a > 0) & (b > 0)
    pa_, pb = np.maximum(a - 1, 0), np.maximum(b - 1, 0)
    cont = inside & (ends[pa_] == ends[a]) & (test_ends[pb] == test_ends[b]) & (tokens[pa_] == tests[pb])
    a, b = a[~cont], b[~cont]
    length = np.full(len(a), depth)
    on = np.arange(len(a))
    while len(on):
        x, y = a[on] + length[on], b[on] + length[on]
        ok = (x < ends[a[on]]) & (y < test_ends[b[on]])
        on, x, y = on[ok], x[ok], y[ok]
        on = on[tokens[x] == tests[y]]
        length[on] += 1
    return a, b, length


def _flat(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in one array, the end of each position's text, and each position's text."""
    size = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((x for t in texts for x in t), np.int64, int(size.sum()))
    return ids, np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(texts)), size)


def _test_blocks(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    block, n = [], 0
    for row in items.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).distinct().toLocalIterator():
        words = WORDS(row[1].lower())
        if block and n + len(words) > limit:
            yield block
            block, n = [], 0
        block.append((row[0], words))
        n += len(words)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item, words, doc_word, item_word): per document and leaked item the longest verbatim match of at least ``min_words`` words and where it starts in both."""
    spark = ship(docs.sparkSession)
    schema = T.StructType([
        docs.schema[key], items.schema[item],
        T.StructField("words", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("item_word", T.IntegerType()),
    ])
    names, types = schema.names, [None, None, pa.int32(), pa.int32(), pa.int32()]
    out = spark.createDataFrame([], schema)
    for block in _test_blocks(items, item, text, block_words):
        vocabulary: dict[str, int] = {}
        test_ids, test_ends, test_of = _flat([[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] for _, words in block])
        shared = spark.sparkContext.broadcast((vocabulary, test_ids, test_ends, test_of, [k for k, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, tests, test_ends, test_of, item_keys = shared.value
            get = vocabulary.get
            for b in batches:
                keys, texts = b.column(0), b.column(1)
                chars = np.cumsum(np.asarray(pa.compute.utf8_length(texts).fill_null(0)))
                at = 0
                while at < len(keys):  # shards of whole documents
                    to = max(at + 1, int(np.searchsorted(chars, (int(chars[at - 1]) if at else 0) + SHARD_CHARS, "right")))
                    tokens, ends, doc = _flat([[get(w, 0) for w in WORDS(t.lower())] if t else [] for t in texts.slice(at, to - at).to_pylist()])
                    x, y, length = matches(tokens, ends, tests, test_ends, min_words)
                    if len(x):
                        d, i = doc[x], test_of[y]
                        order = np.lexsort((y, x, -length, i, d))
                        d, i, x, y, length = d[order], i[order], x[order], y[order], length[order]
                        first = np.ones(len(d), bool)
                        first[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
                        d, i, x, y, length = d[first], i[first], x[first], y[first], length[first]
                        doc_start, test_start = np.searchsorted(doc, d), np.searchsorted(test_of, i)
                        yield pa.RecordBatch.from_arrays([
                            keys.take(pa.array(d + at)), pa.array([item_keys[k] for k in i.tolist()]),
                            pa.array(length, types[2]), pa.array(x - doc_start, types[3]), pa.array(y - test_start, types[4]),
                        ], names=names)
                    at = to

        out = out.unionByName(spread(docs.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())).mapInArrow(run, schema))
    # rows come one per delivered row; a document delivered twice is listed once
    best = F.max_by(F.struct("words", "doc_word", "item_word"), F.struct("words", -F.col("doc_word"), -F.col("item_word")))
    return out.groupBy(key, item).agg(best.alias("m")).select(key, item, "m.words", "m.doc_word", "m.item_word")


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The documents that hold no passage of a test item; all columns stay. A row with a null key stays, as nothing leads from it to a test item."""
    return docs.join(leaks(docs, items, key=key, **how).select(key).distinct(), key, "left_anti")

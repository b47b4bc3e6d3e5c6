"""Shingle sets and min-hashes of text columns, computed on whole Arrow batches with arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.session import ship, spread

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
PART = 1000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int, least: int) -> list[np.ndarray | None]:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of each lower-cased text; None for texts of fewer than ``least`` words."""
    parts = [t.lower().split() if t else [] for t in texts]
    flat = pd.util.hash_array(np.array([w for p in parts for w in p] or [""], dtype=object), categorize=True)
    runs = np.zeros(max(len(flat) - words + 1, 0), np.uint64)
    for k in range(words):
        runs = mixed(runs * _MIX[1] + flat[k : k + len(runs)] * _MIX[0] + np.uint64(k + 1))
    out, at = [], 0
    for p in parts:
        out.append(np.unique(runs[at : at + len(p) - words + 1]) if len(p) >= max(least, words) else None)
        at += len(p)
    return out


def family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n fixed hash functions: odd multipliers and offsets."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(values: np.ndarray, starts: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """(n, sets): the least value of each hash function over each set; values holds the sets end to end, none of them empty."""
    mul, add = family(n, seed)
    out = np.empty((n, len(starts)), np.uint64)
    for i in range(n):
        out[i] = np.minimum.reduceat(mixed(values * mul[i] + add[i]), starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): one key for each run of ``rows`` min-hashes."""
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], sig.shape[1], axis=1)
    for r in range(rows):
        key = mixed(key * _MIX[2] + sig[r : bands * rows : rows])
    return key.T


def shingled(df: DataFrame, key: str, text: str, words: int, least: int) -> DataFrame:
    """(k, set): rows whose text has at least ``least`` words, with the sorted hashes of its shingles."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                sets = shingle_sets(part.column(1).to_pylist(), words, least)
                on = [i for i, s in enumerate(sets) if s is not None]
                kept = [sets[i] for i in on]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                flat = (np.concatenate(kept) if kept else np.zeros(0, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["k", "set"])

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("set", T.ArrayType(T.LongType()))])
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return spread(rows).mapInArrow(run, schema)


def banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(k, band): a row per band of each node (k, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                lists = part.column(1)
                starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
                keys = band_keys(signatures(np.asarray(lists.flatten()).view(np.uint64), starts, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), bands))), pa.array(keys.ravel().view(np.int64))], names=["k", "band"])

    schema = T.StructType([nodes.schema["k"], T.StructField("band", T.LongType())])
    return nodes.select("k", "set").mapInArrow(run, schema)

"""Encoding of a text column with a public byte-level BPE vocabulary, by replaying its merges over a corpus.

The words of a block of documents are laid end to end as one array of symbols. An inverted index leads from every
adjacent pair of symbols to the positions where it stands. The merges are applied in rank order, each to all its
positions at once, and only the pairs that touch a merged position are looked up again. So every distinct word is
encoded once per block, whatever its frequency; documents then gather the ids of their words.

Blocks bound the memory of a worker: a block ends at ``BLOCK_CHARS`` characters, and ids of words carry over between
blocks up to ``CARRY`` words, after which the store starts afresh. Nothing is shuffled. What is broadcast is the
vocabulary, whose size is that of the file, not of the data.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; white space of any
kind is text; other columns don't reach the operator.
"""

from __future__ import annotations

import heapq
import importlib.util
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corvane.session import ship, spread

# Fixed value: the public vocabulary's pattern that splits text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 4_000_000
CARRY = 300_000


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a public vocabulary lies: in ``folder``, or in the installed package of public tokenizers."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's file: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


def load_merges(path: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Ids of the 256 bytes, and pair of ids (packed in one int) -> (rank, id of the merged symbol)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
    return [vocab[x] for x in byte_letters()], merges


def replay(words: list[bytes], byte_ids: list[int], merges: dict[int, tuple[int, int]]) -> list[list[int]]:
    """Ids of each word. All merges run in rank order over all words at once."""
    ids = np.array(byte_ids, dtype=np.int64)
    size = [len(w) for w in words]
    symbols = ids[np.frombuffer(b"".join(words), np.uint8)].tolist() if sum(size) else []
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = 0
    for s in size:  # links don't cross words
        if s:
            before[at] = -1
            after[at + s - 1] = -1
            at += s
    index: dict[int, list[int]] = {}
    for p in range(n):
        if (q := after[p]) >= 0:
            index.setdefault(symbols[p] << 32 | symbols[q], []).append(p)
    heap = [(merges[pair][0], pair) for pair in index if pair in merges]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        left, right, new = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
        positions = index.pop(pair)
        if left == right:
            positions.sort()
        for p in positions:
            q = after[p]
            if symbols[p] != left or q < 0 or symbols[q] != right:
                continue  # an earlier merge took one of the two
            symbols[p], symbols[q] = new, -1
            r = after[p] = after[q]
            if r >= 0:
                before[r] = p
                k = new << 32 | symbols[r]
                if k in merges:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(heap, (merges[k][0], k))
            if (o := before[p]) >= 0:
                k = symbols[o] << 32 | new
                if k in merges:
                    if k in index:
                        index[k].append(o)
                    else:
                        index[k] = [o]
                        heapq.heappush(heap, (merges[k][0], k))
    out, at = [], 0
    for s in size:
        out.append([x for x in symbols[at : at + s] if x >= 0])
        at += s
    return out


class Encoder:
    """Encodes blocks of texts; keeps the ids of words between blocks."""

    def __init__(self, byte_ids: list[int], merges: dict[int, tuple[int, int]]):
        self.byte_ids, self.merges = byte_ids, merges
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CARRY:
            self.known = {}
        fresh = list({w for p in parts for w in p} - self.known.keys())
        self.known |= zip(fresh, replay([w.encode("utf-8", "surrogatepass") for w in fresh], self.byte_ids, self.merges))
        known, flat, offsets = self.known, [], np.zeros(len(texts) + 1, np.int32)
        for i, p in enumerate(parts):
            for w in p:
                flat += known[w]
            offsets[i + 1] = len(flat)
        return np.array(flat, np.int32), offsets


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text by the byte-level vocabulary in the file ``vocabulary``."""
    spark: SparkSession = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast(load_merges(vocabulary or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in batches:
            keys, column = b.column(0), b.column(1)
            length = np.cumsum(np.asarray(pa.compute.utf8_length(column).fill_null(0)))
            at = 0
            while at < len(keys):  # blocks of whole documents
                base = int(length[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(length, base + BLOCK_CHARS, "right")))
                flat, offsets = encoder.encode(column.slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])
                at = to

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)

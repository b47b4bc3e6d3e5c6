"""Near-duplicate rows through a Gray-order hierarchical index on fingerprints.

1. Rows with the same set of word runs (shingles) are one class; only one representative of a class goes on.
2. A representative gets ``SEGMENTS`` segments of ``ROWS`` min-hashes each and a sketch of ``BITS`` one-bit min-hashes. Two sets of
   similarity J agree on a segment with probability J**ROWS and differ in about (1-J)/2 of the sketch bits.
3. The index holds each fingerprint once per segment, rotated so that this segment leads. The leading segment is the
   top of the hierarchy: fingerprints whose leading segments differ are pruned from each other as whole groups.
   Below it, a group's sketches are sorted by Gray rank, so neighbours share long bit patterns; the pattern and the
   mask of bits shared by a node's members are factored into the node, level by level.
4. The join descends from pairs of upper nodes: the differences found on masked bits accumulate on the way down, and
   a pair of nodes is pruned with all their members once they exceed ``MAX_DIFFERENCES``.
5. Pairs of representatives left over are checked exactly on their shingle sets.

At J = 0.7 (three-word runs, the lowest similarity asked for) a pair is missed by all 28 segments with probability
(1-0.343)**28 = 8e-6 and by the sketch limit with less than 1e-4; recall against brute force is in the tests.

Groups larger than ``BLOCK`` are split into blocks and joined block by block, each pair of blocks in a task of its own
choosing, so a hot group never sits in one task. Nothing is collected or capped.

Defined cases: null and empty texts and texts of fewer than ``min_words`` words are in no pair; a key delivered more
than once counts once per different text and never pairs with itself; rows with a null key are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.functions.minhash import band_keys, mixed, shingle_sets, signatures
from corvane.session import cut, ship, spread

SEGMENTS, ROWS, BITS = 28, 3, 128
MAX_DIFFERENCES = 38
BLOCK = 1024
FANOUT = 4
PART, PAIRS, SEED = 1000, 1_000_000, 20240301
SKETCH = [f"w{i}" for i in range(BITS // 64)]


def fingerprint(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments as int64 (n, SEGMENTS), sketches as uint64 (n, BITS / 64)) of the sets that lie end to end in values. A segment's number is part of its key, so one table holds all rotations."""
    low = signatures(values, starts, max(SEGMENTS * ROWS, BITS), SEED)
    bits = (mixed(low[:BITS] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8)
    sketch = np.packbits(bits.T.copy(), axis=1).view(">u8").astype(np.uint64)
    return band_keys(low, SEGMENTS, ROWS).view(np.int64), sketch


def gray_order(group: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Order of the rows by group, then by the Gray rank of the sketch (prefix XOR over all its words)."""
    rank = sketch.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    for w in range(1, rank.shape[1]):  # the parity of the words before flips the whole word
        odd = (rank[:, w - 1] & np.uint64(1)).astype(bool)
        rank[odd, w] = ~rank[odd, w]
    return np.lexsort([rank[:, w] for w in range(rank.shape[1] - 1, -1, -1)] + [group])


def _differences(pat: np.ndarray, mask: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count((pat[i] ^ pat[j]) & mask[i] & mask[j]).sum(axis=1).astype(np.int64)


def close_pairs(group: np.ndarray, sketch: np.ndarray, limit: int = MAX_DIFFERENCES) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j (rows already in gray_order) of one group whose sketches differ in at most ``limit`` bits, by the hierarchy over all groups at once."""
    n = len(group)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # levels, leaves first: pattern, mask of shared bits, group, first child, number of children
    levels = [(sketch, np.full_like(sketch, ~np.uint64(0)), group, np.arange(n), np.ones(n, np.int64))]
    while True:
        pat, mask, grp = levels[-1][:3]
        new = np.ones(len(grp), bool)
        new[1:] = grp[1:] != grp[:-1]
        first = np.flatnonzero(new)
        within = np.arange(len(grp)) - np.repeat(first, np.diff(np.append(first, len(grp))))
        heads = np.flatnonzero(within % FANOUT == 0)
        if len(heads) == len(grp):
            break
        ones = np.bitwise_and.reduceat(pat, heads)
        any_ = np.bitwise_or.reduceat(pat, heads)
        shared = np.bitwise_and.reduceat(mask, heads) & ~(ones ^ any_)
        levels.append((ones & shared, shared, grp[heads], heads, np.diff(np.append(heads, len(grp)))))
        if (np.diff(grp[heads]) != 0).all():
            break
    top = len(levels[-1][0])
    i = j = np.arange(top)  # every top node is the root of its group, or a lone one
    for depth in range(len(levels) - 1, 0, -1):
        pat, mask, _, child, size = levels[depth]
        # expand to pairs of children, each unordered pair once
        cnt = size[i] * size[j]
        rep = np.repeat(np.arange(len(i)), cnt)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        x, y = child[i[rep]] + k // size[j[rep]], child[j[rep]] + k % size[j[rep]]
        ok = x <= y
        if depth == 1:
            ok &= x != y
        x, y = x[ok], y[ok]
        pat, mask = levels[depth - 1][:2]
        near = _differences(pat, mask, x, y) <= limit  # a child's mask holds its parent's, so the count has all accumulated differences
        i, j = x[near], y[near]
    if len(levels) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return i, j


def indexed(df: DataFrame, key: str, text: str, words: int, min_words: int) -> DataFrame:
    """(k, cls, leads, w0.., shingles): key, digest of the shingle set, leading segments, sketch and the set itself; short texts are left out. One pass over the texts."""
    ship(df.sparkSession)
    names = ["k", "cls", "leads", *SKETCH, "shingles"]

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                sets = shingle_sets(part.column(1).to_pylist(), words, min_words)
                on = [i for i, s in enumerate(sets) if s is not None]
                if not on:
                    continue
                kept = [sets[i] for i in on]
                sizes = np.array([len(s) for s in kept])
                values = np.concatenate(kept)
                seg, sketch = fingerprint(values, np.cumsum(sizes) - sizes)
                cls = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in kept], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(on, pa.int64())), cls, lists(seg.ravel(), np.full(len(on), SEGMENTS)), *(pa.array(sketch[:, w].copy().view(np.int64)) for w in range(len(SKETCH))), lists(values, sizes)], names=names
                )

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("cls", T.BinaryType()), T.StructField("leads", longs), *(T.StructField(w, T.LongType()) for w in SKETCH), T.StructField("shingles", longs)])
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return spread(rows).mapInArrow(run, schema)


def candidate_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): ids of classes that the Gray-order index leaves as possibly similar, a < b. prints has one row (cls, leads, sketch) per class."""
    words = SKETCH
    # only ids go through the search for shared leading segments; sketches join the few rows that are left
    rows = prints.select("cls", F.explode("leads").alias("lead"))
    sizes = rows.groupBy("lead").count().where("count > 1")
    rows = rows.join(sizes, "lead").join(prints.select("cls", *words), "cls")
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # block pairs (x <= y) that this row takes part in; one for all but hot groups
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.withColumn("other", F.explode(other)).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    rows = rows.select("lead", "x", "y", "own", "cls", *words).repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")
    schema = "a binary, b binary"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(t: pa.Table) -> np.ndarray:
            cols = [np.asarray(t.column(c).combine_chunks()) for c in ("lead", "x", "y")]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            return np.cumsum(new)

        def joins(t: pa.Table, g: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups, as many at a time as have at most PAIRS pairs."""
            first = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
            size = np.diff(np.append(first, len(g)))
            turn = np.cumsum(size * size // 2) // PAIRS
            for x in np.flatnonzero(np.diff(turn, prepend=-1)):
                to = int(np.searchsorted(turn, turn[x], "right"))
                lo, hi = int(first[x]), int(first[to - 1] + size[to - 1])
                yield join(t.slice(lo, hi - lo), g[lo:hi])

        def join(t: pa.Table, g: np.ndarray) -> pa.RecordBatch:
            sk = np.stack([np.asarray(t.column(w).combine_chunks()).view(np.uint64) for w in words], axis=1)
            order = gray_order(g, sk)
            i, j = close_pairs(g[order], sk[order])
            i, j = order[i], order[j]
            own, x, y = (np.asarray(t.column(c).combine_chunks()) for c in ("own", "x", "y"))
            keep = (x[i] == y[i]) | (own[i] != own[j])  # a block meets itself only in its own pair
            i, j = i[keep], j[keep]
            ids = t.column("cls").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], names=["a", "b"])

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            g = groups(t)
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
            if whole:
                yield from joins(t.slice(0, whole), g[:whole])
                held = t.slice(whole).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from joins(t, groups(t))

    found = rows.mapInArrow(pairs, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _jaccard(a: str, b: str):
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar_classes(df: DataFrame, key: str, text: str, words: int = 5, similarity: float = 0.8, min_words: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members (k, cls), links (a, b, jaccard) between classes). Copies aren't expanded. Shingle sets travel only for classes that are candidates."""
    rows = cut(indexed(df, key, text, words, min_words))  # texts are read and hashed once
    one = ["leads", *SKETCH]
    prints = cut(rows.groupBy("cls").agg(F.first(F.struct(*one)).alias("p")).select("cls", "p.*"))
    candidates = cut(candidate_pairs(prints))
    ids = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = cut(rows.select("cls", "shingles").join(ids, "cls", "left_semi").dropDuplicates(["cls"]))
    left = candidates.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    links = both.select("a", "b", _jaccard("sa", "sb").alias("jaccard")).where(F.col("jaccard") >= similarity)
    return rows.select("k", "cls").distinct(), links


def near_duplicate_pairs(df: DataFrame, key: str = "seq", text: str = "text", words: int = 5, similarity: float = 0.8, min_words: int = 10) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all rows whose shingle sets are at least ``similarity`` alike, copies included."""
    members, links = similar_classes(df, key, text, words, similarity, min_words)
    a = members.select(F.col("k").alias("ka"), F.col("cls").alias("a"))
    b = members.select(F.col("k").alias("kb"), F.col("cls").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("ka", "kb")
    copies = a.join(b, F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb")
    pairs = across.unionByName(copies).where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()

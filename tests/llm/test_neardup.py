import random

import numpy as np
from edges import awkward

from corvane.llm import neardup
from corvane.llm.neardup import close_pairs, gray_order, near_duplicate_pairs


def brute(rows, words, threshold):
    sets = {}
    for k, t in rows:
        w = (t or "").lower().split()
        if k is not None and len(w) >= 10:
            sets.setdefault(k, set()).add(frozenset(zip(*(w[i:] for i in range(words)))))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] for x in sets[a] for y in sets[b] if len(x & y) / len(x | y) >= threshold}


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = r.choice(rows)[1].split()
            for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(vocabulary)]
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.choice([12, 40, 90])))))
    return rows


def test_recall_against_brute_force(spark):
    rows = corpus(7, 500)
    for words, threshold in ((3, 0.7), (5, 0.8)):
        expected = brute(rows, words, threshold)
        got = {tuple(x) for x in near_duplicate_pairs(spark.createDataFrame(rows, "seq long, text string"), words=words, similarity=threshold).collect()}
        assert got <= expected and len(got) >= 0.99 * len(expected) and len(expected) > 100


def test_blocks_of_hot_groups(spark, monkeypatch):
    """A group split into many blocks gives the pairs of one block."""
    rows = corpus(8, 150)
    df = spark.createDataFrame(rows, "seq long, text string")
    whole = {tuple(x) for x in near_duplicate_pairs(df, words=3, similarity=0.7).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert {tuple(x) for x in near_duplicate_pairs(df, words=3, similarity=0.7).collect()} == whole


def test_index_finds_all_close_sketches():
    r = np.random.default_rng(1)
    for n, limit in ((2, 5), (60, 20), (700, 38)):
        base = r.integers(0, 2**64, (max(1, n // 6), 2), dtype=np.uint64)
        sketch = base[r.integers(0, len(base), n)]
        for _ in range(14):
            sketch[:, 0] ^= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
            sketch[:, 1] ^= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
        group = r.integers(0, max(2, n // 50), n)
        order = gray_order(group, sketch)
        i, j = close_pairs(group[order], sketch[order], limit)
        got = sorted(tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(i, j))
        expected = [(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and np.bitwise_count(sketch[a] ^ sketch[b]).sum() <= limit]
        assert got == expected


def test_gray_order():
    x = np.arange(16, dtype=np.uint64) << np.uint64(60)
    order = gray_order(np.zeros(16, int), np.stack([x, x * np.uint64(0)], axis=1))
    ranked = (x[order] >> np.uint64(60)).tolist()
    assert all(bin(a ^ b).count("1") == 1 for a, b in zip(ranked, ranked[1:]))


def test_awkward(spark):
    df = awkward(spark)
    assert {tuple(x) for x in near_duplicate_pairs(df).collect()} == {(1, 8)}
    assert near_duplicate_pairs(df.limit(0)).count() == 0

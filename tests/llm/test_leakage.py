import random
import re
from collections import defaultdict

from edges import awkward

from corvane.llm.leakage import leaks, without_leaks

W = re.compile(r"[^\W_]+").findall


def brute(docs, items, n):
    grams = defaultdict(set)
    for i, t in items:
        w = W((t or "").lower())
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = W((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("ab") + str(r.randrange(30))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 12, 25])))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(150):
        w = [word() for _ in range(r.randrange(40))]
        if r.random() < 0.5:
            p = (r.choice(items)[1] or "").split()
            a = r.randrange(len(p) + 1)
            w[len(w) // 2 : len(w) // 2] = p[a : a + r.randrange(26)]
        docs.append((d, r.choice([" ", "\n", " * "]).join(w).upper() if r.random() < 0.5 else ", ".join(w)))
    return docs, items


def test_brute_force(spark):
    docs, items = corpus(3)
    d, i = spark.createDataFrame(docs + docs[:9], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n, block in ((12, 2_000_000), (5, 40)):  # many blocks of test items give what one gives
        got = {(r.doc_id, r.item_id) for r in leaks(d, i, min_words=n, block_words=block).collect()}
        assert got == brute(docs, items, n) and got


def test_longest_match_and_place(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    d = spark.createDataFrame([(1, f"x y {passage} z"), (2, f"{passage[3:]} {passage}")], "doc_id long, text string")
    i = spark.createDataFrame([(9, f"q {passage}")], "item_id long, text string")
    got = {r.doc_id: (r.words, r.doc_word, r.item_word) for r in leaks(d, i).collect()}
    assert got == {1: (20, 2, 1), 2: (20, 19, 1)}
    assert [r.doc_id for r in without_leaks(d, i).collect()] == []


def test_awkward(spark):
    df = awkward(spark, "doc_id")
    items = spark.createDataFrame([(1, "A PLAIN sentence -- of more than ten words stands here, and it ends"), (None, "x"), (2, None), (1, "A plain sentence")], "item_id long, text string")
    assert {tuple(r)[:2] for r in leaks(df, items).collect()} == {(1, 1), (8, 1)}
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0
    assert without_leaks(df, items).columns == df.columns and without_leaks(df, items).count() == df.count() - 3

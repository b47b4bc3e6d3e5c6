import random

from edges import awkward
from pyspark.sql import functions as F

from corvane.llm import mixing, queries

SCHEMA = "source string, target_share double, max_repeats int"


def tables(spark, n=600):
    r = random.Random(6)
    rows = [(i, r.choice(["big"] * 8 + ["small", "tiny", "Big", None, "other"]), " ".join(["word."] * r.randrange(1, 60))) for i in range(n)] + [(n, "big", None), (n + 1, "big", " "), (n + 2, "small", "")]
    return spark.createDataFrame(rows + rows[:30], "id long, source string, text string"), rows


def test_shares_and_caps(spark):
    df, rows = tables(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.1, 2), ("absent", 0.2, 2), (None, 0.1, 1)], SCHEMA)
    chosen, goals = mixing.plan(mixing.pool(df, "c", "id"), targets)
    got = {x.source: x for x in mixing.shares(chosen, goals).collect()}
    pool = {s: sum(len(t.split()) for _, q, t in rows if q and t and q.lower() == s) for s in ("big", "small", "tiny")}
    total = min(pool["big"] / 0.6, pool["small"] * 3 / 0.3, pool["tiny"] * 2 / 0.1)
    for s, share, cap in (("big", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.1, 2)):
        assert abs(got[s].words - total * share) <= 60 and got[s].most_copies <= cap and abs(got[s].share - share) < 0.02
    assert got["absent"].words == 0 and got["absent"].share == 0.0 and set(got) == {"big", "small", "tiny", "absent"}
    copies = {(x.id): x.copies for x in chosen.where("source = 'small'").collect()}
    assert max(copies.values()) - min(copies.values()) <= 1  # whole epochs come first
    assert mixing.mix(chosen).count() == chosen.agg(F.sum("copies")).first()[0]


def test_prefix_of_the_sorted_keys(spark):
    """What the bins select is what a full sort by key would."""
    df, _ = tables(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], SCHEMA)
    records = mixing.pool(df, "c", "id")
    chosen, goals = mixing.plan(records, targets)
    every, _ = mixing.plan(records, spark.createDataFrame([("big", 1.0, 1)], SCHEMA))
    goal = {x.source: x.goal for x in goals.collect()}["big"]
    so_far, expected = 0, set()
    for x in sorted(every.collect(), key=lambda x: (x.key, x.corpus, x.id)):
        if so_far + x.words / 2 <= goal:
            expected.add(x.id)
        so_far += x.words
    assert {x.id for x in chosen.where("source = 'big'").collect()} == expected


def test_heavier_records_come_earlier(spark):
    rows = [(i, "big", "good words end here. " * 3 if i % 2 else "= # 1 2 3 4 5 6 7 8 9 0") for i in range(2000)]
    chosen, _ = mixing.plan(mixing.pool(spark.createDataFrame(rows, "id long, source string, text string"), "c", "id"), spark.createDataFrame([("big", 1.0, 1), ("big2", 0.0, 1)], SCHEMA))
    keys = {int(x.id): x.key for x in chosen.collect()}
    odd, even = ([v for k, v in keys.items() if k % 2 == p] for p in (1, 0))
    assert sum(odd) / len(odd) < sum(even) / len(even)


def test_awkward(spark):
    df = awkward(spark, "id").withColumn("source", F.lit(" BIG "))
    targets = spark.createDataFrame([("big", 1.0, 2)], SCHEMA)
    chosen, goals = mixing.plan(mixing.pool(df, "c", "id"), targets)
    assert {x.id for x in chosen.collect()} == {"1", "5", "6", "7", "8"}
    assert mixing.shares(chosen, goals).first().most_copies == 2
    empty, goals = mixing.plan(mixing.pool(df.limit(0), "c", "id"), targets)
    assert empty.count() == 0 and mixing.shares(empty, goals).first().share == 0.0
    none, _ = mixing.plan(mixing.pool(df, "c", "id"), targets.limit(0))
    assert none.count() == 0


def test_texts_of_the_mix(spark):
    """Each copy has the text that was counted, also where one key was delivered with several texts."""
    df, rows = tables(spark)
    other = spark.createDataFrame([(i, "big", t + " longer than before") for i, _, t in rows[:40] if t] + [(1000, None, "no source here"), (5, "big", None), (None, "big", "no key")], "id long, source string, text string")
    both = df.unionByName(other)
    chosen, _ = mixing.plan(mixing.pool(both, "c", "id").unionByName(mixing.pool(df, "d", "id")), spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 3)], SCHEMA))
    got = mixing.with_texts(mixing.mix(chosen), [("c", both, "id", "text"), ("d", df, "id", "text")]).collect()
    assert all(x.text and len(x.text.split()) == x.words for x in got)
    assert sorted((x.corpus, x.id, x.copy) for x in got) == sorted((x.corpus, x.id, k + 1) for x in chosen.collect() for k in range(x.copies))
    assert any(x.copy == 3 for x in got) and any(x.text.endswith("before") for x in got)


def test_the_query_returns_texts(spark, data):
    got = queries.p4_mix(spark, data).collect()
    sources = {"articles_cleaned": "seq", "general_corpus": "text_id"}
    texts = {(c, str(r[k]), r.text) for c, k in sources.items() for r in spark.read.parquet(f"{data}/{c}.parquet").collect()}
    assert got and {(x.corpus, x.id, x.text) for x in got} <= texts
    chosen, _ = queries._mix(spark, data)
    assert len(got) == chosen.agg(F.sum("copies")).first()[0]

import numpy as np
from edges import awkward
from pyspark.sql import functions as F

from corvane.llm.quality import FEATURES, figures, kinds, learned_rules
from corvane.llm.rulelist import induce
from corvane.llm.sampledocs import labelled_documents


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(labelled_documents(800, seed=99), "text string, label string")
    right = kinds(docs, word_count=None, min_words=0).select((F.col("kind") == F.col("label")).cast("double").alias("r")).agg(F.avg("r")).first()[0]
    assert right >= 0.95


def test_sql_agrees_with_the_rules(spark):
    rules = learned_rules(spark)
    df = figures(spark.createDataFrame(labelled_documents(200, seed=3), "text string, label string"), word_count=None).na.fill(0.0)
    rows = df.select(*FEATURES, F.expr(rules.sql()).alias("kind")).collect()
    assert [r.kind for r in rows] == rules.predict({f: np.array([r[f] for r in rows]) for f in FEATURES}).tolist()


def test_induction():
    r = np.random.default_rng(0)
    x = {"a": r.random(600), "b": r.random(600)}
    y = np.where(x["a"] > 0.7, "hot", np.where(x["b"] < 0.2, "low", "rest")).astype(object)
    rules = induce(x, y, "rest")
    assert (rules.predict(x) == y).mean() > 0.97 and "CASE WHEN" in rules.sql()


def test_figures(spark):
    df = spark.createDataFrame([("One two three.\nFour five six.", 6), ("a | b | c\n| d | e |", 0), ("- tin bar\n- old lamp\n- red door", None)], "text string, word_count int")
    a, b, c = figures(df).collect()
    assert (a.words, a.count_matches, a.closed_share) == (6, True, 1.0) or a.closed_share < 1
    assert b.cell_share == 1.0 and not b.count_matches and c.item_share == 1.0 and not c.count_matches


def test_awkward(spark):
    df = awkward(spark)
    out = kinds(df)
    rows = [(r.seq, r.words, r.kind) for r in out.select("seq", "words", "kind").collect()]
    assert (2, 0, None) in rows and (3, 0, None) in rows and (4, 0, None) in rows and (1, 13, "prose") in rows
    assert out.count() == df.count() and kinds(df.limit(0)).count() == 0
    assert [r.kind for r in out.where("seq = 5").collect()] == ["prose"]

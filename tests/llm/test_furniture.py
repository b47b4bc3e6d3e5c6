import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from edges import awkward
from pyspark.sql import functions as F

from corvane.llm.codepoints import canonical_column
from corvane.llm.furniture import repeated_lines, without_repeated_lines


def brute(rows):
    rows = {r[0]: r for r in rows if r[0] is not None and r[2] and r[2][0] is not None}
    size, cover, places = Counter(r[2][0] for r in rows.values()), defaultdict(set), defaultdict(set)
    for seq, text, cats in rows.values():
        lines = (text or "").split("\n")
        for i, line in enumerate(canonical_column(pa.array(lines)).to_pylist()):
            w = re.sub(r"\d+", "0", line.lower()).split()
            if len(w) >= 4:
                cover[cats[0], " ".join(w)].add(seq)
                places[cats[0], " ".join(w)].add((seq, i))
    return {p for k, v in cover.items() if len(v) >= 4 and len(v) >= 0.05 * size[k[0]] for p in places[k]}


def test_brute_force(spark):
    r = random.Random(4)
    furniture = ["Share this page {} now please", "All rights  reserved by us {}", "two words", "Rated {} stars by {} readers"]
    rows = []
    for i in range(400):
        lines = [f"Own line number {r.random()} of text {i}" for _ in range(r.randrange(5))]
        for f in furniture:
            if r.random() < r.choice([0.02, 0.3]):
                lines.insert(r.randrange(len(lines) + 1), f.format(r.randrange(99), r.randrange(9)))
        rows.append((i, "\n".join(lines) if r.random() < 0.95 else None, r.choice([["A"], ["A", "B"], ["B"], [], None, [None], ["C"]])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "seq long, text string, categories array<string>")
    got = {tuple(x) for x in repeated_lines(df).collect()}
    assert got and got == brute(rows)


def test_removal_keeps_the_rest(spark):
    rows = [(i, f"Heading\nShare this page with friends\nown words of page {i} x{'y' * i}", ["A"]) for i in range(6)] + [(9, None, ["A"]), (10, "", ["A"])]
    out = {x.seq: x.text for x in without_repeated_lines(spark.createDataFrame(rows, "seq long, text string, categories array<string>"), min_share=0.5).collect()}
    assert out[0] == "Heading\nown words of page 0 x" and out[9] is None and out[10] == ""


def test_awkward(spark):
    df = awkward(spark).withColumn("categories", F.array(F.lit("A")))
    assert repeated_lines(df).count() == 0 and repeated_lines(df.limit(0)).count() == 0
    out = without_repeated_lines(df)
    assert out.columns == df.columns and out.count() == df.count()

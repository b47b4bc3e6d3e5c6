"""Rollups of hardened pages: one pass over them, and the counts of their rows."""

from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import harden
from corvane.plans import catalogue


def test_one_pass(spark, data):
    plan = catalogue.queries()["hardening_rollups"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and plan.count("Scan parquet") == 1 and "Union" not in plan


def test_counts_of_all_rows(spark):
    rows = [("dropped", "a", None, [], []), ("dropped", None, None, [], []), ("qa_direct", "b", "mob", ["History", "History"], []), ("main_corpus", None, "mob", ["Trivia", None], ["dedup_removed_1_blocks"])]
    df = spark.createDataFrame(rows, "route string, reason string, family string, section_drops array<string>, warnings array<string>")
    expected = Counter()
    for route, reason, family, sections, warnings in rows:
        expected.update([("route", route), ("family", family or "none"), *(("section", s) for s in sections), *(("warning", w) for w in warnings)])
        expected.update({"dropped": [("drop_reason", reason)], "qa_direct": [("qa_reason", reason)]}.get(route, []))
    assert {(r.what, r.value): r.n for r in harden.rollups(df).collect()} == dict(expected)


def test_what_a_pattern_needs():
    for pattern, expected in [(r"\bMobscan\b", "Mobscan"), (r"^Reason:\s+[^\n]+\n?", "Reason:"), (r"(?i)\[Music\]", ""), (r"(a|b)c*", ""), (r"x(?:yz)?w", "x"), (r"ab(?:cd)ef|g", ""), (r"a(?=bcd)", "a"), (r"(\.png)(?=[a-z])", ".png")]:
        assert harden.needed(pattern) == expected


def test_paragraphs_are_worked_out_once(spark):
    """Some thousand paragraphs in one text; squared work would take minutes."""
    long = [f"{k} " + "word " * 50 for k in range(2000)]
    df = spark.createDataFrame([("\n\n".join([*long, *long, "end"]),), (None,), ("",)], "t string")
    got = [r.x for r in df.select(harden.paragraphs_once(F.col("t")).alias("x")).collect()]
    assert got[0].removed == 2000 and got[0].text == "\n\n".join([*long, "end"]) and got[1].text is None and got[2].text == ""

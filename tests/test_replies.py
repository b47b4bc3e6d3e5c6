"""Replies brought into one form: worked examples, also of odd ones."""

from pyspark.sql import functions as F

from corvane.operators import replies
from corvane.plans import catalogue


def forms(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, raw string, want string")
    return [r.reply_form for r in replies.normalized_replies(df, "raw", "want").orderBy("i").collect()]


def test_query_normalizes_every_article(spark, data):
    df = catalogue.queries()["normalized_replies"](spark, data).cache()
    articles = spark.read.parquet(f"{data}/articles.parquet")
    assert df.columns == ["seq", "text", "title", "format", "warnings"] and df.count() == articles.count()
    assert df.where("text not like '# %' or text not like '%Health: 32%' or text like '%Tameable%' or text like '%**Drops%'").count() == 0
    df.unpersist()


def test_control_characters_stay(spark):
    (got,) = forms(spark, ("## Overview\na\x01b\n## Properties\nColor: \x01red\n## Details\nc", "Cow"))
    assert got.text == "# Cow\n\n## Overview\na\x01b\n## Properties\nColor: \x01red\n## Details\nc" and got.warnings == []


def test_headings_that_come_to_light(spark):
    bold, bullet, broken = forms(
        spark, ("# Cow\n## **Properties**\nColor: red\n## **Details**\n- one\n- two", None), ("## Properties\nColor: red\n- ## Details\n- one", "Cow"), ("##\nOverview\nx", "Cow"),
    )
    assert bold.text == "# Cow\n## Properties\nColor: red\n## Details\none\ntwo"
    assert bullet.text == "# Cow\n\n## Properties\nColor: red\n## Details\none" and bullet.sections == {"properties": "Color: red", "details": "one"}
    assert broken.sections == {"overview": "x"}


def test_property_lines(spark):
    lines = ["- **Health Points**: 32 HP × 16", "Health Points: 5é", "* Damage: 5–7", "Rideable: Yes (with saddle)", "Tameable: No", "Color: n/a", "** **: v", "Range: 1–3", "XP: 4é", "\x1c"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(replies.property_lines(F.col("l")).alias("x")).first().x
    assert got == ["Health: 32", "Health Points: 5é", "Damage: 5-7", "Rideable: Yes", ": v", "Range: 1-3", "XP: 4é", ""]


def test_white_space_and_blank_replies(spark):
    got = forms(spark, (None, "Cow"), (" \n\x1c", None), ("\x1c\n**Drops**\n\n## Drops\nbones", "Cow"), ("## Properties\n\x0b\nColor: red\nloose", "Cow"))
    assert [(g.text, g.title, g.format, g.sections, g.warnings) for g in got[:2]] == [("", "Cow", "unknown", {}, ["empty input"]), ("", "", "unknown", {}, ["empty input"])]
    assert got[2].text == "# Cow\n\nDrops.\n\nDrops.\nbones"
    assert got[3].text == "# Cow\n\n## Properties\n\n\nColor: red\n\n## Details\nloose"

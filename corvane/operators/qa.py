"""Instruction pairs made from articles, and texts made from pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.functions.text import strip
from corvane.operators import rules as R


def paragraphs(text: Column, least: int = 50) -> Column:
    """Stripped lines of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: F.length(p) > least)


def heuristic_pairs(df: DataFrame, key: str = "seq", title: str = "title", text: str = "text") -> DataFrame:
    """(key, instruction, input, output, source): a general question, one for the whole, and one per word that marks a passage. Rows without title, text or a long paragraph give none."""
    rows = df.select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(text).alias("x")).where("t <> '' and x <> ''").withColumn("p", paragraphs(F.col("x"))).where("size(p) > 0")
    t, p, low = F.col("t"), F.col("p"), F.lower("x")
    ask = lambda q, a: F.struct(q.alias("instruction"), a.alias("output"))
    made = [
        ask(F.concat(F.lit("What is "), t, F.lit(" in Minecraft?")), p[0]),
        F.when(F.size(p) > 1, ask(F.concat(F.lit("Tell me everything about "), t, F.lit(" in Minecraft.")), F.array_join(F.slice(p, 1, 3), "\n"))),
    ]
    for word, question in R.QUESTIONS.items():
        before, after = question.split("{}")
        found = F.get(F.filter(p, _mentions(word)), F.lit(0))
        made.append(F.when(low.contains(word) & found.isNotNull(), ask(F.concat(F.lit(before), t, F.lit(after)), found)))
    out = rows.select("k", F.explode(F.filter(F.array(*made), lambda q: q.isNotNull())).alias("q"))
    return out.select(F.col("k").alias(key), "q.instruction", F.lit("").alias("input"), "q.output", F.lit("heuristic_qa").alias("source"))


def _mentions(word: str):
    return lambda p: F.lower(p).contains(word)


def crafting_pairs(df: DataFrame, key: str = "seq", title: str = "title", text: str = "text") -> DataFrame:
    """One pair per line that is about making something."""
    lines = df.select(F.col(key).alias("k"), F.col(title).alias("t"), F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    about = reduce(lambda a, b: a | b, [F.lower("line").contains(w) for w in R.CRAFTING_WORDS])
    return lines.where(about & (F.length("line") > 30)).select(
        F.col("k").alias(key), F.concat(F.lit("How do I craft or obtain "), F.col("t"), F.lit(" in Minecraft?")).alias("instruction"),
        F.lit("").alias("input"), strip(F.col("line")).alias("output"), F.lit("wiki_crafting").alias("source"), F.col("t").alias("article"),
    )


def plain_text(title: Column | None, text: Column, instruction: Column | None = None) -> Column:
    """Title and text on lines of their own; rows that are instructions give an empty text."""
    parts = [F.nullif(c, F.lit("")) for c in (title, text) if c is not None]
    out = strip(F.concat_ws("\n", *parts))
    return out if instruction is None else F.when(instruction.isNotNull(), F.lit("")).otherwise(out)


def training_text(instruction: Column, response: Column, extra: Column | None = None) -> Column:
    asked = instruction if extra is None else F.concat(instruction, F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n"), extra)).otherwise(F.lit("")))
    return F.concat(F.lit("### Instruction:\n"), asked, F.lit("\n\n### Response:\n"), response)


def pairs_from_reply(df: DataFrame, key: str, reply: str, title: str) -> DataFrame:
    """Pairs from a reply that holds a JSON array of objects with q and a; replies without one give none."""
    array = F.regexp_extract(F.col(reply), r"(?s)\[.*\]", 0)
    rows = df.select(F.col(key), F.col(title).alias("article"), F.explode(F.from_json(array, T.ArrayType(T.StructType([T.StructField("q", T.StringType()), T.StructField("a", T.StringType())])))).alias("p"))
    return rows.where("p.q is not null and p.a is not null").select(key, F.col("p.q").alias("instruction"), F.lit("").alias("input"), F.col("p.a").alias("output"), F.lit("ai_generated").alias("source"), "article")


def pairs_from_protocol(df: DataFrame, key: str, reply: str) -> DataFrame:
    """Pairs from lines 'Q: ...' each followed by a line 'A: ...'."""
    found = F.regexp_extract_all(F.col(reply), F.lit(r"(?dm)^Q: .+\nA: .+$"), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("pos", "m"))
    return rows.select(key, "pos", F.regexp_extract("m", r"(?d)^Q: (.+)\nA: ", 1).alias("question"), F.regexp_extract("m", r"(?d)\nA: (.+)$", 1).alias("answer"))

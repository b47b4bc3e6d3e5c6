"""Ordered keep-or-drop rules, each row with the reason of the first rule that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import strip, word_count
from corvane.operators import rules as R


def starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def contains_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def first_reason(tests: list[tuple[Column, str]]) -> Column:
    """The name of the first test that holds, else null."""
    out = F
    for test, reason in tests:
        out = out.when(test, reason)
    return out.otherwise(F.lit(None).cast("string"))


def is_index_page(text: Column) -> Column:
    return F.coalesce(contains_any(F.substring(text, 1, 500), R.INDEX_PAGE_MARKERS), F.lit(False))


def article_reason(title: Column, text: Column, words: Column) -> Column:
    """Why an article is left out; null where it stays. The stored word count decides, 0 where it is missing."""
    t, low = F.coalesce(title, F.lit("")), F.lower(F.coalesce(title, F.lit("")))
    return first_reason([
        (F.coalesce(words, F.lit(0)) < 10, "empty_or_tiny"),
        (t.startswith("Category:"), "category_page"),
        (t.startswith("User:"), "user_page"),
        (t.startswith("Template:"), "template_page"),
        (t.startswith("Minecraft Wiki:"), "meta_wiki_page"),
        (low.contains("render history"), "render_history"),
        (low.contains("texture history"), "texture_history"),
        (t.endswith("/Asset history"), "asset_history"),
        (t.startswith("Debug mode"), "debug_mode"),
        (t.contains("/Structure/"), "structure_blueprint"),
        (t.endswith("/Renders"), "structure_renders"),
        (t.contains("/development gallery/"), "development_gallery"),
        (is_index_page(text) & t.rlike("(?i)" + R.VERSION_TITLE), "version_disambiguation"),
    ])


def changelog_reason(text: Column, words: Column) -> Column:
    return first_reason([(F.coalesce(words, F.lit(0)) < 30, "empty_or_tiny"), (F.coalesce(strip(text).startswith("Lua error:"), F.lit(False)), "lua_error")])


def is_changelog(title: Column, text: Column) -> Column:
    return F.coalesce(title.rlike("(?i)" + R.CHANGELOG_TITLE), F.lit(False)) | F.coalesce(F.substring(text, 1, 1000).contains("Protocol version:"), F.lit(False))


def is_changelog_title(title: Column) -> Column:
    """The narrower test made at harvest."""
    return F.coalesce(title.rlike("(?i)" + R.CHANGELOG_TITLE_STRICT), F.lit(False))


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped rows with removal_reason)."""
    marked = df.withColumn("removal_reason", reason)
    return marked.where("removal_reason is null").drop("removal_reason"), marked.where("removal_reason is not null")


def reason_report(df: DataFrame, reason: Column, words: Column) -> DataFrame:
    """(reason, n, words): rows and words by reason, 'keep' for those that stay."""
    return df.select(F.coalesce(reason, F.lit("keep")).alias("reason"), F.coalesce(words, F.lit(0)).alias("w")).groupBy("reason").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


def kept_totals(df: DataFrame, reason: Column, words: Column) -> DataFrame:
    r, w = reason, F.coalesce(words, F.lit(0))
    return df.select(r.alias("r"), w.alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col("r").isNull()).alias("kept"), F.count_if(F.col("r").isNotNull()).alias("dropped"),
        F.sum("w").alias("words_total"), F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("w"))), F.lit(0)).alias("words_kept"),
        F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("w"))), F.lit(0)).alias("words_dropped"),
    )


def without_bots(df: DataFrame, author: str, bots: list[str]) -> DataFrame:
    """Rows whose author isn't listed; rows without an author stay."""
    return df.where(~F.coalesce(F.col(author), F.lit("")).isin(bots))


def min_length(df: DataFrame, text: str, chars: int = 50) -> DataFrame:
    return df.where(F.length(strip(F.col(text))) >= chars)


def min_words_by_source(df: DataFrame, text: str, source: str, least: dict[str, int], default: int = 0) -> DataFrame:
    """Rows with a text of at least the words asked of their source."""
    wanted = reduce(lambda acc, kv: acc.when(F.col(source) == kv[0], kv[1]), least.items(), F).otherwise(default)
    return df.where((F.length(strip(F.col(text))) > 0) & (word_count(F.col(text)) >= wanted))

"""The catalogue of all pages: cleaned, removed and external ones with setting, bucket, tier and lenses; and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.operators.classify import classified, tier
from corvane.operators.joins import last_wins, lens_members, with_removed
from corvane.operators.rules import TIERS


def catalogue(cleaned: DataFrame, removed: DataFrame | None = None, external: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """(title, word_count, tier, setting, group, also_in, categories, stamp, removal_reason, source): the last row of each title, removed ones only where no cleaned one has the title.

    external has title, prefix, word_count, source and dates post_date, snapshot ('YYYYMMDDhhmmss') and scraped_at.
    """
    empty = F.array().cast("array<string>")
    pages = classified(last_wins(cleaned, "title", order))
    stamp = F.col("scraped_at").cast("date") if "scraped_at" in cleaned.columns else F.lit(None).cast("date")
    out = pages.select("title", F.coalesce("word_count", F.lit(0)).alias("word_count"), "setting", "group", "also_in", F.coalesce("categories", empty).alias("categories"), stamp.alias("stamp"), F.lit(None).cast("string").alias("removal_reason"), F.lit("cleaned").alias("source"))
    if removed is not None:
        gone = last_wins(removed, "title", order).select("title", F.coalesce("word_count", F.lit(0)).alias("word_count"), F.lit("removed_in_phase1").alias("setting"), F.lit("removed_in_phase1").alias("group"), empty.alias("also_in"), F.coalesce("categories", empty).alias("categories"), F.lit(None).cast("date").alias("stamp"), "removal_reason", F.lit("removed").alias("source"))
        out = with_removed(out, gone, "title")
    if external is not None:
        best = F.coalesce(F.col("post_date").cast("date"), F.to_date(F.substring("snapshot", 1, 8), "yyyyMMdd"), F.col("scraped_at").cast("date"))
        name = F.concat(F.lit("["), F.col("prefix"), F.lit("] "), F.col("title"))
        out = out.unionByName(external.select(name.alias("title"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.lit("external").alias("setting"), F.concat(F.lit("external_"), F.col("source")).alias("group"), empty.alias("also_in"), empty.alias("categories"), best.alias("stamp"), F.lit(None).cast("string").alias("removal_reason"), F.lit("external").alias("source")))
    return out.withColumn("tier", tier(F.col("word_count")))


def tier_matrix(cat: DataFrame) -> DataFrame:
    """One row per group: primary pages per tier, pages that have it as a further lens, and words. Pages of fewer than 10 words aren't counted, but their words are."""
    names = [n for _, n in TIERS]
    counted = F.col("tier").isin(names)
    primary = cat.groupBy("group").agg(
        *[F.count_if(F.col("tier") == n).alias(f"tier_{n}") for n in names], F.count_if(counted).alias("n"), F.sum("word_count").alias("words")
    )
    further = cat.where(counted).select(F.explode("also_in").alias("group")).groupBy("group").agg(F.count("*").alias("secondary"))
    out = primary.join(further, "group", "full")
    return out.na.fill(0)


def visible(matrix: DataFrame, least_secondary: int = 30) -> DataFrame:
    return matrix.where((F.col("n") >= 1) | (F.col("secondary") >= least_secondary))


def group_order() -> list[Column]:
    return [F.desc("n"), F.desc("secondary"), F.lower("group"), F.col("group")]


def setting_totals(cat: DataFrame) -> DataFrame:
    return cat.groupBy("setting").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.count_distinct("group").alias("groups"))


def rollup(df: DataFrame) -> DataFrame:
    """(setting, bucket, n, words, avg_words) with totals per setting and over all, where the keys are null."""
    return df.rollup("setting", "bucket").agg(F.count("*").alias("n"), F.sum(F.coalesce("word_count", F.lit(0))).alias("words")).withColumn("avg_words", F.col("words") / F.greatest(F.col("n"), F.lit(1)))


def listing(cat: DataFrame, group: str | None = None, tier_name: str | None = None, query: str | None = None, sort: str = "alpha", offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of titles in a group or lens; sorts are alpha, wc, date_asc, date_desc and, where the catalogue has a column delta, delta. The limit is the page."""
    rows = cat.where(F.col("tier") != "<10")
    if group is not None:
        rows = rows.where((F.col("group") == group) | F.array_contains("also_in", group))
    if tier_name not in (None, "all"):
        rows = rows.where(F.col("tier") == tier_name)
    if query:
        rows = rows.where(F.lower("title").contains(query.lower()))
    by = {
        "alpha": [F.lower("title"), F.col("title")],
        "wc": [F.desc("word_count"), F.col("title")],
        "date_asc": [F.asc_nulls_last("stamp"), F.lower("title"), F.col("title")],
        "date_desc": [F.desc_nulls_last("stamp"), F.desc(F.lower("title")), F.col("title")],
        "delta": [F.desc("delta"), F.col("title")],
    }[sort]
    page = rows.select("title", "word_count", "tier", "group", "stamp", *(["delta"] if "delta" in cat.columns else [])).orderBy(*by)
    return (page.offset(offset) if offset else page).limit(limit)


def search(cat: DataFrame, query: str, order: str = "title", limit: int = 20) -> DataFrame:
    """The first 5 * limit hits in index order, those that start with the query first, then by name, cut to limit."""
    hits = cat.where(F.lower("title").contains(query.lower())).orderBy(order).limit(5 * limit)
    return hits.orderBy(~F.lower("title").startswith(query.lower()), F.lower("title"), "title").limit(limit)


def lenses(cat: DataFrame) -> DataFrame:
    return lens_members(cat, "title", "group", "also_in")


def top_per_bucket(df: DataFrame, n: int, key: str = "seq") -> DataFrame:
    """The n longest pages of each bucket; the rank's bound cuts inside each task."""
    w = W.partitionBy("setting", "bucket").orderBy(F.desc("word_count"), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

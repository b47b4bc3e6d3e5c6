"""Joins between versions, logs and lists of one corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. Combines before its shuffle; a hot key is one row per task."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def to_do(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't in done; the done side is reduced to its keys first."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def needed(items: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return items.join(wanted.select(key).distinct(), key, "left_semi")


def corrected(items: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """items with column replaced where corrections has a value; corrections has one row per key."""
    new = corrections.select(F.col(key), F.col(column).alias("__new"))
    return items.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(items.columns)


def word_delta(raw: DataFrame, cleaned: DataFrame, key: str, words: str) -> DataFrame:
    """(key, delta): difference of the word counts, missing ones as 0."""
    a, b = raw.select(key, F.col(words).alias("a")), cleaned.select(key, F.col(words).alias("b"))
    return a.join(b, key, "left").select(key, F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


def versions(tables: dict[str, DataFrame], key: str, words: str) -> DataFrame:
    """(key, available, counts): in which versions a key stands, and its word count in each. A union and one aggregation instead of a chain of outer joins."""
    parts = None
    for name, df in tables.items():
        one = df.where(F.col(key).isNotNull()).select(F.col(key), F.lit(name).alias("version"), F.coalesce(F.col(words), F.lit(0)).alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    one_each = parts.groupBy(key, "version").agg(F.max("n").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("version", "n")))
    return one_each.groupBy(key).agg(entries.alias("e")).select(key, F.transform("e", lambda x: x["version"]).alias("available"), F.map_from_entries("e").alias("counts"))


def redirected(pages: DataFrame, redirects: DataFrame, title: str, source: str = "from_title", target: str = "to_title") -> DataFrame:
    """(from_title, to_title, title): each redirect once with the page it leads to in one step, or null."""
    once = redirects.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(target).alias(target))
    known = pages.where(F.col(title).isNotNull()).select(F.col(title).alias("__title")).distinct()
    return once.join(known, once[target] == known["__title"], "left").select(source, target, F.col("__title").alias("page"))


def canonical_titles(pages: DataFrame, redirects: DataFrame, title: str, order: str) -> DataFrame:
    """The first page of each title after redirects are followed one step."""
    hops = redirects.where("from_title is not null and to_title is not null").groupBy("from_title").agg(F.min("to_title").alias("to_title"))
    moved = pages.where(F.col(title).isNotNull()).join(hops, pages[title] == hops["from_title"], "left").withColumn("canonical", F.coalesce("to_title", title)).drop("from_title", "to_title")
    return first_wins(moved, "canonical", order)


def lens_members(df: DataFrame, title: str, group: str, also_in: str, lens: Column | None = None) -> DataFrame:
    """(title, lens, is_primary) for the group of a page and every other lens it belongs to."""
    rows = df.select(title, F.explode(F.array_union(F.array(F.col(group)), F.col(also_in))).alias("lens"), F.col(group).alias("g"))
    out = rows.select(title, "lens", (F.col("lens") == F.col("g")).alias("is_primary"))
    return out if lens is None else out.where(F.col("lens") == lens)


def with_removed(pages: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """pages, and those of removed whose key pages doesn't have."""
    return pages.unionByName(removed.join(pages.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def ranked(df: DataFrame, groups: list[str], by: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the rank's bound cuts inside each task before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*groups).orderBy(*by))).where(F.col("__rank") <= n).drop("__rank")


def without_parent_lenses(members: DataFrame, key: str, lens: str, parents: dict[str, tuple[str, ...]]) -> DataFrame:
    """members (key, lens) without those a narrower lens of the same key implies. The table of parents is a literal."""
    table = F.create_map(*[x for k, v in parents.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    up = members.select(F.col(key), F.explode(F.try_element_at(table, F.col(lens))).alias(lens)).distinct()
    return members.join(up, [key, lens], "left_anti")

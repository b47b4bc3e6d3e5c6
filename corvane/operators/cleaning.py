"""Markup and boilerplate removal in a fixed order, as chains of native replacements, and what it cost in words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import rstrip_lines, strip, word_count
from corvane.operators import rules as R
from corvane.operators.filters import is_changelog
from corvane.session import computed_once

TEMPLATE, TEMPLATE_DEPTH = r"\{\{[^{}]*\}\}", 6


def java(pattern: str) -> str:
    """A pattern written for line-feed-only line ends and Unicode classes, for the JVM."""
    return pattern if pattern.startswith("(?") and pattern[2] in "imsdU" else "(?dU)" + pattern


def replace_all(text: Column, patterns, to: str = "", flags: str = "dm") -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?{flags}U){p}", to), patterns, text)


def unlink(text: Column) -> Column:
    """Wiki links become what they show; files vanish."""
    t = F.regexp_replace(text, r"\[\[File:[^\]]*\]\]", "")
    t = F.regexp_replace(t, r"\[\[[^\]]*\|([^\]]+)\]\]", "$1")
    return F.regexp_replace(t, r"\[\[([^\]]+)\]\]", "$1")


def strip_templates(text: Column) -> Column:
    """Innermost templates first, until none is left: ``TEMPLATE_DEPTH`` passes for every text, more for one that still has some.

    A pass that finds a template takes two opening braces at least, so half their number is enough of them.
    """
    once = lambda t: F.regexp_replace(t, TEMPLATE, "")
    deeper = lambda t: F.aggregate(F.sequence(F.lit(1), F.floor(F.regexp_count(t, F.lit(r"\{")) / 2).cast("int")), t, lambda x, _: once(x))
    # a lambda's variable is computed once, the passes written out three times are not
    return F.element_at(F.transform(F.array(reduce(lambda t, _: once(t), range(TEMPLATE_DEPTH), text)), lambda t: F.when(t.rlike(TEMPLATE), deeper(t)).otherwise(t)), 1)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)https?://\S+", "")


def strip_cites(text: Column) -> Column:
    """[3] after a word break; an index like Items[3] stays."""
    return F.regexp_replace(text, r"(?U)(?<![A-Za-z0-9_\]])\[\d+\](?!\w)", "")


def strip_navigation(text: Column) -> Column:
    """Lines with navigation arrows go as a whole."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike("[◄►]")), "\n")


def strip_boilerplate(text: Column) -> Column:
    t = F.regexp_replace(text, "(?iu)" + "|".join(R.BOILERPLATE), "")
    return F.regexp_replace(t, r"(?dm)^Main article:\s*[^\n]*/(Structure|Blueprints)/[^\n]*$", "")


def strip_changelog_header(text: Column) -> Column:
    """Header keys in the first 30 lines, then the notices of change logs."""
    lines = F.split(text, "\n", -1)
    keys = "(?dm)^(" + "|".join(R.CHANGELOG_KEYS) + r")\s*:\s*.*$"
    head = F.regexp_replace(F.array_join(F.slice(lines, 1, 30), "\n"), keys, "")
    rest = F.array_join(F.slice(lines, 31, 2_000_000_000), "\n")
    return replace_all(F.when(rest != "", F.concat(head, F.lit("\n"), rest)).otherwise(head), R.CHANGELOG_LINES)


def tidy(text: Column) -> Column:
    """The final pass on white space and punctuation."""
    t = F.regexp_replace(rstrip_lines(text), r" +([.,;:!?])", "$1")
    return strip(F.regexp_replace(F.regexp_replace(t, r"  +", " "), r"\n{3,}", "\n\n"))


def clean(text: Column, changelog: Column | None = None) -> Column:
    t = strip_boilerplate(strip_navigation(strip_cites(strip_urls(strip_templates(unlink(text))))))
    if changelog is not None:
        t = F.when(changelog, strip_changelog_header(t)).otherwise(t)
    return tidy(t)


def cleaned(df: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """df with clean_text, words_before, words_after, loss and loss_ratio. A null text stays null and counts no words."""
    t = F.col(text)
    marked = computed_once(df, {"__body": strip_boilerplate(strip_navigation(strip_cites(strip_urls(strip_templates(unlink(t)))))), "__log": is_changelog(F.col(title), t)})
    body = F.when(F.col("__log"), strip_changelog_header(F.col("__body"))).otherwise(F.col("__body"))
    out = computed_once(marked, {"clean_text": tidy(body)}).drop("__body", "__log")
    out = computed_once(out, {"words_before": word_count(t), "words_after": word_count(F.col("clean_text"))})
    lost = F.col("words_before") - F.col("words_after")
    return out.withColumn("loss", lost).withColumn("loss_ratio", F.when(F.col("words_before") > 0, lost / F.col("words_before")).otherwise(F.lit(0.0)))


def flagged(df: DataFrame, most: float = 0.30, least_words: int = 50) -> DataFrame:
    """Rows of cleaned() that lost an uncommon share of a text long enough to judge."""
    return df.where((F.col("loss_ratio") > most) & (F.col("words_before") >= least_words))


def emptied(df: DataFrame) -> DataFrame:
    return df.where("words_after = 0 and words_before > 0")


def totals(df: DataFrame) -> DataFrame:
    """One row of sums over cleaned()."""
    return df.agg(
        F.count("*").alias("processed"), F.coalesce(F.sum("words_before"), F.lit(0)).alias("words_in"), F.coalesce(F.sum("words_after"), F.lit(0)).alias("words_out"),
        F.coalesce(F.sum("loss"), F.lit(0)).alias("words_lost"), F.count_if((F.col("loss_ratio") > 0.30) & (F.col("words_before") >= 50)).alias("flagged"),
        F.count_if((F.col("words_after") == 0) & (F.col("words_before") > 0)).alias("emptied"),
    ).withColumn("loss_share", F.when(F.col("words_in") > 0, F.col("words_lost") / F.col("words_in")).otherwise(F.lit(0.0)))


def worst(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The n rows with the highest loss; ties by key. A top-k report: one bounded heap per task, merged."""
    return df.orderBy(F.desc("loss_ratio"), key).limit(n)

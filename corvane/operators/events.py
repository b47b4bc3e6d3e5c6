"""State folded from an append-only log of events, and rates over streams of items, as aggregations and windows.

The fold is by arrival (event_seq), not by time stamp. Each flag depends only on the last event that touches it, so
a fold is one aggregation of maxima: it combines before its shuffle, and a title that holds a tenth of the log, or a
third, is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def deduplicated(log: DataFrame, seq: str = "event_seq") -> DataFrame:
    """Each event once, however often it was delivered; which delivery doesn't matter, they carry the same content."""
    return log.dropDuplicates([seq])


def _last(flag: Column, touches: Column, seq: Column) -> Column:
    """Whether the last event that touches a flag sets it; false if none does."""
    return F.coalesce(F.max_by(F.when(touches, flag), F.when(touches, seq)), F.lit(False))


def exclusion_state(log: DataFrame, seq: str = "event_seq", title: str = "title", lens: str = "bucket_lens", scope: str = "excl_scope", action: str = "excl_action", ts: str = "ts", reason: str = "reason") -> DataFrame:
    """One row per (title, lens) that an event names: four flags, and stamp and reason of the last event that applies.

    Events of scope all_lenses apply to every lens of their title. They are folded once per title and met with the
    fold per (title, lens), instead of copying them to every lens.
    """
    events = log.where(F.col(title).isNotNull()).select(F.col(title).alias("title"), F.col(lens).alias("lens"), (F.col(scope) == "all_lenses").alias("everywhere"), F.col(action).alias("action"), F.col(seq).alias("seq"), F.col(ts).alias("ts"), F.col(reason).alias("reason"))
    on = F.col("action").startswith("exclude")
    touches = {"transform": F.col("action").rlike("_(transform|both)$"), "qa": F.col("action").rlike("_(qa|both)$")}

    def fold(rows: DataFrame, keys: list[str]) -> DataFrame:
        parts = []
        for flag, t in touches.items():
            parts.append(F.max_by(F.when(t, F.struct(F.col("seq"), on.alias("on"))), F.when(t, F.col("seq"))).alias(flag))
            # the global flag is set by excluding everywhere and cleared by any including
            g = t & (~on | F.col("everywhere"))
            parts.append(F.max_by(F.when(g, F.struct(F.col("seq"), on.alias("on"))), F.when(g, F.col("seq"))).alias(f"{flag}_global"))
        return rows.groupBy(*keys).agg(*parts, F.max(F.struct("seq", "ts", "reason")).alias("last"))

    own = fold(events.where(~F.col("everywhere") & F.col("lens").isNotNull()), ["title", "lens"])
    wide = fold(events.where("everywhere"), ["title"])
    lenses = events.where(F.col("lens").isNotNull()).select("title", "lens").distinct()
    a, b = own.alias("a"), wide.alias("b")
    joined = lenses.join(a, ["title", "lens"], "left").join(b, "title", "left")
    names = ["transform", "transform_global", "qa", "qa_global"]
    later = lambda c: F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}"))  # noqa: E731  structs compare by seq first
    flags = [F.coalesce(later(c)["on"], F.lit(False)).alias(c.replace("transform", "transform_excluded").replace("qa", "qa_excluded").replace("_excluded_global", "_excluded_global")) for c in names]
    last = later("last")
    return joined.select("title", "lens", *flags, last["ts"].alias("last_ts"), last["reason"].alias("last_reason"))


ACTIONS = tuple(f"{v}_{w}" for v in ("exclude", "include") for w in ("transform", "qa", "both"))
SCOPES = ("this_lens", "all_lenses")


def validated(log: DataFrame, title: str = "title", scope: str = "excl_scope", action: str = "excl_action", lens: str = "bucket_lens") -> DataFrame:
    """log with problem: what is wrong with an event before it may be appended, or null."""
    problem = (
        F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no title").when(~F.coalesce(F.col(action).isin(list(ACTIONS)), F.lit(False)), "unknown action")
        .when(~F.coalesce(F.col(scope).isin(list(SCOPES)), F.lit(False)), "unknown scope").when((F.col(scope) == "this_lens") & (F.coalesce(F.trim(lens), F.lit("")) == ""), "no lens")
    )
    return log.withColumn("problem", problem)


def spread_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, most, middle): the middle is the upper median, sorted[n // 2]; by rank, not by collecting a group."""
    ranked = df.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(value)) - 1)
    n = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return ranked.join(n, key).where(F.col("place") == F.floor(F.col("n") / 2)).select(key, "least", "most", F.col(value).alias("middle"))


def history(log: DataFrame, title: str, column: str = "title", seq: str = "event_seq") -> DataFrame:
    return log.where(F.col(column) == title).orderBy(seq)


def upserted(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """The last state of each key in a log of updates."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("s")).select(key, "s.*")


def eta_seconds(df: DataFrame, ts: str, order: str, group: str, last: int = 20) -> DataFrame:
    """df with seconds_per_item: mean time between the last ``last`` items of a group; null for fewer than two."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(-(last - 1), 0)
    span = F.unix_micros(F.max(ts).over(w)) - F.unix_micros(F.min(ts).over(w))
    n = F.count(F.col(ts)).over(w)
    return df.withColumn("seconds_per_item", F.when(n >= 2, span / 1e6 / (n - 1)))


def items_per_minute(df: DataFrame, ts: str, group: str, seconds: int = 300) -> DataFrame:
    """df with per_minute: items of the group in the last ``seconds``, as a rate."""
    w = W.partitionBy(group).orderBy(F.unix_seconds(ts)).rangeBetween(-seconds, 0)
    first, n = F.min(F.unix_seconds(ts)).over(w), F.count(F.lit(1)).over(w)
    span = F.unix_seconds(ts) - first
    return df.withColumn("per_minute", F.when((n >= 2) & (span > 0), (n - 1) * 60.0 / span))


def latest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The feed of the last n items. A top-k report: one bounded heap per task, merged."""
    return df.orderBy(F.desc(order)).limit(n)


def tumbling(df: DataFrame, ts: str, key: str, value: str, width: str = "5 minutes") -> DataFrame:
    out = df.where(F.col(ts).isNotNull()).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")

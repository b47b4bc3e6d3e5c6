"""Reproducible samples by hash order, balanced samples by quota, and mixtures by ratio.

A row's place is decided by md5(seed:key), so a sample needs no state and comes out alike on any cluster. Windows are
per stratum and label; where a stratum may hold most rows, a bound on the rank is turned into a bound on the hash by
the optimizer's window group limit, which cuts inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement. A sampling operator: one bounded heap per task, merged."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def subset(df: DataFrame, key: str, mode: str, seed: int = 42) -> DataFrame:
    """full; test_5 or test_20 (by hash); sample_50 (the first 50 by key); single:<key>."""
    if mode.startswith("test_"):
        return sample(df, key, int(mode[5:]), seed)
    if mode.startswith("sample_"):
        return df.orderBy(key).limit(int(mode[7:]))
    if mode.startswith("single:"):
        return df.where(F.col(key).cast("string") == mode[7:])
    return df


def balanced(df: DataFrame, key: str, stratum: str, label: str, targets: dict[str, int], keep_share: dict[str, float], seed: int = 42) -> DataFrame:
    """Per stratum: up to share*n rows labelled KEEP, then DISCARD up to n, the rest UNKNOWN; targets and shares are by stratum."""
    order = W.partitionBy(stratum, label).orderBy(hash_order(F.col(key), seed), key)
    most = max(targets.values(), default=0)
    ranked = df.where(F.col(stratum).isin(list(targets))).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
    rows = [(s, n, int(n * keep_share.get(s, 1 / 3))) for s, n in targets.items()]
    goal = df.sparkSession.createDataFrame(rows, f"{stratum} string, __n int, __k int")  # one row per target
    have = ranked.groupBy(stratum).agg(F.count_if(F.col(label) == "KEEP").alias("__keeps"), F.count_if(F.col(label) == "DISCARD").alias("__discards"))
    quota = F.broadcast(goal).join(F.broadcast(have), stratum)
    n_keep = F.least("__k", "__keeps")
    n_discard = F.least(F.col("__n") - n_keep, F.col("__discards"))
    joined = ranked.join(F.broadcast(quota.select(stratum, n_keep.alias("KEEP"), n_discard.alias("DISCARD"), (F.col("__n") - n_keep - n_discard).alias("UNKNOWN"))), stratum)
    allowed = F.when(F.col(label) == "KEEP", F.col("KEEP")).when(F.col(label) == "DISCARD", F.col("DISCARD")).when(F.col(label) == "UNKNOWN", F.col("UNKNOWN"))
    return joined.where(F.col("__rank") <= allowed).select(*df.columns)


def rescaled(targets: dict[str, int], size: int) -> dict[str, int]:
    total = sum(targets.values())
    return {k: round(v * size / total) for k, v in targets.items()}


def quota_per_group(df: DataFrame, key: str, group: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Up to quotas[g] rows of each group g by hash order."""
    most = max(quotas.values(), default=0)
    ranked = df.where(F.col(group).isin(list(quotas))).withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(hash_order(F.col(key), seed), key))).where(F.col("__rank") <= most)
    allowed = F
    for g, n in quotas.items():
        allowed = allowed.when(F.col(group) == g, n)
    return ranked.where(F.col("__rank") <= allowed.otherwise(0)).drop("__rank")


def mix_sizes(general: int, special: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """How many texts come from the general pool, the special pool, and the special pool once more. Truncation goes through doubles, as the ratios do."""
    if abs(sum(ratios) - 1.0) >= 0.01:
        raise ValueError(f"ratios must sum to 1, not {sum(ratios)}")
    total = max(int(general / ratios[0]), int(special / ratios[1]))
    return tuple(int(total * r) for r in ratios)


def drawn(df: DataFrame, key: str, n: int, available: int, seed: int) -> DataFrame:
    """n rows: without replacement from the pool if it is large enough, else from the pool repeated n // size + 1 times."""
    if not available:
        return df.withColumn("copy", F.lit(0)).limit(0)
    times = 1 if available >= n else n // available + 1
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("copy").cast("string"), F.lit(":"), F.col(key).cast("string"))), key, "copy").limit(n)


def ratio_mix(general: DataFrame, special: DataFrame, key: str, ratios: tuple[float, float, float] = (0.70, 0.20, 0.10), seed: int = 42) -> DataFrame:
    """(part, key, copy) of the mixture; both pools have a column named key."""
    g, m = general.count(), special.count()
    sizes = mix_sizes(g, m, ratios)
    parts = [
        drawn(general.select(key), key, sizes[0], g, seed).withColumn("part", F.lit("general")),
        drawn(special.select(key), key, sizes[1], m, seed + 1).withColumn("part", F.lit("special")),
        drawn(special.select(key), key, sizes[2], m, seed + 2).withColumn("part", F.lit("oversample")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", key, "copy")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key)

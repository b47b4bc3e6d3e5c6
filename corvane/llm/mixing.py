"""One mix from several sources with target shares of its words.

Efraimidis-Spirakis sampling: each record gets the exponential key -ln(u)/weight, u from a hash of its identity and
the seed, the weight from the quality of its text. Taken in order of the key, a prefix of a source is a weighted
sample without replacement. A source gives whole epochs of all its records first; what is missing to its word budget
is the prefix of the sorted keys whose running word total comes closest to it.

The total is the largest for which every source can reach its share within its cap on repeats.

Scale: the running total is taken over ``BINS`` bins of the key (a sum per source and bin, combined before its
shuffle), and only the one bin per source where the budget ends is sorted by record. So no source, however large, is
sorted in one task, and the result is the same as that of a full sort. What the driver sees are the targets and one
row per target; their number is checked against ``MAX_TARGETS``. The plan is made without texts; ``with_texts`` joins
them to the records that are in the mix.

Defined cases: words are counted from the text, never taken from a stored count; null, empty and blank texts have no words and aren't
in the mix; source names are compared without case and outer spaces; records with no source or one without target
aren't in the mix; a record delivered more than once (same key) is one record; a target without records is reported
with a share of 0 and doesn't limit the others; ties of keys are broken by the record's identity; no targets or no
records give an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from corvane.session import cut

BINS = 65_536
MAX_TARGETS = 10_000
WORD = r"(?U)[^\s\x1c-\x1f]+"


def pool(df: DataFrame, corpus: str, key: str, text: str = "text", source: str = "source") -> DataFrame:
    """(corpus, id, source, words, weight, digest) of the records of one table, each once; digest tells which of the texts delivered under one key it is."""
    t = F.col("t")
    words = F.regexp_count(t, F.lit(WORD))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\s]", "")) / F.greatest(F.length(t), F.lit(1))
    stops = F.least(F.lit(1.0), F.regexp_count(t, F.lit(r"[.!?…]")) * 25.0 / F.greatest(F.col("words"), F.lit(1)))
    rows = df.select(F.col(key).cast("string").alias("id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("t"))
    rows = rows.where("id is not null and source is not null").withColumn("words", words.cast("long")).where("words > 0")
    rows = rows.withColumn("weight", F.greatest(F.lit(0.05), letters * (0.5 + 0.5 * stops)))
    rows = rows.withColumn("digest", F.xxhash64("t"))
    return rows.groupBy("id").agg(F.max_by(F.struct("source", "words", "weight", "digest"), F.struct("words", "source", "weight", "digest")).alias("r")).select(F.lit(corpus).alias("corpus"), "id", "r.*")


def plan(records: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(records with their number of copies, one row per target). records as from pool(), possibly a union of pools; targets has source, target_share and max_repeats."""
    spark = records.sparkSession
    small = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null").distinct().limit(MAX_TARGETS + 1).collect()
    if len(small) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    u = (F.pmod(F.xxhash64(F.lit(seed), "corpus", "id"), F.lit(2**53)) + 0.5) / float(2**53)
    records = records.withColumn("key", -F.log(u) / F.col("weight"))
    # a monotone map of the key onto the bins
    records = records.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-0.5 * F.col("key"))))).cast("int"))
    records = cut(records.where(F.col("source").isin([r.source for r in small])))  # texts are read once
    bins = cut(records.groupBy("source", "bin").agg(F.sum("words").alias("words"), F.count("*").alias("records")))
    have = {r.source: (r.words, r.records) for r in bins.groupBy("source").agg(F.sum("words").alias("words"), F.sum("records").alias("records")).collect()}  # at most one row per target
    limits = [have[r.source][0] * r.max_repeats / r.target_share for r in small if r.source in have and r.target_share > 0]
    total = min(limits, default=0)
    rows = []
    for r in small:
        words, n = have.get(r.source, (0, 0))
        goal = math.floor(total * r.target_share + 1e-6)
        epochs = min(goal // words, r.max_repeats) if words else 0
        rest = goal - epochs * words if epochs < r.max_repeats else 0
        rows.append((r.source, r.target_share, r.max_repeats, words, n, goal, int(epochs), int(rest)))
    goals = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, pool_words long, pool_records long, goal long, epochs int, rest long").coalesce(1)
    # the bin in which the running total passes the rest of the budget
    run = W.partitionBy("source").orderBy("bin")
    ends = bins.join(F.broadcast(goals.select("source", "rest")), "source").withColumn("upto", F.sum("words").over(run))
    ends = ends.where("upto > rest").groupBy("source").agg(F.min("bin").alias("last_bin"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before"))
    goals = cut(goals.join(ends, "source", "left"))
    marked = records.join(F.broadcast(goals.select("source", "epochs", "rest", "last_bin", "before")), "source")  # at most MAX_TARGETS rows
    whole = marked.where(F.col("last_bin").isNull() | (F.col("bin") != F.col("last_bin"))).withColumn("extra", (F.col("last_bin").isNull() & (F.col("rest") > 0) | (F.col("bin") < F.col("last_bin"))).cast("int"))
    order = W.partitionBy("source").orderBy("key", "corpus", "id").rowsBetween(W.unboundedPreceding, -1)
    edge = marked.where("bin = last_bin").withColumn("so_far", F.col("before") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("so_far") + F.col("words") / 2 <= F.col("rest")).cast("int")).drop("so_far")
    chosen = whole.unionByName(edge).withColumn("copies", F.col("epochs") + F.coalesce("extra", F.lit(0))).where("copies > 0")
    return chosen.select("corpus", "id", "source", "words", "weight", "key", "digest", "copies"), goals


def shares(chosen: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per target: share asked for and share reached, words, records and most copies of one record."""
    got = chosen.groupBy("source").agg(F.sum(F.col("words") * F.col("copies")).alias("words"), F.count("*").alias("records"), F.max("copies").alias("most_copies"))
    out = goals.select("source", "target_share", "max_repeats", "pool_words", "pool_records").join(got, "source", "left").na.fill(0, ["words", "records", "most_copies"])
    total = F.sum("words").over(W.partitionBy())  # one row per target
    return out.withColumn("share", F.when(total > 0, F.col("words") / total).otherwise(F.lit(0.0)))


def mix(chosen: DataFrame) -> DataFrame:
    """One row per copy in the mix, copies numbered from 1; with_texts() gives them their texts."""
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("corpus", "id", "source", "words", "digest", "copy")


def with_texts(mixed: DataFrame, tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """mixed with the text of each record in place of its digest; tables are (corpus, table, key, text column).

    Every text crosses the shuffle once, however often its record is repeated, and by its record, so that no source is
    hot. Of several texts delivered under one key, the one counted in pool() is taken.
    """
    texts = None
    for corpus, df, key, text in tables:
        one = df.select(F.lit(corpus).alias("corpus"), F.col(key).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text")).where("id is not null and text is not null")
        texts = one if texts is None else texts.unionByName(one)
    return mixed.join(texts.dropDuplicates(["corpus", "id", "digest"]), ["corpus", "id", "digest"]).drop("digest")

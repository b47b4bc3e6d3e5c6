"""Near-duplicate removal in which the first row of a group stays, decided in the order of the rows.

A row is a duplicate if it is similar to an earlier row that is itself kept. That is the lexicographically first
maximal independent set of the similarity graph, not its connected components. The graph is found by min-hash bands
(an equi-join), checked exactly where wished, and resolved in rounds: a row with no undecided earlier neighbour is
decided. Copies of one shingle set are one node, so a group of copies meets no join. Each round writes what it
decided; a round per link of the longest chain at most, and the edges shrink with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.minhash import banded, shingled
from corvane.session import cut

BANDS, ROWS = 9, 13
LEAST_WORDS = 10


def jaccard(a, b):
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def exact_pairs(df: DataFrame, key: str, text: str, similarity: float = 0.8, n: int = 3) -> DataFrame:
    """(a, b, jaccard) between representatives of classes with the same shingle set, by a prefix-filtered shingle join that loses no pair.

    A set of size s shares at least ceil(similarity * s) shingles with any set as similar, so two similar sets meet
    within their first s - ceil(similarity * s) + 1 shingles in any common order; rarest first keeps the join small.
    """
    classes = _classes(shingled(df, key, text, n, LEAST_WORDS))
    grams = classes.select("k", F.size("set").alias("size"), F.explode("set").alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "g")))
    ranked = grams.join(counts, "g").groupBy("k", "size").agg(order.alias("o"))
    prefix = ranked.select("k", "size", F.explode(F.slice("o", F.lit(1), (F.col("size") - F.ceil(F.col("size") * similarity) + 1).cast("int"))).alias("e")).select("k", "size", "e.g")
    a, b = prefix.select("g", F.col("k").alias("a"), F.col("size").alias("sa")), prefix.select("g", F.col("k").alias("b"), F.col("size").alias("sb"))
    near = (F.col("a") < F.col("b")) & (F.least("sa", "sb") >= similarity * F.greatest("sa", "sb"))
    pairs = a.join(b, "g").where(near).select("a", "b").distinct()
    return _checked(pairs, classes, similarity)


def _classes(sets: DataFrame) -> DataFrame:
    """One node per distinct shingle set, its first row."""
    return cut(sets.groupBy("set").agg(F.min("k").alias("k")).select("k", "set"))


def _checked(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    left = pairs.join(nodes.select(F.col("k").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(nodes.select(F.col("k").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", jaccard("x", "y").alias("jaccard")).where(F.col("jaccard") >= similarity)


def candidate_pairs(nodes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b) that agree on a band, a < b. Bands that one node alone has fall out before the join."""
    keys = banded(nodes, bands, rows)
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    keys = keys.join(shared, "band", "left_semi")
    a, b = keys.select("band", F.col("k").alias("a")), keys.select("band", F.col("k").alias("b"))
    return a.join(b, "band").where("a < b").select("a", "b").distinct()


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, kept_by): kept_by is null for kept nodes and an earlier kept neighbour for duplicates. edges are (a, b) with a < b."""
    edges = cut(edges.select("a", "b"))
    decided = None
    while not edges.isEmpty():
        # a node that no undecided node precedes stays; its later neighbours are its duplicates
        later = edges.select(F.col("b").alias("k")).distinct()
        roots = edges.select(F.col("a").alias("k")).distinct().join(later, "k", "left_anti")
        hit = edges.join(roots.withColumnRenamed("k", "a"), "a").groupBy("b").agg(F.min("a").alias("kept_by")).select(F.col("b").alias("k"), "kept_by")
        hit = cut(hit)
        decided = hit if decided is None else decided.unionByName(hit)
        gone = hit.select("k")
        edges = edges.join(gone.withColumnRenamed("k", "b"), "b", "left_anti").join(gone.withColumnRenamed("k", "a"), "a", "left_anti")
        edges = cut(edges.join(roots.withColumnRenamed("k", "a"), "a", "left_anti"))
    return _with_decided(nodes, decided)


def resolve_bands(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """resolve() for the graph in which nodes of one band are neighbours, without listing pairs.

    In each round a node that comes first in all its bands stays, and whatever shares a band with it is its
    duplicate. A band of a third of all nodes costs as many rows, not their square.
    """
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    keys = cut(keys.join(shared, "band", "left_semi"))
    decided = None
    while not keys.isEmpty():
        first = keys.groupBy("band").agg(F.min("k").alias("first"))
        placed = keys.join(first, "band")
        roots = placed.groupBy("k").agg(F.bool_and(F.col("k") == F.col("first")).alias("all")).where("all").select("k")
        led = placed.join(roots.withColumnRenamed("k", "first"), "first", "left_semi")
        hit = cut(led.groupBy("k").agg(F.min("first").alias("root")))  # roots lead themselves
        gone = hit.where("k <> root").select("k", F.col("root").alias("kept_by"))
        decided = gone if decided is None else decided.unionByName(gone)
        keys = cut(keys.join(hit.select("k"), "k", "left_anti"))
    return _with_decided(nodes, decided)


def _with_decided(nodes: DataFrame, decided: DataFrame | None) -> DataFrame:
    if decided is None:
        return nodes.select("k").withColumn("kept_by", F.lit(None).cast(nodes.schema["k"].dataType))
    return nodes.select("k").join(decided, "k", "left")


def first_wins(df: DataFrame, key: str, text: str, similarity: float = 0.8, verify: bool = False, n: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, duplicate_of): every row, with the earlier kept row it duplicates, or null where it stays. Rows too short to judge stay."""
    sets = cut(shingled(df, key, text, n, LEAST_WORDS))
    classes = _classes(sets)
    if verify:
        nodes = resolve(classes, _checked(candidate_pairs(classes, bands, rows), classes, similarity))
    else:
        nodes = resolve_bands(classes, banded(classes, bands, rows))
    # copies follow their class: its first row stays or falls with it, the rest duplicate what stays
    member = sets.join(classes.select("set", F.col("k").alias("head")), "set").select("k", "head").join(nodes.select(F.col("k").alias("head"), "kept_by"), "head")
    of = F.coalesce("kept_by", F.when(F.col("k") != F.col("head"), F.col("head")))
    return df.select(F.col(key).alias("k")).join(member.select("k", of.alias("duplicate_of")), "k", "left").select(F.col("k").alias(key), "duplicate_of")

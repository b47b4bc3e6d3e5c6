"""The pN_ queries of this subpackage and their SQL; __spark_entry__.py adds them where the folder exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.bpe import token_ids
from corvane.llm.furniture import repeated_lines, without_repeated_lines
from corvane.llm.leakage import leaks, without_leaks
from corvane.llm.lookalike import canonical_text, lookalike_pairs
from corvane.llm import mixing
from corvane.llm.neardup import near_duplicate_pairs
from corvane.llm.pairs import defective_pairs
from corvane.llm.quality import FEATURES, LEARNED_ON, kinds
from corvane.llm.spam import spam_pages
from corvane.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(read_table(spark, sf, "articles_cleaned"))


def p1_canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_text(read_table(spark, sf, "articles_cleaned").select("seq", "text"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(read_table(spark, sf, "articles_cleaned"))


def p2_without_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeated_lines(read_table(spark, sf, "articles_cleaned")).select("seq", "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return defective_pairs(read_table(spark, sf, "qa_pairs"))


MIXED = [("articles_cleaned", "seq"), ("general_corpus", "text_id")]


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    first, second = (mixing.pool(read_table(spark, sf, t), t, key) for t, key in MIXED)
    return mixing.plan(first.unionByName(second), read_table(spark, sf, "mix_targets"))


def p4_mix(spark: SparkSession, sf: str) -> DataFrame:
    chosen, goals = _mix(spark, sf)
    reached = mixing.shares(chosen, goals).select("source", F.col("share").alias("source_share"))
    mixed = mixing.mix(chosen).join(F.broadcast(reached), "source")  # one row per target, checked in plan()
    return mixing.with_texts(mixed, [(t, read_table(spark, sf, t), key, "text") for t, key in MIXED]).select("source", "corpus", "id", "words", "copy", "source_share", "text")


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(read_table(spark, sf, "articles"), words=3, similarity=0.7, min_words=10)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return kinds(read_table(spark, sf, "articles"), word_count=None, features=LEARNED_ON).where("kind <> 'prose'").select("seq", "kind").distinct()


def p6_figures(spark: SparkSession, sf: str) -> DataFrame:
    return kinds(read_table(spark, sf, "articles")).select("seq", "words", "count_matches", *FEATURES, "kind")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(read_table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return without_leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages(read_table(spark, sf, "documents"), [read_table(spark, sf, "general_corpus")])


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_WORD = r"[^\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]+"
SQL = {
    "p5_found": f"""WITH w AS (SELECT seq, regexp_extract_all(lower(text), '{_WORD}') AS w FROM articles WHERE text IS NOT NULL),
s AS (SELECT seq, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 10),
g AS (SELECT seq, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.seq < b.seq GROUP BY 1, 2)
SELECT seq_a, seq_b FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.7""",
    "p8_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12), ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Scalar text functions as native column expressions, with Python's idea of white space."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WORD = r"(?U)[^\s\x1c-\x1f]+"
GAP = r"(?U)[\s\x1c-\x1f]+"


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rstrip_lines(text: Column) -> Column:
    """Each line without its trailing white space."""
    return F.regexp_replace(text, r"(?U)[[^\S\n]\x1c-\x1f]+(?=\n|\z)", "")


def special_ratio(text: Column) -> Column:
    """Share of characters that are no letter, digit, space or plain punctuation; 0 for empty."""
    plain = F.length(F.regexp_replace(text, r"""(?U)[\p{L}\p{N}\s.,;:!?'"()-]""", ""))
    return F.when(F.length(text) > 0, plain / F.length(text)).otherwise(F.lit(0.0))


def shingles(text: Column, n: int = 3) -> Column:
    """All runs of n words of the lower-cased text, in order; empty where there are fewer words."""
    w = F.filter(F.split(F.lower(strip(text)), GAP), lambda x: x != "")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def head_words(text: Column, n: int, marker: str = "") -> Column:
    """The first n words and a marker, or the text unchanged where it has no more than n."""
    return F.when(word_count(text) > n, F.concat(F.array_join(F.slice(words(text), 1, n), " "), F.lit(marker))).otherwise(text)


def length_bucket(n: Column, edges: list[int], labels: list[str]) -> Column:
    """Half-open buckets: labels[i] holds values below edges[i], the last label the rest."""
    out = F
    for e, label in zip(edges, labels):
        out = out.when(n < e, label)
    return out.otherwise(labels[-1])


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode canonical composition; no built-in function does it."""
    for s in texts:
        yield s.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def title_case(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each run of letters capitalised, also after an apostrophe or digit, where initcap() only looks at spaces."""
    for s in texts:
        yield s.str.title()


def normalize_text(text: Column) -> Column:
    """Canonical composition, runs of blanks as one, at most one empty line, no outer white space."""
    return strip(F.regexp_replace(F.regexp_replace(nfc(text), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def slug_title(slug: Column) -> Column:
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))

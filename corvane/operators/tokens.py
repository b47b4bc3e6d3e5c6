"""Token sequences for training: packing into fixed windows, padding, byte-pair training and encoding, coverage.

Packing needs the position of a document in the whole stream. The running total is taken in two steps: a total per
range of keys, combined before its shuffle, and a running total within each range. No window spans the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from corvane.functions.text import words
from corvane.session import cut, ship

RANGE, ROUND = 4096, 256
PAD, UNK, BOS, EOS = 0, 1, 2, 3


def word_length_tokens(text: Column) -> Column:
    """A stand-in for a tokenizer in tests: the lengths of the words."""
    return F.transform(words(text), lambda w: F.length(w))


def positioned(df: DataFrame, key: str, tokens: str, eos: int = EOS) -> DataFrame:
    """(key, tokens with the end mark, start): the place of each document's tokens in the stream ordered by key. Empty and null token lists are left out."""
    rows = df.where(F.size(tokens) > 0).select(F.col(key).alias("k"), F.concat(F.col(tokens), F.array(F.lit(eos))).alias("tokens"))
    rows = rows.withColumn("range", F.floor(F.col("k") / RANGE))
    total = rows.groupBy("range").agg(F.sum(F.size("tokens")).alias("n"))
    # ranges of ranges keep the second running total small, too
    total = total.withColumn("upper", F.floor(F.col("range") / RANGE))
    tops = total.groupBy("upper").agg(F.sum("n").alias("n")).withColumn("top", F.sum("n").over(W.orderBy("upper").rowsBetween(W.unboundedPreceding, -1)))  # one row per 16 million keys
    base = F.coalesce(F.sum("n").over(W.partitionBy("upper").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = total.withColumn("base", base).join(tops.select("upper", F.coalesce("top", F.lit(0)).alias("top")), "upper").select("range", (F.col("base") + F.col("top")).alias("base"))
    within = F.coalesce(F.sum(F.size("tokens")).over(W.partitionBy("range").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(offsets, "range").select(F.col("k").alias(key), "tokens", (F.col("base") + F.col("within")).alias("start"))


def packed(df: DataFrame, key: str, tokens: str, context: int, eos: int = EOS) -> DataFrame:
    """(chunk, x, y): windows of ``context`` tokens over the stream, and the same shifted by one; the incomplete tail is dropped.

    A document sends each chunk only the slice that falls into it, not a row per token.
    """
    placed = positioned(df, key, tokens, eos)
    size = F.size("tokens")
    first, last = F.floor(F.greatest(F.col("start") - 1, F.lit(0)) / context), F.floor((F.col("start") + size - 1) / context)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * context - F.col("start"), F.lit(0))
    hi = F.least((F.col("chunk") + 1) * context + 1 - F.col("start"), size.cast("long"))  # one more for the shift
    pieces = pieces.where(hi > lo).select("chunk", (F.col("start") + lo).alias("at"), F.slice("tokens", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = pieces.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"])).alias("t")).where(F.size("t") == context + 1)
    return whole.select("chunk", F.slice("t", 1, context).alias("x"), F.slice("t", 2, context).alias("y"))


def batches_per_epoch(tokens: int, context: int, batch: int) -> int:
    return (tokens - 1) // (context * batch)


def padded(df: DataFrame, key: str, tokens: str, context: int, pad: int = PAD) -> DataFrame:
    """(key, x, y) of sequences that fit: padded right, y shifted by one. Longer ones are left out."""
    fits = df.where((F.size(tokens) <= context) & (F.size(tokens) > 0))
    full = F.concat(F.col(tokens), F.array_repeat(F.lit(pad), context + 1 - F.size(tokens)))
    return fits.select(key, F.slice(full, 1, context).alias("x"), F.slice(full, 2, context).alias("y"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def long_words(df: DataFrame, text: str, least: int = 12) -> DataFrame:
    """(token, freq) of runs of at least ``least`` small letters."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"\b[a-z]{{{least},}}\b"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def greedy_split(token: str, known: frozenset[str], most: int = 4) -> str | None:
    """The token as 2 to ``most`` known words, longest first; None if that leads nowhere."""
    pieces, at = [], 0
    while at < len(token):
        end = next((j for j in range(len(token), at, -1) if token[at:j] in known), None)
        if end is None or len(pieces) == most:
            return None
        pieces.append(token[at:end])
        at = end
    return " ".join(pieces) if len(pieces) > 1 else None


def splits(df: DataFrame, token: str, known: list[str], most: int = 4, out: str = "auto_split") -> DataFrame:
    listed = frozenset(known)

    @F.pandas_udf(T.StringType())
    def split(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: greedy_split(t, listed, most), na_action="ignore")

    ship(df.sparkSession)
    return df.withColumn(out, split(F.col(token)))


def learn_merges(counts: list[tuple[str, int]], size: int) -> list[tuple[bytes, bytes]]:
    """Byte-pair merges from word counts, most frequent pair first, ties by the pair. counts is a vocabulary, bounded by the caller."""
    words_ = [([bytes([b]) for b in w.encode()], n) for w, n in counts]
    pairs: Counter = Counter()
    where: dict[tuple[bytes, bytes], set[int]] = {}
    for i, (w, n) in enumerate(words_):
        for p in zip(w, w[1:]):
            pairs[p] += n
            where.setdefault(p, set()).add(i)
    merges: list[tuple[bytes, bytes]] = []
    while len(merges) < size and pairs:
        best = max(pairs, key=lambda p: (pairs[p], p))
        if pairs[best] < 2:
            break
        merges.append(best)
        for i in where.pop(best, ()):
            w, n = words_[i]
            for p in zip(w, w[1:]):
                pairs[p] -= n
                if pairs[p] <= 0:
                    del pairs[p]
            out, k = [], 0
            while k < len(w):
                if k + 1 < len(w) and (w[k], w[k + 1]) == best:
                    out.append(best[0] + best[1])
                    k += 2
                else:
                    out.append(w[k])
                    k += 1
            words_[i] = (out, n)
            for p in zip(out, out[1:]):
                pairs[p] += n
                where.setdefault(p, set()).add(i)
    return merges


def merges_of(df: DataFrame, text: str, size: int = 1000, vocabulary: int = 200_000) -> list[tuple[bytes, bytes]]:
    """Merges of a corpus, from all its distinct words: up to ``vocabulary`` of them come to the driver, more stay in the cluster and only their most frequent pairs come."""
    counts = word_counts(df, text)
    few = counts.limit(vocabulary + 1).collect()
    return learn_merges([(r.word, r.n) for r in few], size) if len(few) <= vocabulary else _merges_in_cluster(cut(counts), size)


def _merges_in_cluster(counts: DataFrame, size: int) -> list[tuple[bytes, bytes]]:
    """What learn_merges() gives for all rows (word, n): each round counts the pairs of all words and takes as many merges as can't depend on each other."""
    ship(counts.sparkSession)
    merges: list[tuple[bytes, bytes]] = []

    def pairs_after(ranks: dict[tuple[bytes, bytes], int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs: Counter = Counter()

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "n"])
                pairs.clear()
                return out

            for batch in batches:
                for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts = encode_word(w, ranks)
                    for p in zip(parts, parts[1:]):
                        pairs[p] += n
                    if len(pairs) > 200_000:
                        yield flush()
            yield flush()

        return run

    while len(merges) < size:
        found = counts.select("word", "n").mapInArrow(pairs_after({m: i for i, m in enumerate(merges)}), "a binary, b binary, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = [((bytes(r.a), bytes(r.b)), r.n) for r in found.orderBy(F.desc("n"), F.desc("a"), F.desc("b")).limit(ROUND).collect()]
        batch = _independent(top, {a + b for a, b in merges})
        if not batch:
            break
        merges += batch
    return merges[:size]


def _independent(top: list[tuple[tuple[bytes, bytes], int]], made: set[bytes]) -> list[tuple[bytes, bytes]]:
    """The merges that stand first in top, most frequent first, whatever the ones before them change.

    A merge changes only the counts of pairs that share a symbol with it, and a pair it makes is at most as frequent as
    one of those. So pairs without common symbols, more frequent than the first that has one, keep their places. A
    symbol doubled, or made in a second way, follows other rules and ends the row.
    """
    batch: list[tuple[tuple[bytes, bytes], int]] = []
    used: set[bytes] = set()
    rest = top[-1][1] if len(top) == ROUND else 0
    for (a, b), n in top:
        alone = a == b or a + b in made or a + b in used
        if n < 2 or batch and (alone or a in used or b in used):
            rest = n
            break
        batch.append(((a, b), n))
        used |= {a, b, a + b}
        if alone:
            return [batch[0][0]]
    return [p for k, (p, n) in enumerate(batch) if k == 0 or n > rest]


def encode_word(word: str, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    parts = [bytes([b]) for b in word.encode()]
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def encoded(df: DataFrame, key: str, text: str, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """(key, ids): ids 0-3 are pad, unknown, begin and end, then the bytes, then the merges in order."""
    shared = df.sparkSession.sparkContext.broadcast((merges, {m: i for i, m in enumerate(merges)}))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        merges, ranks = shared.value
        table = {bytes([b]): 4 + b for b in range(256)} | {a + b: 260 + i for i, (a, b) in enumerate(merges)}
        known: dict[str, list[int]] = {}

        def one(t):
            out = []
            for w in t.split() if isinstance(t, str) else ():
                if w not in known:
                    known[w] = [table[p] for p in encode_word(w, ranks)]
                out += known[w]
            return out

        return texts.map(one)

    ship(df.sparkSession)
    return df.select(key, ids(F.col(text)).alias("ids"))


def decode(ids: list[int], merges: list[tuple[bytes, bytes]]) -> str:
    return b"".join(bytes([i - 4]) if i < 260 else b"".join(merges[i - 260]) for i in ids if i > 3).decode("utf-8", "replace")


def coverage(df: DataFrame, word: str, ids: str) -> DataFrame:
    """(whole, n): how many words are one token."""
    return df.groupBy((F.size(ids) == 1).alias("whole")).agg(F.count("*").alias("n"))

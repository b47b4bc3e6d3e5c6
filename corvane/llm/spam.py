"""Pages of keywords, links or product tags, told by how unlikely their word classes are in written text.

Each word becomes a class: function word, number, repeated word, other word,
link, tag, separator, word of an offer; commas, stops and line ends are classes too. A word is repeated if it makes up
``REPEAT_SHARE`` of the page, or if words that stand ``REPEAT_LEAST`` times within ``SPAN`` words make up
``REPEAT_PIECE`` of its piece: then many keywords, each with a small share of a long page, are repeated words, and those of prose, with
function words among them, are not. A trigram model over classes is
trained on prose: whole prose tables, counted by an aggregation, and generated writing in several languages
with the lists and change logs that ordinary pages hold (``sampledocs``; a fixed number of documents). A page is cut into sentences and lines,
short lines in a row taken together, and each piece whose perplexity is abnormally high for its length counts
with all its words. So does each stretch of pieces whose perplexity is lower than that of any stretch of the generated writing: a single
piece can't be told from prose by that, since the classes of prose alternate, too. A page is flagged if such words are more than half of its words.

Only the counts of class trigrams (at most ``len(CLASSES)`` cubed) reach the driver; the documents are read once and
nothing of them is shuffled.

Defined cases: null, empty and blank texts have no words and aren't flagged; texts of any length are scored whole; a
repeated row is scored again and listed once; other columns don't reach the operator.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.pairs import FUNCTION_WORDS
from corvane.llm.quality import MORE_WORDS
from corvane.llm.sampledocs import Maker
from corvane.session import ship, spread

CLASSES = "^FNwRULTSO,.B"  # start, function, number, other word, repeated, URL, wiki link, tag, separator, offer, comma, stop, line end
AT = {c: i for i, c in enumerate(CLASSES)}
K = len(CLASSES)
FUNCTION = set(" ".join(FUNCTION_WORDS.values()).split()) | set(MORE_WORDS) | set("a i s t now was were near being of de von i he she we they so very most just after while every each some any other than such which who what how can could would should may might must will did does do go goes went после до через нужно чтобы можно каждый каждая каждое собой редко рядом против ещё очень только потому под над при без между когда где кто чем нет есть это который которая они она мы вы".split())
# Words of offers.
OFFER = set("sku cart stock sale sold buy price cheap discount shipping checkout order offer deal deals promo coupon usd eur $ € £ view wishlist kaufen günstig kostenlos comprar barato gratis acheter pas cher".split()) - {"pas", "view", "order", "offer"}
URL = re.compile(r"(?:https?://|www\.)\S|^[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/|$|\?)|href=|\]\(|^<a$|</a>", re.I)
STEM = re.compile(r"[^\W_]+")
LINK = re.compile(r"\[\[[^\[\]\n]*\]\]")
WORD = re.compile(r"\S+")
MARKDOWN = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)|<a\s[^<>]*>.*?</a>", re.S)
LONG, SHORT, BLOCK = 40, 6, 24
REPEAT_LEAST, REPEAT_SHARE = 5, 0.03
SPAN, REPEAT_PIECE = 1000, 0.7
SAMPLE, SEED = 1500, 5
REMEMBER = 200_000
HIGH_Z, STEPS, STRETCH = 6.5, 8, 100


class Reader:
    """Cuts texts into pieces and gives each word its class; remembers the words it has seen, up to ``REMEMBER``."""

    def __init__(self):
        self.seen: dict[str, tuple[int, str, int]] = {}

    def word(self, w: str) -> tuple[int, str, int]:
        """(class on its own, stem if it may be a repeated word, class that follows it or 0)."""
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        c = _class(w)
        parts = STEM.findall(w)
        stem = parts[0].lower().rstrip("s") if parts and c == AT["w"] else ""
        last = w.rstrip("”\"»’')]")[-1:]
        mark = AT["."] if last and last in ".!?…" and c != AT["U"] else AT[","] if last and last in ",;:" else 0
        out = self.seen[w] = (c, stem, mark)
        return out

    def pieces(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(classes of all pieces end to end, each opened by two starts; where each piece begins; words in each piece)."""
        # the words of a link belong to it, caption and all
        if "](" in text or "<a" in text:
            text = MARKDOWN.sub(lambda m: WORD.sub("\x01", m.group()), text)
        if "[[" in text:
            text = LINK.sub(lambda m: WORD.sub("\x02", m.group()), text)
        seen, word = self.seen, self.word
        lines = [[seen.get(w) or word(w) for w in line.split()] for line in text.split("\n")]
        stems = Counter([x[1] for line in lines for x in line])
        total = sum(map(len, lines))
        least = max(REPEAT_LEAST, REPEAT_SHARE * total)
        often = {k for k, n in stems.items() if k and n >= least}
        near = self.near([x[1] for line in lines for x in line] if total > SPAN else [], stems)
        flat: list[int] = []
        starts: list[int] = []
        words: list[int] = []
        n, was_short, stop, comma, end, repeated = 0, False, AT["."], AT[","], AT["B"], AT["R"]
        at, half, here, again = 0, SPAN // 2, near[0], []

        def close() -> int:
            """Ends a piece. Where words repeated nearby make up most of it, they are repeated words, too."""
            words.append(n)
            if len(again) >= REPEAT_PIECE * n:
                for k in again:
                    flat[k] = repeated
            again.clear()
            return 0

        for line in lines:
            if not line:
                continue
            short = len(line) < SHORT
            if n and not (short and was_short and n < BLOCK):
                n = close()
            was_short = short
            for c, stem, mark in line:
                if not n:
                    starts.append(len(flat))
                    flat += (0, 0)
                n += 1
                if len(near) > 1 and not at % half:
                    here = near[at // half]
                at += 1
                if stem in here:
                    again.append(len(flat))
                flat.append(repeated if stem in often else c)
                if mark == stop:
                    flat.append(stop)
                    if not short:
                        n = close()
                elif mark == comma:
                    flat.append(comma)
                if n >= LONG:
                    n = close()
            if n:
                if short:
                    flat.append(end)
                else:
                    n = close()
        if n:
            close()
        return flat, starts, words

    @staticmethod
    def near(order: list[str], stems: Counter) -> list[set[str]]:
        """Stems that stand at least ``REPEAT_LEAST`` times within ``SPAN`` words, for each half span of a text; a text of up to one span (no order) has one set."""
        if not order:
            return [{k for k, n in stems.items() if k and n >= REPEAT_LEAST}]
        halves = [Counter(order[k : k + SPAN // 2]) for k in range(0, len(order), SPAN // 2)]
        spans = [{k for k, n in (a + b).items() if k and n >= REPEAT_LEAST} for a, b in zip(halves, halves[1:])]
        return [a | b for a, b in zip([spans[0], *spans], [*spans, spans[-1]])]


def _class(w: str) -> int:
    if w[0] == "\x01" or URL.search(w):
        return AT["U"]
    if w[0] == "\x02":
        return AT["L"]
    if w[0] == "#" and len(w) > 1 and w[1].isalpha():
        return AT["T"]
    parts = STEM.findall(w)
    if not parts:
        return AT["S"]
    s = parts[0].lower()
    if s in FUNCTION:
        return AT["F"]
    if s in OFFER or w[0] in "$€£" or w[-1] in "$€£":
        return AT["O"]
    return AT["N"] if parts[0].isdigit() else AT["w"]


def read(reader: Reader, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class trigrams of all texts, where each piece begins, words in each piece, text of each piece)."""
    flat, starts, words, doc = [], [], [], []
    for i, t in enumerate(texts):
        if t:
            f, s, w = reader.pieces(t)
            base = len(flat)
            flat += f
            starts += [base + x for x in s]
            words += w
            doc += [i] * len(w)
    x = np.array(flat, np.int64)
    grams = x.copy()
    if len(x) > 2:
        grams[2:] += x[1:-1] * K + x[:-2] * K * K
    starts = np.array(starts, np.int64)
    real = np.ones(len(x), bool)
    real[starts], real[starts + 1] = False, False
    before = np.concatenate([[0], np.cumsum(real)])
    return grams[real], before[starts], np.array(words, np.int64), np.array(doc, np.int64)


def count_trigrams(texts: list[str]) -> np.ndarray:
    return np.bincount(read(Reader(), texts)[0], minlength=K**3)


def ordinary_writing(n: int = SAMPLE, seed: int = SEED) -> list[str]:
    """Prose in several languages, some with a recipe's list or a change log, or with a link here and there."""
    m = Maker(seed)
    r, out = m.r, []
    for _ in range(n):
        parts = [m.prose(r.randint(30, 160))]
        form = r.random()
        k = r.randint(3, 14)
        if form < 0.25:
            parts.append("\n".join(f"{i + 1}. {r.randint(1, 99)} x {m.word()} {m.word()} {m.word()}" for i in range(k)))
        elif form < 0.5:
            what = ("Fixed {} not being {} near a {} {}", "Added {} {} {} to the {}", "{} range now # (was #)", "Improved {} of {}", "Removed the {} from {} {}")
            parts.append("\n".join("- " + re.sub("#", lambda _: str(r.randint(1, 99)), r.choice(what)).format(*(m.word() for _ in range(4))) for _ in range(k)))
        elif form < 0.6:
            parts.append("\n".join(f"- {m.word()} {m.word()}" for _ in range(k)))
        out.append("\n".join(parts if r.random() < 0.7 else parts[::-1]))
    return out


class Model:
    """Class trigrams with interpolated shorter contexts, and how the mean surprise of ordinary pieces spreads."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(K, K, K).astype(float)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        uni = (uni + 0.5) / (uni.sum() + 0.5 * K)
        bi = (bi + 5 * uni) / (bi.sum(axis=1, keepdims=True) + 5)
        tri = (tri + 5 * bi) / (tri.sum(axis=2, keepdims=True) + 5)
        self.bits = -np.log2(tri).ravel()
        weight = counts / counts.sum()
        self.mean = float((weight * self.bits).sum())
        self.spread = math.sqrt(float((weight * (self.bits - self.mean) ** 2).sum()))
        self.low = 0.0

    def stretches(self, grams: np.ndarray, starts: np.ndarray, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean surprise of each stretch, stretch of each piece): pieces of a text in a row, about ``STRETCH`` trigrams; the mean of one less than half as long is infinite."""
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        inside = starts - np.maximum.accumulate(np.where(first, starts, 0))
        at = inside // STRETCH
        of = np.cumsum(first | np.concatenate([[True], at[1:] != at[:-1]])) - 1
        size = np.diff(np.append(starts, len(grams)))
        n = np.bincount(of, weights=size)
        bits = np.bincount(of, weights=np.add.reduceat(self.bits[grams], starts))
        return np.where(n >= STRETCH / 2, bits / n, np.inf), of

    def shares(self, reader: Reader, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words, share of words in abnormal pieces) of each text."""
        grams, starts, words, doc = read(reader, texts)
        total, odd = np.zeros(len(texts)), np.zeros(len(texts))
        if len(starts):
            size = np.diff(np.append(starts, len(grams)))
            mean = np.add.reduceat(self.bits[grams], starts) / size
            # neighbours depend on each other: longer pieces tell no more than STEPS words
            z = (mean - self.mean) * np.sqrt(np.minimum(size, STEPS)) / self.spread
            np.add.at(total, doc, words)
            level, of = self.stretches(grams, starts, words, doc)
            np.add.at(odd, doc, words * ((z > HIGH_Z) | (level[of] < self.low)))
        return total.astype(np.int64), odd / np.maximum(total, 1)


def train(prose: list[DataFrame], text: str = "text", n: int = SAMPLE, seed: int = SEED) -> Model:
    """The model from all rows of the prose tables and n generated documents. Each source weighs the same, whatever its size."""
    own = read(Reader(), ordinary_writing(n, seed))
    counts = np.bincount(own[0], minlength=K**3).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            c = np.bincount(read(reader, b.column(0).to_pylist())[0], minlength=K**3)
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["gram", "n"])

    total = counts.sum()
    for df in prose:
        ship(df.sparkSession)
        grams = spread(df.select(F.col(text).cast("string"))).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most K cubed rows
        seen = np.zeros(K**3)
        for g in grams:
            seen[g.gram] = g.n
        if seen.sum():
            counts += seen * (total / seen.sum())
    model = Model(counts)
    low = min(model.stretches(*own)[0], default=math.inf)
    model.low = float(low) if low < math.inf else 0.0
    return model


def spam_shares(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, spam_share) of every document with a text."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = shared.value, Reader()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                words, share = m.shares(reader, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int32()), pa.array(share, pa.float64())], names=[key, "words", "spam_share"])

    schema = T.StructType([docs.schema[key], T.StructField("words", T.IntegerType()), T.StructField("spam_share", T.DoubleType())])
    return spread(docs.select(key, text).where(F.col(text).isNotNull())).mapInArrow(run, schema)


def spam_pages(docs: DataFrame, prose: list[DataFrame], key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key): documents with more than ``least`` of their words in abnormal pieces."""
    return spam_shares(docs, train(prose), key, text).where(F.col("spam_share") > least).select(key).distinct()

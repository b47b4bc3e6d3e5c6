"""Numeric functions of model training and sampling, over columns and arrays of logits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corvane.session import computed_once


def learning_rate(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Linear warm-up, cosine decay, a tenth of the peak afterwards."""
    progress = (step - warmup) / float(total - warmup)
    return F.when(step < warmup, peak * step / float(warmup)).when(step >= total, F.lit(peak * 0.1)).otherwise(peak * 0.5 * (1.0 + F.cos(math.pi * progress)))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become null."""
    least = F.element_at(F.sort_array(logits, asc=False), k)
    return F.transform(logits, lambda x: F.when(x >= least, x))


def with_top_p(df: DataFrame, probabilities: str, p: float, out: str) -> DataFrame:
    """df with the smallest set of most likely entries that reaches p, renormalised, the others 0. Arrays are columns of their own, so each is computed once."""
    steps = computed_once(df, {"__ranked": F.sort_array(probabilities, asc=False)})
    ranked = F.col("__ranked")
    before = F.transform(ranked, lambda x, i: F.aggregate(F.slice(ranked, 1, i), F.lit(0.0), lambda a, y: a + y))  # mass ahead of each rank
    steps = computed_once(steps, {"__n": F.size(F.filter(before, lambda b: b <= p))})
    steps = computed_once(steps, {"__kept": F.slice("__ranked", F.lit(1), F.col("__n"))})
    steps = computed_once(steps, {"__least": F.array_min("__kept"), "__total": F.aggregate("__kept", F.lit(0.0), lambda a, y: a + y)})
    scaled = F.transform(probabilities, lambda x: F.when(x >= F.col("__least"), x / F.col("__total")).otherwise(F.lit(0.0)))
    return computed_once(steps, {out: scaled}).drop("__ranked", "__n", "__kept", "__least", "__total")


def argmax(values: Column) -> Column:
    """0-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log of the softmax probability of the 0-based target."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.log(total) - (F.element_at(logits, target + 1) - top)

"""Ordered rule lists by incremental reduced-error pruning, exported to SQL.

Classes are learned from the rarest to the most frequent, which is the default. A rule grows on two thirds of what
is left by the condition of highest information gain, until it covers no other class, and is then cut on the last third to
the beginning that tells most rows right there. A class is done when a pruned rule is right on fewer than
``LEAST_PRECISION`` of the last third's rows it covers, or no example of it is left. Ties go to the earlier feature and the lower threshold, so a seed gives one list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

LEAST_PRECISION = 0.8


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] <= self.value

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value!r}"


@dataclass(frozen=True)
class Rule:
    label: str
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


@dataclass(frozen=True)
class RuleList:
    rules: tuple[Rule, ...]
    default: str

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(x.values()))), self.default, dtype=object)
        for r in reversed(self.rules):
            out[r.holds(x)] = r.label
        return out

    def sql(self) -> str:
        """A CASE expression over the feature columns."""
        if not self.rules:
            return f"'{self.default}'"
        return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r.conditions)} THEN '{r.label}'" for r in self.rules) + f" ELSE '{self.default}' END"


def _cuts(v: np.ndarray, most: int) -> np.ndarray:
    u = np.unique(v)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most)))


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: int) -> list[Condition]:
    on, out = np.ones(len(y), bool), []
    while (on & ~y).any() and len(out) < 8:
        p0, n0 = int((on & y).sum()), int((on & ~y).sum())
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for f, v in x.items():
            for t in _cuts(v[on], cuts):
                for at_least in (True, False):
                    c = Condition(f, at_least, round(float(t), 4))
                    m = on & c.holds(x)
                    p, n = int((m & y).sum()), int((m & ~y).sum())
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                        best = (gain, c, m)
        if best[1] is None:
            break
        out.append(best[1])
        on = best[2]
    return out


def _worth(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> int:
    """Rows of the pruning set that the rule tells right: covered ones of the class and all others that it leaves."""
    m = Rule("", tuple(rule)).holds(x)
    return int((m & y).sum()) + int((~m & ~y).sum())


def _precision(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    m = Rule("", tuple(rule)).holds(x)
    return (int((m & y).sum()) + 1) / (int(m.sum()) + 2)


def induce(x: dict[str, np.ndarray], labels: np.ndarray, default: str, seed: int = 7, cuts: int = 48) -> RuleList:
    """The ordered rule list for labelled rows; x maps feature names to columns."""
    rng = np.random.default_rng(seed)
    names, counts = np.unique(labels, return_counts=True)
    left = np.ones(len(labels), bool)
    rules: list[Rule] = []
    for label in [str(n) for _, n in sorted(zip(counts, names)) if n != default]:
        while (left & (labels == label)).any():
            at = rng.permutation(np.flatnonzero(left))
            y = labels[at] == label
            third = np.zeros(len(at), bool)
            for part in (np.flatnonzero(y), np.flatnonzero(~y)):  # both sets keep the share of the class
                third[part[: len(part) // 3]] = True
            grow = {f: v[at][~third] for f, v in x.items()}
            prune = {f: v[at][third] for f, v in x.items()}
            if not y[~third].any():
                break
            rule = _grow(grow, y[~third], cuts)
            ends = [rule[:n] for n in range(1, len(rule) + 1)]
            rule = max(ends, key=lambda r: _worth(r, prune, y[third]), default=[])  # the shortest of the best
            if not rule or _precision(rule, prune, y[third]) < LEAST_PRECISION:
                break
            done = Rule(label, tuple(rule))
            covered = done.holds(x) & left
            if not (covered & (labels == label)).any():
                break
            rules.append(done)
            left &= ~covered
    return RuleList(tuple(rules), default)

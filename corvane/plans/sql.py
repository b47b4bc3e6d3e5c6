"""Pieces of SQL made from the same tables of values as the operators, in the other engine's dialect."""

from __future__ import annotations

# white space as Python has it, spelled for an engine whose classes know ASCII only
GAP = r"[\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]"
NO_GAP = r"[^\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]"
CATS = "list_filter(coalesce(categories, []), lambda x: x IS NOT NULL)"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def ql(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def tup(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {q(NO_GAP + '+')})"


def n_words(t: str) -> str:
    return f"coalesce(len({words(t)}), 0)"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {q('^' + GAP + '+|' + GAP + '+$')}, '', 'g')"


def rep(t: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, {q(flags)})"


def rep_all(t: str, patterns, to: str = "", lead: str = "(?m)") -> str:
    for p in patterns:
        t = rep(t, lead + p, to)
    return t


def rstrip_lines(t: str) -> str:
    return rep(t, r"[^\S\n]+(\n|$)", r"\1")


def starts(t: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({t}, {q(p)})" for p in prefixes) + ")"


def contains(t: str, parts) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(p)})" for p in parts) + ")"


def case(tests: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {q(v)}" for t, v in tests) + f" ELSE {default} END"


def has(value: str, cats: str = CATS) -> str:
    return f"list_contains({cats}, {q(value)})"


def has_any(values, cats: str = CATS) -> str:
    return f"list_has_any({cats}, {ql(values)})"

"""Replies of a text generator brought into one form, as column expressions.

A reply is cut into blocks, an array of structs with the heading line and the lines below it. Everything after that is
array work on blocks: lines of the properties are mapped one by one, what stands loose below them becomes a block of
its own, and the rest is joined again. Each step is a column that is computed once.

Defined cases: null and blank replies give an empty text with the expected title, format ``unknown``, no sections and
the warning ``empty input``; of several headings with one name the last is in ``sections``; properties are mapped where
they stand, also where the same lines come before; extra columns pass through.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import rstrip_lines, strip
from corvane.session import computed_once

# Sections of a reply, and those folded into running text.
SECTIONS = ("Overview", "Properties", "Details", "Obtaining", "Trivia")
FOLDED = ("Spawning", "Spawn", "Behavior", "Behaviors", "Drops", "Breeding", "Variants", "Edition Differences", "Edition differences", "Mechanics", "Movement", "Combat", "Special Abilities", "Special abilities", "Interactions", "Persistence")
REQUIRED = SECTIONS[:3]
# Properties that say nothing where they are absent, and values that never say anything.
ABSENCE_IS_NO_NEWS, NO_VALUES = ("tameable", "rideable", "breedable", "damage"), ("n/a", "not specified", "null", "-")
# What stands before and around a reply, each at most once and in this order.
WRAPPING = (r"Here is the (?:output|result|markdown):", r"Here'?s the (?:output|result|markdown):", "```markdown", "```")
WORD = r"[\p{L}\p{N}_]"
HEADING = r"##\s+(\w[\w ]*?)\s*$"
CLASSES = {"s": r"[\s\x1c-\x1f]", "S": r"[^\s\x1c-\x1f]", "w": WORD, "b": f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"}


def _pattern(p: str) -> str:
    """A pattern with Python's idea of white space, words and lines, which end at line feeds only."""
    return "(?dU)" + re.sub(r"\\([sSwb])", lambda m: CLASSES[m[1]], p)


def _line(p: str) -> str:
    return _pattern(f"(?m)^{p}")


def any_of(names) -> str:
    return "(" + "|".join(names) + ")"


def reply_format(raw: Column) -> Column:
    """canonical, bold_only, bullet_bold, hybrid_bullet_bold or mixed, by which kinds of lines occur."""
    has = lambda p: raw.rlike(_line(p))
    title, heading, plain = has(r"#\s+\S"), has(r"##\s+\S"), has(r"[A-Z][a-zA-Z ]+:\s+\S")
    bold, bullet = has(r"\*\*" + any_of(SECTIONS) + r"\*\*"), has(r"\s*[-*]\s+\*\*\w")
    kinds = [(title & heading & plain & ~bullet & ~bold, "canonical"), (bold & ~heading, "bold_only"), (bullet & heading, "hybrid_bullet_bold"), (bullet, "bullet_bold")]
    out = F
    for test, name in kinds:
        out = out.when(test, name)
    return out.otherwise("mixed")


def unwrapped(raw: Column) -> Column:
    """A reply without thoughts, introduction and fences."""
    lead = "".join(rf"(?:\s*{w}\s*\n)?" for w in WRAPPING)
    t = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(F.regexp_replace(t, _pattern(r"(?i)\A" + lead), ""), _pattern(r"\n```\s*\z"), ""))


def property_lines(lines: Column) -> Column:
    """Lines of the properties in plain form; without those that say nothing, empty where blank. Each step is an array of its own, so that no line is worked out twice."""
    bold, measured, dashed = _pattern(r"\A\*\*([^*:]+?)\*\*\s*:\s*(.*)\z"), _pattern(r"(?i)\A(Health Points|Health|Damage|XP drop|XP)\s*:\s*([0-9.]+(?:[-–][0-9.]+)?)\b.*\z"), _pattern(r"\d[–—]\d")
    group = F.regexp_extract

    def says_nothing(x: Column) -> Column:
        name, value = (F.lower(strip(group(x, _pattern(r"\A([A-Za-z ]+?)\s*:\s*(.+)\z"), g))) for g in (1, 2))
        return value.isin(*NO_VALUES) | (value.isin("no", "none") & name.isin(*ABSENCE_IS_NO_NEWS))

    for step in (
        lambda x: F.regexp_replace(strip(x), _pattern(r"\A[-*]\s+(?=.)"), ""),
        lambda x: F.when(x.rlike(bold), F.concat(strip(group(x, bold, 1)), F.lit(": "), strip(group(x, bold, 2)))).otherwise(x),
        lambda x: F.regexp_replace(x, _pattern(r"(?i)\A(Tameable|Rideable|Breedable):\s*Yes\b\s*\([^)]*\)\s*\z"), "$1: Yes"),
        lambda x: F.when(x.rlike(measured), F.concat(F.when(F.lower(group(x, measured, 1)) == "health points", "Health").otherwise(group(x, measured, 1)), F.lit(": "), group(x, measured, 2))).otherwise(x),
        lambda x: F.when(x.rlike(dashed), F.regexp_replace(x, _pattern(r"(\d)\s*[–—]\s*(\d)"), "$1-$2")).otherwise(x),
    ):
        lines = F.transform(lines, step)
    return F.filter(lines, lambda x: ~says_nothing(x))


def _blocks(text: Column, head: str = r"##\s+\w") -> Column:
    """array of struct(head, body): the text cut before each line that begins like a heading; the first block has no heading. The blank lines below a heading of words only are its own; a body holds the line feed before it."""
    parts = F.split(F.concat(F.lit("\n"), text), _pattern(rf"(?m)\n(?={head})"), -1)  # the line feed makes a first block also where a heading is first
    head = lambda p: F.regexp_extract(p, _pattern(rf"(?m)\A(?:{HEADING}|[^\n]*)"), 0)
    return F.transform(parts, lambda p, i: F.struct(F.when(i > 0, head(p)).otherwise("").alias("head"), F.substr(p, F.when(i > 0, F.length(head(p)) + 1).otherwise(2)).alias("body")))


def _whole(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], b["body"])), "\n")


def _named(block: Column, names) -> Column:
    return block["head"].rlike(_line(r"##\s+" + any_of(names) + r"\s*$"))


def _first(blocks: Column, test) -> Column:
    """Place of the first block that passes, from 1; null where none does."""
    return F.array_min(F.filter(F.transform(blocks, lambda b, i: F.when(test(b, i), i + 1)), lambda i: i.isNotNull()))


def normalized_replies(df: DataFrame, raw: str, expected: str, out: str = "reply_form") -> DataFrame:
    """df with out: struct(text, title, format, sections, warnings)."""
    r, want = F.col(raw), F.col(expected)
    blank = F.coalesce(strip(r) == "", F.lit(True))
    step = computed_once(df, {"__text": unwrapped(r)})
    # title: a heading, a bold line that is no section, or the one expected
    first = strip(F.regexp_extract("__text", r"\A[^\n]*", 0))
    heading, bold = F.regexp_extract(first, _pattern(r"\A#\s+(\S.*?)\s*\z"), 1), F.regexp_extract(first, _pattern(r"\A\*\*([^*]+)\*\*\s*\z"), 1)
    is_bold = (bold != "") & ~strip(bold).isin(*SECTIONS, *FOLDED)
    title = F.when(heading != "", strip(heading)).when(is_bold, strip(bold)).otherwise(F.coalesce(F.nullif(want, F.lit("")), F.lit("Unknown")))
    step = computed_once(step, {"__title": title, "__how": F.when(heading != "", "h").when(is_bold, "b").otherwise("n")})
    below = F.when(F.col("__how") == "b", F.regexp_replace("__text", r"\A[^\n]*", "")).otherwise(F.col("__text"))
    t = F.when(F.col("__how") == "h", F.col("__text")).otherwise(F.concat(F.lit("# "), "__title", F.when(F.col("__how") == "n", "\n\n").otherwise(""), below))
    # known sections become headings, others running text
    forms = [(rf"\s*\*\*{s}\*\*\s*:?\s*$", f"## {s}") for s in SECTIONS] + [(rf"###+\s+{s}\s*$", f"## {s}") for s in SECTIONS]
    forms += [(rf"\s*{p}\s*$", f"\n\n{s}. ") for s in FOLDED for p in (rf"\*\*{s}\*\*\s*:?", rf"##+\s+{s}")]
    t = reduce(lambda acc, f: F.regexp_replace(acc, _line(f[0]), f[1]), forms, t)  # one at a time, as each takes the blank lines around it
    step = computed_once(step, {"__blocks": _blocks(t)})
    properties = lambda blocks: _first(blocks, lambda b, _: _named(b, ["Properties"]))
    step = computed_once(step, {"__at": properties(F.col("__blocks"))})
    # the properties, line by line
    blocks, at = F.col("__blocks"), F.col("__at")
    mapped = lambda b: F.array_join(property_lines(F.split(b["body"], "\n", -1)), "\n")
    t = _whole(F.transform(blocks, lambda b, i: F.when(F.coalesce(i + 1 == at, F.lit(False)), b.withField("body", mapped(b))).otherwise(b)))
    step = computed_once(computed_once(step, {"__text": t}), {"__blocks": _blocks(F.col("__text"))})  # lines without their bullets can be headings
    # what follows their last line without a heading of its own, and all blocks up to the next that may follow
    rows = F.col("__rows")
    step = computed_once(step, {"__rows": F.when(at.isNotNull(), F.split(F.element_at(blocks, at)["body"], "\n", -1)).otherwise(F.array().cast("array<string>"))})
    is_row = lambda x: strip(x).rlike(_pattern(r"\A[A-Z][A-Za-z ]{0,30}:\s+\S"))
    odd = F.coalesce(F.array_min(F.filter(F.transform(rows, lambda x, i: F.when((strip(x) != "") & ~is_row(x), i)), lambda i: i.isNotNull())), F.size(rows))
    step = computed_once(step, {"__last": F.coalesce(F.array_max(F.transform(F.slice(rows, F.lit(1), odd), lambda x, i: F.when(strip(x) != "", i + 1))), F.lit(0))})
    end = F.coalesce(_first(blocks, lambda b, i: (i + 1 > at) & _named(b, ["Obtaining", "Trivia"])), F.size(blocks) + 1)
    step = computed_once(step, {"__end": end, "__told": F.exists(F.slice(blocks, F.coalesce(at, F.lit(1)), F.size(blocks)), lambda b: _named(b, ["Details"]))})
    rest, last, end = F.slice(rows, F.col("__last") + 1, F.size(rows)), F.col("__last"), F.col("__end")
    between = _whole(F.slice(blocks, at + 1, F.greatest(end - at - 1, F.lit(0))))
    loose = F.when(at.isNotNull() & ~F.col("__told") & (last > 0), strip(F.concat_ws("\n", F.array_join(rest, "\n"), F.nullif(between, F.lit("")))))
    step = computed_once(step, {"__loose": F.coalesce(loose, F.lit(""))})
    block = lambda head, body: F.struct(head.alias("head"), body.alias("body"))
    kept = F.regexp_replace(F.array_join(F.slice(rows, F.lit(1), last), "\n"), _pattern(r"\s+\z"), "")
    wrapped = F.concat(
        F.slice(blocks, F.lit(1), at - 1), F.array(block(F.element_at(blocks, at)["head"], F.concat(F.lit("\n"), kept, F.lit("\n")))),
        F.array(block(F.lit("## Details"), F.concat(F.lit("\n"), "__loose", F.when(end <= F.size(blocks), "\n").otherwise("")))), F.slice(blocks, end, F.size(blocks)),
    )
    t = _whole(F.when(F.col("__loose") != "", wrapped).otherwise(blocks))
    # bold type goes everywhere, bullets after the properties; headings can have been in bold type
    step = computed_once(step, {"__text": F.regexp_replace(t, r"\*\*([^*\n]+?)\*\*", "$1")})
    step = computed_once(step, {"__blocks": _blocks(F.col("__text"))})
    step = computed_once(step, {"__at": properties(blocks)})
    lower = F.regexp_replace(_whole(F.slice(blocks, at + 1, F.size(blocks))), _line(r"\s*[-*]\s+"), "")
    t = F.when(at < F.size(blocks), F.concat(_whole(F.slice(blocks, F.lit(1), at)), F.lit("\n"), lower)).otherwise(F.col("__text"))
    step = computed_once(step, {"__text": strip(rstrip_lines(F.regexp_replace(t, r"\n{3,}", "\n\n")))})
    # sections and what is missing
    parts = F.slice(_blocks(F.col("__text"), HEADING), F.lit(2), F.lit(2_000_000_000))
    name = lambda b: F.lower(strip(F.regexp_extract(b["head"], _line(HEADING), 1)))
    step = computed_once(step, {"__pairs": F.transform(parts, lambda b: F.struct(name(b).alias("key"), strip(b["body"]).alias("value")))})
    keys = F.transform("__pairs", lambda p: p["key"])
    once = F.filter("__pairs", lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    missing = F.filter(F.array(*[F.when(~F.array_contains(keys, s.lower()), F.lit(f"missing canonical section: ## {s}")) for s in REQUIRED]), lambda x: x.isNotNull())
    bullets = F.regexp_count("__text", F.lit(_line(r"\s*[-*]\s+")))
    review = F.when(bullets > 0, F.array(F.concat(bullets.cast("string"), F.lit(" bullet lines remain in prose (review)")))).otherwise(F.array().cast("array<string>"))
    form = F.struct(
        F.when(blank, "").otherwise(F.col("__text")).alias("text"), F.when(blank, F.coalesce(want, F.lit(""))).otherwise(F.col("__title")).alias("title"),
        F.when(blank, "unknown").otherwise(reply_format(r)).alias("format"), F.when(blank, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(once)).alias("sections"),
        F.when(blank, F.array(F.lit("empty input"))).otherwise(F.concat(missing, review)).alias("warnings"),
    )
    return computed_once(step, {out: form}).drop("__text", "__title", "__how", "__blocks", "__at", "__rows", "__last", "__end", "__told", "__loose", "__pairs")

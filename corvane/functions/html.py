"""HTML to text on the standard library's parser: a small tree, and the walks over it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.session import computed_once, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# a start tag that ends an open one of the same group
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
# Classes of elements that carry no content.
NO_CONTENT = frozenset(("navbox", "mw-editsection", "toc", "navigation-not-searchable", "mw-cite-backlink", "reference", "reference-text"))
LEFT_OUT = NO_CONTENT | {"sprite-file", "sound"}
# Beginnings of the lines that open a footer.
FOOTER_LINES = ("Navigation", "External links", "References", "This was a featured article")


class Node:
    __slots__ = ("tag", "attrs", "children", "classes")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.classes = frozenset(self.attrs.get("class", "").split())

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find_all(self, *tags: str, cls: str | None = None) -> Iterator["Node"]:
        return (n for n in self.walk() if (not tags or n.tag in tags) and (cls is None or cls in n.classes))

    def strings(self) -> Iterator[str]:
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack += reversed(n.children)

    def text(self, between: str = "", stripped: bool = True) -> str:
        parts = (s.strip() for s in self.strings()) if stripped else self.strings()
        return between.join(s for s in parts if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, ())
        last = None
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in ends:
                last = depth
            if self.open[depth].tag in ("table", "ul", "ol", "div"):
                break
        if last is not None:
            del self.open[last:]
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def table_rows(table: Node) -> list[list[str]]:
    rows = [[c.text() for c in tr.find_all("td", "th")] for tr in table.find_all("tr")]
    return [r for r in rows if r]


def sounds(root: Node) -> list[str]:
    return [n.attrs["data-mwtitle"].replace(".ogg", "").replace("_", " ") for n in root.find_all("audio") if n.attrs.get("data-mwtitle")]


def redirect_target(root: Node) -> str | None:
    for n in root.find_all("div", cls="redirectMsg"):
        for a in n.find_all("a"):
            return a.attrs.get("title") or a.text() or None
    return None


def page(html: str) -> tuple[list[tuple[str, str, list]], list[list[list[str]]], list[str], str | None]:
    """(parts in the order of the page, raw tables, sound names, redirect target). A part is (kind, text, rows): s for text, t for a table, i for an infobox."""
    root = parse(html)
    tables = [r for r in (table_rows(t) for t in root.find_all("table", cls="wikitable")) if r]
    parts: list[tuple[str, str, list]] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(("s", n, []))
        elif n.tag in ("script", "style") or n.classes & LEFT_OUT or ("pixel-image" in n.classes and not n.text()):
            continue
        elif "infobox" in n.classes:
            parts.append(("i", "", [[c.text(" ") for c in tr.find_all("td", "th")] for tr in n.find_all("tr")]))
        elif n.tag == "table" and "wikitable" in n.classes:
            parts.append(("t", "", table_rows(n)))
        elif n.tag == "br":
            parts.append(("s", "\n", []))
        else:
            stack += reversed(n.children)
    return parts, tables, sounds(root), redirect_target(root)


BODIES = (("article", None, None), ("div", "class", "post-content"), ("div", "class", "post"), ("div", "class", "body"), ("div", "class", "entry-content"), ("div", "id", "content"), ("main", None, None))


def post(html: str, least: int = 80) -> tuple[str, str]:
    """(title, body) of a blog page: its own title, and the first of the usual containers that holds enough text."""
    root = parse(html)
    meta = {n.attrs.get("property"): n.attrs.get("content", "").strip() for n in root.find_all("meta")}
    title = meta.get("og:title") or next((n.text() for n in root.find_all("title")), "")
    body = ""
    for tag, attr, value in BODIES:
        first = next((n for n in root.find_all(tag) if attr is None or value in n.attrs.get(attr, "").split()), None)
        if first is not None and len(text := first.text("\n")) > least:
            body = text
            break
    body = body or meta.get("og:description", "")
    body = re.sub(r"(?s)Wayback Machine.*?https?://\S*", "", body)
    body = re.sub(r"(?s)WAYBACK MACHINE.*", "", body)
    return title, re.sub(r"\n{3,}", "\n\n", body).strip()


_ROWS = T.ArrayType(T.ArrayType(T.StringType()))
PAGE = T.StructType([
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("rows", _ROWS)]))),
    T.StructField("tables", T.ArrayType(_ROWS)), T.StructField("sounds", T.ArrayType(T.StringType())), T.StructField("redirect", T.StringType()),
])


@F.pandas_udf(PAGE)
def _page(html: pd.Series) -> pd.DataFrame:
    read = [page(h) if isinstance(h, str) else (None, None, None, None) for h in html]
    return pd.DataFrame([(p and [dict(zip(("kind", "text", "rows"), x)) for x in p], *rest) for p, *rest in read], columns=PAGE.names)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def _post(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([post(h) if isinstance(h, str) else (None, None) for h in html], columns=["title", "body"])


def pages(df: DataFrame, html: str, out: str = "page") -> DataFrame:
    """df with out: struct(text, tables, sounds, redirect). Python reads the tags; tables, infoboxes and lines are told by native expressions."""
    ship(df.sparkSession)
    read = computed_once(df, {"__read": _page(F.col(html))})
    told = lambda p: F.when(p["kind"] == "t", sentences_of(p["rows"])).when(p["kind"] == "i", infobox_of(p["rows"])).otherwise(p["text"])
    joined = computed_once(read, {"__text": F.array_join(F.filter(F.transform("__read.parts", told), lambda x: x != ""), " ")})
    text = F.when(F.col(html).isNotNull(), content_of(F.coalesce("__text", F.lit(""))))
    return computed_once(joined, {out: F.struct(text.alias("text"), *[F.col(f"__read.{c}").alias(c) for c in PAGE.names[1:]])}).drop("__read", "__text")


def posts(df: DataFrame, html: str, out: str = "post") -> DataFrame:
    ship(df.sparkSession)
    return computed_once(df, {out: _post(F.col(html))})


def class_counts(df: DataFrame, html: str) -> DataFrame:
    """(class, n): how often an element carries each class."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def names(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [c for n in parse(h).walk() for c in n.attrs.get("class", "").split()] if isinstance(h, str) else [])

    ship(df.sparkSession)
    return df.select(F.explode(names(F.col(html))).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def sentences_of(rows: Column) -> Column:
    """Table rows as sentences: each cell below the first row with the name of its column; the cells of a single row stand between bars."""
    head = F.get(rows, F.lit(0))
    name = lambda i: F.coalesce(F.concat(F.nullif(F.get(head, i), F.lit("")), F.lit(": ")), F.lit(""))
    filled = lambda r: F.filter(F.transform(r, lambda c, i: F.when(c != "", F.concat(name(i), c))), lambda c: c.isNotNull())
    below = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(filled(r), ", "))
    return F.when(F.size(rows) == 1, F.array_join(head, " | ")).otherwise(F.array_join(F.filter(below, lambda x: x != ""), "\n"))


def infobox_of(rows: Column) -> Column:
    """Rows of an infobox as lines: two cells as name and value, others between bars."""
    filled = F.transform(rows, lambda r: F.filter(r, lambda c: c != ""))
    return F.array_join(F.transform(F.filter(filled, lambda r: F.size(r) > 0), lambda r: F.when(F.size(r) == 2, F.array_join(r, ": ")).otherwise(F.array_join(r, " | "))), "\n")


def content_of(text: Column) -> Column:
    """Lines with content. The first line that opens a footer ends them but for 'See also'; links, arrows and ticket numbers that stand alone go."""
    from corvane.functions.text import strip

    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
    footer = r"^(?:" + "|".join(FOOTER_LINES) + ")"
    end = F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(footer), i)), lambda i: i.isNotNull())), F.size(lines))
    kept = F.filter(lines, lambda x, i: (x == "See also") | ((i < end) & ~x.rlike(r"(?d)^(?:↑$|https?://|MC-\d+$)")))
    t = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"(?U)\u200c?\s*\[\s*(JE|BE)\s+only\s*\]", " [$1 only]"))


def changelog_sections(text: Column) -> Column:
    """struct(player_facing, technical): lines by the heading that governs them; other headings end both."""
    from corvane.functions.text import strip

    lines = F.split(text, "\n", -1)
    low = F.transform(lines, lambda x: F.lower(strip(x)))
    turn = lambda x: F.when(x.isin("technical", "technical changes", "technical additions"), "t").when(x.isin("fixes", "video", "trivia", "references", "navigation"), "o")
    turns = F.filter(F.transform(low, lambda x, i: F.struct(i.alias("i"), turn(x).alias("k"))), lambda s: s["k"].isNotNull())
    state = lambda i: F.coalesce(F.try_element_at(F.filter(turns, lambda s: s["i"] <= i), F.lit(-1))["k"], F.lit("p"))
    told = lambda k: strip(F.array_join(F.filter(lines, lambda x, i: state(i) == k), "\n"))
    return F.struct(told("p").alias("player_facing"), told("t").alias("technical"))

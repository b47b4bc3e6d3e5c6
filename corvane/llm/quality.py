"""Per-document figures on a text, and the kind of page they tell: prose, list, table or junk.

All figures are native expressions: the text is read once, cut into lines, and each line is told by its form: a row of cells, a
name with a value, an item of an enumeration, or running text; the words in each add up to shares. A rule list
learned by incremental reduced-error pruning (``rulelist``) on ``TRAINING`` labelled documents (``sampledocs``; a
fixed bound, whatever the size of the data) is exported to one CASE expression over the figures.

Defined cases: null, empty and blank texts have 0 words, null figures and null kind; texts of fewer than ``min_words`` words have
figures but no kind; a null stored count is no match; a stored count column may be absent; figures' names that the
table already uses are replaced by the figures.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.pairs import FUNCTION_WORDS
from corvane.llm.rulelist import RuleList, induce
from corvane.llm.sampledocs import labelled_documents
from corvane.session import computed_once, spread

TRAINING = 4000
SEED = 11
WORD = r"(?U)[^\s\x1c-\x1f]+"
# More function words, of further languages; "of" and its kin stand in names, too, and count for no line.
MORE_WORDS = "в и не на что он с как это по но из у за то все так его от о для если или же был бы il lo di non è che si per del della nel sono gli een het van en niet dat op te met voor zijn w nie na się jest do że co jak o em um uma não os as no na".split()
COMMON = sorted(set(" ".join(FUNCTION_WORDS.values()).split()) | set(MORE_WORDS) | {"of", "de", "von"})
IN_NAMES = {"of", "de", "von", "the", "la", "le", "el"}
FEATURES = ("mean_word_length", "symbol_share", "digit_share", "closed_share", "common_share", "item_share", "cell_share", "odd_share", "bare_share", "distinct_share", "short_share")
# rules are learned on what lines tell; the other figures depend on vocabulary and length
LEARNED_ON = ("closed_share", "item_share", "cell_share", "odd_share", "bare_share")


# a word of letters and digits mixed, an endless one, damaged encoding, markup, or symbols alone
ODD = r"^(?:(?=.*\p{L})(?=.*\d).{4,}|.{24,}|.*[ÃÂâïÐ][^\x00-\x7f].*|.*[<>{}\\~^@$].*|(?=[!%&*+/:;=?_#.-]*[^.=-])[!%&*+/:;=?_#.-]{3,})$"
# a line that a program wrote or that markup was left in
MACHINE = r"</?[a-z]+\b[^<>]*>|&#?\w+;|\}\}|^[a-z]+=[a-z]+:\d|\b(?:[Ee]rror|[Ee]xception)\b.*\bline \d+|^Traceback |^\s*at [\w.$]+\("


def figures(df: DataFrame, text: str = "text", word_count: str | None = "word_count", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """df with words, count_matches and the features of each text. Each step's arrays are columns of their own, so that nothing is computed twice."""
    t = F.col(text)
    # links and templates of wiki markup stand for what they show
    plain = F.regexp_replace(F.regexp_replace(t, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1"), r"\{\{[^{}]*\}\}", " ")
    strict = [w for w in COMMON if w not in IN_NAMES]

    def measured(x: Column) -> Column:
        s = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        return F.struct(s.alias("s"), F.split(s, r"(?U)\s+").alias("tokens"), F.split(F.lower(s), r"[^\p{L}'’]+").alias("words"))

    def counted(x: Column) -> Column:
        s = x["s"]
        return F.struct(
            s.alias("s"),
            F.when(s == "", 0).otherwise(F.size(x["tokens"])).alias("n"),
            F.size(F.filter(x["words"], lambda w: w.isin(strict))).alias("common"),
            F.size(F.filter(x["words"], lambda w: w.isin(COMMON))).alias("any"),
            F.size(F.filter(x["tokens"], lambda w: w.rlike(ODD))).alias("odd"),
            s.rlike(r"[.!?…。][\"”»’')\]]*$").alias("stop"),
            F.split(s, r", ").alias("by_comma"),
            F.split(s, r" {2,}").alias("by_gap"),
        )

    def told(x: Column) -> Column:
        s, n, stop = x["s"], x["n"], x["stop"]
        by = lambda sep: F.size(F.split(s, sep))
        csv = (F.size(x["by_comma"]) == 1) & (by(",") >= 3) & F.forall(F.split(s, ","), lambda c: (F.length(c) > 0) & (F.length(c) <= 40))
        gaps = (F.size(x["by_gap"]) >= 2) & F.forall(x["by_gap"], lambda c: F.size(F.split(c, " ")) <= 4)
        bars = s.rlike(r"^(?:\|[-}+]|\|{1,2} ?[\p{L}\p{N}—–-]|\{\| ?\w|! ?[\p{L}\p{N} ]+(?:!!|\||$))") | s.rlike(r"[\p{L}\p{N}%—)] ?\|\|? ?[\p{L}\p{N}—–][^|]*\|")
        cells = bars | s.contains("\t") | (by(" ; ") >= 3) | csv | gaps
        pair = ~stop & s.rlike(r"^\p{L}[\p{L}\p{N} _'()/-]{0,30}(?::| =)\s*[^\s:=]+(?: [^\s:=]+){0,3}$")
        marked = s.rlike(r"^(?:[-*•–—+·▪►✓]|#\d{1,4}|\d{1,4}[.):]|\d{1,4}(?= (?:x |\p{L}{3}))|\(\d{1,4}\)|\[[ xX✓]?\]|[a-zA-Z][.)])\s+\S") & s.rlike(r"\p{L}")
        heading = s.rlike(r"^=.*=$")
        markup = s.rlike(r"[<>{}\\\\=]|&#?\w+;|\S{24}")
        machine = ~stop & s.rlike(MACHINE)
        few = x["common"] * 5 <= n
        short = (n <= 8) & few & ~heading & ~markup & ~s.rlike(r"[.!?…:;,\"”»]$") & (F.regexp_count(s, F.lit(r"\p{L}{2,}")) * 2 >= n)
        brief = lambda parts: (F.size(parts) >= 4) & F.forall(parts, lambda c: F.length(c) <= 40)
        run = ~stop & few & (brief(x["by_comma"]) | brief(F.split(s, r"; ")) | brief(F.split(s, r" [•·] ")))
        item = (marked & (~stop | (n <= 4)) & (x["common"] * 4 <= n)) | short | run
        bare = x["any"] * 12 <= n  # running text with next to no function word
        kind = F.when(n == 0, "e").when(machine, "b").when(cells | pair, "c").when(item, "i").when(heading, "o").when(bare, "b").when(stop, "s").otherwise("o")
        return F.struct(n.alias("n"), kind.alias("kind"), (n <= 8).alias("short"), x["odd"].alias("odd"), x["any"].alias("any"))

    lines = F.col("__lines")
    out = computed_once(df, {"__plain": plain})
    out = computed_once(out, {"__lines": F.transform(F.transform(F.transform(F.split(F.col("__plain"), r"\n"), measured), counted), told)})
    out = out.withColumn("words", F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)))

    def summed(of) -> Column:
        return F.aggregate(lines, F.lit(0), lambda a, x: a + of(x))

    def share(of) -> Column:
        return summed(lambda x: F.when(of(x), x["n"]).otherwise(0)) / F.col("__total")

    total = summed(lambda x: x["n"])
    visible = F.regexp_count(F.col("__plain"), F.lit(r"(?U)\S")) if {"mean_word_length", "symbol_share", "digit_share"} & {*features} else F.lit(0)
    out = computed_once(out, {"__total": F.when(total > 0, total), "__visible": F.when(visible > 0, visible)})
    total, visible = F.col("__total"), F.col("__visible")
    named = {
        "mean_word_length": visible / total,
        "symbol_share": F.regexp_count(F.col("__plain"), F.lit(r"[^\p{L}\p{M}\p{N}\s]")) / visible,
        "digit_share": F.regexp_count(F.col("__plain"), F.lit(r"\p{Nd}")) / visible,
        "closed_share": share(lambda x: x["kind"] == "s"),
        "common_share": summed(lambda x: x["any"]) / total,
        "item_share": share(lambda x: x["kind"] == "i"),
        "cell_share": share(lambda x: x["kind"] == "c"),
        "odd_share": summed(lambda x: F.when(x["kind"] != "c", x["odd"]).otherwise(0)) / total,
        "bare_share": share(lambda x: x["kind"] == "b"),
        "distinct_share": F.size(F.array_distinct(F.filter(F.split(F.col("__plain"), r"(?U)\s+"), lambda w: w != ""))) / total,
        "short_share": share(lambda x: x["short"]),
    }
    matches = F.coalesce(F.col(word_count) == F.col("words"), F.lit(False)) if word_count and word_count in df.columns else F.lit(False)
    named = {k: v for k, v in named.items() if k in features}
    return computed_once(out, named | {"count_matches": matches, "words": F.col("words")}).drop("__plain", "__lines", "__total", "__visible")


@functools.lru_cache(maxsize=8)
def _learned(app: str, n: int, seed: int) -> RuleList:
    spark = SparkSession.getActiveSession()
    docs = spark.createDataFrame(labelled_documents(n, seed), "text string, label string")
    rows = figures(docs, word_count=None, features=LEARNED_ON).select("label", *LEARNED_ON).na.fill(0.0).collect()  # n rows, the documented bound
    x = {f: np.array([r[f] for r in rows], float) for f in LEARNED_ON}
    return induce(x, np.array([r.label for r in rows], dtype=object), "prose")


def learned_rules(spark: SparkSession, n: int = TRAINING, seed: int = SEED) -> RuleList:
    """The rule list learned on n labelled documents; once per application."""
    return _learned(spark.sparkContext.applicationId, n, seed)


def kinds(df: DataFrame, text: str = "text", word_count: str | None = "word_count", min_words: int = 10, rules: RuleList | None = None, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """df with figures() and the kind of each text. features may be cut down to LEARNED_ON where only the kind is wanted."""
    rules = rules or learned_rules(df.sparkSession)
    return figures(spread(df), text, word_count, features).withColumn("kind", F.when(F.col("words") >= min_words, F.expr(rules.sql())))

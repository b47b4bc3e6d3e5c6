"""Broken prompt and response pairs: empty, copied, refusing, truncated answers and answers in another language.

Empty, copied, refusing and other-language answers are found by native rules. Truncated ones need the whole table:

* Sorted neighbours. The sentences of all responses (numbers and names masked) are range-partitioned and sorted by
  text; an unfinished last sentence that is wholly a prefix of the sentence that follows it in that order, and
  never stands finished itself, is a shortened version of it. Sentences of two or more words count, short ones too.
* Where no sibling with the same words exists, the same comparison is made on its last words: how often, over all
  responses, a sentence ends after these words and how often it goes on. A word no text has elsewhere that is the
  beginning of a word other texts have is a cut word, also where it is the whole answer.
* Length-limit spikes. A length at which far more unfinished responses stand than at the lengths around it is a
  limit; unfinished responses of that length are truncated.
* Open brackets and quotation marks, a list marker without its entry, a trailing comma or colon.

Counts are combined inside each task before they are shuffled; only unfinished responses are joined with them.

Defined cases: a null or blank instruction can only have an empty, truncated or refusing answer; a null key is left out; a
key delivered more than once comes out once with the defect that stands first in ``ORDER``; an empty table gives an
empty result; other columns don't reach the operator.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.session import computed_once, cut, ship, spread

ORDER = ("empty", "copy", "refusal", "language", "truncated")

# Answers that stand for none, and labels of answers and questions.
PLACEHOLDERS = ("tbd tba todo null nil nan n/a na undefined blank empty pending placeholder").split() + ["no answer", "not available", "n a", "to be done", "answer here", "your answer", "insert answer"]
ANSWER_LABELS = "answer a output response reply result respuesta r salida réponse sortie antwort ausgabe ответ".split()
QUESTION_LABELS = "q question questions you asked ask the instruction prompt input query user pregunta preguntaste usted preguntó instrucción frage du fragtest sie fragten gefragt vous avez demandé tu as consigne aufgabe вопрос".split()
# Frequent function words by language; words that two of them share are left out where they mislead.
FUNCTION_WORDS = {
    "en": "the and is are was it its that this these those with from for to in on at by not no if then when where which what why how who does do did can will would be been has have had you your they their there than but or as an only one some any about into between without after before because all both most near need needs each known like such tell explain give me short",
    "es": "el la los las un una unos y es son está en con por para que se del al no si cuando donde dónde qué cómo como más muy pero o su sus lo le les hay fue era cada desde sin sobre entre también después hasta porque esta este para sirve contra cuál quién explica cerca hace ser dos muchos juego todo cual",
    "fr": "le la les un une des et est sont dans avec pour par que qui se du au aux ne pas si quand où quoi comment plus très mais ou son sa ses il elle on ce cette chaque depuis sans sur entre aussi après contre à je nous vous quel quels quelle quelles trouve explique faire fabriquer près jeu fois tout comme même",
    "de": "der die das den dem des ein eine einen einem einer und ist sind im in mit für von zu zum zur auf aus bei nach nicht kein keine wenn wo was wie wer man mehr sehr aber oder sein seine es er sie ich wir hat haben wird werden durch über unter zwischen ohne vor seit nur noch dass am um erkläre findet gehört immer alle viele dort jede jeder",
}
LANGUAGE_NAMES = {
    "en": "english inglés ingles anglais englisch englische английский английском",
    "es": "spanish español espanol castellano espagnol spanisch spanische испанский испанском",
    "fr": "french francés frances français francais französisch französische французский французском",
    "de": "german alemán aleman allemand deutsch deutsche немецкий немецком",
    "ru": "russian ruso russe russisch russische русский русском",
}
# How assistants decline, by language; matched outside quotations.
REFUSALS = (
    r"\bi(?:['’]m| am)(?: (?:sorry|afraid)[^.]{0,40}\bi(?:['’]m| am))? (?:not able|unable|not allowed|not permitted|not in a position) to\b",
    r"\b(?:i|we) (?:can['’]?t|cannot|can not|could not|couldn['’]t|won['’]t|will not|am not going to|won['’]t be able to|will not be able to|do not wish to|don['’]t wish to)(?: be able to)? (?:help|assist|answer|respond|reply|provide|discuss|comment|share|say|offer|fulfil|fulfill|comply|talk|give)\b",
    r"\bi(?: would|['’]d)? (?:rather|prefer) not(?: to)? (?:go|answer|say|talk|discuss|comment|respond|get|share)\b",
    r"\bi (?:have to|must|need to|will have to|['’]ll have to|shall have to|am going to have to) (?:decline|refuse|refrain|pass on|respectfully decline|turn)\b",
    r"\bi have no way of (?:knowing|telling)\b", r"\bi (?:do not|don['’]t) have (?:access|enough information|any information|information)\b",
    r"\bmy (?:guidelines|instructions|rules|policy|policies|programming) (?:keep|prevent|forbid|do not allow|don['’]t allow|stop|prohibit)\b",
    r"\b(?:a )?(?:subject|topic|matter) i (?:have been asked|was asked|am told|have been told) to\b", r"\boutside (?:of )?what i (?:can|may|am)\b",
    r"\bnothing i can say\b", r"\bbeyond what i (?:am|may|can)\b", r"\bno answer is possible from my side\b", r"\b(?:decline|refuse) to (?:answer|respond|comment)\b",
    r"\bas an? (?:ai|assistant|language model)\b[^.]{0,60}\b(?:not|cannot|can['’]t|unable|decline|pass|refrain|rather)\b",
    r"\bno (?:puedo|podemos|podría|voy a|me es posible|es posible para mí) (?:ayudar|responder|contestar|dar|hablar|ofrecer|proporcionar|opinar)", r"\bprefiero no (?:contestar|responder|hablar|tratar|opinar|entrar)",
    r"\bno estoy en condiciones de\b", r"\bno (?:me está permitido|tengo permiso|tengo acceso|dispongo de)\b", r"\b(?:debo|tengo que) (?:rechazar|negarme|declinar|abstenerme)\b",
    r"\bje ne (?:peux|puis|pourrai|saurais|suis) pas (?:répondre|aider|vous aider|donner|fournir|parler|en mesure|autorisé|traiter)", r"\bje préfère ne pas\b", r"\bje (?:dois|suis obligé de) (?:refuser|décliner|m['’]abstenir)\b",
    r"\bil m['’]est impossible de\b", r"\bje n['’]ai pas (?:accès|le droit|la permission)\b", r"\bje refuse de\b",
    r"\b(?:kann|darf|möchte|will|werde) ich\b[^.]{0,80}\b(?:nicht|keine|keinen|kein)\b", r"\bich (?:kann|darf|möchte|will|werde)\b[^.]{0,80}\b(?:nicht|keine|keinen|kein)\b[^.]{0,40}\b(?:helfen|antworten|beantworten|geben|sagen|sprechen|äußern)\b",
    r"\bmuss ich\b[^.]{0,60}\b(?:ablehnen|verweigern|passen)\b", r"\bich muss\b[^.]{0,60}\b(?:ablehnen|verweigern|passen)\b", r"\bich habe keinen zugriff\b", r"\bist mir nicht (?:möglich|erlaubt|gestattet)\b",
    r"\bя не (?:могу|буду|имею права|в состоянии) (?:ответить|помочь|отвечать|сказать|говорить|дать)", r"\bпредпочитаю не\b", r"\bвынужден[а]? отказать",
)
# one word of each pattern above
REFUSAL_WORDS = r"\b(?:i|we|my|no|prefiero|debo|tengo|je|il|kann|darf|möchte|will|werde|muss|ich|mir|я|предпочитаю|вынуждена?|decline|refuse|as|nothing|outside|beyond|subject|topic|matter)\b"
# Words no sentence ends with.
NEVER_LAST = frozenset("the a an and or its their his el los las un una y o del que le les une et ou du und oder der das den dem ein eine einen einem und и или".split())
MARKS = r"[\s\p{P}\p{S}\p{C}\p{Z}\p{M}]+"
FEW, RATE, ENDS, SPIKE_LEAST, SPIKE_TIMES, SPIKE_AROUND, SORT_KEY = 6, 0.02, 0.3, 12, 8, 10, 16


def _spaced_words(c: Column) -> Column:
    """Each word between two spaces of its own, so that runs of words can be replaced like characters."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")


def _bare(out: Column) -> Column:
    """The words of an answer in lower case, without marks."""
    return F.trim(F.regexp_replace(F.lower(out), MARKS, " "))


def _is_empty(out: Column, bare: Column) -> Column:
    wrapped = out.rlike(r"^\s*(?:\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{+[^{}]*\}+)\s*$") & (F.size(F.split(bare, " ")) <= 4)
    label = out.rlike(r"(?i)^\s*(?:" + "|".join(ANSWER_LABELS) + r")\s*[:：=-]\s*$")
    return out.isNull() | (bare == "") | bare.isin([re.sub(r"\W+", " ", p) for p in PLACEHOLDERS]) | wrapped | label


def _is_copy(q: Column, o: Column, rest: Column) -> Column:
    """q and o as from _spaced_words(), rest is o without q."""
    left = F.array_except(F.filter(F.split(rest, " +"), lambda w: w != ""), F.array(*map(F.lit, QUESTION_LABELS)))
    return F.coalesce((q != "") & (rest != o) & (F.size(left) == 0), F.lit(False))


def _is_refusal(out: Column) -> Column:
    own = F.regexp_replace(out, r"“[^”]*”|\"[^\"]*\"|«[^»]*»|„[^“”]*[“”]", " ")
    low = F.lower(own)
    return F.coalesce(F.when(low.rlike("(?U)" + REFUSAL_WORDS), low.rlike("(?U)" + "|".join(REFUSALS))), F.lit(False))  # most texts end at the short test


def with_language(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the language code of a text by its function words, or by script; null where it can't be told. Names (capitalised words inside) count for none."""
    t = F.col(text)
    plain = F.lower(F.regexp_replace(t, r"(?<=[\p{L}\p{N}/:,] )\p{Lu}[\p{L}:/'-]*", " "))
    listed = {k: v.split() for k, v in FUNCTION_WORDS.items()}
    # words of no list fall out first
    every = sorted({w for v in listed.values() for w in v})
    out_words = computed_once(df, {"__words": F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: w.isin(every))})
    counts = [F.size(F.filter("__words", _is_one_of(v))) for v in listed.values()]
    scored = computed_once(out_words, {"__scores": F.array(*counts)})
    scored = computed_once(scored, {"__sorted": F.sort_array("__scores", asc=False)})
    letters, cyrillic = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{IsCyrillic}"))
    best, second = F.element_at("__sorted", 1), F.element_at("__sorted", 2)
    named = F.element_at(F.array(*map(F.lit, listed)), F.array_position("__scores", best).cast("int"))
    code = F.when((cyrillic > 5) & (cyrillic * 4 > letters), F.lit("ru")).when((best >= 2) & (best > second), named)
    return computed_once(scored, {out: code}).drop("__words", "__scores", "__sorted")


def _is_one_of(listed: list[str]):
    return lambda w: w.isin(listed)


def _asks_for(question: Column, code: Column) -> Column:
    asked = F.lit(False)
    for k, names in LANGUAGE_NAMES.items():
        asked = asked | ((code == k) & F.lower(question).rlike(r"(?U)\b(?:" + "|".join(names.split()) + r")\b"))
    return asked


TOKEN = re.compile(r"[^\W\d_]+(?:['’/:-][^\W\d_]+)*|\d+(?:[.,:]\d+)*%?|(?:[.!?]+|…)(?=[\s”\"»)\]]|$)|\n|[^\s\w]")
NUMBERED = re.compile(r"(?m)^[ \t]*\d+[.)][ \t]+")
ONE_WORD = r"^\s*(\p{L}+(?:['’/:-]\p{L}+)*)(?:…|\.\.\.)?\s*$"
BULLET = re.compile(r"(?m)^[ \t]*[-*•][ \t]+")
STOPS = set(".!?…\n")


def parse(text: str) -> tuple[list[list[str]], list[list[str]], bool]:
    """(sentences as masked words, the raw words, whether the last one is finished). Numbers become #, names N; a sentence ends at a stop or a line break."""
    text = BULLET.sub("\n•", NUMBERED.sub("\n", text))
    masked, raw, cur, own = [], [], [], []
    done = True
    for m in TOKEN.finditer(text):
        t = m.group()
        if t[0] in STOPS:
            if cur and cur != ["•"]:
                masked.append(cur)
                raw.append(own)
            cur, own = [], []
            done = True
            continue
        if not t[0].isalnum():
            if t == "•" and not cur or cur and t in ",;:—–-(":
                cur.append(t)
            continue
        done = False
        own.append(t)
        if t[0].isdigit():
            cur.append("#")
        elif not cur or cur == ["•"]:
            cur.append(t.lower())
        elif t[0].isupper():
            if cur[-1] == "of" and len(cur) > 1 and cur[-2] == "N":
                cur.pop()
            elif cur[-1] != "N":
                cur.append("N")
        else:
            cur.append(t)
    if cur and cur != ["•"]:
        masked.append(cur)
        raw.append(own)
    return masked, raw, done


def contexts(words: list[str], i: int) -> list[str]:
    """What stands before a possible end after words[i]; * is any word."""
    p = ["^", "^", "^", *words[: i + 1]]
    a, b, c, d = p[-4], p[-3], p[-2], p[-1]
    x = words[0] if words[0] == "•" else ""  # entries of a list end like each other, not like sentences
    return [f"{x}2 {c} {d}", f"{x}3 {b} {c} {d}", f"{x}3 {b} {c} *", f"{x}4 {a} {b} {c} *", f"{x}3 {b} * {d}", f"{x}4 {a} {b} * {d}"]


def _hash(keys: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(keys, dtype=object), categorize=False).view(np.int64) if keys else np.zeros(0, np.int64)


def _opened(text: str) -> bool:
    for a, b in ("()", "[]", "{}", "“”", "«»"):
        if text.count(a) > text.count(b):
            return True
    return text.count('"') % 2 == 1


def _ends_early(text: str) -> bool:
    """Open bracket or quotation, a trailing comma or colon, a marker without its entry."""
    s = text.rstrip()
    return _opened(s) or s[-1:] in (",", ":", ";", "(", "-", "–", "—", "/", "&", "+") or bool(re.search(r"\n[ \t]*(?:[-*•]|\d+[.)]?)$", s))


def _statistics(texts: DataFrame) -> DataFrame:
    """(kind, h, w, ends, goes) over the columns of texts: kind c for a context, w for a word (with the word), combined in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goes, ends, words = Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys, vocabulary = list(goes.keys() | ends.keys()), list(words)
            out = pa.RecordBatch.from_arrays([
                pa.array(["c"] * len(keys) + ["w"] * len(vocabulary)), pa.array(np.concatenate([_hash(keys), _hash(vocabulary)])), pa.array([None] * len(keys) + vocabulary, pa.string()),
                pa.array([ends[k] for k in keys] + [0] * len(vocabulary), pa.int64()), pa.array([goes[k] for k in keys] + [words[w] for w in vocabulary], pa.int64()),
            ], names=["kind", "h", "w", "ends", "goes"])
            for c in (goes, ends, words):
                c.clear()
            return out

        for b in batches:
            for text, is_output in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                masked, raw, done = parse(text.rstrip("…").removesuffix("...") if is_output else text)
                for k, (m, r) in enumerate(zip(masked, raw)):
                    last = k == len(masked) - 1 and not done
                    words.update(r[:-1] if last else r)
                    if is_output:
                        for i in range(len(m) - 1):
                            goes.update(contexts(m, i))
                        if not last and (len(masked) > 1 or len(m) > 3):  # an answer of a few words is no sentence
                            ends.update(contexts(m, len(m) - 1))
                if len(goes) + len(ends) + len(words) > 400_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "kind string, h bigint, w string, ends bigint, goes bigint").groupBy("kind", "h").agg(F.max("w").alias("w"), F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))


def _shortened(outputs: DataFrame) -> DataFrame:
    """(k): keys of responses whose unfinished last sentence is a prefix of the sentence sorted next to it and never stands finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, bool] = {}
            keys, tails, open_ = [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                masked, _, done = parse(text.rstrip("…").removesuffix("..."))
                for i, m in enumerate(masked):
                    s = " ".join(m)
                    if len(m) - (m[0] == "•") < 2:  # a word alone is as good an answer as a beginning
                        continue
                    if i == len(masked) - 1 and not done:
                        keys.append(k), tails.append(s), open_.append(True)
                    elif s not in seen:  # one finished copy says all
                        seen[s] = True
                        keys.append(None), tails.append(s), open_.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(tails, pa.string()), pa.array(open_, pa.bool_())], names=["k", "s", "open"])

    schema = T.StructType([outputs.schema["k"], T.StructField("s", T.StringType()), T.StructField("open", T.BooleanType())])
    kind = pa.int64() if isinstance(outputs.schema["k"].dataType, T.LongType) else None
    rows = outputs.mapInArrow(run, schema)
    # one row per sentence: finished copies anywhere settle it
    kinds = rows.groupBy("s").agg(F.bool_or(~F.col("open")).alias("finished")).withColumn("lead", F.substring("s", 1, SORT_KEY))
    ordered = kinds.where(F.length("s") >= SORT_KEY).repartitionByRange("lead").sortWithinPartitions("lead", "s")
    # what is shorter than the lead may have its extensions in any range; they are found by their beginnings
    leads = kinds.select("lead").distinct().where(F.length("lead") > 3)
    begins = leads.select(F.explode(F.transform(F.sequence(F.lit(3), F.length("lead") - 1), lambda n: F.substring(F.col("lead"), F.lit(1), n))).alias("s")).distinct()
    brief = kinds.where((F.length("s") < SORT_KEY) & ~F.col("finished")).join(begins, "s", "left_semi").select("s")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, finished = None, True
        for b in batches:
            out = []
            for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if before is not None and not finished and s.startswith(before) and len(s) > len(before):
                    out.append(before)
                before, finished = s, f
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["s"])

    short = ordered.select("s", "finished").mapInArrow(scan, "s string").unionByName(brief)
    return rows.where("open").join(short, "s").select("k").distinct()


def _spikes(lengths: DataFrame) -> DataFrame:
    """(n): lengths with far more unfinished responses than the lengths around."""
    counts = lengths.groupBy("n").count()  # one row per length
    around = counts.withColumn("at", F.explode(F.sequence(F.col("n") - SPIKE_AROUND, F.col("n") + SPIKE_AROUND))).where("at <> n")
    mean = around.groupBy("at").agg((F.sum("count") / (2 * SPIKE_AROUND)).alias("mean"))
    return counts.join(mean, counts.n == mean.at, "left").where((F.col("count") >= SPIKE_LEAST) & (F.col("count") >= SPIKE_TIMES * F.coalesce("mean", F.lit(0.0)))).select("n")


def truncated(rows: DataFrame) -> DataFrame:
    """(k): keys of rows (k, q, i, o) whose response breaks off; rows of any quality serve as the corpus."""
    outputs = rows.where("o is not null").select("k", "o")
    texts = outputs.select(F.col("o").alias("t"), F.lit(True).alias("out"))
    for c in ("q", "i"):
        texts = texts.unionByName(rows.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.col(c).alias("t"), F.lit(False).alias("out")))
    stats = cut(_statistics(texts))
    # unfinished by its last mark, or something left open
    ellipsis = F.col("o").rlike(r"(?:…|\.\.\.)\s*$")
    stop = F.col("o").rlike(r"[.!?。？！][”\"»’')\]\s]*$")
    several = F.col("o").rlike(r"\S\s+\S")
    maybe = outputs.where(several & (ellipsis | ~stop | F.col("o").rlike(r"[(\[{“«\"]")))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sure, last, hashes, offsets = [], [], [], [], [0]
            for row, text in enumerate(b.column(1).to_pylist()):
                s = text.rstrip()
                cut_mark = s.endswith(("…", "..."))
                s = s.rstrip("…").removesuffix("...").rstrip()
                masked, raw, done = parse(s)
                early = _ends_early(s)
                if not masked or (done and not early and not cut_mark):
                    continue
                at.append(row)
                own = [] if done or not raw else raw[-1]
                sure.append(early or (len(own) > 1 and own[-1] in NEVER_LAST))
                last.append(own[-1] if own and own[-1][0].isalpha() and s.endswith(own[-1]) else None)
                words = masked[-1]
                if not done and (len(masked) > 1 or len(words) > 3):
                    hashes += contexts(words, len(words) - 1)
                offsets.append(len(hashes))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at, pa.int64())), pa.array(sure, pa.bool_()), pa.array(last, pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_hash(hashes))),
            ], names=["k", "sure", "last", "contexts"])

    schema = T.StructType([rows.schema["k"], T.StructField("sure", T.BooleanType()), T.StructField("last", T.StringType()), T.StructField("contexts", T.ArrayType(T.LongType()))])
    tail = cut(maybe.mapInArrow(tails, schema))
    sure = tail.where("sure").select("k")
    asked = tail.where("not sure").select("k", F.posexplode("contexts").alias("pos", "h")).withColumn("order", F.when(F.col("pos") == 0, 2).when(F.col("pos").isin(3, 5), 4).otherwise(3))
    known = asked.join(stats.where("kind = 'c'").select("h", "ends", (F.col("ends") + F.col("goes")).alias("n")), "h").where(F.col("n") >= FEW)
    # the longest contexts that decide have the word; shorter ones mix positions of different sentences
    rate = F.col("ends") / F.col("n")
    votes = known.groupBy("k", "order").agg(F.max(rate).alias("most"), F.min(rate).alias("least"))
    votes = votes.withColumn("goes_on", F.when(F.col("most") >= ENDS, False).when(F.col("least") <= RATE, True)).where("goes_on is not null")
    goes_on = votes.groupBy("k").agg(F.max_by("goes_on", "order").alias("goes_on")).where("goes_on").select("k")
    # cut words: unknown as a whole, known as a beginning
    vocabulary = stats.where("kind = 'w'").select("w")
    unknown = tail.where("not sure and last is not null").select("k", F.col("last").alias("w")).join(vocabulary, "w", "left_anti")
    wanted = unknown.select("w").distinct()
    begins = vocabulary.where(F.length("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("w"))
    cut_words = unknown.join(wanted.join(begins, "w", "left_semi"), "w", "left_semi").select("k")
    # answers of one word, in any case of letters: as a word that stands alone may have a capital, its vocabulary has none
    ones = outputs.where(~several & ~stop | ~several & ellipsis).select("k", F.lower(F.regexp_extract("o", ONE_WORD, 1)).alias("w")).where("w <> ''")
    alone = ones.join(vocabulary.select(F.lower("w").alias("w")).distinct(), "w", "left_anti")
    cut_alone = alone.join(begins.select(F.lower("w").alias("w")), "w", "left_semi").select("k")
    lengths = tail.where("not sure").select("k").join(outputs.select("k", F.length("o").alias("n")), "k")
    at_limit = lengths.join(_spikes(lengths), "n", "left_semi").select("k")
    short = _shortened(outputs).join(tail.select("k"), "k", "left_semi")
    return sure.unionByName(goes_on).unionByName(cut_words).unionByName(cut_alone).unionByName(at_limit).unionByName(short).distinct()


def defective_pairs(df: DataFrame, key: str = "pair_id", instruction: str = "instruction", output: str = "output", context: str | None = "input") -> DataFrame:
    """(key, defect): each defective pair once with its type of defect."""
    ship(df.sparkSession)
    extra = F.col(context).cast("string") if context else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("k"), F.col(instruction).alias("q"), extra.alias("i"), F.col(output).alias("o")).where("k is not null")
    rows = spread(rows)
    q, o = F.col("q"), F.col("o")
    spoken, asked = F.col("spoken"), F.col("asked")
    ruled = with_language(with_language(rows, "o", "spoken"), "q", "asked")
    other = F.coalesce((spoken != asked) & ~_asks_for(q, spoken), F.lit(False))
    ruled = computed_once(ruled, {"__bare": _bare(o), "__q": _spaced_words(q), "__o": _spaced_words(o)})
    ruled = computed_once(ruled, {"__rest": F.replace(F.col("__o"), F.col("__q"), F.lit(""))})
    copied = _is_copy(F.col("__q"), F.col("__o"), F.col("__rest"))
    rule = F.when(_is_empty(o, F.col("__bare")), "empty").when(copied, "copy").when(_is_refusal(o), "refusal").when(other, "language")
    ruled = computed_once(ruled, {"defect": rule}).select("k", "defect")
    found = ruled.where("defect is not null").unionByName(truncated(rows).select("k", F.lit("truncated").alias("defect")))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("defect"))
    return found.groupBy("k").agg(F.min_by("defect", rank).alias("defect")).select(F.col("k").alias(key), "defect")

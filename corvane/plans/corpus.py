"""Queries over the text corpus: filters, cleaning, classification, hardening, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import text as X
from corvane.functions.html import changelog_sections as sections_of_changelog
from corvane.functions.html import pages
from corvane.operators import catalog, classify, cleaning, external, filters, harden
from corvane.operators import rules as R
from corvane.operators.tokens import long_words
from corvane.plans import sql as S
from corvane.plans.registry import query
from corvane.session import computed_once, read_table

T0 = "coalesce(title, '')"
W0 = "coalesce(word_count, 0)"


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "articles")


# ---- filters and their reports ----

INDEX_PAGE = f"coalesce({S.contains('substr(text, 1, 500)', R.INDEX_PAGE_MARKERS)}, false)"
REASON = S.case([
    (f"{W0} < 10", "empty_or_tiny"), (S.starts(T0, ["Category:"]), "category_page"), (S.starts(T0, ["User:"]), "user_page"), (S.starts(T0, ["Template:"]), "template_page"),
    (S.starts(T0, ["Minecraft Wiki:"]), "meta_wiki_page"), (f"contains(lower({T0}), 'render history')", "render_history"), (f"contains(lower({T0}), 'texture history')", "texture_history"),
    (f"ends_with({T0}, '/Asset history')", "asset_history"), (S.starts(T0, ["Debug mode"]), "debug_mode"), (f"contains({T0}, '/Structure/')", "structure_blueprint"),
    (f"ends_with({T0}, '/Renders')", "structure_renders"), (f"contains({T0}, '/development gallery/')", "development_gallery"),
    (f"{INDEX_PAGE} AND regexp_matches({T0}, {S.q('(?i)' + R.VERSION_TITLE)})", "version_disambiguation"),
])
IS_LOG = f"(coalesce(regexp_matches(title, {S.q('(?i)' + R.CHANGELOG_TITLE)}), false) OR coalesce(contains(substr(text, 1, 1000), 'Protocol version:'), false))"


def _reason():
    return filters.article_reason(F.col("title"), F.col("text"), F.col("word_count"))


@query(f"SELECT coalesce({REASON}, 'keep') AS reason, count(*) AS n, sum({W0}) AS words FROM articles GROUP BY 1")
def filter_reasons(spark, sf):
    return filters.reason_report(articles(spark, sf), _reason(), F.col("word_count"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r IS NOT NULL) AS dropped, sum(w) AS words_total,
coalesce(sum(w) FILTER (r IS NULL), 0) AS words_kept, coalesce(sum(w) FILTER (r IS NOT NULL), 0) AS words_dropped FROM (SELECT {REASON} AS r, {W0} AS w FROM articles)""")
def filter_kept(spark, sf):
    return filters.kept_totals(articles(spark, sf), _reason(), F.col("word_count"))


@query(f"SELECT seq, title, {REASON} AS removal_reason FROM articles WHERE {REASON} IS NOT NULL")
def filter_removed(spark, sf):
    return filters.split_by_reason(articles(spark, sf), _reason())[1].select("seq", "title", "removal_reason")


@query(f"""SELECT CASE WHEN {W0} < 30 THEN 'empty_or_tiny' WHEN coalesce(starts_with({S.strip('text')}, 'Lua error:'), false) THEN 'lua_error' ELSE 'keep' END AS reason,
{IS_LOG} AS is_log, coalesce(regexp_matches(title, {S.q('(?i)' + R.CHANGELOG_TITLE_STRICT)}), false) AS by_title, count(*) AS n FROM articles GROUP BY ALL""")
def changelog_filter(spark, sf):
    df = articles(spark, sf)
    reason = F.coalesce(filters.changelog_reason(F.col("text"), F.col("word_count")), F.lit("keep"))
    return df.select(reason.alias("reason"), filters.is_changelog(F.col("title"), F.col("text")).alias("is_log"), filters.is_changelog_title(F.col("title")).alias("by_title")).groupBy("reason", "is_log", "by_title").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) AS n FROM articles_cleaned WHERE length({S.strip('text')}) > 0 AND {S.n_words('text')} >= CASE source WHEN 'bio' THEN 50 WHEN 'dev_blog' THEN 30 WHEN 'transcript' THEN 100 ELSE 0 END GROUP BY source")
def min_words_by_source(spark, sf):
    return filters.min_words_by_source(read_table(spark, sf, "articles_cleaned"), "text", "source", {"bio": 50, "dev_blog": 30, "transcript": 100}).groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT text_id FROM general_corpus WHERE length({S.strip('text')}) >= 50")
def min_length_texts(spark, sf):
    return filters.min_length(read_table(spark, sf, "general_corpus"), "text").select("text_id")


@query("SELECT coalesce(actor, 'none') AS actor, count(*) AS n FROM exclusion_log WHERE coalesce(actor, '') NOT IN ('batch', 'bot') GROUP BY 1")
def without_bots(spark, sf):
    return filters.without_bots(read_table(spark, sf, "exclusion_log"), "actor", ["batch", "bot"]).groupBy(F.coalesce("actor", F.lit("none")).alias("actor")).agg(F.count("*").alias("n"))


@query(f"SELECT seq, title FROM articles WHERE {S.starts(T0, R.SPINOFF_PREFIXES)}")
def spinoff_titles(spark, sf):
    return articles(spark, sf).where(filters.starts_with_any(F.coalesce("title", F.lit("")), R.SPINOFF_PREFIXES)).select("seq", "title")


# ---- cleaning ----

_t = S.rep("text", r"\[\[File:[^\]]*\]\]")
_t = S.rep(S.rep(_t, r"\[\[[^\]]*\|([^\]]+)\]\]", r"\1"), r"\[\[([^\]]+)\]\]", r"\1")
for _ in range(cleaning.TEMPLATE_DEPTH):
    _t = S.rep(_t, r"\{\{[^{}]*\}\}")
_t = S.rep(_t, "https?://" + S.NO_GAP + "+")
_t = S.rep(_t, r"(^|[^A-Za-z0-9_\]])\[\d+\]($|\W)", r"\1\2")
_t = f"array_to_string(list_filter(string_split({_t}, chr(10)), lambda x: NOT regexp_matches(x, '[◄►]')), chr(10))"
_t = S.rep(S.rep(_t, "(?i)" + "|".join(R.BOILERPLATE)), r"(?m)^Main article:\s*[^\n]*/(Structure|Blueprints)/[^\n]*$")
_keys = "(?m)^(" + "|".join(R.CHANGELOG_KEYS) + r")\s*:\s*.*$"
_head = S.rep("array_to_string(string_split(body, chr(10))[1:30], chr(10))", _keys)
_rest = "array_to_string(string_split(body, chr(10))[31:], chr(10))"
_log = S.rep_all(f"({_head} || CASE WHEN {_rest} <> '' THEN chr(10) || {_rest} ELSE '' END)", R.CHANGELOG_LINES)
_tidy = S.strip(S.rep(S.rep(S.rep(S.rstrip_lines("x"), " +([.,;:!?])", r"\1"), "  +", " "), r"\n{3,}", "\n\n"))
CLEANED = f"""cleaned AS (SELECT *, words_before - words_after AS loss, CASE WHEN words_before > 0 THEN (words_before - words_after) / words_before ELSE 0.0 END AS loss_ratio FROM (
SELECT *, {S.n_words('text')} AS words_before, {S.n_words('clean_text')} AS words_after FROM (SELECT seq, title, text, {_tidy} AS clean_text FROM (
SELECT *, CASE WHEN is_log THEN {_log} ELSE body END AS x FROM (SELECT *, {IS_LOG} AS is_log, {_t} AS body FROM articles)))))"""


def _cleaned(spark, sf) -> DataFrame:
    return cleaning.cleaned(articles(spark, sf))


@query(f"WITH {CLEANED} SELECT seq, clean_text, words_after FROM cleaned")
def regex_clean_text(spark, sf):
    return _cleaned(spark, sf).select("seq", "clean_text", "words_after")


@query(f"""WITH {CLEANED} SELECT count(*) AS processed, sum(words_before) AS words_in, sum(words_after) AS words_out, sum(loss) AS words_lost,
count(*) FILTER (loss_ratio > 0.30 AND words_before >= 50) AS flagged, count(*) FILTER (words_after = 0 AND words_before > 0) AS emptied,
CASE WHEN sum(words_before) > 0 THEN sum(loss)::DOUBLE / sum(words_before)::DOUBLE ELSE 0.0 END AS loss_share FROM cleaned""")
def clean_stats(spark, sf):
    return cleaning.totals(_cleaned(spark, sf))


@query(f"WITH {CLEANED} SELECT seq, words_before, words_after, loss_ratio FROM cleaned WHERE loss_ratio > 0.1 AND words_before >= 50")
def clean_flagged(spark, sf):
    return cleaning.flagged(_cleaned(spark, sf), most=0.1).select("seq", "words_before", "words_after", "loss_ratio")


@query(f"WITH {CLEANED} SELECT seq, loss, loss_ratio, substr(text, 1, 240) AS text_before_head, substr(clean_text, 1, 240) AS text_after_head FROM cleaned ORDER BY loss_ratio DESC, seq LIMIT 100")
def clean_loss_top100(spark, sf):
    return cleaning.worst(_cleaned(spark, sf), "seq").select("seq", "loss", "loss_ratio", F.substring("text", 1, 240).alias("text_before_head"), F.substring("clean_text", 1, 240).alias("text_after_head"))


@query(f"SELECT doc_id, {S.strip(S.rep(S.rep('nfc_normalize(text)', '[ ' + chr(9) + ']+', ' '), chr(10) + '{3,}', chr(10) * 2))} AS text FROM documents")
def nfc_normalize(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))


# ---- scalars and reports ----


@query(f"SELECT seq, {S.n_words('text')} AS words, CASE WHEN length(text) > 0 THEN length({S.rep('text', '''[\\p{L}\\p{N}\\s\\x{0b}\\x{85}\\x{1c}-\\x{1f}\\p{Z}.,;:!?'\"()-]''')})::DOUBLE / length(text) ELSE 0.0 END AS special_ratio FROM articles")
def special_chars(spark, sf):
    return articles(spark, sf).select("seq", X.word_count(F.col("text")).alias("words"), X.special_ratio(F.col("text")).alias("special_ratio"))


@query("""SELECT seq, 'sha256:' || substr(sha256(text), 1, 16) AS content_hash, regexp_replace(title, '[^A-Za-z0-9_]', '_', 'g') AS safe_name, substr(text, 1, 200) AS preview,
length(text) // 4 AS tokens, lower(title) AS low, upper(title) AS up FROM articles""")
def scalar_columns(spark, sf):
    t, x = F.col("title"), F.col("text")
    return articles(spark, sf).select("seq", X.content_hash(x).alias("content_hash"), X.safe_name(t).alias("safe_name"), F.substring(x, 1, 200).alias("preview"), X.token_estimate(x).cast("long").alias("tokens"), F.lower(t).alias("low"), F.upper(t).alias("up"))


@query(f"SELECT CASE WHEN w < 50 THEN '<50' WHEN w < 100 THEN '50-100' WHEN w < 500 THEN '100-500' WHEN w < 2000 THEN '500-2000' ELSE '>2000' END AS bucket, count(*) AS n FROM (SELECT {S.n_words('text')} AS w FROM documents) GROUP BY 1")
def length_histogram(spark, sf):
    bucket = X.length_bucket(X.word_count(F.col("text")), [50, 100, 500, 2000], ["<50", "50-100", "100-500", "500-2000", ">2000"])
    return read_table(spark, sf, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


NINE = ["0", "1-9", "10-49", "50-99", "100-499", "500-999", "1000-4999", "5000-9999", "10000+"]


@query(f"""SELECT b.place, b.bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(9)) AS place, unnest({S.ql(NINE)}) AS bucket) b LEFT JOIN (
SELECT CASE WHEN w = 0 THEN '0' WHEN w < 10 THEN '1-9' WHEN w < 50 THEN '10-49' WHEN w < 100 THEN '50-99' WHEN w < 500 THEN '100-499' WHEN w < 1000 THEN '500-999'
WHEN w < 5000 THEN '1000-4999' WHEN w < 10000 THEN '5000-9999' ELSE '10000+' END AS bucket, count(*) AS n FROM (SELECT {W0} AS w FROM articles) GROUP BY 1) USING (bucket)""")
def length_histogram_nine(spark, sf):
    bucket = X.length_bucket(F.coalesce("word_count", F.lit(0)), [1, 10, 50, 100, 500, 1000, 5000, 10000], NINE)
    counts = articles(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(i, b) for i, b in enumerate(NINE)], "place long, bucket string")
    return every.join(counts, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM articles) GROUP BY 1 ORDER BY n DESC, category LIMIT 50")
def category_top(spark, sf):
    return articles(spark, sf).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category")).limit(50)


@query("SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '\\b[a-z]{10,}\\b')) AS token FROM documents) GROUP BY 1 ORDER BY freq DESC, token LIMIT 500")
def token_freq_top(spark, sf):
    return long_words(read_table(spark, sf, "documents"), "text", 10).orderBy(F.desc("freq"), "token").limit(500)


@query("SELECT count(DISTINCT token) AS tokens, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(text, '\\b[a-z]{10,}\\b')) AS token FROM documents)")
def token_freq_totals(spark, sf):
    return long_words(read_table(spark, sf, "documents"), "text", 10).agg(F.count("*").alias("tokens"), F.sum("freq").alias("occurrences"))


@query(f"SELECT source, count(*) AS docs, sum({S.n_words('text')}) AS words, sum(length(text)) AS chars FROM general_corpus GROUP BY source")
def corpus_totals(spark, sf):
    t = F.col("text")
    return read_table(spark, sf, "general_corpus").groupBy("source").agg(F.count("*").alias("docs"), F.sum(X.word_count(t)).alias("words"), F.sum(F.length(t)).alias("chars"))


@query(f"SELECT replace({S.strip('text')}, chr(10), ' ') AS value FROM general_corpus WHERE {S.strip('text')} <> ''")
def corpus_lines(spark, sf):
    from corvane.sources.sinks import corpus_lines as lines

    return lines(read_table(spark, sf, "general_corpus"), "text")


# ---- classification ----

_slashes = f"(length({T0}) - length(replace({T0}, '/', '')))"
_circuits = S.starts(T0, ["Redstone circuits/"])
_meta = S.q("|".join(R.META_CATEGORIES))
SETTING = S.case([
    (S.starts(T0, R.SPINOFF_TITLES), "spinoff"),
    (f"{S.has_any(R.APRIL_FOOLS_CATEGORIES)} OR regexp_matches({T0}, {S.q('(?i)' + R.APRIL_FOOLS_TITLE)})", "april_fools"),
    (S.has_any(R.EDUCATION_CATEGORIES), "education_edition"),
    (f"{S.starts(T0, R.META_TITLES)} OR {S.has_any(R.META_PAGE_CATEGORIES)}", "wiki_meta"),
    (f"{S.starts(T0, R.TUTORIAL_TITLES)} OR {S.has_any(R.TUTORIAL_CATEGORIES)} OR {T0} IN {S.tup(R.TUTORIAL_PAGES)} OR ({_circuits} AND {_slashes} = 1) OR ({S.has_any(R.MODDING_CATEGORIES)} AND ({T0} = 'Mod' OR {S.starts(T0, ['Mods/'])}))", "tutorial"),
    (f"len(list_filter({S.CATS}, lambda x: x NOT IN {S.tup(R.VERSION_CATEGORIES_IGNORED)} AND regexp_matches(x, {S.q(R.VERSION_CATEGORY)}))) > 0 OR {S.has_any(R.VERSION_CATEGORIES)}", "versions"),
    (f"{S.starts(T0, ['Movie:'])} OR {S.has_any(R.MEDIA_CATEGORIES)} OR len(list_filter({S.CATS}, lambda x: ends_with(x, '_chapters'))) > 0", "media_franchise"),
    (f"{S.has_any(R.REAL_WORLD_CATEGORIES)} OR ({S.has_any(R.HISTORY_CATEGORIES)} AND NOT {S.has_any(R.VANILLA_CATEGORIES)})", "real_world"),
    (f"{_circuits} AND {_slashes} >= 2", "wiki_meta"),
], "'game_vanilla'")
_first = lambda ordered: f"list_filter({S.ql(ordered)}, lambda p: list_contains({S.CATS}, p))[1]"
_vanilla = "coalesce(" + S.case([
    (f"{S.starts(T0, ['Crafting/'])} OR ({S.starts(T0, ['Banner/'])} AND {S.contains(f'lower({T0})', ['crafting', 'pattern'])})", "Crafting_recipes"),
    (f"ends_with({T0}, '/Structure')", "Structure_subpages"), (f"ends_with({T0}, '/BS')", "Block_states_reference"), (S.starts(T0, ["List of "]), "Lists"),
    (f"contains({T0}, '/Before ')", "Mechanic_history"), (f"{S.starts(T0, ['Redstone '])} AND {S.has('Redstone')} AND NOT {S.has('Ore')}", "Redstone_mechanics"),
    (f"{T0} IN {S.tup(R.EDITION_TITLES)}", "Edition_overview"), (S.starts(T0, R.TECHNICAL_TITLES), "Java_Edition_technical"),
    ("coalesce(contains(lower(substr(text, 1, 300)), 'disambiguation page'), false)", "Disambiguation_pages"),
]) + f", {_first(R.PRIORITY)}, " + S.case([
    (f"{T0} IN {S.tup(R.MECHANIC_TITLES)} OR {S.starts(T0, ['Hitbox/'])}", "Game_mechanics"), (f"{T0} IN {S.tup(R.MENU_TITLES)}", "Menu_screens"),
]) + f", list_filter({S.CATS}, lambda x: NOT regexp_matches(x, {_meta}) AND x NOT IN {S.tup(R.EDITION_TAGS)})[1], 'Other')"
_company = f"{T0} IN {S.tup(R.COMPANY_TITLES)}"
_any = lambda test: f"len(list_filter({S.CATS}, lambda x: {test})) > 0"
_other = {
    "spinoff": S.case([(S.starts(T0, ["Dungeons:", "MCD:"]), "Minecraft_Dungeons"), (S.starts(T0, ["Legends:"]), "Minecraft_Legends"), (S.starts(T0, ["Earth:", "Minecraft Earth:"]), "Minecraft_Earth"), (S.starts(T0, ["Story Mode:"]), "Minecraft_Story_Mode")], "'Spinoff_other'"),
    "april_fools": f"coalesce({_first(('Joke_blocks', 'Joke_items', 'Joke_mobs', 'Joke_entities', 'Joke_biomes', 'Joke_effects', 'Joke_dimensions', 'Joke_features', chr(65) + 'pril_Fools' + chr(39), 'April_Fools'))}, 'April_Fools_other')",
    "education_edition": S.case([(S.has("MinecraftEdu_blocks"), "MinecraftEdu_blocks"), (S.has("MinecraftEdu_items"), "MinecraftEdu_items"), (S.has("Chemistry_Resource_Pack"), "Chemistry"), (S.has_any(("MinecraftEdu", "MinecraftEdu_features")), "MinecraftEdu_features")], "'Minecraft_Education_features'"),
    "tutorial": S.case([(S.has("Java_Edition_guides"), "Java_Edition_guides"), (S.has("Bedrock_Edition_guides"), "Bedrock_Edition_guides"), (f"{T0} IN {S.tup(R.TUTORIAL_PAGES)} OR {_circuits}", "Redstone_tutorials"), (S.starts(T0, ["Tutorial:Programs"]), "Software_tutorials")], "'Tutorials'"),
    "media_franchise": S.case([
        (f"{S.starts(T0, ['Movie:'])} OR {_any(S.starts('x', ['A_Minecraft_Movie']))}", "A_Minecraft_Movie"), (_any(S.starts("x", ["Minecraft_Mini-Series"])), "Mini_Series"),
        (S.has_any(("Minecraft_(Dark_Horse_Comics)_series", "Comic_books")), "Comics"), (S.has_any(("Books", "Fiction", "Nick_Eliopulos_novels", "Max_Brooks_novels", "Meta_novels", "Science_fiction")), "Books"),
        (S.has("Animated_content"), "Animated_shorts"), (S.has("Live_action_content"), "Live_action"), (S.has_any(("Adventure_maps", "Maps")), "Maps"), (S.has("Game_trailers"), "Trailers"),
        (_any("ends_with(x, '_chapters')"), "Book_chapters"), (S.has("Online_content"), "Online_content"), (S.has("Editorials"), "Editorials"), (S.has("Minecraft_(franchise)"), "Franchise_meta"),
    ], "'Media_other'"),
    "real_world": S.case([(S.has_any(R.PEOPLE), "People"), (f"{S.has('Mojang_Studios')} AND NOT {_company}", "People"), (_company, "Companies"), (S.has_any(R.EVENTS), "Events"), (S.has_any(R.HISTORY_CATEGORIES), "History"), (S.has_any(R.COMPANIES), "Companies"), (S.has_any(R.COMMUNITY), "Community_business")], "'Real_world_other'"),
    "versions": f"coalesce(list_filter({S.CATS}, lambda x: ends_with(x, '_versions') AND x NOT IN {S.tup(R.EDITION_TAGS)})[1], CASE WHEN {S.has('Lost_versions')} THEN 'Lost_versions' END, 'Versions')",
    "wiki_meta": S.case([(S.starts(T0, ["File:"]), "Files"), (S.starts(T0, ["Template:"]), "Templates"), (S.starts(T0, ["Help:"]), "Help_pages"), (S.starts(T0, ["Minecraft Wiki:"]), "Wiki_self_reference"), (S.has("Soft_redirects"), "Redirects"), (f"{_circuits} AND {_slashes} >= 2", "Redstone_schemas")], "'Wiki_meta_other'"),
}
_bucket = "CASE setting " + " ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in _other.items()) + f" ELSE {_vanilla} END"
_parents = "CASE bucket " + " ".join(f"WHEN {S.q(k)} THEN {S.ql(v)}" for k, v in R.PARENTS.items()) + " ELSE [] END"
_lenses = f"list_filter({S.CATS}, lambda x, i: x <> bucket AND NOT list_contains({_parents}, x) AND NOT regexp_matches(x, {_meta}) AND x NOT IN {S.tup(R.EDITION_TAGS)} AND list_position({S.CATS}, x) = i)"
_family = "CASE " + " ".join(f"WHEN setting = {S.q(k)} THEN {S.q(v)}" for k, v in R.SETTING_FAMILIES.items()) + " " + " ".join(f"WHEN bucket IN {S.tup(v)} THEN {S.q(k)}" for k, v in R.FAMILIES.items()) + " ELSE 'none' END"
_tier = "CASE " + " ".join(f"WHEN {{w}} >= {n} THEN {S.q(name)}" for n, name in reversed(R.TIERS)) + " ELSE '<10' END"
TIER = _tier.format(w=W0)
CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN setting = 'game_vanilla' THEN bucket ELSE setting || '::' || bucket END AS grp, {_lenses} AS also_in, {_family} AS family FROM (
SELECT *, {_bucket} AS bucket FROM (SELECT *, {SETTING} AS setting FROM {{table}})))"""
PAGES = CLASSIFIED.format(table="articles")


def _classified(spark, sf) -> DataFrame:
    return classify.classified(articles(spark, sf))


@query(f"WITH {PAGES} SELECT seq, setting, bucket, grp, array_to_string(also_in, '|') AS also_in, family, {TIER} AS tier FROM classified")
def page_groups(spark, sf):
    return _classified(spark, sf).select("seq", "setting", "bucket", F.col("group").alias("grp"), F.array_join("also_in", "|").alias("also_in"), "family", classify.tier(F.coalesce("word_count", F.lit(0))).alias("tier"))


@query(f"WITH {PAGES} SELECT setting, bucket, count(*) AS n, sum({W0}) AS words, sum({W0})::DOUBLE / greatest(count(*), 1) AS avg_words FROM classified GROUP BY ROLLUP (setting, bucket)")
def bucket_rollup(spark, sf):
    return catalog.rollup(_classified(spark, sf))


@query(f"WITH {PAGES} SELECT family, count(*) AS n FROM classified GROUP BY family")
def family_counts(spark, sf):
    return _classified(spark, sf).groupBy("family").agg(F.count("*").alias("n"))


@query(f"WITH {PAGES} SELECT setting, bucket, seq, {W0} AS word_count FROM classified WHERE word_count IS NOT NULL QUALIFY row_number() OVER (PARTITION BY setting, bucket ORDER BY word_count DESC, seq) <= 3")
def topn_per_bucket(spark, sf):
    return catalog.top_per_bucket(_classified(spark, sf).where("word_count is not null"), 3).select("setting", "bucket", "seq", "word_count")


@query(f"WITH {PAGES} SELECT family, seq FROM classified QUALIFY row_number() OVER (PARTITION BY family ORDER BY seq) <= 5")
def first_per_family(spark, sf):
    from corvane.operators.joins import ranked

    return ranked(_classified(spark, sf).select("family", "seq"), ["family"], [F.col("seq")], 5)


# ---- routing and hardening ----

_deprecated = R.DEPRECATION_BANNER.replace(r"|officially made unobtainable\.(?!\s*in\s)", "")
_head15 = "substr(coalesce(text, ''), 1, 1500)"
_unobtainable = r"officially made unobtainable\."
_banner = f"(regexp_matches({_head15}, {S.q(_deprecated)}) OR len(regexp_extract_all({_head15}, {S.q(_unobtainable)})) > len(regexp_extract_all({_head15}, {S.q(_unobtainable + chr(92) + 's*in' + chr(92) + 's')})))"
_guide = S.starts(T0, ["Tutorial:"])
_nonblank = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {S.n_words('x')} > 0)"
ROUTE = S.case([
    (S.has("Disambiguation_pages"), "route_qa_direct/disambig"), (S.has("Set_index_pages"), "route_qa_direct/set_index"), (S.starts(T0, R.META_TITLES), "drop/wiki_meta_prefix"),
    (S.has_any(("Files_with_a_license_template", "Mojang_images", "Notice_templates", "Documentation_pages", "Soft_redirects")), "drop/wiki_meta"),
    (f"{S.starts(T0, ['List of '])} AND {W0} > 1000 AND len({_nonblank}) > 0 AND len(list_filter({_nonblank}, lambda x: {S.n_words('x')} <= 6))::DOUBLE / len({_nonblank}) > 0.7", "drop/list_pure_enumeration"),
    ("setting = 'versions'", "route_qa_direct/version_changelog_page"), (f"NOT {_guide} AND {S.has_any(('Unused_features', 'Unused_biomes'))}", "drop/unused_content"),
    (f"NOT {_guide} AND {_banner}", "drop/deprecated_content"), (f"{S.starts(T0, ['Java Edition history of '])} AND {W0} < 500", "drop/history_subpage_changelog_only"),
    (f"{S.has('Removed_features')} AND {S.starts(T0, ['Item format/', 'Block format/'])}", "drop/removed_format_nbt_only"), ("bucket = 'Removed_features'", "drop/removed_features_only"),
    (f"{S.has('MinecraftEdu_blocks')} AND {W0} < 400", "drop/edu_discontinued_stub"), (f"{S.has('Minecraft_Education')} AND {W0} < 50", "drop/edu_stub"),
], "'keep'")


@query(f"WITH {PAGES} SELECT seq, split_part(r, '/', 1) AS decision, nullif(split_part(r, '/', 2), '') AS reason FROM (SELECT seq, {ROUTE} AS r FROM classified)")
def phase0_routing(spark, sf):
    return harden.routed(articles(spark, sf)).select("seq", "decision", "reason")


_pre = S.rep("text", "[​‌‍\\x{2060}\\x{FEFF}]".replace("​", "\\x{200B}").replace("‌", "\\x{200C}").replace("‍", "\\x{200D}"))
_pre = S.rep(_pre, r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " ")
_pre = S.rep(S.rep(_pre, "[“”„‟]", '"'), "[‘’]", "'")
_pre = S.rstrip_lines(S.rep(S.rep(f"replace({_pre}, '⁄', '/')", r"(\d)[–—](\d)", r"\1-\2"), r"\n{3,}", "\n\n"))


@query(f"SELECT seq, {_pre} AS text FROM articles_cleaned")
def pre_clean(spark, sf):
    return read_table(spark, sf, "articles_cleaned").select("seq", harden.pre_clean(F.col("text")).alias("text"))


_plain_heads = S.rep("text", r"(?m)^== *(.*?) *==$", r"\1")
_known = S.tup(R.SECTIONS_DROPPED + R.SECTIONS_CONDITIONAL + R.SECTIONS_KEPT)
SECTIONS = f"""lines AS (SELECT seq, title, categories, unnest(string_split({_plain_heads}, chr(10))) AS line, unnest(range(1, len(string_split({_plain_heads}, chr(10))) + 1)) AS i FROM articles WHERE text IS NOT NULL),
marked AS (SELECT *, CASE WHEN {S.strip('line')} IN {_known} THEN i END AS h FROM lines),
spans AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY seq ORDER BY i) AS s FROM marked),
named AS (SELECT *, first_value({S.strip('line')}) OVER (PARTITION BY seq, s ORDER BY i) AS name, bool_or(i <> s AND contains(line, 'are maintained on the bug tracker')) OVER (PARTITION BY seq, s) AS bug FROM spans),
told AS (SELECT *, s IS NOT NULL AND (name IN {S.tup(R.SECTIONS_DROPPED)} OR (name = 'Issues' AND bug) OR (name = 'Achievements' AND NOT ({S.contains(T0, ['Achievement', 'Advancement'])} OR {S.has_any(('Achievements', 'Advancements'))}))) AS gone FROM named)"""


@query(f"WITH {SECTIONS} SELECT seq, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, coalesce(string_agg(name, '|' ORDER BY i) FILTER (gone AND i = s), '') AS dropped FROM told GROUP BY seq")
def section_drops(spark, sf):
    df = articles(spark, sf).where("text is not null").withColumn("text", F.regexp_replace("text", r"(?m)^== *(.*?) *==$", "$1"))
    return harden.sections_dropped(df).select("seq", "sections.text", F.array_join("sections.dropped", "|").alias("dropped"))


@query(f"WITH {SECTIONS} SELECT seq, i::BIGINT AS line_no, name AS header FROM told WHERE s IS NOT NULL")
def governing_header(spark, sf):
    """The header that governs each line: the last one at or before it."""
    from pyspark.sql import Window as W

    known = list(R.SECTIONS_DROPPED + R.SECTIONS_CONDITIONAL + R.SECTIONS_KEPT)
    text = F.regexp_replace("text", r"(?m)^== *(.*?) *==$", "$1")
    lines = articles(spark, sf).where("text is not null").select("seq", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    head = F.when(X.strip(F.col("line")).isin(known), X.strip(F.col("line")))
    w = W.partitionBy("seq").orderBy("i").rowsBetween(W.unboundedPreceding, 0)  # the lines of one page
    return lines.select("seq", (F.col("i") + 1).cast("long").alias("line_no"), F.last(head, ignorenulls=True).over(w).alias("header")).where("header is not null")


_stuttered = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 IN (1, 2) THEN 'Java Edition: ' || x WHEN i % 4 = 3 THEN 'Bedrock Edition: ' || x ELSE x END), chr(10))"
_edition = f"regexp_extract(x, {S.q(R.EDITION_PREFIX)}, 1)"


@query(f"""SELECT seq, regexp_replace(array_to_string(list_transform(l, lambda x, i: CASE WHEN i > 1 AND {_edition} <> '' AND {_edition} = regexp_extract(l[i - 1], {S.q(R.EDITION_PREFIX)}, 1)
THEN regexp_replace(x, {S.q(R.EDITION_PREFIX)}, '') ELSE x END), chr(10)), {S.q('(?m)' + R.PLATFORM_LINE)}, '', 'g') AS text FROM (SELECT seq, string_split({_stuttered}, chr(10)) AS l FROM articles)""")
def edition_stutter(spark, sf):
    lead = lambda x, i: F.when((i + 1) % 4 == 0, x).when((i + 1) % 4 == 3, F.concat(F.lit("Bedrock Edition: "), x)).otherwise(F.concat(F.lit("Java Edition: "), x))
    text = F.array_join(F.transform(F.split("text", "\n", -1), lead), "\n")
    return articles(spark, sf).select("seq", harden.edition_stutter(text).alias("text"))


_tab = S.rep(S.rep_all("text", R.TABLE_ROWS), "(?m)" + R.CONSOLE_PREFIX)


@query(f"SELECT seq, {_tab} AS text FROM articles")
def tabular_drops(spark, sf):
    return articles(spark, sf).select("seq", harden.tabular_rows(F.col("text")).alias("text"))


@query(f"SELECT seq, {S.rep_all('text', R.INLINE_NOISE)} AS text FROM articles")
def inline_noise(spark, sf):
    return articles(spark, sf).select("seq", harden.inline_noise(F.col("text")).alias("text"))


_fam = "CASE family " + " ".join(f"WHEN {S.q(k)} THEN {S.rep_all('text', v)}" for k, v in R.FAMILY_LINES.items()) + " ELSE text END"


@query(f"WITH {PAGES} SELECT seq, {_fam} AS text FROM classified")
def family_lines(spark, sf):
    return _classified(spark, sf).select("seq", harden.family_lines(F.col("text"), F.col("family")).alias("text"))


_twice = "(text || chr(10) || chr(10) || text)"
_norm = f"list_transform(p, lambda x: array_to_string({S.words('x')}, ' '))"


@query(f"""SELECT seq, array_to_string(k, chr(10) || chr(10)) AS text, len(p) - len(k) AS removed FROM (SELECT *, list_filter(p, lambda x, i: NOT (length(n[i]) >= 200 AND list_position(n, n[i]) < i)) AS k
FROM (SELECT *, {_norm} AS n FROM (SELECT seq, string_split({_twice}, chr(10) || chr(10)) AS p FROM articles WHERE text IS NOT NULL)))""")
def paragraph_dedup(spark, sf):
    df = articles(spark, sf).where("text is not null")
    return computed_once(df, {"r": harden.paragraphs_once(F.concat("text", F.lit("\n\n"), "text"))}).select("seq", "r.text", F.col("r.removed").cast("long").alias("removed"))


@query()
def boilerplate_strip(spark, sf):
    from corvane.session import ship

    ship(spark)
    return articles(spark, sf).select("seq", harden.without_noise(F.col("text")).alias("text"))


@query()
def word_repair(spark, sf):
    from corvane.session import ship

    ship(spark)
    return articles(spark, sf).select("seq", harden.repaired(F.col("text")).alias("text"))


@query()
def final_cleanup(spark, sf):
    return articles(spark, sf).select("seq", harden.final_cleanup(F.col("text")).alias("text"))


def _hardened(spark, sf) -> DataFrame:
    return harden.hardened(articles(spark, sf))


@query()
def harden_record(spark, sf):
    return _hardened(spark, sf).select("seq", "route", "reason", "family", "hard_text", "hard_words", "original_words", "words_removed", F.array_join("section_drops", "|").alias("section_drops"), F.array_join("warnings", "|").alias("warnings"))


@query()
def hardening_rollups(spark, sf):
    return harden.rollups(_hardened(spark, sf))


@query()
def hardening_stable(spark, sf):
    return harden.is_stable(_hardened(spark, sf), "seq")


@query(f"WITH {PAGES} SELECT split_part(r, '/', 1) AS decision, count(*) AS n, sum({W0}) AS words FROM (SELECT word_count, {ROUTE} AS r FROM classified) GROUP BY 1")
def route_totals(spark, sf):
    return harden.routed(articles(spark, sf)).groupBy("decision").agg(F.count("*").alias("n"), F.sum(F.coalesce("word_count", F.lit(0))).alias("words"))


# ---- other sources, HTML ----

_enc = "text"
for _h in R.FOOTERS:
    _enc = S.rep(_enc, rf"(?s)\n\n{_h}\s*\n.*")
_enc = S.rep(_enc, r"\(\s*[A-Z]+-?[a-zəɛɪʊɔæʌɑːˌˈ]+,\s*[A-Z][a-z]+:\s*\[[^\]]+\]\s*[;,]?\s*")
_enc = S.rep(_enc, r"\[[\s\x{0b}\x{85}\p{Z}\x{250}-\x{2FF}\x{300}-\x{36F}\x{2B0}-\x{2FF}\x{C0}-\x{24F}\p{L}\p{N}_'ːˈˌ\-]+\]")
_enc = S.strip(S.rep(S.rep(_enc, r"\n{3,}", "\n\n"), " +", " "))


@query(f"SELECT seq, {_enc} AS text FROM articles")
def encyclopedia_clean(spark, sf):
    return articles(spark, sf).select("seq", external.encyclopedia(F.col("text")).alias("text"))


@query(f"SELECT seq, {S.strip(S.rep(S.rep('text', R.CAPTION_TAGS), S.GAP + '+', ' '))} AS text FROM articles_cleaned WHERE source = 'transcript'")
def caption_clean(spark, sf):
    return read_table(spark, sf, "articles_cleaned").where("source = 'transcript'").select("seq", external.captions(F.col("text")).alias("text"))


@query()
def blog_clean(spark, sf):
    df = read_table(spark, sf, "articles_cleaned").where("source = 'dev_blog'")
    noise = ["Archive", "Random Post", "theme", "by", ".", "powered by"]
    return external.blog_posts(df, "title", "text", "The dev blog", noise).select("seq", "post.title", "post.body", "post.post_date")


@query(f"""SELECT b.source, b.w AS words_before, coalesce(a.w, 0) AS words_after, CASE WHEN b.w > 0 THEN (coalesce(a.w, 0) - b.w) * 100.0::DOUBLE / b.w ELSE 0.0 END AS delta_pct
FROM (SELECT source, sum({S.n_words('text')}) AS w FROM general_corpus GROUP BY source) b LEFT JOIN (SELECT source, sum({S.n_words('text')}) AS w FROM general_corpus WHERE length(text) >= 100 GROUP BY source) a ON b.source IS NOT DISTINCT FROM a.source""")
def source_word_delta(spark, sf):
    df = read_table(spark, sf, "general_corpus")
    return external.words_before_after(df, df.where("length(text) >= 100"), "source", "text")


@query("""SELECT pair_id, make_date(1990 + pair_id::INT % 40, 1 + pair_id::INT % 12, 1 + pair_id::INT % 28) AS day FROM qa_pairs""")
def split_dates(spark, sf):
    n = F.col("pair_id").cast("int")
    month = F.element_at(F.array(*map(F.lit, external.MONTHS)), 1 + n % 12)
    return read_table(spark, sf, "qa_pairs").select("pair_id", external.split_date(month, (1 + n % 28).cast("string"), (1990 + n % 40).cast("string")).alias("day"))


@query()
def html_text(spark, sf):
    return pages(read_table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "page.text", F.size("page.tables").alias("tables"))


_turn = f"lower({S.strip('line')})"


@query(f"""WITH l AS (SELECT seq, unnest(string_split({_plain_heads}, chr(10))) AS line, unnest(range(1, len(string_split({_plain_heads}, chr(10))) + 1)) AS i FROM articles WHERE text IS NOT NULL),
m AS (SELECT *, CASE WHEN {_turn} IN ('technical', 'technical changes', 'technical additions') THEN 't' WHEN {_turn} IN ('fixes', 'video', 'trivia', 'references', 'navigation') THEN 'o' END AS k FROM l),
s AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY seq ORDER BY i), 'p') AS state FROM m)
SELECT seq, coalesce({S.strip("string_agg(line, chr(10) ORDER BY i) FILTER (state = 'p')")}, '') AS player_facing, coalesce({S.strip("string_agg(line, chr(10) ORDER BY i) FILTER (state = 't')")}, '') AS technical FROM s GROUP BY seq""")
def changelog_sections(spark, sf):
    text = F.regexp_replace("text", r"(?m)^== *(.*?) *==$", "$1")
    return computed_once(articles(spark, sf).where("text is not null"), {"s": sections_of_changelog(text)}).select("seq", "s.player_facing", "s.technical")

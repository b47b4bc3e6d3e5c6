"""Queries that join, rank, fold, sample and pack the tables of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import numeric as N

from corvane.operators import catalog, dedup, events, joins, prompts, qa, replies, sampling, tokens
from corvane.operators import rules as R
from corvane.operators.filters import article_reason
from corvane.plans import sql as S
from corvane.plans.corpus import CLASSIFIED, REASON, TIER, T0, W0
from corvane.plans.registry import query
from corvane.session import computed_once, read_table, ship, spread
from corvane.streaming import logs


def table(name: str):
    return lambda spark, sf: read_table(spark, sf, name)


articles, cleaned, pairs, log, redirects, general, documents, event_table, embeddings = map(table, ("articles", "articles_cleaned", "qa_pairs", "exclusion_log", "redirects", "general_corpus", "documents", "events", "embeddings"))

# ---- joins ----


@query("SELECT seq, title FROM articles a WHERE NOT EXISTS (SELECT 1 FROM articles_cleaned c WHERE c.seq = a.seq)")
def resume_anti(spark, sf):
    return joins.to_do(articles(spark, sf).select("seq", "title"), cleaned(spark, sf), "seq")


@query("SELECT seq, title FROM articles a WHERE EXISTS (SELECT 1 FROM redirects r WHERE r.to_title = a.title)")
def needed_semi(spark, sf):
    return joins.needed(articles(spark, sf).select("seq", "title"), redirects(spark, sf).select(F.col("to_title").alias("title")), "title").select("seq", "title")


LAST = "SELECT title, max_by(seq, seq) AS seq, arg_max_null(word_count, seq) AS word_count FROM {} WHERE title IS NOT NULL GROUP BY title"


@query("SELECT title, max(seq) AS seq FROM articles WHERE title IS NOT NULL GROUP BY title")
def last_wins_titles(spark, sf):
    return joins.last_wins(articles(spark, sf).select("title", "seq", "word_count"), "title", "seq").select("title", "seq")


@query(f"SELECT a.title, a.seq AS seq_raw, c.seq AS seq_cleaned FROM ({LAST.format('articles')}) a JOIN ({LAST.format('articles_cleaned')}) c USING (title)")
def audit_inner(spark, sf):
    a = joins.last_wins(articles(spark, sf).select("title", F.col("seq").alias("seq_raw")), "title", "seq_raw")
    return a.join(joins.last_wins(cleaned(spark, sf).select("title", F.col("seq").alias("seq_cleaned")), "title", "seq_cleaned"), "title")


@query(f"SELECT a.title, abs(coalesce(a.word_count, 0) - coalesce(c.word_count, 0)) AS delta FROM ({LAST.format('articles')}) a LEFT JOIN ({LAST.format('articles_cleaned')}) c USING (title)")
def word_delta(spark, sf):
    last = lambda df: joins.last_wins(df.select("title", "seq", "word_count"), "title", "seq")
    return joins.word_delta(last(articles(spark, sf)), last(cleaned(spark, sf)), "title", "word_count")


@query("""SELECT title, string_agg(version, '|' ORDER BY version) AS available, string_agg(n::VARCHAR, '|' ORDER BY version) AS counts FROM (
SELECT title, version, max(coalesce(n, 0)) AS n FROM (SELECT title, 'cleaned' AS version, word_count AS n FROM articles_cleaned UNION ALL SELECT title, 'raw', word_count FROM articles UNION ALL SELECT title, 'documents', n_chars FROM documents)
WHERE title IS NOT NULL GROUP BY 1, 2) GROUP BY title""")
def version_availability(spark, sf):
    docs = documents(spark, sf).select("title", F.col("n_chars").alias("word_count"))
    raw, clean = (f(spark, sf).select("title", F.col("word_count").cast("long").alias("word_count")) for f in (articles, cleaned))
    out = joins.versions({"cleaned": clean, "raw": raw, "documents": docs}, "title", "word_count")
    return out.select("title", F.array_join("available", "|").alias("available"), F.array_join(F.transform("available", lambda v: F.element_at("counts", v).cast("string")), "|").alias("counts"))


@query("SELECT seq, coalesce(x.word_count, a.word_count) AS word_count FROM articles a LEFT JOIN (SELECT seq, max(word_count) AS word_count FROM articles_cleaned GROUP BY seq) x USING (seq)")
def corrections_left(spark, sf):
    new = cleaned(spark, sf).groupBy("seq").agg(F.max("word_count").alias("word_count"))
    return joins.corrected(articles(spark, sf).select("seq", "word_count"), new, "seq", "word_count")


@query("SELECT r.from_title, r.to_title, t.title AS page FROM (SELECT from_title, min(to_title) AS to_title FROM redirects WHERE from_title IS NOT NULL GROUP BY 1) r LEFT JOIN (SELECT DISTINCT title FROM articles) t ON t.title = r.to_title")
def redirect_targets(spark, sf):
    return joins.redirected(articles(spark, sf), redirects(spark, sf), "title")


@query("""SELECT canonical, min(seq) AS seq FROM (SELECT coalesce(r.to_title, a.title) AS canonical, a.seq FROM articles a
LEFT JOIN (SELECT from_title, min(to_title) AS to_title FROM redirects WHERE from_title IS NOT NULL AND to_title IS NOT NULL GROUP BY 1) r ON r.from_title = a.title WHERE a.title IS NOT NULL) GROUP BY 1""")
def canonical_titles(spark, sf):
    return joins.canonical_titles(articles(spark, sf).select("title", "seq"), redirects(spark, sf), "title", "seq").select("canonical", "seq")


@query(f"SELECT seq, title, {TIER} AS tier FROM articles WHERE {REASON} IS NULL UNION ALL SELECT seq, title, {TIER} FROM articles WHERE {REASON} IS NOT NULL AND title NOT IN (SELECT title FROM articles WHERE {REASON} IS NULL AND title IS NOT NULL)")
def removed_union(spark, sf):
    from corvane.operators.classify import tier

    df = articles(spark, sf).withColumn("r", article_reason(F.col("title"), F.col("text"), F.col("word_count"))).withColumn("tier", tier(F.coalesce("word_count", F.lit(0)))).select("seq", "title", "tier", "r")
    return joins.with_removed(df.where("r is null").drop("r"), df.where("r is not null and title is not null").drop("r"), "title")


LENSES = CLASSIFIED.format(table="(SELECT * FROM articles WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq DESC) = 1)")


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalogue(articles(spark, sf))


@query(f"WITH {LENSES} SELECT lens, count(*) AS n, count(*) FILTER (lens = grp) AS n_primary FROM (SELECT grp, unnest(list_distinct(list_concat([grp], also_in))) AS lens FROM classified) GROUP BY lens")
def lens_members(spark, sf):
    return catalog.lenses(_catalogue(spark, sf)).groupBy("lens").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))


@query(f"""WITH {LENSES}, c AS (SELECT *, {TIER} AS tier, {W0} AS w FROM classified),
p AS (SELECT grp, {', '.join(f"count(*) FILTER (tier = {S.q(n)}) AS {chr(34)}tier_{n}{chr(34)}" for _, n in R.TIERS)}, count(*) FILTER (tier <> '<10') AS n, sum(w) AS words FROM c GROUP BY grp),
s AS (SELECT unnest(also_in) AS grp FROM c WHERE tier <> '<10'), t AS (SELECT grp, count(*) AS secondary FROM s GROUP BY grp)
SELECT grp, {', '.join(f"coalesce({chr(34)}tier_{n}{chr(34)}, 0) AS {chr(34)}tier_{n}{chr(34)}" for _, n in R.TIERS)}, coalesce(n, 0) AS n, coalesce(words, 0) AS words, coalesce(secondary, 0) AS secondary FROM p FULL JOIN t USING (grp)""")
def tier_matrix(spark, sf):
    return catalog.tier_matrix(_catalogue(spark, sf)).withColumnRenamed("group", "grp")


@query(f"WITH {LENSES} SELECT setting, count(*) AS n, sum({W0}) AS words, count(DISTINCT grp) AS groups FROM classified GROUP BY setting")
def setting_totals(spark, sf):
    return catalog.setting_totals(_catalogue(spark, sf))


@query(f"WITH {LENSES} SELECT title, {W0} AS word_count FROM classified WHERE {TIER} <> '<10' AND (grp = 'Mobs' OR list_contains(also_in, 'Mobs')) ORDER BY lower(title), title LIMIT 25 OFFSET 10")
def listing_alpha(spark, sf):
    return catalog.listing(_catalogue(spark, sf), "Mobs", offset=10, limit=25).select("title", "word_count")


@query(f"WITH {LENSES} SELECT title, {W0} AS word_count FROM classified WHERE {TIER} = '100-499' AND contains(lower(title), 'copper') ORDER BY 2 DESC, 1 LIMIT 25")
def listing_longest(spark, sf):
    return catalog.listing(_catalogue(spark, sf), tier_name="100-499", query="Copper", sort="wc", limit=25).select("title", "word_count")


@query(f"WITH {LENSES} SELECT title, scraped_at::DATE AS stamp FROM classified WHERE {TIER} <> '<10' ORDER BY 2 ASC NULLS LAST, lower(title), title LIMIT 50")
def listing_oldest(spark, sf):
    return catalog.listing(_catalogue(spark, sf), sort="date_asc", limit=50).select("title", "stamp")


@query("SELECT title FROM (SELECT title FROM (SELECT DISTINCT title FROM articles WHERE contains(lower(title), 'tin')) ORDER BY title LIMIT 100) ORDER BY NOT starts_with(lower(title), 'tin'), lower(title), title LIMIT 20")
def search_titles(spark, sf):
    return catalog.search(_catalogue(spark, sf), "tin").select("title")


# ---- sets ----


@query("SELECT source, count(*) AS n FROM (SELECT source FROM articles_cleaned UNION ALL SELECT source FROM general_corpus UNION ALL SELECT source FROM qa_pairs) GROUP BY source")
def union_corpora(spark, sf):
    parts = [f(spark, sf) for f in (cleaned, general, pairs)]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT title, min(place) AS place FROM (SELECT title, seq AS place FROM articles UNION ALL SELECT from_title, 1000000000 FROM redirects) WHERE title IS NOT NULL GROUP BY title")
def ordered_titles(spark, sf):
    both = articles(spark, sf).select("title", F.col("seq").alias("place")).unionByName(redirects(spark, sf).select(F.col("from_title").alias("title"), F.lit(1_000_000_000).cast("long").alias("place")))
    return joins.first_wins(both.withColumn("p", F.col("place")), "title", "place").select("title", "place")


@query("SELECT DISTINCT title FROM articles WHERE title IS NOT NULL EXCEPT SELECT title FROM documents")
def titles_not_in_documents(spark, sf):
    return articles(spark, sf).where("title is not null").select("title").subtract(documents(spark, sf).select("title"))


# ---- events ----

ONCE = "(SELECT * FROM exclusion_log QUALIFY row_number() OVER (PARTITION BY event_seq ORDER BY event_seq) = 1)"


def _flag(name: str, scope: str = "true") -> str:
    touch = f"regexp_matches(e.excl_action, '_({name}|both)$') AND {scope}"
    return f"coalesce(max_by(starts_with(e.excl_action, 'exclude'), e.event_seq) FILTER ({touch}), false)"


_GLOBAL = "(e.excl_scope = 'all_lenses' OR starts_with(e.excl_action, 'include'))"


@query(f"""WITH once AS {ONCE}, lenses AS (SELECT DISTINCT title, bucket_lens AS lens FROM once WHERE title IS NOT NULL AND bucket_lens IS NOT NULL)
SELECT l.title, l.lens, {_flag('transform')} AS transform_excluded, {_flag('transform', _GLOBAL)} AS transform_excluded_global, {_flag('qa')} AS qa_excluded, {_flag('qa', _GLOBAL)} AS qa_excluded_global,
arg_max_null(e.ts, e.event_seq) AS last_ts, arg_max_null(e.reason, e.event_seq) AS last_reason
FROM lenses l JOIN once e ON e.title = l.title AND (e.excl_scope = 'all_lenses' OR e.bucket_lens = l.lens) GROUP BY 1, 2""")
def exclusion_state(spark, sf):
    return events.exclusion_state(events.deduplicated(log(spark, sf)))


@query(f"""WITH once AS {ONCE}, top AS (SELECT title FROM once WHERE title IS NOT NULL GROUP BY title ORDER BY count(*) DESC, title LIMIT 1)
SELECT event_seq, excl_action, excl_scope FROM once WHERE title = (SELECT title FROM top)""")
def exclusion_history(spark, sf):
    once = events.deduplicated(log(spark, sf))
    top = once.where("title is not null").groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(1).select("title")
    return once.join(top, "title", "left_semi").select("event_seq", "excl_action", "excl_scope")


@query(f"SELECT bucket_lens, max_by(excl_action, event_seq) AS excl_action, max(event_seq) AS event_seq FROM {ONCE} WHERE bucket_lens IS NOT NULL GROUP BY 1")
def bucket_state(spark, sf):
    return events.upserted(log(spark, sf).where("bucket_lens is not null").select("bucket_lens", "excl_action", "event_seq"), "bucket_lens", "event_seq")


@query(f"""WITH once AS {ONCE}, st AS (SELECT title, max_by(starts_with(excl_action, 'exclude'), event_seq) FILTER (regexp_matches(excl_action, '_(transform|both)$') AND excl_scope = 'all_lenses') AS gone FROM once WHERE title IS NOT NULL GROUP BY title)
SELECT a.seq, coalesce(st.gone, false) AS excluded FROM articles a LEFT JOIN st ON st.title = a.title""")
def items_with_exclusion(spark, sf):
    """Items with the state of the transform flag over the events that hold everywhere."""
    wide = events.deduplicated(log(spark, sf)).where("title is not null and excl_scope = 'all_lenses'").where(F.col("excl_action").rlike("_(transform|both)$"))
    state = wide.groupBy("title").agg(F.max_by(F.col("excl_action").startswith("exclude"), "event_seq").alias("gone"))
    return articles(spark, sf).join(state, "title", "left").select("seq", F.coalesce("gone", F.lit(False)).alias("excluded"))


@query("SELECT event_type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY event_type")
def earliest_per_key(spark, sf):
    return event_table(spark, sf).where("ts is not null").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT event_id, CASE WHEN n >= 2 THEN span / 1e6 / (n - 1) END AS seconds_per_item FROM (SELECT event_id, count(ts) OVER w AS n, epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w) AS span
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def eta_last20(spark, sf):
    df = event_table(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.eta_seconds(df, "ts", "event_id", "user_id").select("event_id", "seconds_per_item")


@query("""SELECT event_id, CASE WHEN n >= 2 AND s - f > 0 THEN (n - 1) * 60.0::DOUBLE / (s - f) END AS per_minute FROM (SELECT event_id, s, count(*) OVER w AS n, min(s) OVER w AS f
FROM (SELECT *, floor(epoch_us(ts) / 1e6)::BIGINT AS s FROM events WHERE ts IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))""")
def rate_5min(spark, sf):
    df = event_table(spark, sf).where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.items_per_minute(df, "ts", "user_id").select("event_id", "per_minute")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def latest_50(spark, sf):
    return events.latest(event_table(spark, sf), "event_id", 50).select("event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def tumbling_5min(spark, sf):
    return events.tumbling(event_table(spark, sf), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(*) AS n, sum((props ->> '$.k')::INT) AS k_sum, max((props ->> '$.k')::INT) AS k_max FROM events GROUP BY event_type")
def event_props(spark, sf):
    return event_table(spark, sf).select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY event_type")
def stream_counts(spark, sf):
    """The counts kept by a stream over the table, once it has seen all of it."""
    schema = event_table(spark, sf).schema
    stream = logs.read_folder(spark, f"{sf}/events.parque[t]", schema).where("ts is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    return logs.run_to_end(stream, "corvane_stream_counts", "complete")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_last_event(spark, sf):
    schema = event_table(spark, sf).schema
    stream = logs.last_event(logs.read_folder(spark, f"{sf}/events.parque[t]", schema), "user_id", "event_id", ["event_id", "event_type"])
    return logs.run_to_end(stream, "corvane_stream_last", "complete")


# ---- samples and mixtures ----


@query("SELECT seq FROM articles ORDER BY md5('42:' || seq), seq LIMIT 20")
def md5_sample(spark, sf):
    return sampling.sample(articles(spark, sf), "seq", 20).select("seq")


_prefix = f"CASE WHEN contains({T0}, ':') THEN split_part({T0}, ':', 1) END"
_person = r"(?m)^(Gender|Species|Actor|Aliases|First appearance):"
_rarity = r"(?m)^Rarity:\s*(UNIQUE|Common|Rare|Uncommon|Legendary|Deluxe)"
_x8, _x10 = "substr(coalesce(text, ''), 1, 800)", "substr(coalesce(text, ''), 1, 1000)"
_bare = f"regexp_replace({T0}, {S.q('^(' + '|'.join(R.SPINOFF_PREFIXES) + ')')}, '')"
_match = lambda t, p: f"regexp_matches({t}, {S.q(p)})"
LABEL = S.case([
    (_match(T0, r":[\d.]+[\w\-]*$"), "DISCARD"), (_match(_x8, _person), "KEEP"), (_match(_x8, r"(?m)^(Episode|Season|Chapter|Written by|Directed by|Boss):"), "KEEP"),
    (S.contains("substr(coalesce(text, ''), 1, 300)", ["Enchantment", "Applicable to:"]), "DISCARD"), (S.contains(_bare, prompts._ITEMS), "DISCARD"),
    (f"{_match(_x8, _rarity)} AND {_match(_x8, '(?m)^Type:' + chr(92) + 's*(Horse|Hero|Weapon|Armor|Skin|Mount)')}", "DISCARD"), (_match(_x8, "(?m)^Health points:"), "DISCARD"),
], "'UNKNOWN'")
_after = f"CASE WHEN contains({T0}, ':') THEN regexp_replace({T0}, '(?s)^[^:]*:', '') ELSE {T0} END"
_role = S.contains(f"lower({_x10})", prompts._ROLES)
STRICT = S.case([
    (f"{_match(_after, '^[' + chr(92) + 'd.]+[' + chr(92) + 'w' + chr(92) + '-]*$')} OR {_match(_after, '^' + chr(92) + 'd+' + chr(92) + '.' + chr(92) + 'd+')}", "DISCARD"), (f"{_match(_x10, _person)} AND {_role}", "KEEP"),
    (_match(_x10, r"(?m)^(Episode|Season|Chapter|Written by|Directed by):"), "KEEP"),
    (f"{_match(_x10, _rarity)} AND {_match(_x10, '(?m)^Type:' + chr(92) + 's*(Armor|Melee Weapon|Ranged Weapon|Horse|Hero|Skin|Mount|Banner|Tower|Structure|Artifact|Enchantment|Currency)')}", "DISCARD"),
    (f"{_match(_x10, '(?m)^Health points:')} AND NOT {_role}", "DISCARD"),
], "'UNKNOWN'")
TARGETS, KEEP_SHARE = {"Dungeons": 6, "Movie": 5, "Category": 4, "Tutorial": 3}, {"Movie": 0.9, "Category": 0.2}


@query(f"SELECT seq, {LABEL} AS label, {STRICT} AS strict FROM articles")
def expected_labels(spark, sf):
    t, x = F.col("title"), F.col("text")
    return articles(spark, sf).select("seq", prompts.expected_label(t, x).alias("label"), prompts.expected_label_strict(t, x).alias("strict"))


@query(f"SELECT {LABEL} AS label, count(*) AS n FROM articles GROUP BY 1")
def label_distribution(spark, sf):
    return articles(spark, sf).groupBy(prompts.expected_label(F.col("title"), F.col("text")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT seq, {_prefix} AS stratum, {LABEL} AS label FROM articles), g AS (SELECT unnest({S.ql(TARGETS)}) AS stratum, unnest({list(TARGETS.values())}) AS n, unnest({[int(n * KEEP_SHARE.get(k, 1 / 3)) for k, n in TARGETS.items()]}) AS k),
h AS (SELECT stratum, n, k, count(*) FILTER (label = 'KEEP') AS ks, count(*) FILTER (label = 'DISCARD') AS ds FROM g JOIN r USING (stratum) GROUP BY stratum, n, k),
z AS (SELECT stratum, n, least(k, ks) AS keeps, least(n - least(k, ks), ds) AS discards FROM h)
SELECT seq, stratum, label FROM (SELECT r.*, keeps, discards, n, row_number() OVER (PARTITION BY r.stratum, label ORDER BY md5('42:' || seq), seq) AS place FROM r JOIN z USING (stratum))
WHERE place <= CASE label WHEN 'KEEP' THEN keeps WHEN 'DISCARD' THEN discards ELSE n - keeps - discards END""")
def stratified_sample(spark, sf):
    t = F.coalesce("title", F.lit(""))
    df = articles(spark, sf).select("seq", F.when(t.contains(":"), F.split_part(t, F.lit(":"), F.lit(1))).alias("stratum"), prompts.expected_label(F.col("title"), F.col("text")).alias("label"))
    return sampling.balanced(df, "seq", "stratum", "label", TARGETS, KEEP_SHARE)


@query(f"""SELECT seq, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || seq), seq) AS place FROM (SELECT seq, {_prefix} AS stratum FROM articles a WHERE {W0} >= 50 AND seq NOT IN (SELECT seq FROM articles_cleaned)))
WHERE place <= CASE stratum WHEN 'Dungeons' THEN 3 WHEN 'User' THEN 2 WHEN 'Category' THEN 5 ELSE 0 END""")
def prefix_quota_sample(spark, sf):
    t = F.coalesce("title", F.lit(""))
    unseen = joins.to_do(articles(spark, sf).where(F.coalesce("word_count", F.lit(0)) >= 50), cleaned(spark, sf), "seq")
    df = unseen.select("seq", F.when(t.contains(":"), F.split_part(t, F.lit(":"), F.lit(1))).alias("stratum"))
    return sampling.quota_per_group(df, "seq", "stratum", {"Dungeons": 3, "User": 2, "Category": 5}, seed=7)


@query("SELECT 'test_5' AS mode, seq FROM (SELECT seq FROM articles ORDER BY md5('42:' || seq), seq LIMIT 5) UNION ALL SELECT 'sample_50', seq FROM (SELECT seq FROM articles ORDER BY seq LIMIT 50) UNION ALL SELECT 'single:7', seq FROM articles WHERE seq = 7")
def mode_subsets(spark, sf):
    df = articles(spark, sf).select("seq")
    parts = [sampling.subset(df, "seq", m).select(F.lit(m).alias("mode"), "seq") for m in ("test_5", "sample_50", "single:7")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_n = "(SELECT count(*) FROM general_corpus WHERE {0} <> '')".format(S.strip("text"))
_m = "(SELECT count(*) FROM articles WHERE {0} <> '')".format(S.strip("concat_ws(chr(10), nullif(title, ''), nullif(text, ''))"))
_total = f"greatest(floor({_n} / 0.7::DOUBLE), floor({_m} / 0.2::DOUBLE))"


@query(f"SELECT 'general' AS part, floor({_total} * 0.7::DOUBLE)::BIGINT AS n UNION ALL SELECT 'special', floor({_total} * 0.2::DOUBLE)::BIGINT UNION ALL SELECT 'oversample', floor({_total} * 0.1::DOUBLE)::BIGINT")
def ratio_mix_counts(spark, sf):
    g = general(spark, sf).where(qa.plain_text(None, F.col("text")) != "").select(F.col("text_id").alias("key"))
    m = articles(spark, sf).where(qa.plain_text(F.col("title"), F.col("text")) != "").select(F.col("seq").alias("key"))
    return sampling.ratio_mix(g, m, "key").groupBy("part").agg(F.count("*").alias("n"))


# ---- near duplicates ----

_w = f"list_filter(regexp_split_to_array(lower({S.strip('text')}), {S.q(S.GAP + '+')}), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT seq, {_w} AS w FROM articles WHERE text IS NOT NULL), s AS (SELECT seq, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 10),
c AS (SELECT min(seq) AS k, s FROM s GROUP BY s), g AS (SELECT k, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, c::DOUBLE / (na + nb - c) AS jaccard FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8""")
def exact_jaccard_pairs(spark, sf):
    return dedup.exact_pairs(articles(spark, sf), "seq", "text", 0.8)


@query()
def minhash_lsh_dups(spark, sf):
    return dedup.first_wins(articles(spark, sf), "seq", "text")


@query()
def dedup_greedy(spark, sf):
    """First rows win, candidates checked exactly; wide bands so that next to no pair at the threshold is missed."""
    return dedup.first_wins(articles(spark, sf), "seq", "text", verify=True, bands=32, rows=4)


# ---- pairs and prompts ----

_paras = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: length(x) > 50)"
_asked = ", ".join(f"CASE WHEN contains(lower(text), {S.q(k)}) AND len(list_filter(p, lambda x: contains(lower(x), {S.q(k)}))) > 0 THEN {{'i': {S.q(v.split('{}')[0])} || title || {S.q(v.split('{}')[1])}, 'o': list_filter(p, lambda x: contains(lower(x), {S.q(k)}))[1]}} END" for k, v in R.QUESTIONS.items())


@query(f"""SELECT seq, q.i AS instruction, '' AS input, q.o AS output, 'heuristic_qa' AS source FROM (SELECT seq, unnest(list_filter([{{'i': 'What is ' || title || ' in Minecraft?', 'o': p[1]}},
CASE WHEN len(p) > 1 THEN {{'i': 'Tell me everything about ' || title || ' in Minecraft.', 'o': array_to_string(p[1:3], chr(10))}} END, {_asked}], lambda x: x IS NOT NULL)) AS q
FROM (SELECT seq, title, text, {_paras} AS p FROM articles WHERE title <> '' AND text <> '') WHERE len(p) > 0)""")
def heuristic_qa(spark, sf):
    return qa.heuristic_pairs(articles(spark, sf))


@query(f"""SELECT seq, 'How do I craft or obtain ' || title || ' in Minecraft?' AS instruction, '' AS input, {S.strip('line')} AS output, 'wiki_crafting' AS source, title AS article
FROM (SELECT seq, title, unnest(string_split(text, chr(10))) AS line FROM articles) WHERE {S.contains('lower(line)', R.CRAFTING_WORDS)} AND length(line) > 30""")
def crafting_qa(spark, sf):
    return qa.crafting_pairs(articles(spark, sf))


@query("""SELECT pair_id, '### Instruction:' || chr(10) || instruction || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || input ELSE '' END || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text FROM qa_pairs""")
def instruction_format(spark, sf):
    return pairs(spark, sf).select("pair_id", qa.training_text(F.col("instruction"), F.col("output"), F.col("input")).alias("text"))


@query(f"SELECT seq, {S.strip('concat_ws(chr(10), nullif(title, chr(32)[2:]), nullif(text, chr(32)[2:]))')} AS text FROM articles")
def plain_texts(spark, sf):
    return articles(spark, sf).select("seq", qa.plain_text(F.col("title"), F.col("text")).alias("text"))


_head = "CASE WHEN {w} > 60 THEN array_to_string({l}[1:60], ' ') || '{m}' ELSE {t} END"
_hat = "(?i)^(?:" + "|".join(R.HATNOTES) + ")$"
_hatless = f"array_to_string(l[coalesce(list_min(list_filter(list_transform(l, lambda x, i: CASE WHEN NOT regexp_matches({S.strip('x')}, {S.q(_hat)}) THEN i END), lambda i: i IS NOT NULL)), len(l) + 1):], chr(10))"


@query(f"SELECT seq, 'Header' || chr(10) || chr(10) || 'Task' || chr(10) || chr(10) || 'Title: ' || {T0} || chr(10) || 'Categories: ' || CASE WHEN len(coalesce(categories, [])) > 0 THEN array_to_string(categories, ', ') ELSE '(none)' END || chr(10) || 'Lens: Mobs' || chr(10) || chr(10) || {_head.format(w=S.n_words('coalesce(text, chr(32)[2:])'), l=S.words('coalesce(text, chr(32)[2:])'), m=' [...]', t='coalesce(text, chr(32)[2:])')} AS prompt FROM articles")
def prompt_texts(spark, sf):
    return articles(spark, sf).select("seq", prompts.prompt("Header", "Task", F.col("title"), F.col("categories"), F.lit("Mobs"), F.col("text"), 60).alias("prompt"))


@query(f"SELECT seq, {_head.format(w=S.n_words('x'), l=S.words('x'), m='', t='x')} AS text FROM (SELECT seq, {_hatless} AS x FROM (SELECT seq, string_split('Note:' || chr(10) || ' ' || chr(10) || text, chr(10)) AS l FROM articles))")
def prepared_inputs(spark, sf):
    return articles(spark, sf).select("seq", F.concat(F.lit("Note:\n \n"), "text").alias("t")).select("seq", prompts.prepared_input(F.col("t"), 60).alias("text"))


_reply = "CASE pair_id % 5 WHEN 0 THEN 'KEEP: ' || output WHEN 1 THEN 'discard — ' || output WHEN 2 THEN 'I would say DISCARD, not KEEP' WHEN 3 THEN 'Label is KEEP' || chr(10) || output ELSE output END"


def _replies(spark, sf) -> DataFrame:
    n, o = F.col("pair_id") % 5, F.col("output")
    reply = F.when(n == 0, F.concat(F.lit("KEEP: "), o)).when(n == 1, F.concat(F.lit("discard — "), o)).when(n == 2, "I would say DISCARD, not KEEP").when(n == 3, F.concat(F.lit("Label is KEEP\n"), o)).otherwise(o)
    return pairs(spark, sf).where("output is not null").select("pair_id", reply.alias("reply"))


_r = S.strip("reply")
_said = lambda c: f"regexp_extract({_r}, {S.q('(?is)^' + c + chr(92) + 's*[:—' + chr(92) + '-–]' + chr(92) + 's*(.+)')}, 1)"
_rest = lambda c, at: S.strip(f"split_part({S.rep(S.strip(f'substr({_r}, {at} + {len(c)})'), '^[:—' + chr(92) + '-–]+')}, chr(10), 1)")
_at = {c: f"strpos(upper({_r}), '{c}')" for c in ("KEEP", "DISCARD")}
_won = f"CASE WHEN {_at['KEEP']} > 0 AND ({_at['DISCARD']} = 0 OR {_at['KEEP']} < {_at['DISCARD']}) THEN 'KEEP' WHEN {_at['DISCARD']} > 0 THEN 'DISCARD' END"


@query(f"""SELECT pair_id, CASE WHEN {_said('KEEP')} <> '' THEN 'KEEP' WHEN {_said('DISCARD')} <> '' THEN 'DISCARD' ELSE coalesce({_won}, 'UNPARSEABLE') END AS label,
CASE WHEN {_said('KEEP')} <> '' THEN {S.strip(f"split_part({S.strip(_said('KEEP'))}, chr(10), 1)")} WHEN {_said('DISCARD')} <> '' THEN {S.strip(f"split_part({S.strip(_said('DISCARD'))}, chr(10), 1)")}
WHEN {_won} = 'KEEP' THEN {_rest('KEEP', _at['KEEP'])} WHEN {_won} = 'DISCARD' THEN {_rest('DISCARD', _at['DISCARD'])} ELSE substr({_r}, 1, 100) END AS reason
FROM (SELECT pair_id, {_reply} AS reply FROM qa_pairs WHERE output IS NOT NULL)""")
def parsed_replies(spark, sf):
    return prompts.classified_replies(_replies(spark, sf), ["KEEP", "DISCARD"]).select("pair_id", "label", "reason")


@query(f"""SELECT count(*) FILTER (e <> 'UNKNOWN' AND e = a) AS correct, count(*) FILTER (e <> 'UNKNOWN') AS total, CASE WHEN count(*) FILTER (e <> 'UNKNOWN') > 0 THEN count(*) FILTER (e <> 'UNKNOWN' AND e = a) * 100.0::DOUBLE / count(*) FILTER (e <> 'UNKNOWN') ELSE 0.0 END AS pct
FROM (SELECT {LABEL} AS e, {STRICT} AS a FROM articles)""")
def eval_accuracy(spark, sf):
    t, x = F.col("title"), F.col("text")
    return prompts.accuracy(articles(spark, sf).select(prompts.expected_label(t, x).alias("e"), prompts.expected_label_strict(t, x).alias("a")), "e", "a")


@query("SELECT pair_id, instruction AS instruction, '' AS input, output AS output, 'ai_generated' AS source, article FROM qa_pairs WHERE instruction IS NOT NULL AND output IS NOT NULL")
def json_reply_pairs(spark, sf):
    made = F.to_json(F.array(F.struct(F.col("instruction").alias("q"), F.col("output").alias("a"))))
    df = pairs(spark, sf).where("instruction is not null and output is not null").select("pair_id", "article", F.concat(F.lit("Sure:\n"), made, F.lit("\nDone.")).alias("reply"))
    return qa.pairs_from_reply(df, "pair_id", "reply", "article")


@query("SELECT pair_id, 0 AS pos, instruction AS question, output AS answer FROM qa_pairs WHERE regexp_matches(instruction, '^[^\\n\\r]+$') AND regexp_matches(output, '^[^\\n\\r]+$')")
def protocol_pairs(spark, sf):
    line = lambda c: F.col(c).rlike(r"^[^\n\r]+\z")
    df = pairs(spark, sf).where(line("instruction") & line("output")).select("pair_id", F.concat(F.lit("Q: "), "instruction", F.lit("\nA: "), "output", F.lit("\n")).alias("reply"))
    return qa.pairs_from_protocol(df, "pair_id", "reply")


@query()
def normalized_replies(spark, sf):
    reply = F.concat(F.lit("**"), F.coalesce("title", F.lit("X")), F.lit("**\n\n**Overview**\n"), F.coalesce("text", F.lit("")), F.lit("\n## Properties\n- **Health Points**: 32 HP × 16\n- **Tameable**: No\n**Drops**\nbones"))
    df = replies.normalized_replies(spread(articles(spark, sf)).select("seq", "title", reply.alias("reply")), "reply", "title", "r")
    return df.select("seq", "r.text", "r.title", "r.format", F.array_join("r.warnings", "|").alias("warnings"))


@query("SELECT pair_id, upper(instruction) AS reply FROM qa_pairs WHERE instruction IS NOT NULL")
def batch_generation(spark, sf):
    """A batch run with a stand-in for the generator."""
    return prompts.generated(pairs(spark, sf).where("instruction is not null"), "pair_id", "instruction", _upper).select("pair_id", "reply")


def _upper(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


# ---- tokens and numbers ----

_tok = f"list_transform({S.words('text')}, lambda x: length(x))"


@query(f"""WITH t AS (SELECT doc_id, list_append({_tok}, 3) AS t FROM documents WHERE {S.n_words('text')} > 0), f AS (SELECT flatten(list(t ORDER BY doc_id)) AS f FROM t),
c AS (SELECT f, unnest(range(0, ((len(f) - 1) // 64)::BIGINT)) AS chunk FROM f)
SELECT chunk, array_to_string(f[chunk * 64 + 1:chunk * 64 + 64], ' ') AS x, array_to_string(f[chunk * 64 + 2:chunk * 64 + 65], ' ') AS y FROM c""")
def pack_chunks(spark, sf):
    df = documents(spark, sf).select("doc_id", tokens.word_length_tokens(F.col("text")).alias("t"))
    out = tokens.packed(df, "doc_id", "t", 64)
    return out.select("chunk", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"""SELECT pair_id, array_to_string(list_concat(t, list_transform(range(65 - len(t)), lambda i: 0))[1:64], ' ') AS x, array_to_string(list_concat(t, list_transform(range(65 - len(t)), lambda i: 0))[2:65], ' ') AS y
FROM (SELECT pair_id, {_tok.replace('text', 'output')} AS t FROM qa_pairs) WHERE len(t) BETWEEN 1 AND 64""")
def pad_sequences(spark, sf):
    df = pairs(spark, sf).select("pair_id", tokens.word_length_tokens(F.col("output")).alias("t"))
    return tokens.padded(df, "pair_id", "t", 64).select("pair_id", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS word FROM general_corpus) GROUP BY word")
def vocabulary_counts(spark, sf):
    return tokens.word_counts(general(spark, sf), "text")


@query()
def bpe_coverage(spark, sf):
    """How many of the corpus's long words a vocabulary learned from it holds whole."""
    merges = tokens.merges_of(general(spark, sf), "text", 300)
    listed = tokens.long_words(general(spark, sf), "text", 6).select(F.col("token").alias("word"))
    return tokens.coverage(tokens.encoded(listed, "word", "word", merges), "word", "ids")


@query()
def joined_word_splits(spark, sf):
    known = "the of in a player block ore with and hill side work shop bench drop hawk moth glass stone".split()
    return tokens.splits(tokens.long_words(documents(spark, sf), "text", 6), "token", known).where("auto_split is not null")


_e = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""SELECT vec_id, list_position(e, list_max(e)) - 1 AS best, round(list_max(p), 9) AS p_best, round(list_sum(list_sort(p, 'DESC')[1:5]), 9) AS p_top5 FROM (SELECT *, list_transform(z, lambda x: x / list_sum(z)) AS p
FROM (SELECT *, list_transform(e, lambda x: exp((x - list_max(e)) / 0.5)) AS z FROM (SELECT vec_id, {_e} AS e FROM embeddings)))""")
def softmax_topk(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    p = embeddings(spark, sf).select("vec_id", e.alias("e")).withColumn("p", N.softmax(F.col("e"), 0.5))
    top5 = F.aggregate(F.slice(F.sort_array("p", asc=False), 1, 5), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", N.argmax(F.col("e")).cast("long").alias("best"), F.round(F.array_max("p"), 9).alias("p_best"), F.round(top5, 9).alias("p_top5"))


@query(f"""SELECT vec_id, len(list_filter(e, lambda x: x >= list_sort(e, 'DESC')[10]))::BIGINT AS kept, round(ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) - (e[label % 64 + 1] - list_max(e)), 9) AS loss
FROM (SELECT vec_id, label, {_e} AS e FROM embeddings)""")
def topk_and_loss(spark, sf):
    e = embeddings(spark, sf).select("vec_id", (F.col("label") % 64).alias("l"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    kept = F.size(F.filter(N.top_k(F.col("e"), 10), lambda x: x.isNotNull()))
    return e.select("vec_id", kept.cast("long").alias("kept"), F.round(N.cross_entropy(F.col("e"), F.col("l")), 9).alias("loss"))


@query("SELECT event_id, round(CASE WHEN s < 100 THEN 0.001 * s / 100 WHEN s >= 5000 THEN 0.0001 ELSE 0.001 * 0.5 * (1.0 + cos(pi() * (s - 100) / 4900.0)) END, 12) AS lr FROM (SELECT event_id, event_id % 6000 AS s FROM events)")
def lr_schedule(spark, sf):
    return event_table(spark, sf).select("event_id", F.round(N.learning_rate(F.col("event_id") % 6000, 100, 5000, 0.001), 12).alias("lr"))


@query(f"SELECT title, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS title FROM articles WHERE {W0} >= 10) GROUP BY 1 ORDER BY n DESC, title LIMIT 50")
def most_common(spark, sf):
    w = articles(spark, sf).where(F.coalesce("word_count", F.lit(0)) >= 10).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("title"))
    return w.groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(50)




# ---- more of the catalogue, sources and sinks ----


@query(f"""SELECT coalesce(CASE WHEN coalesce(trim(title), '') = '' THEN 'no title' WHEN NOT coalesce(excl_action IN {S.tup(events.ACTIONS)}, false) THEN 'unknown action'
WHEN NOT coalesce(excl_scope IN {S.tup(events.SCOPES)}, false) THEN 'unknown scope' WHEN excl_scope = 'this_lens' AND coalesce(trim(bucket_lens), '') = '' THEN 'no lens' END, 'fine') AS problem, count(*) AS n FROM exclusion_log GROUP BY 1""")
def event_problems(spark, sf):
    return events.validated(log(spark, sf)).groupBy(F.coalesce("problem", F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT event_type, min(value) AS least, max(value) AS most, list_sort(list(value))[count(value) // 2 + 1] AS middle FROM events WHERE value IS NOT NULL GROUP BY event_type")
def value_spread(spark, sf):
    return events.spread_of(event_table(spark, sf), "event_type", "value")


_parent_case = "CASE lens " + " ".join(f"WHEN {S.q(k)} THEN {S.ql(v)}" for k, v in R.PARENTS.items()) + " END"


@query(f"""WITH m AS (SELECT DISTINCT seq, unnest(categories) AS lens FROM articles), u AS (SELECT DISTINCT seq, unnest({_parent_case}) AS lens FROM m)
SELECT lens, count(*) AS n FROM m WHERE lens IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.seq = m.seq AND u.lens = m.lens) GROUP BY lens""")
def lenses_without_parents(spark, sf):
    members = articles(spark, sf).select("seq", F.explode("categories").alias("lens")).where("lens is not null").distinct()
    return joins.without_parent_lenses(members, "seq", "lens", R.PARENTS).groupBy("lens").agg(F.count("*").alias("n"))


@query(f"""SELECT '[' || left(source, 3) || '] ' || title AS title, coalesce(n_chars, 0) AS word_count, coalesce(CASE WHEN doc_id % 3 = 0 THEN fetched_at::DATE END, CASE WHEN doc_id % 3 = 1 THEN DATE '2009-05-22' END, fetched_at::DATE) AS stamp FROM documents WHERE title IS NOT NULL AND source IS NOT NULL""")
def external_entries(spark, sf):
    d = documents(spark, sf).where("title is not null and source is not null")
    ext = d.select("title", F.substring("source", 1, 3).alias("prefix"), F.col("n_chars").cast("int").alias("word_count"), "source", F.when(F.col("doc_id") % 3 == 0, F.col("fetched_at")).alias("post_date"), F.when(F.col("doc_id") % 3 == 1, F.lit("20090522101010")).alias("snapshot"), F.col("fetched_at").alias("scraped_at"))
    return catalog.catalogue(articles(spark, sf), external=ext).where("source = 'external'").select("title", F.col("word_count").cast("long").alias("word_count"), "stamp")


@query(f"""WITH {LENSES}, c AS (SELECT title, max_by(word_count, seq) AS n FROM (SELECT title, seq, coalesce(word_count, 0) AS word_count FROM articles_cleaned) WHERE title IS NOT NULL GROUP BY title)
SELECT title, abs({W0} - coalesce(n, 0)) AS delta FROM classified LEFT JOIN c USING (title) WHERE {TIER} <> '<10' ORDER BY delta DESC, title LIMIT 40""")
def listing_most_changed(spark, sf):
    clean = joins.last_wins(cleaned(spark, sf).select("title", "seq", F.coalesce("word_count", F.lit(0)).alias("n")), "title", "seq")
    cat = _catalogue(spark, sf).join(clean.select("title", "n"), "title", "left").withColumn("delta", F.abs(F.col("word_count") - F.coalesce("n", F.lit(0))))
    return catalog.listing(cat, sort="delta", limit=40).select("title", "delta")


@query(f"SELECT count(*) AS n FROM general_corpus WHERE length(trim(text)) >= 50")
def hub_rows(spark, sf):
    from corvane.sources.jsonl import capped

    return capped(general(spark, sf), "text").agg(F.count("*").alias("n"))


@query("SELECT seq, title, array_to_string(categories, '|') AS categories, word_count FROM articles")
def json_round_trip(spark, sf):
    """The table written as JSON lines and read again with its schema, every line strictly."""
    import uuid

    from corvane.session import shared_dir
    from corvane.sources.jsonl import read_strict
    from corvane.sources.sinks import overwrite

    df = articles(spark, sf).select("seq", "title", "categories", "word_count")
    path = f"{shared_dir(spark)}/corvane-json-{uuid.uuid4().hex[:8]}"
    overwrite(df, path)
    return read_strict(spark, path, df.schema).select("seq", "title", F.array_join("categories", "|").alias("categories"), "word_count")


@query(f"SELECT coalesce({REASON}, 'keep') AS route, count(*) AS n FROM articles GROUP BY 1")
def routed_sink(spark, sf):
    """Rows written by route in one pass and counted as they lie."""
    import uuid

    from corvane.session import shared_dir
    from corvane.sources.sinks import routed

    df = articles(spark, sf).select("seq", "title", "text", F.coalesce(article_reason(F.col("title"), F.col("text"), F.col("word_count")), F.lit("keep")).alias("route"))
    path = f"{shared_dir(spark)}/corvane-routes-{uuid.uuid4().hex[:8]}"
    routed(df, "route", path)
    return spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n"))


@query()
def html_classes(spark, sf):
    from corvane.functions.html import class_counts

    markup = F.concat(F.lit('<div class="page '), F.coalesce("source", F.lit("none")), F.lit('"><p class=text>'), F.coalesce("text", F.lit("")))
    return class_counts(documents(spark, sf).select(markup.alias("h")), "h")


@query()
def slug_titles(spark, sf):
    from corvane.functions.text import slug_title

    ship(spark)
    return articles(spark, sf).select("seq", slug_title(F.replace(F.lower("title"), F.lit(" "), F.lit("-"))).alias("title"))


@query(f"""WITH p AS (SELECT vec_id, list_transform(z, lambda x: x / list_sum(z)) AS p FROM (SELECT vec_id, list_transform(e, lambda x: exp((x - list_max(e)) / 0.05)) AS z FROM (SELECT vec_id, {_e} AS e FROM embeddings))),
r AS (SELECT vec_id, list_sort(p, 'DESC') AS r FROM p)
SELECT vec_id, len(list_filter(range(len(r)), lambda i: coalesce(list_sum(r[1:i]), 0.0) <= 0.9))::BIGINT AS kept FROM r""")
def nucleus(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    p = computed_once(computed_once(embeddings(spark, sf), {"e": e}).select("vec_id", "e"), {"p": N.softmax(F.col("e"), 0.05)})
    return N.with_top_p(p, "p", 0.9, "q").select("vec_id", F.size(F.filter("q", lambda x: x > 0)).cast("long").alias("kept"))

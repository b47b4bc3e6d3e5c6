"""Setting and bucket of a page from its title, categories and text; the lenses it belongs to besides; its family and tier.

All tests are native expressions over literal tables; the result is one struct computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.operators import rules as R
from corvane.operators.filters import first_reason, starts_with_any
from corvane.session import computed_once


def has_any(cats: Column, values) -> Column:
    return F.arrays_overlap(cats, F.array(*map(F.lit, values)))


def has(cats: Column, value: str) -> Column:
    return F.array_contains(cats, value)


def slashes(title: Column) -> Column:
    return F.length(title) - F.length(F.replace(title, F.lit("/"), F.lit("")))


def tier(words: Column) -> Column:
    out = F.lit("<10")
    for least, name in R.TIERS:
        out = F.when(words >= least, name).otherwise(out)
    return out


def setting(t: Column, c: Column) -> Column:
    real = F.filter(c, lambda x: ~x.isin(list(R.VERSION_CATEGORIES_IGNORED)))
    versions = F.exists(real, lambda x: x.rlike(R.VERSION_CATEGORY)) | has_any(c, R.VERSION_CATEGORIES)
    circuits = t.startswith("Redstone circuits/")
    modding = has_any(c, R.MODDING_CATEGORIES) & ((t == "Mod") | t.startswith("Mods/"))
    return F.coalesce(first_reason([
        (starts_with_any(t, R.SPINOFF_TITLES), "spinoff"),
        (has_any(c, R.APRIL_FOOLS_CATEGORIES) | t.rlike("(?iu)" + R.APRIL_FOOLS_TITLE), "april_fools"),
        (has_any(c, R.EDUCATION_CATEGORIES), "education_edition"),
        (starts_with_any(t, R.META_TITLES) | has_any(c, R.META_PAGE_CATEGORIES), "wiki_meta"),
        (starts_with_any(t, R.TUTORIAL_TITLES) | has_any(c, R.TUTORIAL_CATEGORIES) | t.isin(list(R.TUTORIAL_PAGES)) | (circuits & (slashes(t) == 1)) | modding, "tutorial"),
        (versions, "versions"),
        (t.startswith("Movie:") | has_any(c, R.MEDIA_CATEGORIES) | F.exists(c, lambda x: x.endswith("_chapters")), "media_franchise"),
        (has_any(c, R.REAL_WORLD_CATEGORIES) | (has_any(c, R.HISTORY_CATEGORIES) & ~has_any(c, R.VANILLA_CATEGORIES)), "real_world"),
        (circuits & (slashes(t) >= 2), "wiki_meta"),
    ]), F.lit("game_vanilla"))


def is_meta(x: Column) -> Column:
    return x.rlike("|".join(R.META_CATEGORIES))


def first_of(cats: Column, ordered) -> Column:
    """The first of ordered that stands in cats, else null."""
    return F.get(F.filter(F.array(*map(F.lit, ordered)), lambda p: F.array_contains(cats, p)), F.lit(0))


def vanilla_bucket(t: Column, c: Column, text: Column) -> Column:
    low = F.lower(t)
    by_title = first_reason([
        (t.startswith("Crafting/") | (t.startswith("Banner/") & (low.contains("crafting") | low.contains("pattern"))), "Crafting_recipes"),
        (t.endswith("/Structure"), "Structure_subpages"),
        (t.endswith("/BS"), "Block_states_reference"),
        (t.startswith("List of "), "Lists"),
        (t.contains("/Before "), "Mechanic_history"),
        (t.startswith("Redstone ") & has(c, "Redstone") & ~has(c, "Ore"), "Redstone_mechanics"),
        (t.isin(list(R.EDITION_TITLES)), "Edition_overview"),
        (starts_with_any(t, R.TECHNICAL_TITLES), "Java_Edition_technical"),
        (F.coalesce(F.lower(F.substring(text, 1, 300)).contains("disambiguation page"), F.lit(False)), "Disambiguation_pages"),
    ])
    late = first_reason([
        (t.isin(list(R.MECHANIC_TITLES)) | t.startswith("Hitbox/"), "Game_mechanics"),
        (t.isin(list(R.MENU_TITLES)), "Menu_screens"),
    ])
    any_left = F.get(F.filter(c, lambda x: ~is_meta(x) & ~x.isin(list(R.EDITION_TAGS))), F.lit(0))
    return F.coalesce(by_title, first_of(c, R.PRIORITY), late, any_left, F.lit("Other"))


def other_bucket(t: Column, c: Column, where: Column) -> Column:
    """Buckets of all settings but the vanilla one."""
    spinoff = first_reason([
        (t.startswith("Dungeons:") | t.startswith("MCD:"), "Minecraft_Dungeons"), (t.startswith("Legends:"), "Minecraft_Legends"),
        (t.startswith("Earth:") | t.startswith("Minecraft Earth:"), "Minecraft_Earth"), (t.startswith("Story Mode:"), "Minecraft_Story_Mode"),
    ])
    jokes = F.coalesce(first_of(c, ("Joke_blocks", "Joke_items", "Joke_mobs", "Joke_entities", "Joke_biomes", "Joke_effects", "Joke_dimensions", "Joke_features", "April_Fools'", "April_Fools")), F.lit("April_Fools_other"))
    education = F.coalesce(first_reason([
        (has(c, "MinecraftEdu_blocks"), "MinecraftEdu_blocks"), (has(c, "MinecraftEdu_items"), "MinecraftEdu_items"),
        (has(c, "Chemistry_Resource_Pack"), "Chemistry"), (has_any(c, ("MinecraftEdu", "MinecraftEdu_features")), "MinecraftEdu_features"),
    ]), F.lit("Minecraft_Education_features"))
    tutorial = F.coalesce(first_reason([
        (has(c, "Java_Edition_guides"), "Java_Edition_guides"), (has(c, "Bedrock_Edition_guides"), "Bedrock_Edition_guides"),
        (t.isin(list(R.TUTORIAL_PAGES)) | t.startswith("Redstone circuits/"), "Redstone_tutorials"), (t.startswith("Tutorial:Programs"), "Software_tutorials"),
    ]), F.lit("Tutorials"))
    media = F.coalesce(first_reason([
        (t.startswith("Movie:") | F.exists(c, lambda x: x.startswith("A_Minecraft_Movie")), "A_Minecraft_Movie"),
        (F.exists(c, lambda x: x.startswith("Minecraft_Mini-Series")), "Mini_Series"),
        (has_any(c, ("Minecraft_(Dark_Horse_Comics)_series", "Comic_books")), "Comics"),
        (has_any(c, ("Books", "Fiction", "Nick_Eliopulos_novels", "Max_Brooks_novels", "Meta_novels", "Science_fiction")), "Books"),
        (has(c, "Animated_content"), "Animated_shorts"), (has(c, "Live_action_content"), "Live_action"), (has_any(c, ("Adventure_maps", "Maps")), "Maps"),
        (has(c, "Game_trailers"), "Trailers"), (F.exists(c, lambda x: x.endswith("_chapters")), "Book_chapters"), (has(c, "Online_content"), "Online_content"),
        (has(c, "Editorials"), "Editorials"), (has(c, "Minecraft_(franchise)"), "Franchise_meta"),
    ]), F.lit("Media_other"))
    company = t.isin(list(R.COMPANY_TITLES))
    real = F.coalesce(first_reason([
        (has_any(c, R.PEOPLE), "People"), (has(c, "Mojang_Studios") & ~company, "People"), (company, "Companies"), (has_any(c, R.EVENTS), "Events"),
        (has_any(c, R.HISTORY_CATEGORIES), "History"), (has_any(c, R.COMPANIES), "Companies"), (has_any(c, R.COMMUNITY), "Community_business"),
    ]), F.lit("Real_world_other"))
    versions = F.coalesce(F.get(F.filter(c, lambda x: x.endswith("_versions") & ~x.isin(list(R.EDITION_TAGS))), F.lit(0)), F.when(has(c, "Lost_versions"), "Lost_versions"), F.lit("Versions"))
    meta = F.coalesce(first_reason([
        (t.startswith("File:"), "Files"), (t.startswith("Template:"), "Templates"), (t.startswith("Help:"), "Help_pages"),
        (t.startswith("Minecraft Wiki:"), "Wiki_self_reference"), (has(c, "Soft_redirects"), "Redirects"),
        (t.startswith("Redstone circuits/") & (slashes(t) >= 2), "Redstone_schemas"),
    ]), F.lit("Wiki_meta_other"))
    out = F.when(where == "spinoff", F.coalesce(spinoff, F.lit("Spinoff_other"))).when(where == "april_fools", jokes).when(where == "education_edition", education)
    return out.when(where == "tutorial", tutorial).when(where == "media_franchise", media).when(where == "real_world", real).when(where == "versions", versions).when(where == "wiki_meta", meta)


def family(where: Column, bucket: Column) -> Column:
    out = F.lit("none")
    for name, members in R.FAMILIES.items():
        out = F.when(bucket.isin(list(members)), name).otherwise(out)
    for s, name in R.SETTING_FAMILIES.items():
        out = F.when(where == s, name).otherwise(out)
    return out


def parents(bucket: Column) -> Column:
    """The broader categories a bucket implies; empty where there are none."""
    table = F.create_map(*[x for k, v in R.PARENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, bucket), F.array().cast("array<string>"))


def classified(df: DataFrame, title: str = "title", categories: str = "categories", text: str = "text") -> DataFrame:
    """df with setting, bucket, group, also_in and family. Null titles and categories count as empty, null entries are left out."""
    t = F.coalesce(F.col(title), F.lit(""))
    c = F.filter(F.coalesce(F.col(categories), F.array().cast("array<string>")), lambda x: x.isNotNull())
    out = computed_once(df, {"__t": t, "__c": c})
    t, c = F.col("__t"), F.col("__c")
    out = computed_once(out, {"setting": setting(t, c)})
    out = computed_once(out, {"bucket": F.when(F.col("setting") == "game_vanilla", vanilla_bucket(t, c, F.col(text))).otherwise(other_bucket(t, c, F.col("setting")))})
    up = parents(F.col("bucket"))
    lenses = F.array_distinct(F.filter(c, lambda x: (x != F.col("bucket")) & ~F.array_contains(up, x) & ~is_meta(x) & ~x.isin(list(R.EDITION_TAGS))))
    group = F.when(F.col("setting") == "game_vanilla", F.col("bucket")).otherwise(F.concat_ws("::", "setting", "bucket"))
    return computed_once(out, {"group": group, "also_in": lenses, "family": family(F.col("setting"), F.col("bucket"))}).drop("__t", "__c")

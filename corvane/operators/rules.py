"""Rule tables as data. The values are fixed: they must equal those of the corpus format they were made for."""

from __future__ import annotations

# Markers of index pages, looked for in the first 500 characters.
INDEX_PAGE_MARKERS = (
    "This disambiguation page lists articles associated with the same title",
    "This disambiguation page lists articles associated with the same version number",
    "This disambiguation page lists achievements and advancements",
    "This is an index of related pages",
)
# Fixed value: titles that are nothing but a version number.
VERSION_TITLE = r"^(\d+(\.\d+)+[a-z0-9_\-]*|\d{6,8}|0\.\d+[a-z0-9_\-]*|[ab]\d[\d.a-z_\-]*)$"
# Change-log titles as the cleaner and as the harvester know them.
CHANGELOG_TITLE = r"^(Java Edition|Bedrock Edition|Pocket Edition|Legacy Console Edition)\s+[\d\w.]"
CHANGELOG_TITLE_STRICT = r"^(Java Edition|Bedrock Edition|Pocket Edition|Legacy Console Edition)\s+[\d.]"
# Posting programs whose texts are left out.
POSTING_PROGRAMS = (
    "[deleted]", "AutoModerator", "RemindMeBot", "WikiTextBot", "SaveVideo", "Sneakpeekbot", "RepostSleuthBot", "GifReversingBot", "haikusbot",
    "sub_doesnt_exist_bot", "LinkifyBot", "HelperBot_", "TotesMessenger", "BotDefense", "B0tRank", "DownloadVideo", "savevideobot", "VideoTrim",
)
# Lines of a blog's page that belong to no post.
BLOG_NOISE = (
    "← last post", "next post →", "Archive", "Random Post", "tumblrist", "theme", "by", "topherchris", ".", "powered by", "Tumblr",
    "Opinions, rants, screenshots and demos from an up and coming indie game developer.",
)
# Words that a vocabulary should hold as one token each.
WORDS_TO_COVER = (
    "Creeper", "Enderman", "Zombie", "Skeleton", "Spider", "Blaze", "Ghast", "Wither", "Ender", "Piglin", "Villager", "Pillager", "Ravager", "Phantom", "Drowned", "Husk", "Stray",
    "Warden", "Allay", "Sniffer", "Breeze", "Bogged", "Redstone", "Netherite", "Obsidian", "Bedrock", "Glowstone", "Deepslate", "Amethyst", "Terracotta", "Prismarine", "Purpur",
    "Shulker", "Sculk", "Dripstone", "Tuff", "Calcite", "Elytra", "Trident", "Totem", "Ender Pearl", "Nether", "Overworld", "biome", "Savanna", "Taiga", "Badlands", "Mangrove",
    "crafting", "smelting", "enchanting", "brewing", "smithing", "spawner", "hopper", "piston", "comparator", "repeater", "Stronghold", "Mineshaft", "Bastion", "Fortress",
)
# Titles of pages on other games.
SPINOFF_PREFIXES = ("Dungeons:", "Legends:", "Earth:", "Story Mode:", "MCD:")

# Maintenance phrases removed wherever they stand, case ignored.
BOILERPLATE = (
    r"This template is used to categorize the article\.",
    r"This article is a stub\s*\.",
    r"This tutorial page is a stub\s*\.",
    r"This tutorial page is a work in progress\.",
    r"This article is a work in progress\.",
    r"This section is a work in progress\.",
    r"You can help by expanding it\s*\.",
    r"The talk page may contain suggestions\.",
    r"Please help expand and improve it\s*\.",
    r"Please help improve this page\.",
    r"Please expand the (section|article) to include this information\.",
    r"Further details may exist on the talk page\s*\.",
    r"This section of the article is empty\.",
    r"This section needs expansion\.",
    r"This (section|article) needs to be updated\.",
    r"Please update this (section|article) to reflect recent updates or newly available information\.",
    r"This section is missing information about:",
    r"This list is incomplete\s*;\s*you can help by expanding it\s*\.",
    r"This (article|tutorial page) needs cleanup to comply with the style guide\s*\.\s*\[\s*discuss\s*\]",
    r"This (article|section) would benefit from the addition of more images\.",
    r"Please remove this notice once you have added suitable images to the (article|section)\.",
    r"This (article|section) would benefit from the addition of isometric renders\s*\.",
    r"Please remove this notice once you have added suitable isometric renders to the (article|section)\.",
    r"This (article|section) would benefit from the addition of more sounds\.",
    r"Please remove this notice once you have added suitable sounds to the (article|section)\.",
    r"Instructions: Needs images and fill empty sections\.",
    r"This article is a (Java Edition|Bedrock Edition|Legacy Console Edition) (block|item|entity|mob) (render|texture) history subpage\.",
    r"This article is a texture history subpage\.",
    r"This article is a dynamic list\s*\.",
    r"Its subject matter requires frequent updates to remain current and complete[^.]*\.",
    r"This disambiguation page lists articles associated with the same (title|version number)\.\s*If an internal link led you here, you may wish to change the link to point directly to the intended article\.",
    r"This disambiguation page lists achievements and advancements associated with the same title\.\s*If an internal link led you here[^.]*\.",
    r"This is an index of related pages that share a common conceptual attribute\.\s*Unlike disambiguation pages[^.]*\.",
    r"This version is currently lost\.",
    r"While this version is known to exist, it has not been archived(, and is therefore considered lost| in the launcher or elsewhere, and is therefore considered lost)\s*\.",
    r"If you believe you have a copy of this version, please post it on the talk page\s*\.",
    r"This version does not have an official title\.",
    r"Please update the name if confirmed by reliable sources, such as in the launcher\s*\.",
    r"This topic is named from the game code\.",
    r"This topic is named based on the topic's music track and game code\.",
    r"This topic is named by the community\.",
    r"correct tool, drops the block itself",
    r"correct tool, drops nothing or something other than the block itself",
    r"italicized can be instant mined",
    r"Listed difficulties are considered to be the minimum difficulty the item is obtainable on unless stated otherwise\.",
    r"Tags common to all entities see Template:Nbt inherit/entity/template",
    r"Sounds: Sound, Closed captions, Source, Description, Identifier, Translation key, Volume, Pitch(, Attenuationdistance)?",
    r"Icon, Achievement, In-game description, Actual requirements \(if different\), Gamerscore earned, Trophy type \(PS\)",
)
# Keys of the technical header of a change log.
CHANGELOG_KEYS = (
    "Edition", "Release date", "Type", "Downloads", "Obfuscation maps", "Protocol version", "Data version", "Resource pack format",
    "Data pack format", "Minimum Java version", "Server version", "Internal version", "Version code", "Build version", "Cache ID", "Old ID",
    "Old file name", "Official name", "Snapshot for", "Release Candidate for", "Editor version", "Compilation date",
)
# Line patterns of change logs, removed in this order.
CHANGELOG_LINES = (
    r"^Other editions with a version [^\n]*\n(?:(?:Java Edition|Bedrock Edition|Bedrock Preview|Bedrock Editor|Pocket Edition|Legacy Console Edition|New Nintendo 3DS Edition|Minecraft China|Minecraft Education|Xbox One|Xbox 360|PlayStation\s*(?:3|4|Vita)|Wii U|Nintendo Switch|PS3|PS4|PS Vita)[^\n]*\n)+",
    r"^There is a guide for this update!\s*\n(?:See [^\n]+\n)?",
    r"^This article (documents an April Fools' Day joke version|is about the April Fool's joke snapshot)\.[^\n]*\n",
    r"^There is no proper release version or development version[^\n]*\n",
    r"^Lua error:[^\n]*$",
)

# Section names by what happens to the section. Kept names only end the section before them.
SECTIONS_DROPPED = (
    "Block states", "Fluid states", "Block data", "Entity data", "History", "Data history", "Pre-release history", "Videos", "Gallery", "Renders",
    "Screenshots", "Mojang screenshots", "Mojang images", "Concept artwork", "Storyboards", "Behind-the-scenes", "Promotional images", "Wallpapers",
    "Posters", "In other media", "Filmography", "Discography", "Credits",
)
SECTIONS_CONDITIONAL = ("Issues", "Achievements")
SECTIONS_KEPT = (
    "Overview", "Description", "Appearance", "Lore", "Behavior", "Spawning", "Spawn", "Drops", "Combat", "Strategy", "Variants", "Taming", "Breeding",
    "Riding", "Properties", "Obtaining", "Usage", "Crafting", "Crafting ingredient", "Smelting", "Smelting ingredient", "Smelting fuel", "Trading",
    "Brewing", "Repairing", "Mining", "Sounds", "Data values", "ID", "Generated loot", "Generation", "Structures", "Biomes", "Mobs", "Blocks", "Climate",
    "Colors", "Features", "Vegetation", "Trivia", "See also", "References", "Notes", "External links", "Advancements", "Examples", "Syntax", "Arguments",
    "Output", "Result", "Restrictions", "Permissions", "Plot", "Cast", "Production", "Release", "Reception", "Awards", "Effect", "Effects", "Causes",
    "Levels", "Tools", "Recipes", "Furnace recipes", "Stonecutter recipes", "Smithing", "Stonecutting",
)

# Pages about content that is gone, told by their banner.
DEPRECATION_BANNER = (
    r"This page describes content that has been removed (?:from the game|and was only present in earlier versions)"
    r"|This article (?:is about|describes) the unused\b"
    r"|This article documents a feature that has been officially scrapped"
    r"|This page describes an edition of the game that has been officially discontinued"
    r"|This feature is available only in MinecraftEdu, an edition of the game that has been officially discontinued"
    r"|officially made unobtainable\.(?!\s*in\s)"
)

# Maintenance categories, as patterns.
META_CATEGORIES = (
    r"^Pages_with_", r"^Pages_using_", r"^Pages_needing_", r"^Pages_missing_", r"^Pages_", r"^Articles_to_be_", r"^Articles_with_empty_",
    r"^Articles_needing_", r"^Articles_missing_", r"^Articles_", r"^Minecraft_Work_in_progress", r"^Stubs$", r"^Minecraft_stubs$", r"_stubs$",
    r"^Verify$", r"^Verify_for_", r"^Verify_changelog_", r"^Verify_current_", r"^Check_version$", r"^Check_the_code$", r"^Testing_needed$",
    r"^Cleanup_with_a_reason$", r"^Cleanup_without_a_reason$", r"^Article_cleanup$", r"^Pending_", r"^Pending_split$", r"^Current_split$",
    r"^Missing_discussion_link", r"^Unknown_.*_version_history$", r"^Unknown_version_history$", r"^Information_needed$", r"^Citation_needed$",
    r"^Ajax_loaded_pages$", r"^Featured_articles$", r"^Needs_updating$", r"^CC_BY-SA_pages$", r"^Incomplete_lists$", r"^Asset_history_pages$",
    r"^Technical_block_history_sections$", r"^Blocks_without_map_color$", r"^Missing_blast_resistance$", r"^Missing_stackability$",
    r"^Resources_with_invalid_renewability$", r"^Createable_blocks$", r"^Readable_by_comparators$",
)
EDITION_TAGS = (
    "Bedrock_Edition", "Java_Edition", "Legacy_Console_Edition", "Bedrock_Edition_specific_information", "Java_Edition_specific_information",
    "Renewable_resources", "Stackable_resources", "Non-renewable_resources", "Non-stackable_resources",
)
# Word-count tiers, lower bound and name.
TIERS = ((10, "10-49"), (50, "50-99"), (100, "100-499"), (500, "500-999"), (1000, "1000-4999"), (5000, "5000+"))

# What tells the setting of a page, in the order of the tests.
SPINOFF_TITLES = ("Dungeons:", "MCD:", "Legends:", "Earth:", "Minecraft Earth:", "Story Mode:")
APRIL_FOOLS_CATEGORIES = ("Joke_features", "Joke_blocks", "Joke_items", "Joke_mobs", "Joke_entities", "Joke_biomes", "Joke_effects", "Joke_dimensions", "Joke_block_renders", "April_Fools'", "April_Fools")
APRIL_FOOLS_TITLE = r"\(April Fools'? joke\)|\bApril Fools'?\b"
EDUCATION_CATEGORIES = ("Minecraft_Education", "Minecraft_Education_specific_information", "MinecraftEdu", "MinecraftEdu_blocks", "MinecraftEdu_items", "MinecraftEdu_features", "Education_Edition_exclusive", "Education_Edition_features", "Minecraft_Education_features", "Chemistry_Resource_Pack")
META_TITLES = ("File:", "Template:", "Help:", "Minecraft Wiki:")
META_PAGE_CATEGORIES = ("Files_with_a_license_template", "Mojang_images", "Notice_templates", "Template_styles", "Documentation_pages", "Soft_redirects", "Version_banners", "Minecraft_Wiki")
TUTORIAL_TITLES = ("Tutorial:", "Tutorials/")
TUTORIAL_CATEGORIES = ("Tutorials", "Java_Edition_guides", "Bedrock_Edition_guides")
TUTORIAL_PAGES = ("Redstone circuits", "Redstone components", "Redstone mechanics", "MCRedstoneSim schematics")
MODDING_CATEGORIES = ("Mods", "Mod_loaders", "Mod_managers", "Game_customization")
VERSION_CATEGORY = r".+_(versions|previews|betas|snapshots|development_versions?)$"
VERSION_CATEGORIES = ("Lost_versions", "Versions", "Versions_with_unofficial_names", "Release_timeline_subpages", "Development_version_lists", "Java_Edition_release_timeline", "Bedrock_Edition_release_timeline", "Minecraft_Education_release_timeline", "Named_updates")
VERSION_CATEGORIES_IGNORED = (
    "Unknown_Bedrock_version_history", "Unknown_Java_version_history", "Unknown_Console_version_history", "Unknown_Java_Indev_version_history",
    "Unknown_Java_Beta_version_history", "Unknown_Java_Classic_version_history", "Unknown_Java_Alpha_version_history",
    "Unknown_Pocket_Edition_version_history", "Unknown_MinecraftEdu_version_history", "Unknown_Education_Edition_version_history",
    "Unknown_version_history", "Check_version", "Check_the_code",
)
MEDIA_CATEGORIES = (
    "Minecraft_Mini-Series", "Mini-Series_episodes", "Minecraft_Mini-Series_characters", "Minecraft_Mini-Series_locations", "M.A.R.I.L.L.A._and_Narrator_series",
    "Mob_Squad", "Minecraft:_Mob_Squad_chapters", "A_Minecraft_Movie", "A_Minecraft_Movie_mobs", "A_Minecraft_Movie_characters", "A_Minecraft_Movie_locations",
    "A_Minecraft_Movie_objects", "Comic_books", "Live_action_content", "Animated_content", "Books", "Fiction", "Nick_Eliopulos_novels", "Max_Brooks_novels",
    "Meta_novels", "Adventure_maps", "Game_trailers", "Editorials", "Online_content", "Minecraft_(Dark_Horse_Comics)_series", "Minecraft:_Story_Mode", "Maps",
    "Science_fiction", "Minecraft_(franchise)",
)
PEOPLE = ("Actors", "YouTubers", "Streamers", "Hosts", "Players", "Students", "Mobologists", "Musicians")
EVENTS = ("MINECON", "Minecraft_Live", "Events", "Historical_events", "Live_streams", "Eerie_Mojang_Office_Party", "A_Minecraft_Movie_Live_Event")
COMPANIES = ("Microsoft", "Companies")
COMMUNITY = ("Community", "Collaborations", "Cross-franchise_promotions", "Merchandise", "Discontinued", "Minecraft_Marketplace", "Event_servers", "Minecraft_Blast", "Minecraft_4k", "Mojam_games", "Minecraft_Earth", "Minecraft_Story_Mode", "Minecraft_Experience", "China_Edition")
REAL_WORLD_CATEGORIES = PEOPLE + ("Mojang_Studios",) + COMPANIES + EVENTS + COMMUNITY
HISTORY_CATEGORIES = ("History", "15th_Anniversary", "10th_Anniversary", "MCC_x_Minecraft_15th_Anniversary_Party", "Birthday_skin_packs")
VANILLA_CATEGORIES = (
    "Blocks", "Manufactured_blocks", "Natural_blocks", "Generated_structure_blocks", "Utility_blocks", "Non-solid_blocks", "Technical_blocks", "Items", "Tools",
    "Weapons", "Armor", "Food", "Mobs", "Animal_mobs", "Hostile_mobs", "Monster_mobs", "Passive_mobs", "Aquatic_mobs", "Tameable_mobs", "Bosses", "Plants",
    "Crops", "Ore", "Entities", "Block_entities", "Game_mechanics", "Status_effects", "Potion_effects", "Effects", "Enchantments", "Generated_structures",
    "Biomes", "Sounds", "Music_Discs",
)
COMPANY_TITLES = ("Mojang Studios", "Mojang", "Mojang AB", "Microsoft", "Sony", "Nintendo", "4J Studios", "Telltale Games")
EDITION_TITLES = (
    "Bedrock Edition", "Java Edition", "Minecoin", "Pocket Edition", "Education Edition", "Minecraft Education", "Legacy Console Edition", "Xbox 360 Edition",
    "Xbox One Edition", "PlayStation 3 Edition", "PlayStation 4 Edition", "PlayStation Vita Edition", "Wii U Edition", "Nintendo Switch Edition",
    "New Nintendo 3DS Edition", "China Edition", "Apple TV Edition", "MinecraftEdu",
)
# Categories from the most to the least specific; the first a page has is its bucket.
PRIORITY = (
    "Ore", "Bosses", "Animal_mobs", "Hostile_mobs", "Monster_mobs", "Passive_mobs", "Aquatic_mobs", "Tameable_mobs", "Nether_mobs", "Undead_mobs",
    "Flying_mobs", "Humanoid_mobs", "Removed_mobs", "Arthropod_mobs", "Plants", "Crops", "Saplings", "Flowers", "Trees", "Vegetation", "Manufactured_blocks",
    "Natural_blocks", "Generated_structure_blocks", "Utility_blocks", "Non-solid_blocks", "Technical_blocks", "Liquids", "Fluids", "Tools", "Weapons", "Armor",
    "Food", "Brewing_ingredients", "Raw_materials", "Potions", "Music_Discs", "Mobs", "Blocks", "Items", "Block_entities", "Stationary_entities",
    "Joke_entities", "Projectiles", "Vehicles", "Playable_entities", "Entities", "Generated_structures", "Structures", "Generated_features", "Biomes",
    "Overworld_biomes", "Nether_biomes", "End_biomes", "Dimensions", "The_End", "The_Nether", "Environment", "Settlements", "Structure_blueprints",
    "Village_blueprints", "Village_structure_subpages", "Game_mechanics", "Status_effects", "Potion_effects", "Effects", "Enchantments", "Crafting", "Combat",
    "Gameplay", "Game_terms", "Game_modes", "Element", "Elements", "Minigames", "Server", "Mechanisms", "Redstone_mechanics", "Redstone_circuits", "Redstone",
    "Removed_blocks", "Removed_items", "Experimental", "Sounds", "Music", "Achievements", "Advancements", "Menu_screens", "UI", "Skin_packs", "Capes",
    "Texture_packs", "Resource_packs", "Mash-up_packs", "Character_Creator", "Add-ons", "Collaborative_skin_packs", "Collaborative_add-ons",
    "Collaborative_maps", "Collaboration_character_items", "DLC_promotions", "Achievement_disambiguation_pages", "Version_disambiguation_pages",
    "Disambiguation_pages", "Set_index_pages", "Commands", "Java_Edition_protocol", "Protocol_Details", "Java_Edition_technical", "Top-level_data_pages",
    "Data_packs", "Sound_data_pages", "Texture_atlases", "Textures", "Chunk_format", "Item_format", "Java_Edition_data_values",
    "Bedrock_Edition_level_format", "Custom_software", "Websites", "Calculators", "Interactive_tools_and_calculators", "Data_pages", "Fonts",
    "Minecraft_dynamic_lists", "Development", "Mods", "Mod_loaders", "Mod_managers", "Game_customization", "Removed_features",
)
MECHANIC_TITLES = (
    "Block properties", "Block update", "Spawn limit", "Spawn event", "Hitbox", "Waxing", "Tick speed", "Piston/Technical components", "Block tick",
    "Random tick", "Game tick", "Cave", "Ore vein", "Hostility", "Villager professions", "Green particle", "File extensions", "Cooking", "Crafting", "Combat",
    "Smelting",
)
MENU_TITLES = (
    "Title Screen", "Menu screen", "Create New World", "Select World", "Graphics settings", "Controls", "World Options", "Tooltip/Colors", "Autosave",
    "Simulation distance", "Pause Menu", "Options", "Video Settings", "Audio Settings",
)
TECHNICAL_TITLES = (
    "Data component format/", "Data component predicate/", "Sounds.json/", "Bedrock Edition data values", "Java Edition data values",
    "Bedrock Edition protocol", "Java Edition protocol/", "Bedrock Edition level format/", "Java Edition level format/", "Block behaviour",
)
# Broader categories that a bucket implies.
PARENTS = {
    "Animal_mobs": ("Mobs", "Entities"),
    "Hostile_mobs": ("Mobs", "Entities"),
    "Monster_mobs": ("Mobs", "Entities"),
    "Passive_mobs": ("Mobs", "Entities"),
    "Aquatic_mobs": ("Mobs", "Entities"),
    "Tameable_mobs": ("Mobs", "Entities"),
    "Nether_mobs": ("Mobs", "Entities"),
    "Undead_mobs": ("Mobs", "Entities"),
    "Flying_mobs": ("Mobs", "Entities"),
    "Humanoid_mobs": ("Mobs", "Entities"),
    "Removed_mobs": ("Mobs", "Entities"),
    "Arthropod_mobs": ("Mobs", "Entities"),
    "Bosses": ("Mobs", "Entities", "Hostile_mobs"),
    "Mobs": ("Entities",),
    "Manufactured_blocks": ("Blocks",),
    "Natural_blocks": ("Blocks",),
    "Generated_structure_blocks": ("Blocks",),
    "Utility_blocks": ("Blocks",),
    "Non-solid_blocks": ("Blocks",),
    "Technical_blocks": ("Blocks",),
    "Liquids": ("Blocks",),
    "Fluids": ("Blocks",),
    "Tools": ("Items",),
    "Weapons": ("Items",),
    "Armor": ("Items",),
    "Food": ("Items",),
    "Brewing_ingredients": ("Items",),
    "Raw_materials": ("Items",),
    "Potions": ("Items",),
    "Music_Discs": ("Items",),
    "Ore": ("Blocks", "Natural_blocks"),
    "Redstone_mechanics": ("Redstone",),
    "Redstone_circuits": ("Redstone",),
    "Achievement_disambiguation_pages": ("Disambiguation_pages", "Set_index_pages"),
    "Version_disambiguation_pages": ("Disambiguation_pages", "Set_index_pages"),
    "Set_index_pages": ("Disambiguation_pages",),
    "Status_effects": ("Effects",),
    "Potion_effects": ("Effects",),
    "Generated_features": ("Generated_structures",),
    "Overworld_biomes": ("Biomes",),
    "Nether_biomes": ("Biomes",),
    "End_biomes": ("Biomes",),
}
# Families of buckets, and of settings.
FAMILIES = {
    "mob": ("Bosses", "Animal_mobs", "Hostile_mobs", "Monster_mobs", "Passive_mobs", "Aquatic_mobs", "Tameable_mobs", "Nether_mobs", "Undead_mobs", "Flying_mobs", "Humanoid_mobs", "Removed_mobs", "Arthropod_mobs", "Mobs"),
    "plant_ore": ("Ore", "Plants", "Crops", "Saplings", "Flowers", "Trees", "Vegetation"),
    "item": ("Tools", "Weapons", "Armor", "Food", "Brewing_ingredients", "Raw_materials", "Potions", "Music_Discs", "Items"),
    "mechanic": ("Game_mechanics", "Status_effects", "Potion_effects", "Effects", "Enchantments", "Crafting", "Combat", "Gameplay"),
    "world": ("Generated_structures", "Structures", "Biomes", "Overworld_biomes", "Nether_biomes", "End_biomes", "Dimensions", "Environment"),
    "command": ("Commands",),
}
SETTING_FAMILIES = {"versions": "version", "tutorial": "tutorial", "real_world": "real_world", "media_franchise": "media"}

# Line and inline patterns removed per family.
FAMILY_LINES = {
    "plant_ore": (r"^\s*\d+(?:\s*,\s*\d+){5,}\s*$",),
    "item": (r"^Eat each of these \d+ foods?:.*$", r"^Unenchanted:\s+\([^)]+\)(?:\s*,\s*[^,\n]+){5,}\s*$"),
    "mechanic": (r"^Primary items\s*$",),
    "world": (r"^Visit all of these \d+ biomes?:.*$", r"^Hot Tourist Destinations\s*$"),
    "version": (r"^(?:Beta|Build|Preview|Snapshot|Client version|Server version)(?:\s+for)?:\s+\S.*\n?",),
    "tutorial": (r"^[a-z]{2,5}-\$\s*$", r"^Category:\s+[^,]+,\s+Data:\s+.*\n?"),
    "media": (r"^Ditto\s*$",),
}
# Edition names that open a line, and lines of platforms only.
EDITION_PREFIX = r"^(Java Edition(?: Classic| Indev| Infdev| Alpha| Beta)?|Pocket Edition(?: Alpha)?|Bedrock Edition|Legacy Console Edition|New Nintendo 3DS Edition|Minecraft Education|PlayStation 4 Edition):\s+"
PLATFORM_LINE = r"^Legacy Console Edition:\s+(?:Xbox 360|Xbox One|PS3|PS4|PS Vita|Wii U|Switch)(?:,\s*(?:Xbox 360|Xbox One|PS3|PS4|PS Vita|Wii U|Switch))+\s*$"
# Rows of broken tables, and the version numbers that open a console row.
TABLE_ROWS = (
    r"^Block: (?:Tool|Options|Breakingtime \(sec\)|Efficiency|Default|Wooden)\s*$",
    r"^Block: (?:Hardness|Wood|Stone|Iron|Diamond|Netherite|Hopper|Dispenser|Sticky)[^\n]*$",
    r"^Map color:(?:\s*\d+\s+COLOR\s+_[A-Z]+)+\s*$",
    r"^Map color: JE: \d+ colors? .*$",
    r"^Map color: \d+ [A-Z][A-Z_ ]+\s*$",
    r"^Mob: (?:Monster|Creature|Ambient|Water Creature|Underground Water Creature|Axolotl|Misc) category\s*$",
    r"^Item:\s+(?:Java Edition|Bedrock Edition|Java\s+Edition\s+and\s+Bedrock\s+Edition)\s*$",
    r"^\d+ (?:issues?|bugs?) (?:fixed|reported)\.?\s*$",
    r"^PS4, Other\s*$",
    r"^[A-Z][^\n,]+, [^\n]*?, \d+, (?:Bronze|Silver|Gold|Platinum)\s*$",
    r"^[?,\s]+,\s+Added .+$",
    r"^Identifier:\s+[a-z_]+\s*$",
    r"^Allowed values:\s*[0-9]+\s*$",
    r"^Metadata Bits:\s*(?:0x[0-9a-fA-F]\s*)+$",
    r"^Category:\s+[^,\n]+,\s+Data:\s+.*$",
    r"^Sources:\s*See\s*§\s*\w+\s*$",
)
CONSOLE_PREFIX = r"^(?:TU\d+(?:,\s*CU\d+)?(?:,\s*[\d.]+)+(?:,\s*Patch \d+)?(?:,\s*[\d.]+)?,\s*)"
# References and leavings inside lines.
INLINE_NOISE = (
    r"\(?\s*see\s*[#§]\s*[A-Z][\w ]+\s*\)?",
    r"\(?\s*see\s+(?:also[:,\s]+)?[A-Z][\w ]+\s*[#§]\s*[\w ]+\)?",
    r"\bObjectSprite\s+[\w-]+\.png:\s*Sprite image[^\n]+",
    r"\(\s*\)",
    r"\(\s*×\s*\d+(?:\.\d+)?\s*\)",
)
# Whole lines of maintenance text.
LINE_NOISE = (
    r'^Issues relating to "[^"]+" are maintained on the bug tracker\..*\n?',
    r'(?s:^Issues relating to "[^"]+" are not maintained on the bug tracker because it is an April Fools\' joke\..*?Invalid"\s*\n?)',
    r"^An interactive widget is being loaded\.{0,3}.*\n?",
    r"^For other uses, see [^\n.]+\.\s*\n?",
    r"^For the [^,\n]+, see [^\n.]+\.\s*\n?",
    r"^For an overview of all [^,\n]+ biomes, see [^\n.]+\.\s*\n?",
    r"^Not to be confused with [^\n.]+\.\s*\n?",
    r"^This article is about [^\n.]+\. For [^,\n]+, see [^\n.]+\.\s*\n?",
    r'^"[^"]+" redirects here\. For [^,\n]+, see [^\n.]+\.\s*\n?',
    r"^Main article: .+\n?",
    r"^See Tutorial:.+\n?",
    r"^See also:\s+\S.*\n?",
    r"^There is a related tutorial page\b.*\n?",
    r"^There is an associated technical blocks page for .+\n?",
    r"^Spoiler warning! This section contains detailed information about [^\n.]+\..*\n?",
    r"^Editor's note:.*\n?",
    r"^Tagged on: \w+ \d+, \d{4}\.\s*\n?",
    r"^It has been suggested that this section be split into its own page at .+\[discuss\]\s*\n?",
    r"^If this split affects many pages, or may potentially be controversial, do not split until a consensus has been reached\.\s*\n?",
    r"^This section needs cleanup to comply with the style guide\..*\n?",
    r"^Please help improve this section\.\s*\n?",
    r"^An official name has not been given\. Please update the name if confirmed by reliable sources\.\s*\n?",
    r"(?s:^This section uses a bug \(MC-\d+\) to make a contraption.*?\nUse at your own risk\.\s*\n?)",
    r"^This section describes content that is currently in development\.\s*\n?",
    r"^This content has appeared in development versions for [^,\n]+, but the full update adding it has not been released yet\.\s*\n?",
    r"^The specific instructions are:.+\n?",
    r"^Please remove this notice once you have added a suitable .+\n?",
    r"^This (?:page|section|article) (?:needs to be|should be) rewritten\..*\n?",
    r"^YouTube Video \( view on YouTube \)\s*\n?",
    r"^.+ \( view on YouTube \)\s*\n?",
    r"^Vimeo Video \( view on Vimeo \)\s*\n?",
    r"^Reason:\s+[^\n]+\n?",
    r"^Main article: Movie:[^\n]*\[edit\]\s*\n?",
)
NOISE_TO_SPACE = (
    "\u200c?" + r"\[\s*(?:verify|more information needed|citation needed|check the code|is this the correct version\?|discuss|edit|sic)\s*\]",
    r"\(\s*(?:MC|MCPE|MCL|REALMS|EDU)-\d+\s*\)",
    "\u200c?" + r"\[\s*(?:Java Edition only|JE only|JEonly|Bedrock Edition only|BE only|BEonly|Bedrock and Pi editions only|edu only|upcoming)\s*\]",
)
# What must come through word repair unchanged, with the mark that stands for it meanwhile.
KEPT_NAMES = (
    "globalSoundEvents|randomTickSpeed|doDaylightCycle|keepInventory|doMobSpawning|mobGriefing|doFireTick|naturalRegeneration|doWeatherCycle|commandBlockOutput|"
    "sendCommandFeedback|showDeathMessages|spectatorsGenerateChunks|disableElytraMovementCheck|RangedAttackGoal|MeleeAttackGoal|TemptGoal|FollowOwnerGoal|PanicGoal|"
    "SitGoal|FloatGoal|AvoidEntityGoal|BeeEntityData|MushroomCow|craftingScreen|TransferCooldown|CustomName|DealtDamage|DuplicationCooldown|BatFlags|"
    "MinecraftEdu|JavaScript|TypeScript|PlayStation|MineCon|iPad|iPhone|PvP|PvE|MMORPG|GitHub|YouTube|TikTok|OpenGL|DirectX|FabricMC|NeoForge"
)
PROTECTED = (
    (r"#[0-9A-Fa-f]{6,8}\b", "__HEX_PROTECT__"),
    (r"\b[a-z][a-z0-9_-]*/[a-z0-9_/-]+\.(?:png|json|jar|ogg|txt|zip|lang|properties|nbt|mcfunction)\b", "__FILEPATH_PROTECT__"),
    (r"\b\d+w\d+[a-z]+\b", "__SNAPSHOT_PROTECT__"),
    (r"\b(?:MC|MCPE|MCL|REALMS|EDU)-\d+\b", "__BUGID_PROTECT__"),
    (r"\bTU\d+\b|\bCU\d+\b", "__TUVER_PROTECT__"),
    (rf"\b(?:{KEPT_NAMES})\b", "__WHITELIST_PROTECT__"),
)
TYPE_TAGS = r"\[(?:NBT (?:Compound|List)(?:\s*/\s*JSON\s+(?:Object|Array))?|String|Int(?:eger)?|Long|Short|Byte|Float|Double|Boolean|Array|Int Array|Byte Array|Long Array|JSON Object|JSON Array)\]"
ASSET_LINK = r"#/media/File:\S+"
ID_ROW = r"(?m)^(?:Identifier:\s+\S.*|Translation key:\s+\S.*|Item tags:\s+\S.*|Numeric ID:\s+\S.*|Form:\s+\S.*|Name:\s+[^\n]*Identifier:[^\n]*)$"
NAMESPACED = r"\bminecraft:([a-z_/]+)(?=[^a-z_/]|$)"
DOTTED = r"\b(?:block|item|entity|tile|effect|enchantment|potion|subtitles?)\.minecraft\.([a-z_.]+)(?=[^a-z_.]|$)"
# Places where two words have run together, and what goes between.
SPLITS = (
    (r"(\d)(?=[A-Z])", r"\1 "),
    (r"([a-z])(?=[A-Z][a-z])", r"\1 "),
    (r"([.!?])(?=[A-Z])", r"\1 "),
    (r"([a-z])(?=/[a-z])", r"\1 "),
    (r"([a-z])(?=@[aprs])", r"\1 "),
    (r"([a-z])(?=#[A-Za-z])", r"\1 "),
    (r",(?=[A-Z])", r", "),
    (r"(\.(?:png|jar|ogg|json|txt|zip|lang|nbt|mcfunction))(?=[a-zA-Z])", r"\1 "),
    (r"(from|to)(?=#[0-9A-Fa-f]{6,8})", r"\1 "),
)
# Footers of encyclopedia pages, in the order they are cut.
FOOTERS = ("References", "External links", "Notes", "Bibliography", "Further reading", "See also", "Citations", "Sources", "Footnotes", "Awards")
CAPTION_TAGS = r"(?i)\[(Music|Applause|Laughter|Cheering|Cheers|Inaudible|Crowd|Chuckles|Sigh|Sighs|Pause|Silence|Crowd noise|upbeat music|Dramatic music|Speaker \d+)\]"
# Words that mark a passage for a question, with the question.
QUESTIONS = {
    "craft": "How do I craft {} in Minecraft?", "spawn": "Where does {} spawn in Minecraft?", "drop": "What does {} drop in Minecraft?",
    "damage": "How much damage does {} do in Minecraft?", "biome": "In which biome can I find {} in Minecraft?", "breed": "How do I breed {} in Minecraft?",
    "tame": "How do I tame {} in Minecraft?", "enchant": "What enchantments can be applied to {} in Minecraft?", "smelt": "How do I smelt {} in Minecraft?",
    "potion": "How do I brew {} in Minecraft?",
}
CRAFTING_WORDS = ("craft", "recipe", "ingredient", "smelting", "brewing")
# Notes that open a page and say nothing of its subject.
HATNOTES = (
    r"For other uses,?\s*see .+", r"Not to be confused with .+", r"This article is about .+?(\.\s*For .+, see .+\.?)?", r'".+" redirects here\.\s*(For .+, see .+\.?)?',
    r'".+" may refer to:?', r"This page describes content that is (a part|part) of the .+ DLC\.?", r"This feature is exclusive to .+",
    r"This article documents an April Fools?'?.+", r"This article is about the .+?(\.\s*For .+, see .+\.?)?", r"Instructions:\s*", r"Note:\s*", r"Verify the plot.+",
    r"Expand on .+", r"Find out from the developers.+", r"An official name.+", r"Please update the name.+", r"This article has no navigation boxes\.",
    r"Please add one or more navigation box templates.+", r"Add data values section\.?", r"Add sounds,? if there is any\.?", r"Missing information", r"Empty sections", r"\s*",
)

"""Words that ran together in extracted pages, with their separate form. The values are fixed and their order matters."""

from __future__ import annotations

# Hand-picked runs of words.
JOINED_WORDS = (
    (r"\bNotchbelieved\b", r"Notch believed"),
    (r"\bNotchsaid\b", r"Notch said"),
    (r"\bNotchannounced\b", r"Notch announced"),
    (r"\bNotchteased\b", r"Notch teased"),
    (r"\bNotchshowed\b", r"Notch showed"),
    (r"\bNotchexpresses\b", r"Notch expresses"),
    (r"\bJebexplained\b", r"Jeb explained"),
    (r"\bJebsaid\b", r"Jeb said"),
    (r"\bDinnerbonesaid\b", r"Dinnerbone said"),
    (r"\bMojang Studiosconfirmed\b", r"Mojang Studios confirmed"),
    (r"\bWintersannounced\b", r"Winters announced"),
    (r"\bLydiaWinters\b", r"Lydia Winters"),
    (r"\bBergenstensays\b", r"Bergensten says"),
    (r"\bKingbdogzstates\b", r"Kingbdogz states"),
    (r"\bVisitallof\b", r"Visit all of"),
    (r"\bEateachof\b", r"Eat each of"),
    (r"\bKilloneof\b", r"Kill one of"),
    (r"\bKilleachof\b", r"Kill each of"),
    (r"\bHaveallof\b", r"Have all of"),
    (r"\bBreed a pair ofanyof\b", r"Breed a pair of any of"),
    (r"\bforJava Edition\b", r"for Java Edition"),
    (r"\bofJava Edition\b", r"of Java Edition"),
    (r"\binJava Edition\b", r"in Java Edition"),
    (r"\bbyJava Edition\b", r"by Java Edition"),
    (r"\btoJava Edition\b", r"to Java Edition"),
    (r"\bfromJava Edition\b", r"from Java Edition"),
    (r"\bonJava Edition\b", r"on Java Edition"),
    (r"\bwithJava Edition\b", r"with Java Edition"),
    (r"\bisJava Edition\b", r"is Java Edition"),
    (r"\bforBedrock Edition\b", r"for Bedrock Edition"),
    (r"\bofBedrock Edition\b", r"of Bedrock Edition"),
    (r"\binBedrock Edition\b", r"in Bedrock Edition"),
    (r"\btoBedrock Edition\b", r"to Bedrock Edition"),
    (r"\bfromBedrock Edition\b", r"from Bedrock Edition"),
    (r"\bonBedrock Edition\b", r"on Bedrock Edition"),
    (r"\bwithBedrock Edition\b", r"with Bedrock Edition"),
    (r"\bofXbox 360 Edition\b", r"of Xbox 360 Edition"),
    (r"\b\.minecraftfolder\b", r".minecraft folder"),
    (r"\bAvg\.per chest\b", r"Avg. per chest"),
    (r"\bcheststo search\b", r"chests to search"),
    (r"\bFilenamein Minecraft\b", r"Filename in Minecraft"),
    (r"\bAttenuationdistance\b", r"Attenuation distance"),
    (r"\bCraftingrecipe\b", r"Crafting recipe"),
    (r"\bSmeltingrecipe\b", r"Smelting recipe"),
    (r"\bAmbientsounds\b", r"Ambient sounds"),
    (r"\bUsableitems\b", r"Usable items"),
    (r"\bPricemultiplier\b", r"Price multiplier"),
    (r"\bVillagerexperience\b", r"Villager experience"),
    (r"\bTrades instock\b", r"Trades in stock"),
    (r"\bbebred\b", r"be bred"),
    (r"\bbredusing\b", r"bred using"),
    (r"\bcraftedfrom\b", r"crafted from"),
    (r"\bnowuses\b", r"now uses"),
    (r"\bnowsell\b", r"now sell"),
    (r"\bnowdrop\b", r"now drop"),
    (r"\bnowspawn\b", r"now spawn"),
    (r"\babarrier\b", r"a barrier"),
    (r"\babeacon\b", r"a beacon"),
    (r"\bablock\b", r"a block"),
    (r"\babiomein\b", r"a biome in"),
    (r"\bachance\b", r"a chance"),
    (r"\bachest\b", r"a chest"),
    (r"\bafireball\b", r"a fireball"),
    (r"\baflower\b", r"a flower"),
    (r"\bahopper\b", r"a hopper"),
    (r"\bamob\b", r"a mob"),
    (r"\baplayer\b", r"a player"),
    (r"\bavillage\b", r"a village"),
    (r"\bavillager\b", r"a villager"),
    (r"\bawitch hut\b", r"a witch hut"),
    (r"\bazombie\b", r"a zombie"),
    (r"\baniron ingot\b", r"an iron ingot"),
    (r"\banillager\b", r"an illager"),
    (r"\bthebasalt\b", r"the basalt"),
    (r"\bthecrafting\b", r"the crafting"),
    (r"\bthechests\b", r"the chests"),
    (r"\btheinventory\b", r"the inventory"),
    (r"\btheblock\b", r"the block"),
    (r"\btheirpath\b", r"their path"),
    (r"\btheircreaking\b", r"their creaking"),
    (r"\btheterrain\b", r"the terrain"),
    (r"\bWardensnow\b", r"Wardens now"),
    (r"\bWardensdrop\b", r"Wardens drop"),
    (r"\bGoatsnow\b", r"Goats now"),
    (r"\bPigsnowdrop\b", r"Pigs now drop"),
    (r"\bSheepnowdrop\b", r"Sheep now drop"),
    (r"\bEndermennow\b", r"Endermen now"),
    (r"\bEndermenare\b", r"Endermen are"),
    (r"\bMobscan\b", r"Mobs can"),
    (r"\bmobscan\b", r"mobs can"),
    (r"\bHostile mobscan\b", r"Hostile mobs can"),
    (r"\bspidersfollow\b", r"spiders follow"),
    (r"\bsomespiderson\b", r"some spiders on"),
    (r"\bcraftrabbit\b", r"craft rabbit"),
    (r"\bcraftfermented\b", r"craft fermented"),
    (r"\bcraftsuspicious\b", r"craft suspicious"),
    (r"\bcraftpurpur\b", r"craft purpur"),
    (r"\bcraftcampfires\b", r"craft campfires"),
    (r"\bcrafttools\b", r"craft tools"),
    (r"\bSmeltcharred\b", r"Smelt charred"),
    (r"\bSmeltbaked\b", r"Smelt baked"),
    (r"\bbyshearing\b", r"by shearing"),
    (r"\bintrial\b", r"in trial"),
    (r"\binflower\b", r"in flower"),
    (r"\bpotsof\b", r"pots of"),
    (r"\bwithcows\b", r"with cows"),
    (r"\bwithwheat\b", r"with wheat"),
    (r"\bwithbuckets\b", r"with buckets"),
    (r"\bbestfoodin\b", r"best food in"),
    (r"\bviazombie\b", r"via zombie"),
    (r"\bacraftingrecipe\b", r"a crafting recipe"),
    (r"\bcraftablein\b", r"craftable in"),
    (r"\businggold\b", r"using gold"),
    (r"\bbecameobtainable\b", r"became obtainable"),
    (r"\bwhenlavaflows\b", r"when lava flows"),
    (r"\boversoul\b", r"over soul"),
    (r"\bsoilnext\b", r"soil next"),
    (r"\btoblue\b", r"to blue"),
    (r"\bitrenewable\b", r"it renewable"),
    (r"\bafteritem\b", r"after item"),
    (r"\bheartis\b", r"heart is"),
    (r"\bthroughcommands\b", r"through commands"),
    (r"(\d+\.\d+(?:\.\d+)?)Experiment([A-Z])", r"\1 (Experiment) \2"),
    (r"\bUpcomingBedrock Edition\b", r"Upcoming Bedrock Edition"),
    (r"\bUpcomingJava Edition\b", r"Upcoming Java Edition"),
    (r"(?<=[a-z]{3})and(?=\s*[A-Z])", r" and "),
    (r"\bCoalorCharcoal\b", r"Coal or Charcoal"),
    (r"\bBone MealorLapis Lazuli\b", r"Bone Meal or Lapis Lazuli"),
    (r"\bBrown MushroomorRed Mushroom\b", r"Brown Mushroom or Red Mushroom"),
    (r"\bHelmetorChestplate\b", r"Helmet or Chestplate"),
    (r"(\d+)(health|HP|points|seconds|minutes|hours|days|blocks|chunks|ticks|levels?|emeralds?|enchantments?)\b", r"\1 \2"),
    (r"\btheterrain\.png\b", r"the terrain.png"),
    (r"\binclient\.jar\b", r"in client.jar"),
    (r"\bgui/items\.pngwere\b", r"gui/items.png were"),
    (r"\bstitched_terrain\.pngand\b", r"stitched_terrain.png and"),
)
# Runs found by their frequency in the corpus.
FREQUENT_JOINED_WORDS = (
    (r"\bobtainingexperience\b", r"obtaining experience"),
    (r"\btheinventory\b", r"the inventory"),
    (r"\binsuspicious\b", r"in suspicious"),
    (r"\bportalchests\b", r"portal chests"),
    (r"\binenchantment\b", r"in enchantment"),
    (r"\bsoulenchantments\b", r"soul enchantments"),
    (r"\bbycreeperskilled\b", r"by creepers killed"),
    (r"\btheadvancement\b", r"the advancement"),
    (r"\btheenchantment\b", r"the enchantment"),
    (r"\btheachievement\b", r"the achievement"),
    (r"\btorchflowers\b", r"torch flowers"),
    (r"\btheplayerhas\b", r"the player has"),
    (r"\bandminecraft\b", r"and minecraft"),
    (r"\bfirefromlava\b", r"fire from lava"),
    (r"\bthemrenewable\b", r"them renewable"),
    (r"\bcraftsuspicious\b", r"craft suspicious"),
    (r"\bcraftredstone\b", r"craft redstone"),
    (r"\bbecraftedusing\b", r"be crafted using"),
    (r"\bplacefeature\b", r"place feature"),
    (r"\binventorywhen\b", r"inventory when"),
    (r"\bfromcreepersthat\b", r"from creepers that"),
    (r"\btovillagersandzombie\b", r"to villagers and zombie"),
    (r"\bcraftcampfires\b", r"craft campfires"),
    (r"\bbecomerenewable\b", r"become renewable"),
    (r"\bnowrenewable\b", r"now renewable"),
)

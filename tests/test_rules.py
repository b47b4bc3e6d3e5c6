"""Worked examples of single rules."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.functions import html, text
from corvane.operators import classify, cleaning, external, filters, harden, prompts, qa, tokens


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_article_reasons(spark):
    reason = filters.article_reason(F.col("t"), F.col("x"), F.col("w"))
    marker = "This disambiguation page lists articles associated with the same title"
    for title, body, words, expected in [
        ("Category:X", "", 9, "empty_or_tiny"), ("Category:X", "", 50, "category_page"), ("Stone Texture History", "", 50, "texture_history"),
        ("b1.5", marker, 50, "version_disambiguation"), ("Level.dat", marker, 50, None), ("Stone", "", 50, None), ("Debug mode x", "", 50, "debug_mode"),
    ]:
        assert one(spark, reason, t=title, x=body, w=words) == expected


def test_nulls_in_filters(spark):
    df = spark.createDataFrame([(None, None, None), ("a", None, 20)], "title string, text string, word_count int")
    kept, dropped = filters.split_by_reason(df, filters.article_reason(F.col("title"), F.col("text"), F.col("word_count")))
    assert kept.count() == 1 and dropped.first().removal_reason == "empty_or_tiny"


def test_cleaning_steps(spark):
    for f, before, after in [
        (cleaning.unlink, "[[File:a.png]][[x|y]][[z]]", "yz"), (cleaning.strip_templates, "{{a{{b}}c}}d", "d"), (cleaning.strip_cites, "fact [3]", "fact "),
        (cleaning.strip_cites, "ArmorItems[3]", "ArmorItems[3]"), (cleaning.tidy, "a player , hisses", "a player, hisses"), (cleaning.strip_navigation, "a\n◄ b\nc", "a\nc"),
        (cleaning.strip_boilerplate, "x THIS ARTICLE IS A STUB . y", "x  y"),
    ]:
        assert one(spark, f(F.col("t")), t=before) == after


def test_templates_of_any_depth(spark):
    """As many passes as there are templates to take."""
    for depth in (1, 6, 7, 8, 40):
        nested = "a " + "{{x|" * depth + "y" + "}}" * depth + " b"
        assert one(spark, cleaning.strip_templates(F.col("t")), t=nested) == "a  b", depth
        df = cleaning.cleaned(spark.createDataFrame([(1, nested, "A"), (2, None, "B")], "seq long, text string, title string"))
        assert {r.seq: (r.clean_text, r.words_after) for r in df.collect()} == {1: ("a b", 2), 2: (None, 0)}
    braces = "{{z" * 20 + "{" * 9 + "{x}}" + "{y}}" * 8  # braces that close up only as templates go
    expected, before = braces, None
    while expected != before:
        before, expected = expected, re.sub(r"\{\{[^{}]*\}\}", "", expected)
    assert one(spark, cleaning.strip_templates(F.col("t")), t=braces) == expected


def test_changelog_header_only_in_the_first_lines(spark):
    body = "Type: x\n" + "\n".join(["line"] * 40) + "\nType: y"
    out = one(spark, cleaning.strip_changelog_header(F.col("t")), t=body)
    assert out.startswith("\nline") and out.endswith("Type: y")


def test_middle_stages():
    f = lambda s: harden.middle_stages(s, "none")
    assert f("costs 5HP in biomesBadlands, use@a ,Weaving") == "costs 5 HP in biomes Badlands, use @a , Weaving"
    assert f("Notchsaid so") == "Notch said so"
    assert f("then theplayerhas it") == "then the player has it"
    assert f("use minecraft:oak_log now") == "use oak log now"
    assert f("Translation key: item.minecraft.x") == "Translation key: item.minecraft.x"
    assert f("Java Edition: A\nJava Edition: B") == "Java Edition: A\nB"
    assert f("in 24w14potato and #FF00AAff") == "in 24w14potato and #FF00AAff"
    assert f("real fact [verify] here (MC-123) end") == "real fact   here   end"


def test_sections():
    assert harden.drop_sections("Intro\nHistory\nold\nTrivia\nfact", False) == ("Intro\nTrivia\nfact", ["History"])
    assert harden.drop_sections("Issues\nnone", False) == ("Issues\nnone", [])
    assert harden.drop_sections('Issues\n"x" are maintained on the bug tracker.', False) == ("", ["Issues"])
    assert harden.drop_sections("Achievements\nrow", False)[1] == ["Achievements"] and harden.drop_sections("Achievements\nrow", True)[1] == []


def test_paragraphs_once(spark):
    p = "word " * 50
    got = one(spark, harden.paragraphs_once(F.col("t")), t=f"{p}\n\nshort\n\nshort\n\n{p}")
    assert got.removed == 1 and got.text.count("short") == 2


def test_routing(spark):
    df = spark.createDataFrame(
        [("A", ["Disambiguation_pages"], "x", 5), ("Tutorial:X", ["Unused_features"], "x", 50), ("X", ["Unused_features"], "x", 50), ("X", ["Removed_features"], "x", 50), (None, None, None, None)],
        "title string, categories array<string>, text string, word_count int",
    )
    got = [(r.decision, r.reason) for r in harden.routed(df).select("decision", "reason").collect()]
    assert got == [("route_qa_direct", "disambig"), ("keep", None), ("drop", "unused_content"), ("drop", "removed_features_only"), ("keep", None)]


def test_hardened_twice_is_the_same(spark, data):
    out = harden.hardened(spark.read.parquet(f"{data}/articles.parquet"))
    stable = harden.is_stable(out, "seq").collect()
    assert stable and sum(r.stable for r in stable) >= 0.9 * len(stable)


def test_classes(spark):
    df = spark.createDataFrame(
        [("Dungeons:Sword", ["Blocks"], ""), ("Ancient", ["Blocks", "Ore"], ""), ("Z", [], "This disambiguation page"), ("Cake", ["10th_Anniversary", "Blocks"], ""), ("Mod", ["Mods"], ""), ("V", ["Java_Edition_versions"], "")],
        "title string, categories array<string>, text string",
    )
    got = [(r.setting, r.bucket, r.also_in) for r in classify.classified(df).collect()]
    assert got == [("spinoff", "Minecraft_Dungeons", ["Blocks"]), ("game_vanilla", "Ore", []), ("game_vanilla", "Disambiguation_pages", []), ("game_vanilla", "Blocks", ["10th_Anniversary"]), ("tutorial", "Tutorials", ["Mods"]), ("versions", "Java_Edition_versions", [])]


def test_tiers(spark):
    for n, expected in [(9, "<10"), (10, "10-49"), (5000, "5000+"), (999, "500-999")]:
        assert one(spark, classify.tier(F.col("n")), n=n) == expected


def test_replies(spark):
    parse = prompts.parsed_reply(F.col("t"), ["KEEP", "DISCARD"])
    for reply, label, reason in [("KEEP — hero\nmore", "KEEP", "hero"), ("maybe", "UNPARSEABLE", "maybe"), ("I say DISCARD not KEEP", "DISCARD", "not KEEP"), ("keep", "KEEP", ""), ("KEEP\nwhy", "KEEP", "why")]:
        got = one(spark, parse, t=reply)
        assert (got.label, got.reason) == (label, reason)


def test_reply_form():
    got = prompts.normalized_reply("<think>x</think>**Creeper**\n**Overview**\nA mob.\n## Properties\n- **Health Points**: 32 HP × 16\n- Tameable: No\n**Drops**\n- powder", "Creeper")
    assert got["title"] == "Creeper" and got["sections"]["properties"].startswith("Health: 32") and "Tameable" not in got["text"]
    assert prompts.normalized_reply("  ", "T")["warnings"] == ["empty input"]


def test_hatnotes(spark):
    assert one(spark, prompts.without_hatnotes(F.col("t")), t="For other uses, see X.\n\nNote:\nReal line\nNote:") == "Real line\nNote:"
    assert one(spark, prompts.without_hatnotes(F.col("t")), t="Note:\n ") == ""


def test_generator_retries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string")

    def broken(texts):
        raise ValueError("no")

    out = prompts.generated(df, "id", "p", broken)
    assert [r.error for r in out.collect()] == ["ValueError: no"] * 2
    assert prompts.remaining(df, out, "id").count() == 2


def test_pairs(spark):
    df = spark.createDataFrame([(1, "Stick", "You craft it from two planks, which is cheap, and then you hold it."), (2, None, "x"), (3, "E", "short")], "seq long, title string, text string")
    assert sorted(r.instruction for r in qa.heuristic_pairs(df).collect()) == ["How do I craft Stick in Minecraft?", "What is Stick in Minecraft?"]
    assert qa.heuristic_pairs(df.limit(0)).count() == 0


def test_blog():
    noise = frozenset(["Archive"])
    title, body, date = external.blog_post("The Blog: Hello", "Hello\nMay\n22\n2009\nposted 3 weeks ago\nArchive\n--\nText here", "The Blog", noise)
    assert (title, body, date) == ("Hello", "Posted May 22, 2009.\n\nText here", "2009-05-22")


def test_captions_and_footers(spark):
    assert one(spark, external.captions(F.col("t")), t=" a [Music]\n b ") == "a b"
    assert one(spark, external.encyclopedia(F.col("t")), t="Text\n\nReferences\nmore\nmore") == "Text"


def test_html():
    page = """<div class="navbox">no</div><p>A <a href=x>b</a> c<p>second<br>line<script>x</script>
    <table class="wikitable"><tr><th>H<th>I<tr><td>1<td>2</table><table class="infobox"><tr><td>HP</td><td>20</td></tr></table>
    <audio data-mwtitle="Cow_moo.ogg"></audio><p>
    References
    gone"""
    text_, tables, sounds, _ = html.page(page)
    assert "H: 1, I: 2" in text_ and "HP: 20" in text_ and "gone" not in text_ and "no" not in text_.split() and tables == [[["H", "I"], ["1", "2"]]] and sounds == ["Cow moo"]
    assert html.post("<title>T</title><article>" + "x" * 90 + "</article>") == ("T", "x" * 90)


def test_scalars(spark):
    assert one(spark, text.word_count(F.col("t")), t="a　b\x1cc\x85d") == 4
    assert one(spark, text.strip(F.col("t")), t="　 a b\x1c\n") == "a b"
    assert one(spark, text.special_ratio(F.col("t")), t="") == 0.0
    assert one(spark, text.rstrip_lines(F.col("t")), t="a \t\nb  ") == "a\nb"
    assert one(spark, text.shingles(F.col("t")), t="A b c d") == ["a b c", "b c d"] and one(spark, text.shingles(F.col("t")), t="a b") == []
    assert one(spark, text.slug_title(F.col("t")), t="it's-2nd-try") == "It'S 2Nd Try"


def test_greedy_split():
    known = frozenset(["the", "inventory", "in"])
    assert tokens.greedy_split("theinventory", known) == "the inventory" and tokens.greedy_split("abcxyz", known) is None and tokens.greedy_split("the", known) is None


def test_byte_pairs(spark):
    df = spark.createDataFrame([(1, "low lower lowest low"), (2, None)], "id long, t string")
    merges = tokens.merges_of(df, "t", 10)
    got = {r.id: r.ids for r in tokens.encoded(df, "id", "t", merges).collect()}
    assert tokens.decode(got[1], merges) == "lowlowerlowestlow" and got[2] == []


def test_byte_pairs_of_more_words_than_the_driver_takes(spark):
    """The merges of all words, also of those beyond the most frequent."""
    r = random.Random(5)
    words = ["".join(r.choice("aab") + r.choice(("n", "nn", "st", "é")) for _ in range(r.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame([(" ".join(words[k : k + 50]),) for k in range(0, 400, 50)], "t string")
    whole = tokens.learn_merges(list(Counter(words).items()), 25)
    assert tokens.merges_of(df, "t", 25, vocabulary=10) == whole == tokens.merges_of(df, "t", 25)

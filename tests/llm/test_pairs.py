from edges import awkward
from pyspark.sql import functions as F

from corvane.llm.pairs import defective_pairs, with_language

SCHEMA = "pair_id long, instruction string, input string, output string"


def defects(spark, rows):
    return {x.pair_id: x.defect for x in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rules(spark):
    q = "How do I craft the Tin Lamp of Oz?"
    rows = [
        (1, q, "", None), (2, q, "", "​"), (3, q, "", "n/a"), (4, q, "", "Answer:"), (5, q, "", "[no answer]"), (6, q, "", "?!"),
        (11, q, "", "how do i craft the tin lamp of oz"), (12, q, "", f"{q} {q}"), (13, q, "", f"You asked: {q}"), (14, "Repeat the next line: Tin is soft.", "", "Tin is soft."),
        (21, q, "", "I'm sorry, but I can't help with that."), (22, q, "", "Leider kann ich dabei nicht helfen."), (23, q, "", "“I can't help you,” says the smith, and hands over a lamp."), (24, q, "", "I cannot place the lamp on water, as the guide puts it."),
        (31, q, "", "El horno está en la aldea y se abre con una llave."), (32, "Translate into Spanish: The lamp is old.", "", "El horno está en la aldea y se abre con una llave."), (33, "¿Dónde está la lámpara y para qué sirve?", "", "The lamp is in the house and it is made of tin."),
        (41, q, "", "42"), (42, q, "", "No."), (43, q, "", "tin"), (44, q, "", "You need:\n- 3 tin bars\n- 2 old lamps"), (45, q, "", "The lamp is safe to touch. (oil"), (46, q, "", "First you take the tin, then you heat it,"),
    ]
    got = defects(spark, rows)
    assert {k for k, v in got.items() if v == "empty"} == {1, 2, 3, 4, 5, 6}
    assert {k for k, v in got.items() if v == "copy"} == {11, 12, 13}
    assert {k for k, v in got.items() if v == "refusal"} == {21, 22}
    assert {k for k, v in got.items() if v == "language"} == {31, 33}
    assert {k for k, v in got.items() if v == "truncated"} == {45, 46}


def test_truncation_by_the_table(spark):
    metals, beasts = ["tin", "copper", "silver", "amber", "cobalt", "jade"], ["golem", "drake", "heron", "miner", "ghoul"]
    full = [f"The {b} drops {i + 3} strands when it is struck with a {m} lever." for i, b in enumerate(beasts) for m in metals] + [f"Seven lamps made of {m} surround the altar in {b.title()}ville." for b in beasts for m in metals]
    rows = [(i, f"What about {i}?", "", t) for i, t in enumerate(full)]
    rows += [(100, "q one", "", "The golem drops 9 strands when it is struck with a"), (101, "q two", "", "Seven lamps made of tin surround"), (102, "q three", "", "Seven lamps made of cobalt surround the altar in Drakeville"), (103, "q four", "", "The heron drops 4 strands when it is struck with a silver lev"), (104, "q five", "", "Seven lamps made of…")]
    got = defects(spark, rows)
    assert got == {100: "truncated", 101: "truncated", 103: "truncated", 104: "truncated"}


def test_short_stubs(spark):
    """Stubs of two or three words beside a longer sibling, and a word alone that breaks off."""
    full = ["You can craft it from tin.", "The old lamp is soft and warm.", "Obsidian glows in the dark.", "It needs a lever. It needs two ropes as well.", "Jade is green.", "Use tin."]
    rows = [(i, f"What about {i}?", "", t) for i, t in enumerate(full)]
    rows += [(100, "q one", "", "You can craft"), (101, "q two", "", "A lever is here. The old"), (102, "q three", "", "Obsid"), (103, "q four", "", "obsid…")]
    rows += [(200, "q five", "", "jade"), (201, "q six", "", "Tin"), (202, "q seven", "", "Use tin"), (203, "q eight", "", "red lamp"), (204, "q nine", "", "Yes"), (205, "q ten", "", "Lamp")]
    assert defects(spark, rows) == dict.fromkeys((100, 101, 102, 103), "truncated")


def test_language(spark):
    rows = [("The house is on the hill and it is old.", "en"), ("Der Ofen ist in der Stadt und er ist alt.", "de"), ("В городе стоит старый дом.", "ru"), ("Tin 5", None), (None, None), ("", None)]
    df = with_language(spark.createDataFrame(rows, "t string, want string"), "t", "got")
    assert [r.got for r in df.collect()] == [w for _, w in rows]


def test_awkward(spark):
    df = awkward(spark, "pair_id", "output").withColumns({"instruction": F.lit(None).cast("string"), "input": F.lit(None).cast("string")})
    got = {x.pair_id: x.defect for x in defective_pairs(df).collect()}
    assert {k: v for k, v in got.items() if v == "empty"} == {2: "empty", 3: "empty", 4: "empty", 6: "empty"}
    assert defective_pairs(df.limit(0)).count() == 0

import random

from edges import awkward

from corvane.llm.sampledocs import Maker
from corvane.llm.spam import Reader, ordinary_writing, spam_pages, spam_shares, train

ORDINARY = [
    "The old lamp stands in the hall, and nobody knows who made it. When it rains, the light of the lamp is seen from the hill.",
    "Version 2.1\n- Fixed a lamp not being lit near the door\n- Added red tin bars to the hall\n- Door range now 5 (was 7)",
    "Mix the flour with the water.\n1. 3 x old tin bars\n2. 5 x red clay cups\n3. 1 x small oak lid\nThen bake it for an hour until it is brown.",
    "https://a.example/x\nThis page tells how the lamp was made and who brought it to the hall.\nhttps://b.example/y\nHere one can read about the door, which is made of oak and very old.",
    "Der Ofen steht in der Stadt, und niemand weiß, wer ihn gebaut hat. Wenn es regnet, ist das Licht auf dem Berg zu sehen.",
]
SPAM = [
    "cheap tin lamp, buy tin lamp, tin lamp online, best tin lamp, tin lamp sale, tin lamp cheap, free tin lamp, tin lamp 2024, top tin lamp, tin lamp shop",
    "#lamp #tin #copper #hall #door #oak #brass #cup #lid #bar #hill #light #rain #oven",
    "[tin lamp](http://a.example/1) | [oak door](http://b.example/2) | [red cup](http://c.example/3) | [old lid](http://d.example/4)",
    "Lamp: https://a.example/1\nDoor: www.b.example/2\nCup - http://c.example/3\nLid https://d.example/4\nBar: e.example/5",
    "[[Tin Lamp]]\n[[Oak Door]]\n[[Red Cup]]\n[[Old Lid|lid]]\n[[Bar of Iron]]",
    "Tin Lamp SKU 10231 9.99 add to cart\nOak Door SKU 55120 19.50 sold out\nRed Cup SKU 31822 3.25 in stock\nOld Lid SKU 90011 1.75 add to cart",
]


def test_pages(spark):
    rows = list(enumerate(ORDINARY + SPAM))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in spam_pages(df, []).collect()} == set(range(len(ORDINARY), len(rows)))


def test_held_out_writing_is_ordinary():
    model = train([])
    _, share = model.shares(Reader(), ordinary_writing(300, seed=77))
    assert (share <= 0.5).mean() > 0.98


def test_share_follows_the_mixture():
    r = random.Random(1)
    model = train([])
    prose = " ".join(ORDINARY[:1] * 4)
    spam = " ".join("tin lamp " + r.choice(["shop", "sale", "free", "map"]) for _ in range(60))
    few, many = model.shares(Reader(), [f"{prose}\n{' '.join(spam.split()[:30])}", f"{ORDINARY[0]}\n{spam}"])[1]
    assert few < 0.5 < many


def test_many_keywords_in_long_pages():
    """Each keyword is far below its share of the page; together they are most of it."""
    r = random.Random(2)
    m = Maker(9)
    model, words = train([]), [m.word() for _ in range(50)]
    prose = "\n".join(ordinary_writing(120, seed=78))
    n = len(prose.split())
    stuffed = [
        " ".join(words * 25), ", ".join(f"{r.choice(words)} {r.choice(words)}" for _ in range(1000)), "\n".join(" ".join(r.choice(words[:40]) for _ in range(10)) for _ in range(100)),
        prose + "\n" + " ".join(r.choice(words[:25]) for _ in range(n * 3 // 2)),
    ]
    fine = [prose, prose + "\n" + " ".join(r.choice(words[:25]) for _ in range(n * 2 // 3)), "\n".join(ORDINARY * 50)]
    share = model.shares(Reader(), stuffed + fine)[1]
    assert (share[:4] > 0.55).all() and (share[4:] < 0.45).all()


def test_too_predictable():
    """Keywords strung together with one small word between them: no piece is surprising, the stretch is too regular for writing."""
    r = random.Random(4)
    m = Maker(11)
    model, words = train([]), [m.word() for _ in range(60)]
    strung = " ".join(f"{r.choice(words)} of" for _ in range(300))
    prose = "\n".join(ordinary_writing(40, seed=79))
    share = model.shares(Reader(), [strung, f"{prose}\n{' '.join([strung] * 20)}", prose, f"{strung}\n{prose}"])[1]
    assert (share[:2] > 0.55).all() and (share[2:] < 0.45).all()


def test_trained_on_a_table(spark):
    prose = spark.createDataFrame([(t,) for t in [*ORDINARY, None, ""]], "text string")
    df = spark.createDataFrame(list(enumerate(SPAM)), "doc_id long, text string")
    assert spam_pages(df, [prose]).count() == len(SPAM)


def test_awkward(spark):
    df = awkward(spark, "doc_id")
    model = train([])
    got = {(r.doc_id, r.words) for r in spam_shares(df, model).collect()}
    assert (3, 0) in got and (4, 0) in got and (2, 0) not in got
    assert spam_pages(df.limit(0), []).count() == 0
    assert 1 not in {r.doc_id for r in spam_pages(df, []).collect()}

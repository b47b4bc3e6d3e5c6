import random
import unicodedata

import pyarrow as pa
import pytest
from edges import awkward
from hypothesis import given, settings, strategies as st

from corvane.llm.codepoints import canonical_column
from corvane.llm.lookalike import canonical_text, lookalike_pairs


def form(s):
    return canonical_column(pa.array([s], pa.string())).to_pylist()[0]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｗｉｄｅ　１２", "wide 12"), ("café", "café"), ("sаt", "sat"), ("a​b­", "ab"), (" a   b \n c ", "a b\nc"), ("x\r\ny z", "x\ny\nz"),
        ("Τοm", "Tom"), ("q̣̇", "q̣̇"), ("한", "한"), ("ﾊﾟ", "パ"), ("sе́t", "sét"), ("﻿a", "a"),
    ],
)
def test_same_look(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("e", "é"), ("a b", "a\nb"), ("ﬁ", "fi"), ("x²", "x2"), ("“a”", '"a"'), ("сор", "cop"), ("a.b", "a b"), ("…", "..."), ("👩‍🚀", "👩🚀")])
def test_different_look(a, b):
    assert form(a) != form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40))
def test_form_is_stable_and_composed(s):
    once = form(s)
    assert form(once) == once
    assert unicodedata.normalize("NFC", once) == once


def test_batches_agree_with_single_rows():
    r = random.Random(2)
    alphabet = "aeo \ń̈аο​ ｗ한각"
    rows = [None, "", *("".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(300))]
    assert canonical_column(pa.array(rows)).to_pylist() == [None if x is None else form(x) for x in rows]
    assert canonical_column(pa.array(rows).slice(5, 50)).to_pylist() == [None if x is None else form(x) for x in rows[5:55]]


def test_pairs(spark):
    rows = [(1, "Tom sat"), (2, "Tοm sat"), (3, "Tom  sat"), (3, "Tom  sat"), (4, "Tom sat"), (5, "tom sat"), (6, None), (7, ""), (8, " "), (None, "Tom​ sat")]
    got = {tuple(x) for x in lookalike_pairs(spark.createDataFrame(rows, "seq long, text string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}


def test_awkward(spark):
    df = awkward(spark)
    assert lookalike_pairs(df).collect() == []
    assert lookalike_pairs(df.limit(0)).count() == 0
    out = canonical_text(df)
    assert out.columns == df.columns and out.count() == df.count()

import pytest
from edges import LONG, awkward

from corvane.llm.bpe import Encoder, load_merges, token_ids, vocabulary_path

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_like_the_library(library, data):
    import duckdb

    texts = [r[0] or "" for r in duckdb.sql(f"select text from '{data}/documents.parquet'").fetchall()]
    texts += ["<|endoftext|> a", "don't 'LL we've  \n\n x\t", "🙂🙂 日本語 é", "a" * 3000, " ", "", "aaaa aaaa", "  x", LONG[:20000]]
    flat, offsets = Encoder(*load_merges(PATH)).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == library(texts)


def test_blocks_don_t_matter(spark, library, monkeypatch):
    from corvane.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    texts = ["some text here", "", None, "and more of it " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.ids for r in token_ids(df).orderBy("doc_id").collect()] == library([t or "" for t in texts])


def test_awkward(spark, library):
    df = awkward(spark, "doc_id")
    got = token_ids(df)
    assert got.columns == ["doc_id", "ids"] and got.count() == df.count()
    assert [r.ids for r in got.where("doc_id in (2, 3)").collect()] == [[], []]
    assert [r.ids for r in got.where("doc_id = 5").collect()] == library([LONG])
    assert token_ids(df.limit(0)).count() == 0

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
ENCODER = bpe.PrefixEncoder(bpe.vocabulary_path(), cache_pieces=50)
REFERENCE = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
REFERENCE.encode_special_tokens = True


def plain(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcdeghilnorst  ABT'.,!?019\n\té漢🎧​ß-_")) | st.text())
def test_equals_the_public_encoder(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 2000, "the" * 1500, " " * 999, "<|endoftext|>", "I'll we'VE", "=-" * 700, "\x00\x7f"])
def test_runs(text):
    assert ENCODER.encode(text) == plain(text)


def test_the_corpus(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", None), (3, "hello world", "z"), (None, "  ", "w")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df).collect()]
    assert got == [(1, []), (2, []), (3, plain("hello world")), (3, plain("hello world")), (None, plain("  "))]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in bpe.count_tokens(df.select("doc_id", "text")).collect()] == [0, 0, 2, 2, len(plain("  "))]

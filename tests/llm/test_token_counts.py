import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from pulsegrid.llm.token_counts import PIECE_CHARS, PairCounter, count_tokens, words_of
from tests_llm_data import awkward_texts, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_counts_are_those_of_the_library(library):
    count = PairCounter(MODEL)
    for _ in range(2):  # the second time from memory
        for text in awkward_texts():
            assert count(text) == len(library.encode(text)), text[:40]


def test_long_texts_are_split_between_words(library):
    text = "some words  and   gaps " * (PIECE_CHARS // 10) + "x" * 50 + " end"
    parts = list(words_of(text))
    assert len(parts) > 2 and "".join(map("".join, parts)) == "▁" + text.replace(" ", "▁")
    assert PairCounter(MODEL)(text) == len(library.encode(text))


def test_memory_is_bounded(monkeypatch, library):
    import pulsegrid.llm.token_counts as module

    monkeypatch.setattr(module, "REMEMBERED_CHARS", 20)
    count = PairCounter(MODEL)
    for text in ["first words here", "others come later on", "x" * 1000, "first words again"]:
        assert count(text) == len(library.encode(text))
        assert len(count.counts) < 12 and not any(len(w) > 64 for w in count.counts)


def test_documents(spark, library):
    docs = documents(spark).withColumnRenamed("score", "n_tokens").withColumnRenamed("n", "n_bytes")
    got = {r.doc_id: r for r in count_tokens(docs, MODEL, limit=100).collect()}
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == want.keys()
    for k, text in want.items():
        n = len(library.encode(text))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(text.encode()), n, n > 100)


def test_odd_tables(spark):
    assert count_tokens(documents(spark).limit(0), MODEL).count() == 0
    rows = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b"), (None, "")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_bytes, r.n_tokens) for r in count_tokens(rows, MODEL).collect()) == [
        ("", 0, 0), ("", 0, 0), ("1", 3, 2), ("1", 3, 2)]

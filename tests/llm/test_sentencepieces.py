import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from pulsegrid.llm.sentencepieces import TextEncoder, encode_documents
from tests_llm_data import awkward_texts, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_ids_are_those_of_the_library(library):
    texts = awkward_texts()
    encode = TextEncoder(MODEL)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encode(texts)):
            assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text[:40]


def test_documents(spark, library):
    docs = documents(spark)
    got = {r.doc_id: r for r in encode_documents(docs, MODEL).collect()}
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == want.keys()
    for k, text in want.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert got[k].decoded == library.decode(ids)


def test_empty_table(spark):
    assert encode_documents(documents(spark).limit(0), MODEL).count() == 0

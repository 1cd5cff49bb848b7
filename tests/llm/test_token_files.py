import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pulsegrid.llm import token_files as tf
from pulsegrid.llm.shared import Tables
from tests_llm_data import awkward_texts, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_library():
    library, encode = Tokenizer.from_file(PATH), tf.WordEncoder(PATH, 2)
    texts = awkward_texts() + ["A.B, c!? d's e... f-g", "<|ENDOFTEXT|> x", "naïve, ÉCOLE. İx! Σς."]
    for _ in range(2):
        flat, sizes = encode([t.encode() for t in texts])
        for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text[:40]


def test_new_words_are_encoded_without_offsets():
    encode = tf.WordEncoder(PATH, 2)
    library = encode.library

    class Fast:
        encode_batch_fast = staticmethod(library.encode_batch_fast)

    encode.library = Fast()
    texts = ["plain words, naïve words; ÉCOLE 12", "", ". ,", "words"]
    flat, sizes = encode([t.encode() for t in texts])
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_words_that_come_again_stay_remembered(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED_WORDS", 40)
    library, encode, learned = Tokenizer.from_file(PATH), tf.WordEncoder(PATH, 2), []
    learn = encode.learn
    encode.learn = lambda words: (learned.extend(words), learn(words))
    common = "again, and naïve again; it is. ÉCOLE"
    for k in range(30):
        texts = [common, " ".join(f"single{chr(97 + k % 26)}{chr(97 + j)}." for j in range(20)) + f" x{k}", ""]
        flat, sizes = encode([t.encode() for t in texts])
        for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert learned.count(b"again,") == 1 and len(encode.words) < 100


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for n, top in [(1, 5), (7, 2), (5000, 3), (5000, 40_000), (20_000, 60)]:
        docs = [rng.integers(0, top, rng.integers(1, 50)).astype(np.uint32) for _ in range(n // 10 + 1)]
        docs.append(np.full(4000, 1, np.uint32))
        flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        payload = tf.compress(flat, sizes, 49_408)
        block = tf.Block(payload)
        assert all(a.tolist() == b.tolist() for a, b in zip(block.documents(), docs, strict=True))
        assert block.document(len(docs) - 1).tolist() == docs[-1].tolist() and block.document(0).tolist() == docs[0].tolist()
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
            if a < b:
                assert block.tokens(a, b).tolist() == flat[a:b].tolist()
    phrases = [rng.integers(0, 40_000, 6) for _ in range(30)]
    flat = np.concatenate([phrases[k] for k in rng.integers(0, 30, 3000)]).astype(np.uint32)
    payload = tf.compress(flat, np.array([len(flat)]), 49_408)
    assert tf.Block(payload).document(0).tolist() == flat.tolist()
    assert len(payload) < 0.8 * len(flat)  # a phrase of six ids takes one or two symbols of two bytes


def test_documents(spark):
    docs = documents(spark)
    library, start = Tokenizer.from_file(PATH), 0
    blocks = tf.write_documents(docs, PATH, Tables(spark, "t"))
    got = {r.doc_id: r for r in tf.read_documents(blocks).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "b"), (3, "z"), (3, "y"), (3, "y"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tf.read_documents(tf.write_documents(docs, PATH, Tables(spark, "t"))).collect())
    assert got == [(0, None, 1), (1, None, 2), (3, 3, 2), (5, 3, 2), (7, 3, 2)]
    assert tf.read_documents(tf.write_documents(docs.limit(0), PATH, Tables(spark, "t"))).count() == 0

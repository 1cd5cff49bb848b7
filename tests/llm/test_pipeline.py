from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
import corpus_pipeline
from pulsegrid.llm import mixing, rule_quality
from test_exact_dedup import brute as brute_exact
from test_jaccard_join import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_classifier(spark, stages):
    before, after = stages[0]
    rated = rule_quality.score(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(rated.where("predicted = 1"))
    assert 0.5 * before.count() < after.count() < before.count()


def test_exact(stages):
    before, after = stages[1]
    assert ids(after) == sorted(i for i, v in brute_exact([(r.doc_id, r.text) for r in before.collect()]).items() if v[2])


def test_near(stages):
    before, after = stages[2]
    assert ids(after) == sorted({c for _, c in brute_near([(r.doc_id, r.text) for r in before.collect()]).values()})


def test_mix(stages):
    before, after = stages[3]
    count, taken = Counter(ids(after)), {r.doc_id: r for r in mixing.taken_words(before).collect()}
    assert all(abs(count[i] - r.taken / max(r["size"], 1)) < 1 for i, r in taken.items()) and max(count.values()) <= 2


def test_encoding(stages):
    before, after = stages[4]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in before.collect()}
    assert ids(after) == ids(before)
    for r in after.collect():
        want = library.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == library.decode(want)


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import robust_rules as rr
from tests_llm_data import documents


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_base_rules(spark):
    docs = documents(spark)
    extra = [(-1, "a b c d e f g h " * 3, "x", "y", 0), (-2, "l one\nl two\n\nl one\n  \n  \nl one", "x", None, 0),
             (-3, "w " * 40 + " ".join(f"v{k}" for k in range(200)), None, None, 0)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rr.base_rules(docs).collect()}
    assert got == want


def test_chi_square():
    assert abs(rr.chi2_at(0.95, 4) - 9.4877) < 1e-3 and abs(rr.chi2(5.3853, 4) - 0.75) < 1e-4


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 3
    rows = spark.createDataFrame([("g", "l", 10**9, *map(float, v)) for v in x], ["g", "lang", "n_words", *rr.AXES])
    p = rr.OutlierParams(prior=0.0)
    got = rr.distances(rows, rr.moments(rows, p), p).toPandas()
    cov = np.cov(x.T, bias=True) + np.diag(np.square(p.least))
    d = got[rr.AXES].to_numpy() - x.mean(axis=0)
    assert np.allclose(got.d2, np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), rtol=1e-6)


def test_outliers_do_not_hide_each_other(spark):
    """A quarter of far rows would spoil a plain covariance; the trusted part is free of them."""
    rng = np.random.default_rng(2)
    near, far = rng.normal(size=(300, 4)), rng.normal(size=(90, 4)) * 0.1 + 8
    rows = [("g", "l", 10**9, k >= 300, *map(float, v)) for k, v in enumerate(np.vstack([near, far]))]
    df = spark.createDataFrame(rows, ["g", "lang", "n_words", "far", *rr.AXES])
    p = rr.OutlierParams(part=0.7, prior=0.0)
    got = rr.distances(df, rr.estimate(df.drop("far"), p), p).toPandas()
    limit = rr.chi2_at(1 - p.rare, 4)
    assert (got[got.far].d2 > limit).all() and (got[~got.far].d2 <= limit).mean() > 0.99


def test_documents(spark):
    docs = documents(spark)
    got = rr.quality_rules(docs)
    assert got.columns[-4:] == ["n_repeat_words", "base_failed", "outlier_distance", "kept"]
    rows = got.collect()
    assert len(rows) == docs.count() and not any(r.kept and r.base_failed for r in rows)
    assert {r.doc_id: r.kept for r in rr.quality_rules(docs.repartition(5)).collect()} == {r.doc_id: r.kept for r in rows}
    good = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    passed = got.where("NOT base_failed").join(good, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert passed > 0.99


def test_one_bad_axis_alone_rejects_at_any_length(spark):
    """Symbols, repeated lines or repeated passages reject a document by themselves; one of each in a rare text does not."""
    rng = np.random.default_rng(4)
    text = lambda n: "\n".join(" ".join(f"w{k:04d}" for k in rng.integers(0, 9999, 10)) for _ in range(n // 10))
    rows = [(k, text(int(rng.choice([50, 100, 300, 1000]))), "en", "s") for k in range(400)]
    rows = [(k, t + "\n" + "\n".join(t.split("\n")[:2]) if k % 25 == 0 else t, la, s) for k, t, la, s in rows]
    bad = []
    for n in (50, 100, 300, 1000):
        t = text(n)
        said = "".join("#" if k % 4 == 0 and c != "\n" else c for k, c in enumerate(t))
        bad.append((10_000 + n, said, "en", "s"))  # a quarter symbols
        bad.append((20_000 + n, "\n".join(f"{x}\nyes\nno" for x in t.split("\n")), "en", "s"))  # two of three lines are repeated
        if n >= 300:  # 28 % of the words are in passages said again
            part = t.split("\n")
            k = round(0.14 * len(part) / 0.86)
            bad.append((30_000 + n, "\n".join(x + " " for x in part) + "\n" + "  \n".join(part[:k]), "en", "s"))
    got = rr.quality_rules(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")).toPandas()
    got = got.set_index("doc_id")
    assert not got.loc[[r[0] for r in bad]].base_failed.any()
    assert not got.loc[[r[0] for r in bad]].kept.any()
    assert got.loc[[r[0] for r in rows]].kept.mean() > 0.97


def test_empty_table(spark):
    assert rr.quality_rules(documents(spark).limit(0)).count() == 0

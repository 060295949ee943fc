"""Learned operators on held-out rows, and search against brute force."""
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from arbor.llm import ann, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(score, y):
    r = pd.Series(score).rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def held_out(df, labels, label, k, held):
    got = df.toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % k == held for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    x = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    return x.score.to_numpy(), x[label].to_numpy()


def test_quality_held_out(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    s, y = held_out(quality.score(docs, quality.fit(docs, labels)), labels, "quality", 3, 1)
    assert auc(s, y) > 0.97 and ((s >= 0.5) == y).mean() > 0.95


def test_toxicity_held_out(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = toxicity.fit(docs, labels)
    s, y = held_out(toxicity.score(docs, model), labels, "toxic", 5, 0)
    # other languages than English have too few toxic examples to learn from at this size
    assert auc(s, y) > 0.8 and ((s >= 0.5) & (y == 0)).sum() == 0
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, model).where("predicted = 0").count()


def test_langid_held_out(spark):
    docs = read(spark, "documents")
    got = langid.identify(docs, langid.fit(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    x = got[got.held_out]
    assert (x.lang == x.lang_pred).mean() > 0.98


def test_scores_do_not_see_labels_or_other_columns(spark):
    """Other values in the columns that are never inputs leave the model and scores as
    they are, and held-out labels do not matter."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    upset = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a = toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "score").toPandas().sort_values("doc_id").score.to_numpy()
    b = toxicity.score(docs, toxicity.fit(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source"), upset)).select("doc_id", "score").toPandas().sort_values("doc_id").score.to_numpy()
    assert (a == b).all()


def test_nearest_examples_are_exact(spark, monkeypatch):
    """Block-max search gives what all cosines give, whatever the blocks."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    texts = [r.text or "" for r in docs.limit(200).collect()]
    want = None
    for block in (4, 64, 4096):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        m = toxicity.fit(docs, labels)
        got = [m.nearest(*m.vector(t)) for t in texts]
        if want is None:
            want = got
        for (a, i), (b, j) in zip(got, want):
            assert np.allclose(a, b, atol=1e-12) and (i == j).all()


def test_edges(edge, nothing, labels):
    n = edge.count()
    for module in (quality, toxicity):
        model = module.fit(edge, labels)
        got = module.score(edge, model).toPandas()
        assert len(got) == n and got.score.between(0, 1).all()
        assert module.score(nothing, module.fit(nothing, labels)).count() == 0
        blank = module.score(edge, module.fit(nothing, labels)).toPandas()
        assert len(blank) == n and blank.score.between(0, 1).all()
    kept = toxicity.accepted(edge, toxicity.fit(edge, labels))
    assert kept.columns == edge.columns
    got = langid.identify(edge, langid.fit(edge)).toPandas()
    assert len(got) == n and got.score.between(0, 1).all()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").lang_pred
    assert by[0] == by[1] == by[2] == "und" and by[3] in ("en", "de")
    assert langid.identify(edge, langid.fit(nothing)).where("lang_pred <> 'und'").count() == 0


def brute(vectors, queries, k=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        s = (x * np.asarray(vectors[q], float)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_search_recall(spark):
    df = read(spark, "embeddings")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0])
    got = ann.search(df, df.where("vec_id % 20 = 0")).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, g in got.groupby("query_id"):
        exact = dict(brute(vectors, [q], len(vectors))[q])
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and len(g) == min(20, len(vectors) - 1) and q not in set(g.vec_id)
        assert np.allclose(g.score, [exact[i] for i in g.vec_id], atol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        hits += len(set(g.vec_id) & {i for i, _ in want[q]})
    assert set(got.query_id) == set(want) and hits >= 0.9 * sum(map(len, want.values()))


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (40, [0.0, 0.0]), (60, None), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (80, []), (8, [-3.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 8, -3.0), (20, 1, 8, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    one = spark.createDataFrame([(20, [3.0]), (20, [9.0]), (4, [2.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(one, one.where("vec_id = 20")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 4, 6.0)]
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    assert ann.search(df, df.where("false")).count() == 0


def test_shape_and_tail_of_long_words():
    from arbor.llm.quality import word_columns

    long = "ab" * 40
    assert word_columns(long + "c1!")[2] == word_columns("c1!")[2] != word_columns(long)[2]
    assert word_columns(long + "-9")[1] == word_columns("a-9")[1]


def test_blank_quality_does_not_follow_the_sample(spark):
    """A blank text gets the share of all labelled rows, however few of them are sampled."""
    df = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} text") for i in range(200)] + [(1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    small, large = (quality.fit(df, labels, sample=n) for n in (20, 400))
    assert small.prior == large.prior
    blank = [r.score for r in quality.score(df, small).where("doc_id >= 1000").collect()]
    assert blank == [small.prior] * 2


def test_a_language_of_long_texts_is_learned(spark, monkeypatch):
    from arbor.llm import _common

    rng = random.Random(3)
    text = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcde", 20), "aa") for i in range(40)] + [(100 + i, text("vwxyz", 3000), "zz") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(_common.chosen_texts, "__defaults__", (8000,))
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 76

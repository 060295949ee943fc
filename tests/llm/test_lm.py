"""The language model against plain dictionaries."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arbor.llm import lm

SF = "/root/testdata/sf0.001"


def split(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), b" "]


def plain(rows):
    """doc_id -> (tokens, known, N, base, score by quantised counts without false hits)."""
    train = [split(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    uni, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    total, distinct, starts = sum(uni.values()), len(uni), len(train)
    value = lambda c: 0.0 if not c else 1.0 if c == 1 else 2.0**math.floor(math.log2(c)) * 1.386
    out = []
    for i, text in rows:
        t = split(text)
        base = sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in t)
        s = 0.0
        for v, w in zip([None, *t], t):
            p0 = value(uni[w]) / (total + 1) if uni[w] else 1 / ((total + 1))
            c, c_v = value(pairs[v, w]), value(starts if v is None else uni[v])
            s += min(0.0, math.log10((c + lm.KAPPA * p0) / (max(c, c_v) + lm.KAPPA)))
        out.append((i, len(t), sum(uni[w] > 0 for w in t), total, base, s))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_scores_match_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))
    got = rows_of(lm.report(docs))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12)
    tokens = sum(w[1] for w in want)
    # false hits of the filter lift unseen n-grams a little
    assert sum(abs(g[5] - w[5]) for g, w in zip(got, want)) / tokens < 0.02
    assert {r.held_out for r in lm.report(docs).collect()} == {True, False}
    held = [(g[4], g[5]) for g in got if zlib.crc32(str(g[0]).encode()) % 7 == 2]
    assert sum(s for _, s in held) > sum(b for b, _ in held)


def test_small_head_many_segments_and_blocks_that_travel(spark, monkeypatch):
    """Rare words are joined, chunks cut texts, and both ways of scoring agree."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))
    train = docs.where(lm.fold(lm.F.col("doc_id"), 7) != 2)
    model = lm.fit(train, head=50, segment_tokens=1500)
    assert model.n_segments > 3 and len(model.head.counts) < 50
    here = rows_of(lm.score(docs, model))
    monkeypatch.setattr(lm, "SALT_BYTES", 4000)
    far = rows_of(lm.score(docs, model, most_bytes=0))
    assert [g[:4] for g in here] == [g[:4] for g in far] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in here], [w[4] for w in want], rtol=1e-12)
    assert np.allclose([g[4:] for g in here], [g[4:] for g in far], rtol=1e-9)


def test_rare_words_keep_their_own_counts(spark):
    """Beyond the head too, a word's probability follows its count: no shared value."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))
    model = lm.fit(docs.where(lm.fold(lm.F.col("doc_id"), 7) != 2), head=50, segment_tokens=1500)
    for most in (lm.BROADCAST_BYTES, 0):
        got = rows_of(lm.score(docs, model, most_bytes=most))
        assert sum(abs(g[5] - w[5]) for g, w in zip(got, want)) / sum(w[1] for w in want) < 0.02


def test_long_texts_are_cut_at_separators(monkeypatch):
    texts = [b"one two  three\tfour " * 30, b"", b"x" * 500, b" a b "]
    whole = [np.concatenate(x) for x in zip(*[p[3:6] for p in lm.tokens(texts)])]
    monkeypatch.setattr(lm, "CHUNK", 16)
    cut = [np.concatenate(x) for x in zip(*[p[3:6] for p in lm.tokens(texts)])]
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 300, 5000)
    data = lm.build(keys, counts)
    got = lm.probe(keys, data, 0, len(data) * 8)
    assert (got >= lm.level(counts)).all() and (got == lm.level(counts)).mean() > 0.95
    assert (lm.probe(rng.integers(0, 2**63, 5000).astype(np.uint64), data, 0, len(data) * 8) > 0).mean() < 0.04


def test_edge_rows(edge, edge_rows, nothing):
    got = rows_of(lm.report(edge))
    want = sorted(plain([(r[0], r[1]) for r in edge_rows]), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)
    assert lm.report(nothing).collect() == []
    alone = edge.where("doc_id = 2").select("doc_id", "text")
    assert lm.score(alone, lm.fit(nothing)).first().score == pytest.approx(0.0)

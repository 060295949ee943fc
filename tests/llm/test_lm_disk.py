"""The language model where its segments travel: what it writes, and texts cut into parts."""
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from arbor.llm import lm


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_travelling_segments_write_less_than_the_texts(spark, monkeypatch):
    """A row of 39 bytes for every token is several times the input; texts are written
    compressed, keys of many segments get a byte each."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lm.fit(docs, segment_tokens=3000)
    assert model.n_segments > 20
    written, kept = [], lm.staged

    def staged(df, what):
        out = kept(df, what)
        written.append(sum(f.stat().st_size for f in Path(out._stage_path.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(lm, "staged", staged)
    far = rows_of(lm.score(docs, model, most_bytes=0))
    texts, here = docs.agg(F.sum(F.octet_length("text"))).first()[0], rows_of(lm.score(docs, model))
    assert [f[:4] for f in far] == [h[:4] for h in here] and np.allclose([f[4:] for f in far], [h[4:] for h in here], rtol=1e-9)
    assert sum(written[:-1]) < texts


def test_texts_longer_than_a_part(spark, edge, monkeypatch):
    """Parts of a long text are one row, whichever separators they end with; copies of a
    segment for some of the parts change nothing."""
    blank = spark.createDataFrame([(900, "a b" + " \t\n" * 3000 + "c a b"), (901, "a b c"), (902, "x" * 9000)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(blank)
    model = lm.fit(docs, head=40, segment_tokens=20_000)
    here = rows_of(lm.score(docs, model))
    monkeypatch.setattr(lm, "PART_BYTES", 2500, raising=False)
    monkeypatch.setattr(lm, "SALT_BYTES", 10_000)
    far = rows_of(lm.score(docs, model, most_bytes=0))
    assert model.n_segments > 2 and len(far) == docs.count()
    assert [f[:4] for f in far] == [h[:4] for h in here] and np.allclose([f[4:] for f in far], [h[4:] for h in here], rtol=1e-9)


def test_keys_travel_as_differences():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        key = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) & lm._UPPER)
        assert (lm._unpacked(lm._packed(key)) == key).all()
    assert len(lm._packed(key)) < 6.1 * len(key)
    ends = np.array([0, lm._UPPER], np.uint64)
    assert (lm._unpacked(lm._packed(ends)) == ends).all()

"""What the near-duplicate stage writes beside its texts."""
import random
from pathlib import Path

from pyspark.sql import functions as F

from arbor.llm import simhash


def test_near_duplicates_write_less_than_their_texts(spark, monkeypatch):
    """Sets of shingles take more bytes than the texts; no stage may write them, and
    copies of a text, rows of one name, stay one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(800)) for _ in range(40)]
    rows = [(10 * k + c, t if c < 2 else t + " " + word()) for k, t in enumerate(texts) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, kept = [], simhash.staged

    def staged(df, what):
        out = kept(df, what)
        written.append(sum(f.stat().st_size for f in Path(out._stage_path.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(simhash, "staged", staged)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [10 * k for k in range(40)]
    distinct = docs.select("text").distinct().agg(F.sum(F.octet_length("text"))).first()[0]
    assert sum(written) < 0.5 * distinct

"""What a task of the resampler has in memory at a time."""
from pyspark.sql import functions as F

from arbor.llm import resample


def test_batches_and_statements_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    """A task's memory follows its Arrow batch and the text of one statement: neither may
    take all rows that Spark or the task would put together by default."""
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 1200).alias("text"))
    plain, out = resample.pieces, str(tmp_path / "sizes")

    def pieces(batch, **kw):
        for first, texts in plain(batch, **kw):
            with open(out, "a") as f:
                f.write(f"{batch.nbytes} {sum(map(len, texts))} {len(texts)}\n")
            yield first, ["a few words"] * len(texts)

    monkeypatch.setattr(resample, "pieces", pieces)
    assert resample.resample(docs, docs.limit(0)).count() == 2000
    sizes = [tuple(map(int, x.split())) for x in open(out)]
    assert sum(n for *_, n in sizes) == 2000 and sum(t for _, t, _ in sizes) > 10_000_000
    assert max(b for b, *_ in sizes) < 6 << 20 and max(t for _, t, _ in sizes) < 1.1 * (1 << 20)

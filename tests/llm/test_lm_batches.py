"""What a task of the language model has in memory at a time."""
from arbor.llm import lm


def test_blocks_come_in_batches_bounded_by_bytes(spark, monkeypatch, tmp_path):
    """A segment's blocks are few large rows: a batch of as many rows as Spark counts to
    by default would hold them all."""
    docs, plain, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(16), lm._filters, str(tmp_path / "sizes")

    def filters(batches):
        def seen():
            for b in batches:
                with open(out, "a") as f:
                    f.write(f"{b.nbytes} {b.num_rows}\n")
                yield b
        yield from plain(seen())

    monkeypatch.setattr(lm, "_filters", filters)
    monkeypatch.setattr(lm, "BATCH_BYTES", 1 << 16, raising=False)
    model = lm.fit(docs)
    sizes = [tuple(map(int, x.split())) for x in open(out)]
    assert model.n_segments == 1 and sum(n for _, n in sizes) >= 16
    total = sum(b for b, _ in sizes)
    assert max(b for b, _ in sizes) < total / 3 and total > 500_000

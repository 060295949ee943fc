"""FLAC media columns: texts as payloads, stored losslessly, read back, cut into blocks.

encoded() pads each text's bytes to a positive multiple of UNIT and encodes them; store()
writes the streams to the shared folder and reads them back; blocks of PCM are decoded
from the stored streams with every checksum verified, each with its sample offset, so
that a reader can seek (pcm_blocks() gives them as rows, report() sums them up again for
each document).  Null and empty texts are UNIT zero bytes.  Long texts are coded in
bounded chunks.  Rows repeat as in the input; other columns are ignored.  Media whose
checksums fail stop the job with ValueError; null media have no blocks.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from ._common import pieces, schema_with, staged, text_of

UNIT = 64
BATCH = 1 << 20


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the streams of encoded(), written and read back."""
    return staged(encoded(docs), "media")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a FLAC stream."""
    def run(batches):
        for b in batches:
            for at, texts in pieces(b, most_bytes=BATCH):
                raw = [t.encode() for t in texts]
                media = flac.encode([r + bytes(-len(r) % UNIT or (0 if r else UNIT)) for r in raw])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())],
                                                 names=["doc_id", "n_bytes", "media"])

    d = docs.select("doc_id", text_of().alias("text"))
    return d.mapInArrow(run, schema_with(d, ["doc_id"], "n_bytes long, media binary"))


def _groups(column, most: int = BATCH):
    start, size, held = 0, 0, []
    for i in range(len(column)):
        m = column[i].as_py()
        held.append(m)
        size += len(m)
        if size >= most:
            yield start, held
            start, size, held = i + 1, 0, []
    if held:
        yield start, held


def features(samples: np.ndarray) -> str:
    """Peak, zero crossings, sum of absolute samples and of absolute differences of mono
    samples."""
    return f"{int(np.abs(samples).max(initial=0))}:{int(np.count_nonzero(np.diff(np.signbit(samples))))}:{int(np.abs(samples).sum())}:{int(np.abs(np.diff(samples)).sum())}"


def _blocks(streams: list[bytes]):
    """For each stream (sample_offset, byte_offset, n_samples, pcm) of its blocks, pcm as
    signed little-endian 32-bit samples, channels interleaved."""
    for samples, frames in flac.decode(streams):
        yield [(first, byte, n, samples[first:first + n].astype("<i4").tobytes()) for first, byte, n in frames.tolist()]


def report(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored streams give when read back."""
    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            for at, held in _groups(b.column(2)):
                cols = [[] for _ in range(6)]
                for m, blocks in zip(held, _blocks(held)):
                    samples = np.zeros(sum(n for _, _, n, _ in blocks), np.int64)
                    for first, _, n, pcm in blocks:
                        samples[first:first + n] = np.frombuffer(pcm, "<i4")
                    payload = (samples + 128).astype(np.uint8).tobytes()
                    for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), features(samples))):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                part = b.slice(at, len(held))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                                 names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema_with(media, ["doc_id", "n_bytes"], ddl))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, byte_offset, n_samples, pcm: a row per block of each
    stream, pcm as signed little-endian 32-bit samples, channels interleaved."""
    def run(batches):
        for b in batches:
            for at, held in _groups(b.column(1)):
                cols = [[] for _ in range(5)]
                for doc, blocks in zip(b.column(0).slice(at, len(held)).to_pylist(), _blocks(held)):
                    for block in blocks:
                        for c, v in zip(cols, (doc, *block)):
                            c.append(v)
                kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "sample_offset", "byte_offset", "n_samples", "pcm"])

    d = media.where(F.col("media").isNotNull()).select("doc_id", "media")
    return d.mapInArrow(run, schema_with(d, ["doc_id"], "sample_offset long, byte_offset long, n_samples int, pcm binary"))

"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Features of a text are counted into WIDTH hashed columns: lower-case words, word shapes
(letters and digits folded, runs collapsed) and the character-type tail of each word.
Logarithmic counts are weighted by inverse document frequency and normalised; one more
column is the root of the share of words that repeat the word before, times REPEATS.  A
truncated singular value decomposition of the
training sample gives RANK latent directions.  The labelled latent vectors are
broadcast (SAMPLE * RANK floats); each batch of documents is multiplied with blocks of
them, and the NEIGHBOURS most similar vote with weights of their similarity.

Training uses at most SAMPLE labelled rows (and SAMPLE_BYTES of their text) outside the
held-out fold; the idf belongs to
that model.  Null and empty texts have no features and get the training base rate.
Equally similar neighbours are taken in training order (texts in ascending order).
Without labelled rows the score is 0.5.  Rows repeat as in the input; extra columns are
ignored.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, labelled_sample, pieces, schema_with, text_of

#: Labelled rows fitted on (half of each label at most), hashed columns, latent rank.
SAMPLE = 3200
WIDTH = 4096
RANK = 64
NEIGHBOURS = 24
FOLDS, HELD = 3, 1
REPEATS = 1.5
#: Weight of a neighbour: max(0, cosine) to this power.
POWER = 4
MEMO = 400_000
BLOCK = 1024


def _column(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode("utf-8", "surrogatepass")) % (WIDTH - 1)


class _Kinds(dict):
    """str.translate table: upper-case A, other letters a, digits 0, the rest itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        self[code] = k
        return k


_KINDS = _Kinds()
_collapse = re.compile(r"(.)\1+", re.S).sub


def word_columns(word: str) -> tuple[int, int, int]:
    kinds = word.translate(_KINDS)
    return _column("w", word.lower()), _column("s", _collapse(r"\1", kinds)), _column("t", kinds[-3:].lower())


class Words(dict):
    """Dense ids of words, given out on first sight together with their columns."""

    def __init__(self):
        super().__init__()
        self.columns = np.zeros((MEMO, 3), np.int32)

    def __missing__(self, word: str) -> int:
        i = len(self)
        self[word] = i
        self.columns[i] = word_columns(word)
        return i


class Counter:
    """Dense hashed counts of batches of texts, the share of repeats last; word columns
    are memoised."""

    def __init__(self):
        self.words = Words()

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH), np.float32)
        for i, t in enumerate(texts):
            words = t.split()
            for at in range(0, len(words), MEMO // 2):
                some = words[at:at + MEMO // 2]
                if len(self.words) + len(some) > MEMO:
                    self.words.clear()
                w = np.fromiter(map(self.words.__getitem__, some), np.int64, len(some))
                out[i] += np.bincount(self.words.columns[w].ravel(), minlength=WIDTH)
                out[i, -1] += np.count_nonzero(w[1:] == w[:-1])
            out[i, -1] /= max(1, len(words))
        return out


class Model:
    def __init__(self, texts: list[str], y: list[int], rank: int = RANK, counts: dict[int, int] | None = None):
        self.y = np.asarray(y, np.float32)
        # of all labelled rows: the sample's share would follow the sample's size
        counts = counts or {0: len(y) - sum(y), 1: sum(y)}
        self.base = counts.get(1, 0) / sum(counts.values()) if sum(counts.values()) else 0.5
        # each label gets the same total weight, as the sample does not keep their shares
        share = np.array([max(1, (self.y == k).sum()) for k in (0, 1)], np.float32)
        self.weight = 1 / share[self.y.astype(int)] if len(y) else self.y
        self.prior = self.base
        counter = Counter()
        a = np.concatenate([counter.counts(texts[i:i + 256]) for i in range(0, len(texts), 256)]) if texts else np.zeros((0, WIDTH), np.float32)
        self.idf = np.log((1 + len(texts)) / (1 + (a > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        a = self.scaled(a)
        rng = np.random.default_rng(7)
        q = rng.standard_normal((WIDTH, min(rank + 16, WIDTH))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(a.T @ (a @ q))
        _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
        self.basis = np.ascontiguousarray((q @ vt.T)[:, :rank])
        self.known = self.latent(a)

    def scaled(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x[:, -1] = 0
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        x[:, -1] = REPEATS * np.sqrt(counts[:, -1])
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not len(some) or not len(self.known):
            return out
        z = self.latent(self.scaled(counts[some]))
        k = min(NEIGHBOURS, len(self.known))
        best = np.full((len(z), 0), 0.0, np.float32)
        who = np.zeros((len(z), 0), np.int64)
        for at in range(0, len(self.known), BLOCK):
            sim = np.concatenate([best, z @ self.known[at:at + BLOCK].T], axis=1)
            idx = np.concatenate([who, np.broadcast_to(np.arange(at, min(at + BLOCK, len(self.known))), (len(z), sim.shape[1] - best.shape[1]))], axis=1)
            # a stable sort: of equals the earlier example, which stands further left
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            best, who = np.take_along_axis(sim, top, 1), np.take_along_axis(idx, top, 1)
        w = np.maximum(best, 0).astype(np.float64) ** POWER * self.weight[who]
        total = w.sum(axis=1)
        good = (w * self.y[who]).sum(axis=1)
        out[some] = np.where(total > 0, good / np.maximum(total, 1e-300), self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    rows, counts = labelled_sample(docs, labels, "quality", folds, held, sample // 2)
    rows = sorted({(t, y) for _, t, y in rows})
    return Model([t for t, _ in rows], [y for _, y in rows], counts=counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    data = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, counter = shared.value, Counter()
        for b in batches:
            for at, texts in pieces(b, most_bytes=1 << 19):
                s = np.concatenate([m.score(counter.counts(texts[k:k + 256])) for k in range(0, len(texts), 256)])
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return data.mapInArrow(run, schema_with(data, ["doc_id", "held_out"], "score double, predicted int"))

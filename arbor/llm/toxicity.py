"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-case words of the sample, all of them.  A term weighs (1 + log tf)
times its idf times its relevance: FLOOR, plus the part of its log-odds between toxic and
clean examples that exceeds CERTAIN standard errors.  (Plain TF-IDF finds 30 of 97
held-out toxic texts at sf0.1, since a few insults drown in long prose.)  For the
relevance a word counts once for every different word before it, so that copies of one
text do not make its words evidence.  Words that the sample lacks weigh as the rarest
ones with FLOOR: they only lengthen the vector.

Labelled examples lie in an inverted index that is cut into blocks of BLOCK examples; for
each term the index keeps the greatest weight in every block.  A query adds these block
maxima to an upper bound per block, visits blocks in falling order of the bound, and
stops when no bound can reach the k-th cosine found: the NEIGHBOURS nearest examples are
exact, and equally near ones are taken in the order of ids.  They vote with the square of
their cosine, each weighted by its label's share of all labelled rows over its share of
the sample, so that scores do not depend on how many rows were sampled; a prior of
similarity PRIOR keeps scores calibrated where evidence is weak.

At most SAMPLE labelled rows of each label (and SAMPLE_BYTES of their text) outside the
held-out fold are fitted on; every whole text is scored.  A null, empty or word-free
text, and one that shares no word with an example, gets the share of toxic labels.
Without labels the score is 0.  Rows repeat as in the input.
"""
from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, labelled_sample, pieces, schema_with, text_of

#: Labelled rows of each label, at most.
SAMPLE = 2500
FLOOR = 0.1
CERTAIN = 3.0
BLOCK = 512
NEIGHBOURS = 25
FOLDS, HELD = 5, 0
PRIOR = 0.1
#: Nearest examples that are named as evidence.
EVIDENCE = 5

_words = re.compile(r"[^\W_]+").findall


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """FLOOR plus what the log-odds of words exceed CERTAIN standard errors by."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return FLOOR + np.maximum(0, np.abs(odds) - CERTAIN * error)


class Model:
    """Terms with their weights, and the block-max inverted index of the examples.

    rows: (id, text, label) in the order of ids; counts: labelled rows of each label."""

    def __init__(self, rows: list[tuple[int, str, int]], counts: dict[int, int] | None = None):
        y = np.array([r[2] for r in rows], np.int64)
        n, pos = len(rows), int(y.sum())
        counts = counts or {0: n - pos, 1: pos}
        total = sum(counts.values())
        self.base = counts.get(1, 0) / total if total else 0.0
        self.vocabulary: dict[str, int] = {}
        ids, tf, pairs = [], [], [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for _, text, label in rows:
            seq = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in _words(text.lower())], np.int64)
            u, first, count = np.unique(seq, return_index=True, return_counts=True)
            before = np.where(first > 0, seq[np.maximum(first - 1, 0)], -1) if len(seq) else first
            pairs[label].append(u << 32 | before + 1)
            ids.append(u)
            tf.append(count)
        v = len(self.vocabulary)
        seen = [np.bincount(np.unique(np.concatenate(p)) >> 32, minlength=v) for p in pairs]
        # an example stands for so many labelled rows of its label
        stands = np.array([counts.get(k, 0) / max(1, (n - pos, pos)[k]) for k in (0, 1)])
        df = sum(np.bincount(np.concatenate([np.zeros(0, np.int64)] + [u for u, k in zip(ids, y) if k == label]), minlength=v) * stands[label] for label in (0, 1))
        self.weight = np.log((1 + total) / (1 + df)) * relevance(seen[1], seen[0], pos, n - pos) if n else np.zeros(0)
        self.weight = np.append(self.weight, np.log(1 + total) * FLOOR)
        vectors = []
        for u, c in zip(ids, tf):
            w = (1 + np.log(c)) * self.weight[u]
            vectors.append(w / max(float(np.sqrt((w * w).sum())), 1e-300))
        # examples of one most frequent word (which tells languages apart), label and
        # strongest term lie together, so that maxima are tight
        lead = lambda i, v: int(ids[i][np.argmax(v[i])]) if len(ids[i]) else -1
        order = sorted(range(n), key=lambda i: (lead(i, tf), int(y[i]), lead(i, vectors), i))
        self.row = np.array(order, np.int64)
        self.example = [r[0] for r in rows]
        self.y, self.share = y, stands[y] / stands.max() if n else np.zeros(0)
        self.blocks = -(-n // BLOCK)
        self.cuts, self.places, self.values = [], [], []
        self.peaks = np.zeros((v, self.blocks), np.float32)
        for b in range(self.blocks):
            some = order[b * BLOCK:(b + 1) * BLOCK]
            term = np.concatenate([ids[i] for i in some])
            place = np.repeat(np.arange(len(some)), [len(ids[i]) for i in some])
            value = np.concatenate([vectors[i] for i in some])
            o = np.argsort(term, kind="stable")
            self.cuts.append(np.searchsorted(term[o], np.arange(v + 1)).astype(np.int32))
            self.places.append(place[o].astype(np.int16))
            self.values.append(value[o])
            top = np.zeros(v)
            np.maximum.at(top, term, value)
            # single precision, rounded up
            self.peaks[:, b] = np.nextafter(top.astype(np.float32), np.float32(2))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known words and their weights, divided by the whole vector's length."""
        count = Counter(_words(text.lower()))
        n = len(count)
        # the place after the known words stands for all others
        ids = np.fromiter(map(self.vocabulary.get, count, repeat(len(self.weight) - 1)), np.int64, n)
        w = (1 + np.log(np.fromiter(count.values(), np.float64, n))) * self.weight[ids]
        w /= max(float(np.sqrt((w * w).sum())), 1e-300)
        known = np.flatnonzero(ids < len(self.weight) - 1)
        known = known[np.argsort(ids[known])]
        return ids[known], w[known]

    def cosines(self, block: int, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The cosine with every example of a block."""
        lo = self.cuts[block][ids].astype(np.int64)
        n = self.cuts[block][ids + 1] - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.places[block][at], weights=self.values[block][at] * np.repeat(weights, n), minlength=min(BLOCK, len(self.row) - block * BLOCK))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places (in the order of ids) of the k examples of greatest positive
        cosine, ties to the earlier place: exact."""
        best, who = np.zeros(0), np.zeros(0, np.int64)
        bound = weights @ self.peaks[ids]
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1] - 1e-6:
                break
            got = self.cosines(b, ids, weights)
            at = np.flatnonzero(got > (best[-1] if len(best) == k else 0) - 1e-12)
            at = at[got[at] > 0]
            best, who = np.concatenate([best, got[at]]), np.concatenate([who, self.row[b * BLOCK + at]])
            o = np.lexsort((who, -best))[:k]
            best, who = best[o], who[o]
        return best, who

    def score(self, text: str) -> tuple[float, list[int]]:
        """Score in 0..1 and the ids of the nearest examples, which carry it."""
        ids, weights = self.vector(text)
        if not len(ids):
            return self.base, []
        cos, who = self.nearest(ids, weights)
        w = cos * cos * self.share[who]
        vote = (w @ self.y[who] + PRIOR * self.base) / (w.sum() + PRIOR)
        return float(vote), [self.example[i] for i in who[:EVIDENCE].tolist()]


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Equal texts of one label are one example, that of the least id."""
    rows, counts = labelled_sample(docs, labels, "toxic", folds, held, sample)
    first: dict[tuple[str, int], int] = {}
    for i, t, y in rows:
        first.setdefault((t, y), i)
    return Model(sorted((i, t, y) for (t, y), i in first.items()), counts)


def score(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of near examples); a row per
    document, with the columns of keep after them."""
    held = (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    data = docs.select("doc_id", held, text_of().alias("_text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = list(keep)

    def run(batches):
        m = shared.value
        for b in batches:
            for at, texts in pieces(b, "_text"):
                got = [m.score(t) for t in texts]
                s = np.array([x for x, _ in got])
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)),
                     pa.array([e for _, e in got], pa.list_(pa.int64()))] + [part.column(3 + i) for i in range(len(extra))],
                    names=["doc_id", "held_out", "score", "predicted", "evidence", *extra])

    schema = schema_with(data, ["doc_id", "held_out"], "score double, predicted int, evidence array<bigint>")
    for c in extra:
        schema = schema.add(data.schema[c])
    return data.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic, with their own columns."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    kept = score(packed, model, ["_row"]).where("predicted = 0")
    return kept.select("_row.*")

"""Language identification with string kernels.

Kernel: blended-spectrum presence, |S(x) & S(y)| / sqrt(|S(x)| |S(y)|), where S is the
set of 1-, 2- and 3-grams of the lower-case text.  Letters of every script stand for
themselves; all other characters are one blank.  A gram is one number of three 21-bit
code points, so that no two grams are confused.  Landmark texts, at least one of each
language, give the Nystroem features K(x, landmarks) K(landmarks, landmarks)^(-1/2);
one-versus-rest kernel ridge regression is fitted on them.  Scoring is a product of
presence matrices with the landmarks' and of the result with the coefficients, batch by
batch.

The model is fitted on a bounded sample of labelled rows, SAMPLE over all languages but
EACH at least of every language, and SAMPLE_BYTES of text; scoring covers every whole
text.  A null text, or one without a letter, is 'und' with score 0.  Ties go to the
alphabetically first language.  Without labelled rows every text is 'und'.  Repeated rows
are scored alike; extra columns are ignored.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chosen_texts, fold, pieces, text_of

#: Training rows over all languages, rows of each at least, landmarks, ridge weight.
SAMPLE = 1600
EACH = 4
LANDMARKS = 128
RIDGE = 1e-3
FOLDS, HELD = 4, 2


@cache
def _letters() -> np.ndarray:
    """Every code point that is a letter as itself, the others as 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint64)


def grams(text: str) -> tuple[np.ndarray, bool]:
    """The set of grams as ascending numbers, and whether the text has a letter."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    # code points plus one, so that shorter grams differ from longer ones
    one = c + np.uint64(1)
    two = one[:-1] << np.uint64(21) | one[1:]
    three = two[:-1] << np.uint64(21) | one[2:]
    return np.unique(np.concatenate([one, two, three])), bool(c.any())


class Model:
    """Grams of the landmarks, their presence, coefficients and language names."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.names = sorted(set(langs))
        rows = [grams(t)[0] for t in texts]
        by = {n: [i for i, x in enumerate(langs) if x == n] for n in self.names}
        picked = [by[n][k] for k in range(max(map(len, by.values()), default=0)) for n in self.names if k < len(by[n])][:max(landmarks, len(self.names))]
        self.grams = np.unique(np.concatenate([rows[i] for i in picked])) if picked else np.zeros(0, np.uint64)
        self.marks = np.zeros((len(self.grams), len(picked)), np.float32)
        for j, i in enumerate(picked):
            self.marks[np.searchsorted(self.grams, rows[i]), j] = 1 / np.sqrt(len(rows[i]))
        k = np.array([self.marks[self.known(r)].sum(axis=0, dtype=np.float64) / np.sqrt(len(r)) for r in rows])
        kmm = k[picked]
        w, v = np.linalg.eigh((kmm + kmm.T) / 2)
        root = v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-6))) @ v.T
        x = np.column_stack([k @ root, np.ones(len(texts))])
        y = np.array([[1.0 if a == n else -1.0 for n in self.names] for a in langs])
        beta = np.linalg.solve(x.T @ x + ridge * len(texts) * np.eye(x.shape[1]), x.T @ y)
        self.coef = (root @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)

    def known(self, row: np.ndarray) -> np.ndarray:
        """Places of a text's grams among those of the landmarks."""
        at = np.minimum(np.searchsorted(self.grams, row), len(self.grams) - 1)
        return at[self.grams[at] == row]

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One margin per text and language, and which texts have a letter."""
        p = np.zeros((len(texts), len(self.grams)), np.float32)
        size, letter = np.ones(len(texts), np.float32), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            if t:
                row, letter[i] = grams(t)
                p[i, self.known(row)] = 1
                size[i] = len(row)
        return (p @ self.marks) / np.sqrt(size)[:, None] @ self.coef + self.bias, letter

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        margin, letter = self.margins(texts)
        best = margin.argmax(axis=1)
        e = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
        score = 1 / e.sum(axis=1)
        return ([self.names[b] if ok else "und" for b, ok in zip(best, letter)],
                [float(s) if ok else 0.0 for s, ok in zip(score, letter)])


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model | None:
    """Fit on as many rows of each language, in the order of a hash of the id.

    Ids are chosen first, so that texts of other rows are never sorted: of each language
    those whose hash is below a bound that some more than the wanted number meet, and of
    these the first, so that no task ranks a whole language."""
    rows = docs.where((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                      & F.col("text").rlike(r"\p{L}"))
    ids = rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    counts = ids.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(EACH, sample // len(counts))
    bound = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * each + 64) / r["count"])) for r in counts], "lang string, part double")
    place = (F.col("h").cast("double") + float(1 << 63)) / float(1 << 64)
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = ids.join(F.broadcast(bound), "lang").where(place <= F.col("part")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)
    got = chosen_texts(rows, few.select("doc_id", "lang", F.col("lang").alias("y"), "r"), ["doc_id", "lang"])
    got = sorted({(r.r, r.y, r.text) for r in got})
    return Model([t for _, _, t in got], [x for _, x, _ in got]) if got else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    held = (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    data = docs.select("doc_id", held, text_of().alias("text"))
    if model is None:
        return data.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for at, texts in pieces(b, most_bytes=1 << 19):
                names, scores = [], []
                # a batch's presence matrix stays below about 64 MB
                step = max(1, min(256, (16 << 20) // max(1, len(m.grams))))
                for k in range(0, len(texts), step):
                    n, s = m.predict(texts[k:k + step])
                    names += n
                    scores += s
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    schema = data.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return data.mapInArrow(run, schema)

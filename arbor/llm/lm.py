"""Bigram language model kept in a log-frequency Bloom filter.

A count c is quantised to q = 1 + floor(log2 c); the filter holds the entry (n-gram, j)
for every j from 1 to q, and a probe asks for j = 1, 2, ... until the first miss.  From
the quantised counts the probability of a word w after v is (c(vw) + KAPPA * p0(w)) /
(c(v) + KAPPA): p0 is the relative frequency of w, and that of one token for unseen words.
The head holds the words with more than 1 / HEAD of all tokens, so at most HEAD.

The filter has two parts.  The head's unigrams form one bounded filter that is always
broadcast.  Bigrams, and the counts of rarer words (as contexts: a token follows each of
them, so these are their counts as words too), lie in segments of about SEGMENT_TOKENS
tokens, each a range of the keys, so that neither a context nor a word makes a segment
large.  While all segments together take at most `most_bytes` (checked), they are
broadcast and one pass scores the documents.  Beyond that, texts are written in
compressed parts of about PART_BYTES; a part asks the segments for its distinct keys once
each, gets a byte for each back and is scored where it meets them: the same values, linear
in the input, and no token travels, only keys and texts.

Exact unigram counts serve the add-one base score: those of the head are broadcast, rarer
words are joined, so no key of that join holds more than 1 / HEAD of the tokens.

Null and empty texts hold the end token alone.  Every row gives one row, repeated and
null ids too (a null id is of fold 0 and so trains).  Without training rows all scores
are 0.  Words are hashed to 64 bits for the model; base counts go by the words.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop
from ._common import fold, staged, text_of

HEAD = 1 << 20
KAPPA = 4.0
HASHES = 6
SEGMENT_TOKENS = 1 << 20
#: Bytes of segments that are broadcast together, of text that is worked on at a time, of
#: text whose keys are asked for together, and of text whose keys meet one copy of a segment.
BROADCAST_BYTES = 128 << 20
CHUNK = 1 << 20
PART_BYTES = 4 << 20
SALT_BYTES = 64 << 20
#: Bytes of an Arrow batch: rows of blocks are large, and as many as Spark counts to by
#: default would take hundreds of megabytes, in the JVM and in Python.
BATCH_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of parts hold megabytes too: row groups and pages end by their bytes, not by rows.
PARQUET = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: N-grams that a task counts before it writes them out.
TASK_KEYS = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEP = re.compile(rb"[\x20\x09-\x0D]")
_SEPS = b"\x20\x09\x0A\x0B\x0C\x0D"
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 * 0xD1342543DE82EF95 % 2**64 | 1
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_CONTEXT = np.uint64(0xA0761D6478BD642F)
#: A segment of a million keys takes one of 2^48 / segments for another far less often than
#: its filter does.
KEY_BITS = 48
_LOW = np.uint64(64 - KEY_BITS)
_UPPER = ~np.uint64(0) << _LOW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams; keys have KEY_BITS, the upper ones, since some of them travel."""
    return mix(v * np.uint64(0xD6E8FEB86659FD93) + w) & _UPPER


def own(w: np.ndarray) -> np.ndarray:
    """Keys of single words."""
    return mix(w ^ _CONTEXT) & _UPPER


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for."""
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int):
        if n > len(cls.up):
            n = max(n, CHUNK + 4096)
            base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            base[0] = inverse[0] = 1
            cls.up, cls.down = np.cumprod(base), np.cumprod(inverse)
        return cls.up, cls.down


def hashed(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word of buf, which ends with a separator."""
    raw = np.frombuffer(buf, np.uint8)
    sep = _IS_SEP[raw]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(sep) and not sep[0]:
        edge = np.concatenate([[0], edge])
    lo, hi = edge[::2], edge[1::2]
    up, down = _Powers.to(len(raw))
    total = raw.astype(np.uint64)  # eight times the text: worked on in place
    total += np.uint64(1)
    total *= up[:len(raw)]
    np.cumsum(total, out=total)
    before = np.where(lo > 0, total[lo - 1], np.uint64(0)) if len(lo) else np.zeros(0, np.uint64)
    return mix((total[hi - 1] - before) * down[lo] + (hi - lo).astype(np.uint64) * END), lo, hi


def _parts(texts: list[bytes], ends: bool):
    """Lists of (document, bytes, whether it ends there) of about CHUNK bytes; long texts
    are cut at separators.  ends: whether the last text does."""
    held, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > CHUNK and (m := _SEP.search(t, at + CHUNK)):
            yield [*held, (i, t[at:m.start()], False)]
            held, size, at = [], 0, m.start()
        held.append((i, t[at:], ends or i < len(texts) - 1))
        size += len(t) - at
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokens(texts: list[bytes], last: np.uint64 = END, ends: bool = True):
    """For each part: its lower-cased bytes; begin and end of its words; document, context
    and word hashes of all its tokens, end tokens among them; places of the words there.
    last: the token before the first text; ends: whether the last text does."""
    for part in _parts(texts, ends):
        buf = b" ".join(b for _, b, _ in part).translate(_LOWER) + b" "
        h, lo, hi = hashed(buf)
        begin = np.cumsum([0, *(len(b) + 1 for _, b, _ in part[:-1])])
        which = np.searchsorted(begin, lo, "right") - 1
        ends = np.array([k for k, (_, _, end) in enumerate(part) if end], np.int64)
        at = np.searchsorted(which, ends, "right")
        seq, doc = np.insert(h, at, END), np.array([i for i, _, _ in part], np.int64)[np.insert(which, at, ends)]
        where = np.ones(len(seq), bool)
        where[at + np.arange(len(at))] = False
        context = np.concatenate([[last], seq[:-1]]).astype(np.uint64) if len(seq) else seq
        last = seq[-1] if len(seq) else last
        yield buf, lo, hi, doc, np.where(context == END, START, context), seq, np.flatnonzero(where)


def _texts(batch: pa.RecordBatch):
    """First row and texts of runs of rows of some CHUNKs."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.column(batch.schema.get_field_index("text")).cast(pa.binary())):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size > 4 * CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


# ---------------------------------------------------------------- the filter

def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


#: Mean count of a level, where counts fall as their inverse square; 0 for no level.
VALUE = np.array([0.0, 1.0, *(2.0**(q - 1) * 1.386 for q in range(2, 65))])


def segment(key: np.ndarray, segments: int) -> np.ndarray:
    """Ranges of keys: what is sorted by key is sorted by segment."""
    return (((key >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _bits(key: np.ndarray, j: int, size: np.ndarray | int):
    """The HASHES bit places of the entries (key, j) in filters of the sizes in bits."""
    x = mix(key + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))
    a, b, size = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1), np.uint64(size) if np.isscalar(size) else size.astype(np.uint64)
    for i in range(HASHES):
        yield (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of a filter for the keys' quantised counts: HASHES / ln 2 bits an entry."""
    q = level(counts)
    size = max(64, int(q.sum() * HASHES / np.log(2)))
    size = min(-(-size // 64) * 64, 2**32 - 64)
    out = np.zeros(size, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for at in _bits(keys[q >= j], j, size):
            out[at] = True
    return np.packbits(out, bitorder="little")


def probe(keys: np.ndarray, data: np.ndarray, offset: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """Quantised counts by membership probes; a filter begins at offset bytes of data and
    has size bits, for each key or for all."""
    found, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    each = not np.isscalar(size)
    for j in range(1, 65):
        key = keys[alive]
        here, n = (offset[alive], size[alive]) if each else (offset, size)
        ok = np.arange(len(alive))
        for i, at in enumerate(_bits(key, j, n)):
            at = at[ok]
            byte = (at >> np.uint64(3)).astype(np.int64) + (here[ok] if each else here)
            ok = ok[(data[byte] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        alive = alive[ok]
        if not len(alive):
            break
        found[alive] = j
    return found


class Head:
    """What every task needs to know of the frequent words and of all tokens."""

    def __init__(self, total: int, distinct: int, hashes: np.ndarray, counts: np.ndarray, starts: int):
        order = np.argsort(hashes)
        self.total, self.distinct, self.starts = total, distinct, starts
        self.hashes, self.counts = hashes[order], counts[order]
        self.filter = build(hashes, counts)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of head words, 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)

    def rare(self, h: np.ndarray) -> np.ndarray:
        """Those words of h that are not in the head; the start and the end count as such."""
        return h[(self.count(h) == 0) & (h != START) & (h != END)]

    def base(self, count) -> np.ndarray:
        return np.log10((count + 1.0) / (self.total + self.distinct + 1.0))

    def quantised(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is in the head (the start and the end of a text count as such),
        and its quantised count by the head's filter."""
        q = probe(h, self.filter, 0, len(self.filter) * 8)
        start = (h == START) | (h == END)
        q[start] = level(np.array([self.starts]))[0] if self.starts else 0
        return start | (self.count(h) > 0), q

    def log_probability(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of quantised counts; a word without any counts as one more token."""
        p0 = np.maximum(VALUE[word], 1.0) / (self.total + 1)
        c = VALUE[pair]
        return np.minimum(0.0, np.log10((c + KAPPA * p0) / (np.maximum(VALUE[context], c) + KAPPA)))


class Model:
    """Head, staged exact counts (token, n), staged segments (seg, bits), and both sizes."""

    def __init__(self, head, counts, segments, n_segments, n_bytes):
        self.head, self.counts, self.segments, self.n_segments, self.n_bytes = head, counts, segments, n_segments, n_bytes


def _word_counts(batches):
    for buf, lo, hi, doc, _, seq, where in (part for b in batches for _, texts in _texts(b) for part in tokens(texts)):
        if len(seq):
            h = seq[where]
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            n_end = len(seq) - len(where)
            # the end token is the only one with a separator in it
            yield pa.RecordBatch.from_arrays([pa.array([*(buf[a:z] for a, z in zip(lo[first].tolist(), hi[first].tolist())), b" "], pa.binary()),
                                              pa.array(np.append(n, n_end))], names=["token", "n"])


def token_hash(words: list[bytes]) -> np.ndarray:
    """As tokens() hashes them; b' ' is the end token."""
    out = np.empty(len(words), np.uint64)
    step, size = [], 0
    for i, w in enumerate([*words, None]):
        if w is None or size > CHUNK:
            h = hashed(b" ".join(words[k] for k in step) + b" ")[0] if step else []
            out[step] = h
            step, size = [], 0
        if w == b" ":
            out[i] = END
        elif w is not None:
            step.append(i)
            size += len(w) + 1
    return out


def _staged(df: DataFrame, what: str, **conf: str) -> DataFrame:
    """staged() with Arrow batches of BATCH_BYTES."""
    spark = df.sparkSession
    conf = {BATCH: str(BATCH_BYTES)} | conf
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return staged(df, what)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _by_segment(key: np.ndarray, segments: int):
    """Each segment that occurs among sorted keys, and its keys' places."""
    seg = segment(key, segments)
    first = np.flatnonzero(np.diff(seg, prepend=-1))
    return [(int(seg[lo]), slice(int(lo), int(hi))) for lo, hi in zip(first, [*first[1:], len(seg)])]


def _pair_counts(head, segments: int):
    """Blocks of sorted keys and their counts within a task's part, by segment."""
    def flush(keys, counts):
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        some = _by_segment(key, segments)
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.int32()), pa.array([key[x].tobytes() for _, x in some], pa.binary()),
                                           pa.array([_small(n[x]) for _, x in some], pa.binary())], names=["seg", "keys", "counts"])

    def run(batches):
        h, (keys, counts, size) = head.value, ([], [], 0)
        for *_, v, w, _ in (part for b in batches for _, texts in _texts(b) for part in tokens(texts)):
            if len(w):
                for key in (bigram(v, w), own(h.rare(v))):
                    key, n = np.unique(key, return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    size += len(key)
                if size > TASK_KEYS:
                    yield flush(keys, counts)
                    keys, counts, size = [], [], 0
        if size:
            yield flush(keys, counts)
    return run


def _small(n: np.ndarray) -> bytes:
    """Counts as bytes, 8 of them for each where one of them needs more."""
    return n.astype(np.uint8 if len(n) == 0 or n.max() < 256 else np.uint64).tobytes()


def _filters(batches):
    """A filter for each segment from its blocks, which come together."""
    def solve(seg, blocks):
        key = np.concatenate([k for k, _ in blocks])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([c for _, c in blocks])[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bits = build(key[first], np.add.reduceat(n, first))
        return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["seg", "bits"])

    held, last = [], None
    for b in batches:
        for row in zip(*b.columns):  # a block at a time: a batch holds megabytes of them
            seg, keys, counts = (x.as_py() for x in row)
            if seg != last and held:
                yield solve(last, held)
                held = []
            last, key = seg, np.frombuffer(keys, np.uint64)
            held.append((key, np.frombuffer(counts, np.uint8 if len(counts) == len(key) else np.uint64)))
    if held:
        yield solve(last, held)


def fit(train: DataFrame, head: int = HEAD, segment_tokens: int = SEGMENT_TOKENS) -> Model:
    """Counts of train's texts.  At most `head` words come to the driver, each with more
    than 1 / head of all tokens."""
    spark = train.sparkSession
    texts = train.select(text_of().alias("text"))
    counts = _staged(texts.mapInArrow(_word_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct, starts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("token") == F.lit(bytearray(b" ")), F.col("n"))), F.lit(0))).first()
    top = [(bytes(r.token), r.n) for r in counts.where(F.col("n") > total // head).toLocalIterator()]
    h = Head(total, distinct, token_hash([t for t, _ in top]), np.array([n for _, n in top], np.int64), starts)
    segments = max(1, -(-total // segment_tokens))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(h)
    built = _staged(texts.mapInArrow(_pair_counts(shared, segments), "seg int, keys binary, counts binary").repartition(min(parts, segments), "seg")
                   .sortWithinPartitions("seg").mapInArrow(_filters, "seg int, bits binary"), "lm-segments")
    n_bytes = built.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    return Model(h, counts, built, segments, n_bytes)


# ---------------------------------------------------------------- scoring

_ROW = "row long, doc_id long, n_tokens long, known long, base double, part double, cold array<struct<token:binary,n:long>>"
_PART = "part long, row long, ids array<long>, sizes array<long>, last long, ends boolean, text binary"


def _sums(h: Head, m: int, parts, ask):
    """Of m documents: tokens, known ones, base scores, model scores, and the words outside
    the head as an Arrow array of lists.  ask: quantised counts of keys by the segments."""
    n_tokens, known, base, part = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
    cold = [(np.zeros(0, np.int64), [], np.zeros(0, np.int64))]
    for buf, lo, hi, doc, v, w, where in parts:
        if not len(w):
            continue
        n_tokens += np.bincount(doc, minlength=m)
        words, first, of = np.unique(w, return_index=True, return_inverse=True)
        exact = h.count(words)
        known += np.bincount(doc, weights=(exact > 0)[of], minlength=m).astype(np.int64)
        base += np.bincount(doc, weights=np.where(exact > 0, h.base(exact), 0.0)[of], minlength=m)
        is_word = np.full(len(w), -1)
        is_word[where] = np.arange(len(where))
        rare = np.flatnonzero((exact == 0)[of])
        if len(rare):
            pair, times = np.unique(doc[rare] * len(words) + of[rare], return_counts=True)
            at = is_word[first[pair % len(words)]]
            cold.append((pair // len(words), [buf[lo[i]:hi[i]] if i >= 0 else b" " for i in at.tolist()], times))
        in_head, q = h.quantised(words)
        few = np.flatnonzero(~in_head)
        q[few] = ask(own(words[few]))
        contexts, of_v = np.unique(v, return_inverse=True)
        v_head, v_q = h.quantised(contexts)
        few = np.flatnonzero(~v_head)
        v_q[few] = ask(own(contexts[few]))
        part += np.bincount(doc, weights=h.log_probability(ask(bigram(v, w)), v_q[of_v], q[of]), minlength=m)
    cut = np.searchsorted(np.concatenate([d for d, _, _ in cold]), np.arange(m + 1)).astype(np.int32)
    rare = pa.StructArray.from_arrays([pa.array([t for _, x, _ in cold for t in x], pa.binary()), pa.array(np.concatenate([n for _, _, n in cold]))], ["token", "n"])
    return n_tokens, known, base, part, pa.ListArray.from_arrays(pa.array(cut), rare)


def _rows(first: int, ids, sums) -> pa.RecordBatch:
    """Rows of _ROW, numbered from first."""
    some = [np.arange(first, first + len(ids)), ids, *sums]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in some], names=[c.split(" ")[0] for c in _ROW.split(", ")])


def _score(head, whole, segments: int):
    """Rows of documents, by segments that are all here."""
    def run(batches):
        h, (data, offset, size), n_rows = head.value, whole.value, TaskContext.get().partitionId() << 33

        def ask(keys):
            seg = segment(keys, segments)
            return probe(keys, data, offset[seg], size[seg])

        for b, first_row, texts in ((b, *some) for b in batches for some in _texts(b)):
            m = len(texts)
            yield _rows(n_rows, b.column(b.schema.get_field_index("doc_id")).slice(first_row, m), _sums(h, m, tokens(texts), ask))
            n_rows += m
    return run


def _cut(most: int):
    """Rows of _PART: whole texts of `most` bytes together, or a part of a longer text, cut
    at separators; row is the first text's number, last the hash of the word before a part."""
    def before(piece, last):
        piece = piece.rstrip(_SEPS)
        word = piece[max(piece.rfind(_SEPS[i:i + 1]) for i in range(len(_SEPS))) + 1:]
        return token_hash([word.translate(_LOWER)])[0] if word else last

    def run(batches):
        part = row = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.binary()]
        names = [c.split(" ")[0] for c in _PART.split(", ")]

        def made(ids, texts, last=END, ends=True):
            nonlocal part
            some = [part, row, ids, [len(t) for t in texts], int(np.uint64(last).view(np.int64)), ends, pa.compress(b"".join(texts), codec="zstd", asbytes=True)]
            part += 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(some, kinds)], names=names)

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("text")).cast(pa.binary())):
                i, t = i.as_py(), t.as_py() or b""
                if ids and size + len(t) > most:
                    yield made(ids, texts)
                    row += len(ids)
                    ids, texts, size = [], [], 0
                at, last = 0, END
                while len(t) - at > most and (m := _SEP.search(t, at + most)):
                    piece = t[at:m.start()]
                    yield made([i], [piece], last, False)
                    last, at = before(piece, last), m.start()
                if at:
                    yield made([i], [t[at:]], last)
                    row += 1
                else:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
        if ids:
            yield made(ids, texts)
    return run


def _uncut(b: pa.RecordBatch, i: int):
    """Number, first row, ids and tokens() of a part."""
    part, row, ids, sizes, last, ends, text = (b.column(b.schema.get_field_index(c.split(" ")[0]))[i].as_py() for c in _PART.split(", "))
    text, at = pa.decompress(text, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b"", np.cumsum([0, *sizes]).tolist()
    return part, row, ids, list(tokens([text[lo:hi] for lo, hi in zip(at, at[1:])], np.int64(last).view(np.uint64), ends))


def _keys(h: Head, parts) -> np.ndarray:
    """The distinct keys that _sums asks for, sorted."""
    keys = [np.zeros(0, np.uint64)]
    for *_, v, w, _ in parts:
        keys += [bigram(v, w), own(h.rare(np.unique(np.concatenate([v[:1], w]))))]
    return np.unique(np.concatenate(keys))


def _asked(head, segments: int):
    """Blocks of the keys of parts, by segment."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, _, _, parts = _uncut(b, i)
                key = _keys(head.value, parts)
                some = _by_segment(key, segments)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.int32()), pa.array([part] * len(some), pa.int64()), pa.array([_packed(key[x]) for _, x in some], pa.binary())], names=["seg", "part", "keys"])
    return run


def _packed(key: np.ndarray) -> bytes:
    """Sorted keys as their differences, in as few bytes each as the largest one needs."""
    apart = np.diff(key >> _LOW)
    width = -(-int(apart.max(initial=0)).bit_length() // 8)
    return bytes([width]) + key[:1].tobytes() + apart.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    apart = np.zeros(((len(data) - 9) // width if width else 0, 8), np.uint8)
    apart[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(len(apart), width)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1) >> _LOW, apart.reshape(-1).view(np.uint64)]), dtype=np.uint64) << _LOW


def _answered(batches):
    """Of blocks that follow their segment's filter: a byte for each key, its quantised
    count.  A batch's blocks of one segment are probed together."""
    def solve(data, blocks):
        key = np.concatenate([k for *_, k in blocks])
        q = (np.zeros(len(key), np.int64) if data is None else probe(key, data, 0, len(data) * 8)).astype(np.uint8)
        at = np.cumsum([0, *(len(k) for *_, k in blocks)]).tolist()
        return pa.RecordBatch.from_arrays([pa.array([s for s, *_ in blocks], pa.int32()), pa.array([p for _, p, _ in blocks], pa.int64()),
                                           pa.array([q[lo:hi].tobytes() for lo, hi in zip(at, at[1:])], pa.binary())], names=["seg", "part", "found"])

    data, last = None, None
    for b in batches:
        held = []
        for row in zip(*(b.column(b.schema.get_field_index(c)) for c in ("seg", "part", "bits", "keys"))):
            seg, part, bits, keys = (x.as_py() for x in row)
            if bits is not None or seg != last:
                if held:
                    yield solve(data, held)
                data, last, held = None if bits is None else np.frombuffer(bits, np.uint8), seg, []
            if bits is None:
                held.append((seg, part, _unpacked(keys)))
        if held:
            yield solve(data, held)


def _meet(head):
    """Rows of documents from parts, each after the answers of its segments in order."""
    def run(batches):
        h, found = head.value, []
        for b in batches:
            answers, texts = b.column(b.schema.get_field_index("found")), b.column(b.schema.get_field_index("text"))
            for i in range(b.num_rows):
                if not texts[i].is_valid:
                    found.append(answers[i].as_py())
                    continue
                part, row, ids, parts = _uncut(b, i)
                key, q = _keys(h, parts), np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
                if len(key) != len(q):
                    raise ValueError(f"part {part}: {len(q)} answers to {len(key)} keys")
                yield _rows(row, pa.array(ids, pa.int64()), _sums(h, len(ids), parts, lambda keys, key=key, q=q: q[np.searchsorted(key, keys)]))
                found = []
    return run


def _far(texts: DataFrame, model: Model, head) -> DataFrame:
    """Rows of documents, one for each part of a text, by segments that take blocks of keys."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _staged(texts.mapInArrow(_cut(PART_BYTES), _PART), "lm-parts", **PARQUET)
    size = cut.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    salts = max(1, -(-size // (model.n_segments * SALT_BYTES)))
    none = lambda kind: F.lit(None).cast(kind)
    asked = (model.segments.select("seg", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none("long").alias("part"), "bits", none("binary").alias("keys"))
             .unionByName(cut.mapInArrow(_asked(head, model.n_segments), "seg int, part long, keys binary").select("seg", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int").alias("salt"), "part", none("binary").alias("bits"), "keys")))
    found = _staged(asked.repartition(parts, "seg", "salt").sortWithinPartitions("seg", "salt", F.col("bits").isNull()).mapInArrow(_answered, "seg int, part long, found binary"), "lm-found")
    names = [c.split(" ")[0] for c in _PART.split(", ")]
    met = (found.select("part", "seg", "found", *(none(cut.schema[c].dataType).alias(c) for c in names[1:]))
           .unionByName(cut.select("part", none("int").alias("seg"), none("binary").alias("found"), *names[1:])))
    rows = _staged(met.repartition(parts, "part").sortWithinPartitions("part", F.col("text").isNotNull(), "seg").mapInArrow(_meet(head), _ROW), "lm-rows")
    drop(cut, found)
    return rows


def score(docs: DataFrame, model: Model, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; one row per document."""
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(model.head)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if model.n_bytes <= most_bytes:
        offset, size, data, at = np.full(model.n_segments, -1), np.full(model.n_segments, 64), [], 0
        for r in model.segments.toLocalIterator():
            offset[r.seg], size[r.seg] = at, len(r.bits) * 8
            data.append(np.frombuffer(bytes(r.bits), np.uint8))
            at += len(r.bits)
        offset[offset < 0] = at  # segments without n-grams read zeros
        whole = spark.sparkContext.broadcast((np.concatenate([*data, np.zeros(8, np.uint8)]), offset, size))
        rows = _staged(texts.mapInArrow(_score(head, whole, model.n_segments), _ROW), "lm-rows")
        out = rows.drop("cold")
    else:
        rows = _far(texts, model, head)
        out = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "part")))
    cold = rows.where(F.size("cold") > 0).select("row", F.explode("cold").alias("c")).select("row", "c.token", "c.n")
    found = cold.join(model.counts.withColumnRenamed("n", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    denominator = float(model.head.total + model.head.distinct + 1)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(denominator))).alias("more_base"))
    out = out.join(sums, "row", "left")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("known") + nought("more_known")).alias("n_known"), F.lit(model.head.total).cast("long").alias("train_tokens"),
                      (F.col("base") + nought("more_base")).alias("base_score"), F.col("part").alias("score"))


def report(docs: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those outside fold 2 of 7."""
    held = F.coalesce(fold(F.col("doc_id"), 7), F.lit(0)) == 2
    return score(docs, fit(docs.where(~held))).withColumn("held_out", held)

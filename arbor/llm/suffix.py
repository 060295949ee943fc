"""Removal of repeated passages by suffix arrays.

A byte goes if it lies in a LENGTH-byte string that also starts anywhere else in the
table.  Equal strings must meet without gathering the corpus, so every window of LENGTH
bytes is dealt by content: its anchor is the k-gram of least hash inside it (winnowing).
Windows that follow each other with one anchor form a snippet; snippets of an anchor
that occurs once cannot repeat and are left out.  Equal snippets become one entry with a
multiplicity, and all entries of an anchor are held against each other in shards of about
SHARD positions.  Each shard sorts its suffixes (Larsson-Sadakane: ranks of h symbols are
refined to 2h, only where still tied) and marks the starts whose neighbour shares LENGTH
bytes, as the ranks of the round of 128 symbols tell; a suffix of an entry with copies
has its copy's as a neighbour, with all of it in common.

An anchor with more entries than a shard holds (a passage in a third of all documents,
between different neighbours) is dealt over several shards; they are merged by binary
search in the sorted digests of their distinct windows, which travel in blocks by bucket.

Rows are named by two 64-bit hashes, of the text and of the id with the text, so that
copies of one text never meet in one task; only texts that carry a wanted snippet's
first occurrence are read again for its bytes.

Null and empty texts have no bytes; texts below LENGTH bytes keep all of theirs.  Equal
texts of LENGTH bytes or more repeat each other and lose everything.  Rows repeat as in
the input.  Extra columns are ignored, in dedup() they pass through.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop
from ._common import schema_with, staged, text_of

LENGTH = 200
GRAM = 64
#: Positions of a shard; texts longer than STRETCH are cut into overlapping stretches.
SHARD = 1 << 19
STRETCH = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        _powers = both[0], both[1]
    return _powers


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every gram of the bytes."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every width values in a row."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, x.max(), x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1:width - 1 + n])


def snippets(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first start, starts) of the snippets: together they hold every
    window start of raw once."""
    at = 0
    while at + length <= len(raw):
        data = np.frombuffer(raw[at:at + STRETCH + length - 1], np.uint8)
        h = gram_hashes(data, gram)
        # earliest gram of least hash: the place breaks ties of the upper bits
        order = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        least = sliding_least(order, length - gram + 1)
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        yield from zip(h[place[first]].view(np.int64).tolist(), (first + at).tolist(), np.diff(np.append(first, len(place))).tolist())
        at += STRETCH


def _anchors(batches):
    """The anchors of each text, one row each."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            got = [a for raw in b.column(0).slice(at, 256).to_pylist() for a, _, _ in snippets(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["anchor"])


def _occurrences(batches):
    """k1, k2, anchor, sid, start, n of every snippet; the anchor and the sid, a hash of
    the snippet's bytes, make 128 bits together."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            count, anchors, sids, starts, sizes = [], [], [], [], []
            for raw in part.column(2).to_pylist():
                before = len(anchors)
                for anchor, start, n in snippets(raw):
                    anchors.append(anchor)
                    sids.append(digest(raw[start:start + n + LENGTH - 1]))
                    starts.append(start)
                    sizes.append(n)
                count.append(len(anchors) - before)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(k).to_numpy(), count)) for k in (0, 1)]
                + [pa.array(anchors, pa.int64()), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())],
                names=["k1", "k2", "anchor", "sid", "start", "n"])


def _cut(batches):
    """Bytes of the wanted snippets of each text; rows of one name are cut once."""
    seen = set()
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            cols = [[] for _ in range(6)]
            for k1, k2, raw, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = raw.as_py()
                for w in wanted.as_py():
                    data = raw[w["start"]:w["start"] + w["n"] + LENGTH - 1]
                    for c, v in zip(cols, (w["grp"], w["anchor"], w["sid"], w["crowded"], w["many"], data)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))],
                names=["grp", "anchor", "sid", "crowded", "many", "data"])


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, buffer, remaining, owner) of all suffixes of the texts, each text closed
    by an end of its own that sorts before every byte."""
    return _refined(texts, 4)[:4]


def _refined(texts: list[bytes], length: int):
    """What suffix_array() gives, then ranks by the first reach symbols, and reach: the
    largest of 4, 8, 16, ... that is at most length (4 or more)."""
    reach = 4 << (length // 4).bit_length() - 1
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n, s = len(buf), len(texts)
    owner = np.repeat(np.arange(s), sizes)
    rem = np.cumsum(sizes)[owner] - np.arange(n)
    place = np.arange(n, dtype=np.uint64)
    padded = np.concatenate([buf.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key = key << np.uint64(9) | np.where(rem > j, padded[j:j + n], np.uint64(0))
    bits = np.uint64(max(1, int(n + s).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    tight = 3 * int(bits) <= 64

    def ordered(first: np.ndarray, second: np.ndarray, who: np.ndarray):
        """who sorted by (first, second, who), and where the pair changes."""
        if tight:
            k = np.sort(first << (bits + bits) | second << bits | who)
            pair, who = k >> bits, k & mask
            return who.astype(np.int64), np.concatenate([[True], pair[1:] != pair[:-1]])
        o = np.lexsort((who, second, first))
        f, g = first[o], second[o]
        return who[o].astype(np.int64), np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])])

    if 36 + int(bits) <= 64:
        k = np.sort(key << bits | place)
        sa, key = (k & mask).astype(np.int64), k >> bits
    else:
        sa = np.lexsort((place, key))
        key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 4
    kept = rank
    while len(slots):
        if h == reach:
            kept = rank.copy()
        who = sa[slots]
        ended = rem[who] <= h
        second = np.where(ended, owner[who], s + rank[np.minimum(who + h, n - 1)])
        got, new = ordered(rank[who].astype(np.uint64), second.astype(np.uint64), who.astype(np.uint64))
        sa[slots] = got
        rank[got] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    # where the rounds end before reach, all ranks differ already
    return sa, buf, rem, owner, kept, reach


def kasai(sa: np.ndarray, buf: np.ndarray, rem: np.ndarray, lane: int = 512) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by position: what
    the tests hold repeated_starts() against.

    Kasai's loop over positions (the next prefix is at most one shorter), run over
    stretches of lane positions side by side; eight bytes are compared at a time."""
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    words = np.concatenate([buf, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(words, (n + 8, 8), (1, 1)).copy().view("<u8").ravel()
    lcp = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for step in range(min(lane, n)):
        i = starts + step
        if i[-1] >= n:
            starts, h = starts[:-1], h[:-1]
            i = i[:-1]
            if not len(i):
                break
        j = before[i]
        most = np.where(j >= 0, np.minimum(rem[i], rem[j]), 0)
        h = np.minimum(np.maximum(h - 1, 0), most)
        go = np.flatnonzero(h < most)
        while len(go):
            x = words[i[go] + h[go]] ^ words[j[go] + h[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            h[go] = np.minimum(h[go] + same, most[go])
            go = go[(same == 8) & (h[go] < most[go])]
        lcp[i] = h
    return lcp


def repeated_starts(texts: list[bytes], length: int = LENGTH, copies: list[bool] | None = None) -> list[np.ndarray]:
    """For each text, whether the length bytes (4 or more) from each start also start
    elsewhere; a text with copies stands for itself and them."""
    sa, buf, rem, owner, rank, reach = _refined(texts, length)
    hit = np.zeros(len(buf), bool)
    if copies is not None:
        # in the array of all texts each suffix of such a text lies beside its copy's
        hit = np.array(copies, bool)[owner] & (rem >= length)
    # neighbours in order share length bytes if they share the first and the last reach of
    # them, which the ranks of that round tell: no common prefix is measured
    whole = rem[sa] >= length
    near = np.flatnonzero(whole[:-1] & whole[1:])
    one, two = sa[near], sa[near + 1]
    for at in (0, length - reach):
        same = rank[one + at] == rank[two + at]
        one, two = one[same], two[same]
    hit[one] = True
    hit[two] = True
    ends = np.cumsum([len(t) for t in texts])
    return [hit[e - len(t):e - length + 1] for t, e in zip(texts, ends)]


def runs_of(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])]


#: A window of a crowded anchor: its digest, its entry and where in it it starts.
_WINDOW = np.dtype([("hi", ">u8"), ("lo", ">u8"), ("anchor", "<i8"), ("sid", "<i8"), ("start", "<i4")])
_FOUND = pa.schema([("anchor", pa.int64()), ("sid", pa.int64()), ("runs", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                    ("bucket", pa.int32()), ("block", pa.binary())])
_FOUND_DDL = "anchor long, sid long, runs array<struct<lo:int,hi:int>>, bucket int, block binary"


def _shards(bits: int):
    """Solves shards.  Rows come sorted by grp; shards close at the end of a group.  Runs
    are told for every entry with repeated windows.  A shard of crowded anchors also
    gives its distinct windows in the order of their digests, cut into 2^bits buckets."""
    def solve(rows):
        out = {f.name: [] for f in _FOUND}

        def tell(**row):
            for k, c in out.items():
                c.append(row.get(k))

        windows = []
        for (anchor, sid, crowded, many, data), flags in zip(rows, repeated_starts([r[-1] for r in rows], copies=[r[-2] for r in rows])):
            if flags.any():
                tell(anchor=anchor, sid=sid, runs=runs_of(flags))
            if crowded:
                w = np.empty(len(flags), _WINDOW)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i:i + LENGTH]) for i in range(len(flags))), ">u8")
                w["hi"], w["lo"], w["anchor"], w["sid"], w["start"] = digests[::2], digests[1::2], anchor, sid, np.arange(len(flags))
                windows.append(w)
        if windows:
            w = np.concatenate(windows)
            w = w[np.lexsort((w["lo"], w["hi"]))]
            # equal windows of this shard are known to be repeated: one stands for them
            w = w[np.concatenate([[True], (w["hi"][1:] != w["hi"][:-1]) | (w["lo"][1:] != w["lo"][:-1])])]
            bucket = (w["hi"] >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(w)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                tell(bucket=int(bucket[lo]), block=w[lo:hi].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _FOUND], schema=_FOUND)

    def run(batches):
        rows, size, last, seen = [], 0, None, set()
        for b in batches:
            for grp, anchor, sid, crowded, many, data in zip(*(b.column(i).to_pylist() for i in range(6))):
                if grp != last:
                    if size >= SHARD:
                        yield solve(rows)
                        rows, size = [], 0
                    last, seen = grp, set()
                if (anchor, sid) in seen:
                    continue
                seen.add((anchor, sid))
                rows.append((anchor, sid, crowded, many, data))
                size += len(data)
        if rows:
            yield solve(rows)

    return run


def _merge(batches):
    """Blocks of several shards, sorted by bucket: the windows found more than once, by
    binary search."""
    def solve(blocks: list[bytes]):
        w = np.frombuffer(b"".join(blocks), _WINDOW)
        w = w[np.lexsort((w["lo"], w["hi"]))]
        code = np.cumsum(np.concatenate([[0], (w["hi"][1:] != w["hi"][:-1]) | (w["lo"][1:] != w["lo"][:-1])]))
        w = w[np.searchsorted(code, code, "right") - np.searchsorted(code, code, "left") > 1]
        runs: dict[tuple[int, int], list[dict]] = {}
        for anchor, sid, start in zip(w["anchor"].tolist(), w["sid"].tolist(), w["start"].tolist()):
            runs.setdefault((anchor, sid), []).append({"lo": start, "hi": start + 1})
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in runs], pa.int64()), pa.array([k[1] for k in runs], pa.int64()), pa.array(list(runs.values()), _FOUND.field("runs").type)],
            names=["anchor", "sid", "runs"])

    held, last = [], None
    for b in batches:
        for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != last and held:
                yield solve(held)
                held = []
            last = bucket
            held.append(block)
    if held:
        yield solve(held)


def _names(prefix: str = "") -> list:
    """The names of a row, k1 and k2: hashes of its text, and of its id with the text."""
    return [F.xxhash64(text_of()).alias(prefix + "k1"), F.xxhash64(F.lit(LENGTH), F.col("doc_id").cast("long"), text_of()).alias(prefix + "k2")]


def repeats(docs: DataFrame) -> DataFrame:
    """k1, k2, found: array<int>, for every row with repeated windows: begin, end, begin,
    end, ... of covered stretches of bytes, which may overlap, in no order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = docs.select(*_names(), F.encode(text_of(), "UTF-8").alias("raw")).where(F.length("raw") >= LENGTH)
    twice = staged(data.select("raw").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("all"))
                   .where(F.col("all") > 1).select("anchor"), "repeated-anchors")
    some = staged(data.mapInArrow(_occurrences, "k1 long, k2 long, anchor long, sid long, start int, n int").join(twice, "anchor", "left_semi"), "snippets")
    entries = staged(some.groupBy("anchor", "sid").agg((F.count("*") > 1).alias("many"), F.min(F.struct("k1", "k2", "start", "n")).alias("r"))
                     .select("anchor", "sid", "many", "r.*"), "entries")
    # written first, so that the join below has plain sides, whose heavy keys are split
    crowded = staged(entries.groupBy("anchor").agg(F.sum(F.col("n") + LENGTH - 1).alias("size")).where(F.col("size") > SHARD)
                     .select("anchor", F.ceil(F.col("size") / SHARD).alias("m")), "crowded-anchors")
    grp = F.xxhash64("anchor", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("sid"), F.col("m"))).otherwise(F.lit(0)))
    wanted = (entries.join(crowded, "anchor", "left").groupBy("k1", "k2")
              .agg(F.collect_list(F.struct(grp.alias("grp"), "anchor", "sid", F.col("m").isNotNull().alias("crowded"), "many", "start", "n")).alias("wanted")))
    cut = data.join(wanted, ["k1", "k2"]).select("k1", "k2", "raw", "wanted").mapInArrow(_cut, "grp long, anchor long, sid long, crowded boolean, many boolean, data binary")
    found = staged(cut.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_shards(max(1, parts.bit_length() + 2)), _FOUND_DDL), "repeated-windows")
    merged = (found.where("block is not null").select("bucket", "block").repartition(parts, "bucket").sortWithinPartitions("bucket")
              .mapInArrow(_merge, "anchor long, sid long, runs array<struct<lo:int,hi:int>>"))
    runs = staged(found.where("runs is not null").select("anchor", "sid", "runs").unionByName(merged), "runs")
    covered = F.flatten(F.transform("runs", lambda r: F.array(F.col("start") + r["lo"], F.col("start") + r["hi"] + (LENGTH - 1))))
    # a set: rows of one name have the same stretches
    out = staged(some.join(runs, ["anchor", "sid"]).groupBy("k1", "k2").agg(F.flatten(F.collect_set(covered)).alias("found")), "repeats")
    drop(twice, some, entries, crowded, found, runs)
    return out


def removed_spans(found: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if found.values is None or not len(found.values):
        return []
    pairs = found.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:], len(pairs)) - 1].tolist()))


def _with_found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, then _raw and _found."""
    data = docs.select(*keep, F.encode(text_of(), "UTF-8").alias("_raw"), *_names("_"))
    found = repeats(docs.select("doc_id", "text")).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "found": "_found"})
    return data.join(found, ["_k1", "_k2"], "left").select(*keep, "_raw", "_found")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per document."""
    def run(batches):
        for b in batches:
            cols = [[] for _ in range(4)]
            for raw, found in zip(b.column(1), b.column(2)):
                raw = raw.as_py()
                spans = removed_spans(found)
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                for c, v in zip(cols, (len(raw), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d = _with_found(docs.select("doc_id", "text"), ["doc_id"])
    return d.mapInArrow(run, schema_with(d, ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the characters that lie wholly in repeated passages; n_chars, where
    present, follows the text.  Every row stays."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            texts = []
            for raw, found in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                raw = raw.as_py()
                kept, at = [], 0
                for lo, hi in removed_spans(found):
                    while lo < hi and raw[lo] & 0xC0 == 0x80:  # a character begun before
                        lo += 1
                    while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:  # or not ended
                        hi -= 1
                    kept.append(raw[at:lo])
                    at = max(at, hi)
                kept.append(raw[at:])
                texts.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string())], names=[*keep, "text"])

    d = _with_found(docs, keep)
    out = d.mapInArrow(run, schema_with(d, keep, "text string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)

"""Target-distribution importance resampling over hashed n-gram features.

DuckDB works on the texts of each partition: words are cut and unnested, windows give the
runs of one to three words, and a registered function gives zlib's CRC-32 of each.  Only
distinct words are hashed byte by byte; the CRC of a run follows from those of its parts,
since appending n bytes is a linear map of the 32 bits.  Each document's bucket counts
(rising buckets as gaps) and each task's totals are spilled to Parquet in the shared
folder.  Spark merges the totals, turns them into gains and scores the spilled counts;
texts are read once.

Documents are drawn by score: rows are dealt by ranges of (score, id), written once, and
a row's rank is its place in its range plus the sizes of the ranges before, so no task
holds more than a range.  Rows of equal score and id stay in one order by a row number.

Null and empty texts have no features, weight 0 and are never drawn.  A null id is hashed
as an empty one and sorts before others.  Repeated rows are drawn each.  Without target
texts the gains compare with an even spread over the buckets.
"""
from __future__ import annotations

import shutil
import tempfile
import zlib
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop
from ._common import pieces, staged, text_of

BUCKETS = 10_000
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words a document needs, and the share that is drawn, in hundredths.
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
#: Characters of text in one DuckDB statement, and memory it may use for it.  A statement
#: takes some 70 times its text, outside of DuckDB's limit for a part.
BATCH = 1 << 20
MEMORY_MB = 300
#: Bytes of an Arrow batch, as the JVM and Python hold a whole one each.
ARROW_BYTES = 4 << 20

_SQL = f"""
with words as materialized (
    select row, unnest(w) as word, generate_subscripts(w, 1) as pos
    from (select row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') as w from texts)),
known as (select word, crc32(word) as c, strlen(word) as n from (select distinct word from words)),
marked as (select word, c, crc32_append({zlib.crc32(b" ")}::uinteger, n, c) as s, n + 1 as n from known),
runs as (
    select row, c, lead(s) over along as s2, lead(n) over along as n2, lead(s, 2) over along as s3, lead(n, 2) over along as n3
    from words join marked using (word) window along as (partition by row order by pos)),
pairs as (select row, c, crc32_append(c, n2, s2) as c2, s3, n3 from runs),
features as (
    select row, c from pairs union all select row, c2 from pairs where c2 is not null
    union all select row, crc32_append(c2, n3, s3) from pairs where n3 is not null)
select row * $buckets::bigint + c % $buckets as place, count(*) as n from features group by place
"""


@cache
def _append_table(n: int) -> np.ndarray:
    """For each of the four bytes of a CRC, what its 256 values become when n bytes of
    zero are appended: 4 x 256 numbers."""
    if n == 1:
        step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint64) ^ np.uint64(zlib.crc32(b"\0"))
        value = np.arange(256, dtype=np.uint64)[None, :] << (8 * np.arange(4, dtype=np.uint64))[:, None]
        return ((value >> np.uint64(8)) ^ step[(value & np.uint64(255)).astype(int)]).astype(np.uint32)
    half = _append_table(n // 2)
    return _moved(half, _moved(half, _append_table(1) if n % 2 else _IDENTITY))


_IDENTITY = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)


def _moved(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


def crc32_append(c: pa.Array, n: pa.Array, tail: pa.Array) -> pa.Array:
    """CRC of a string and a tail, from the string's CRC, the tail's length and its CRC."""
    c, n, tail = (x.to_numpy(zero_copy_only=False) for x in (c, n, tail))
    if int(n.max(initial=0)) < 1 << 16:
        lengths = np.flatnonzero(np.bincount(n)) if len(n) else n
        of = np.zeros(int(n.max(initial=0)) + 1, np.int64)
        of[lengths] = np.arange(len(lengths))
        of = of[n]
    else:
        lengths, of = np.unique(n, return_inverse=True)
    t = np.concatenate([_append_table(int(k)).ravel() for k in lengths]) if len(lengths) else np.zeros(0, np.uint32)
    c, of = c.astype(np.int64), of << 10
    return pa.array(t[of + (c & 255)] ^ t[of + (c >> 8 & 255) + 256] ^ t[of + (c >> 16 & 255) + 512] ^ t[of + (c >> 24) + 768] ^ tail.astype(np.uint32))


def crc32(words: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], pa.uint32())


class _Session:
    """A DuckDB connection of one task."""

    def __init__(self):
        self.folder = tempfile.mkdtemp()
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": self.folder, "preserve_insertion_order": False})
        self.con.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        self.con.create_function("crc32_append", crc32_append, ["UINTEGER", "BIGINT", "UINTEGER"], "UINTEGER", type="arrow")

    def counts(self, texts: list[str], buckets: int):
        """row, bucket and n, rising by row and bucket."""
        self.con.execute(f"set memory_limit = '{max(MEMORY_MB, 60 * sum(map(len, texts)) >> 20)}MB'")
        self.con.register("texts", pa.table({"row": pa.array(range(len(texts)), pa.int32()), "text": pa.array(texts, pa.string())}))
        got = self.con.execute(_SQL, {"buckets": buckets}).fetchnumpy()
        self.con.unregister("texts")
        order = np.argsort(got["place"])
        place = got["place"][order]
        return place // buckets, place % buckets, got["n"][order]

    def close(self):
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)


_SPILL = "doc_id long, n_words long, n_features long, gaps array<int>, counts array<int>, totals array<long>"


def spilled(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, gaps between its rising buckets
    (the first from -1) and their counts; and one row per task with totals by bucket."""
    names = [c.split(" ")[0] for c in _SPILL.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        session, totals = _Session(), np.zeros(buckets, np.int64)
        try:
            for b in batches:
                ids = b.column(b.schema.get_field_index("doc_id"))
                for first, texts in pieces(b, most_bytes=BATCH):
                    m = len(texts)
                    row, bucket, n = session.counts(texts, buckets)
                    totals += np.bincount(bucket, weights=n, minlength=buckets).astype(np.int64)
                    cut = np.searchsorted(row, np.arange(m + 1)).astype(np.int32)
                    gaps = np.diff(bucket, prepend=-1)
                    gaps[cut[:-1][cut[:-1] < cut[1:]]] = bucket[cut[:-1][cut[:-1] < cut[1:]]] + 1
                    lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (gaps, n)]
                    runs = np.bincount(row, weights=n, minlength=m).astype(np.int64)
                    words = np.where(runs > 3, runs // 3 + 1, (runs + 1) // 2)  # k words have k + (k - 1) + (k - 2) runs
                    yield pa.RecordBatch.from_arrays([ids.slice(first, m), pa.array(words), pa.array(runs), *lists, pa.nulls(m, kinds[5])], names=names)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:5]), pa.array([totals.tolist()], kinds[5])], names=names)
        finally:
            session.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _SPILL)


def merged(spill: DataFrame) -> DataFrame:
    """bucket, n of all tasks' totals."""
    return spill.where("totals is not null").select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket, from totals (bucket, n) of both sides."""
    all_of = lambda df: F.broadcast(df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")))
    spark = source.sparkSession
    rows = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").crossJoin(all_of(source).withColumnRenamed("all", "all_s")).crossJoin(all_of(target).withColumnRenamed("all", "all_t")))
    one = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1).cast("double")
    return rows.select("bucket", F.floor(F.lit(1000.0) * F.log(one("t") * (F.col("all_s") + buckets).cast("double") / (one("s") * (F.col("all_t") + buckets).cast("double")))).alias("gain"))


def weighed(spill: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight of every spilled document."""
    shared = spill.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches):
        for b in batches:
            gaps, counts = b.column(3), b.column(4)
            cut = gaps.offsets.to_numpy()
            at = np.cumsum(gaps.values.to_numpy().astype(np.int64))[cut[0]:cut[-1]] if cut[-1] > cut[0] else np.zeros(0, np.int64)
            at -= np.repeat(np.where(cut[:-1] > cut[0], at[np.maximum(cut[:-1] - cut[0] - 1, 0)] if len(at) else 0, 0), np.diff(cut))
            value = np.cumsum(np.append(0, shared.value[at - 1] * counts.values.to_numpy()[cut[0]:cut[-1]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(value[cut[1:] - cut[0]] - value[cut[:-1] - cut[0]])], names=["doc_id", "n_words", "n_features", "weight"])

    return spill.where("totals is null").select("doc_id", "n_words", "n_features", "gaps", "counts").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in thousandths of a standard Gumbel draw, keyed by the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list, parts: int, what: str) -> DataFrame:
    """rows with rank 1, 2, 3, ... in the order: dealt by ranges and written once."""
    put = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), what)
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in put.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts += [F.lit(p), F.lit(before)]
        before += n
    start = F.create_map(*starts)[part] if starts else F.lit(0)
    return put.withColumn("rank", start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every document.
    target's first column named text gives the target texts."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spill = staged(spilled(docs), "buckets", ARROW_BYTES)
    goal = merged(spilled(target.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    gain = [r.gain for r in gains(merged(spill), goal).orderBy("bucket").collect()]
    scored = staged(weighed(spill, gain).withColumn("score", F.col("weight") + chance(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()), "scores", ARROW_BYTES)
    drop(spill)
    enough = F.col("n_words") >= least_words
    draw = percent * scored.where(enough).count() // 100
    best = ranked(scored.where(enough), [F.col("score").desc(), F.col("doc_id"), F.col("row")], parts, "ranks").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")

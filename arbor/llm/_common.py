"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.stage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Frees a query's shuffle files when it ends, instead of at some later collection.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch, 64 MB by default.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, what: str, batch_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, no lost
    executor makes an expensive stage run twice, and the shuffle files go at once.  The
    files go when the session ends, or before by plans.stage.drop().  batch_bytes: how
    large Arrow batches of df's own steps may get."""
    spark = df.sparkSession
    conf = {FREE_SHUFFLES: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return cut(df, what)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k: the train / held-out split."""
    return F.crc32(doc_id.cast("string")) % k


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Bytes of text that a fit collects at most, over all its groups.
SAMPLE_BYTES = 24 << 20


def chosen_texts(docs: DataFrame, chosen: DataFrame, on: list[str], most_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (doc_id, y, text) of a bounded sample.  chosen has the columns of on (doc_id
    first), y and r, a place within y, in a bounded number of rows.  A chosen key gives
    one text, the one of least hash, however often it repeats.  Texts are whole; within
    each y they are taken in the order of r as long as the bytes of that y, an even part
    of most_bytes, are not spent, passing over texts that no longer fit; a y of which none
    fits gives its shortest one."""
    some = docs.select(*on, text_of().alias("text")).join(F.broadcast(chosen), on)
    some = staged(some.groupBy("doc_id", "y", "r").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
                  .withColumn("n", F.octet_length("text")), "sample")
    rows = some.select("y", "r", "doc_id", "n").collect()
    room = {y: most_bytes // max(1, len({r.y for r in rows})) for y in {r.y for r in rows}}
    take = []
    for r in sorted(rows, key=lambda r: (str(r.y), r.r)):
        if r.n <= room[r.y]:
            room[r.y] -= r.n
            take.append((r.y, r.r))
    have = {y for y, _ in take}
    take += [(y, min((r.n, r.r) for r in rows if r.y == y)[1]) for y in room if y not in have]
    keep = set(take)
    if len(keep) < len(rows):
        some = some.join(F.broadcast(docs.sparkSession.createDataFrame(take, some.select("y", "r").schema)), ["y", "r"]) if take else some.limit(0)
    return some.select("doc_id", "y", "r", "text").collect()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, k: int, held: int,
                    per_class: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """A bounded training sample, and how many labelled ids of each label there are in
    all: up to per_class rows of each label value and most_bytes of text, taken in the
    order of a hash of the id, from rows outside the held-out fold.  Only ids are sorted;
    texts are fetched by a join with the (at most 2 * per_class) chosen ids.  An id with
    both labels counts for each."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)
                      & (fold(F.col("doc_id"), k) != held)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r.y: r["count"] for r in ok.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = ok.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        part = part.select("doc_id", "y", F.xxhash64("doc_id").alias("r"))
        chosen = part if chosen is None else chosen.unionByName(part)
    return sorted((r.doc_id, r.text, r.y) for r in chosen_texts(docs, chosen, ["doc_id"], most_bytes)), counts


def pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 2 << 20):
    """Yield (first row, texts) for runs of rows of about most_bytes; nulls are ''."""
    col = batch.column(batch.schema.get_field_index(column))
    start, size, texts = 0, 0, []
    for i in range(len(col)):
        t = col[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= most_bytes:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts


def schema_with(df: DataFrame, kept: list[str], ddl: str) -> StructType:
    """The kept columns of df, then those of the DDL string."""
    return StructType([df.schema[c] for c in kept] + StructType.fromDDL(ddl).fields)

"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to 32 counts, the set bits of each 2-bit segment.
The Manhattan distance of two count vectors never exceeds the Hamming distance of the
fingerprints.  The counts are cut into B runs of segments; a distance of D or less leaves
at least B - D runs untouched, so two near fingerprints share one of the grid cells
(B - D runs, their counts).  B grows with the number of fingerprints, so that the
expected pairs of strangers in a fingerprint's cells stay below STRANGERS.  Within a cell
the Manhattan bound filters, and the exact Hamming distance decides.

Cells emit what their links connect, one pair a row and never all pairs; cells above
``cell_rows`` are cut into chunks, and every pair of chunks is a task of its own.
Components come from distributed minimum-label propagation over fingerprints, so every
row links, with an id or without.

Nulls and empty texts have fingerprint 0.  Rows of equal text share one fingerprint.
Extra columns of the input are ignored.  The component_id is the least id of the
component, null where no row of it has an id.
"""
from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop
from ._common import schema_with, staged, text_of

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: Pairs of strangers a fingerprint may meet in all its cells, as expected.
STRANGERS = 64
CELL_ROWS = 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if there are
    fewer words; nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one text over its word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, keys: list[str] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns of keys, fp (the fingerprint as a signed long): one row per
    input row."""
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text_of().alias("text"))

    def run(batches):
        for b in batches:
            col = b.column(b.num_columns - 1)
            fp = pa.array([_signed(fingerprint(col[i].as_py(), shingle)) for i in range(len(col))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=["doc_id", *keys, "fp"])

    return data.mapInArrow(run, schema_with(data, ["doc_id", *keys], "fp long"))


def counts_of(fp: np.ndarray) -> np.ndarray:
    """Set bits of each 2-bit segment, n x 32."""
    bits = np.unpackbits(fp.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), 32, 2).sum(axis=2, dtype=np.uint8)


def runs_for(fingerprints: int, distance: int = MAX_DISTANCE) -> int:
    """How many runs to cut the counts into: the fewest that keep strangers apart.  A
    count has 1.5 bits of entropy."""
    for b in range(distance + 2, 33):
        cells, bits = comb(b, distance), 48 * (b - distance) / b
        if fingerprints * cells <= STRANGERS * 2 ** bits or cells > 4096:
            return b
    return 32


def _cell_rows(distance: int, runs: int):
    """The cells of each fingerprint, one row each."""
    cut = [round(i * 32 / runs) for i in range(runs + 1)]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fp):
                continue
            c = counts_of(fp.view(np.uint64)).astype(np.int64)
            code = [c[:, cut[i]:cut[i + 1]] @ (3 ** np.arange(cut[i + 1] - cut[i], dtype=np.int64)) for i in range(runs)]
            cells = []
            for k, kept in enumerate(combinations(range(runs), runs - distance)):
                cell = np.full(len(fp), k, np.int64)
                for i in kept:
                    cell = cell * 3 ** (cut[i + 1] - cut[i]) + code[i]
                cells.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.tile(fp, len(cells)))], names=["cell", "fp"])

    return run


def links_in_groups(group: np.ndarray, fp: np.ndarray, distance: int = MAX_DISTANCE):
    """What the links within equal runs of the sorted array group connect: fingerprints,
    each with the first of its run that it is connected to.

    Row i is held against row i + lag for lag 1, 2, ... as long as some group reaches
    that far, so memory stays linear whatever the size of a group."""
    n = len(group)
    parent = np.arange(n)
    label = np.arange(n)
    counts = counts_of(fp.view(np.uint64)).astype(np.int8)
    bits = fp.view(np.uint64)
    left = np.arange(n - 1)
    lag = 0

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    while True:
        lag += 1
        left = left[left + lag < n]
        left = left[group[left] == group[left + lag]]
        if not len(left):
            break
        i = left[label[left] != label[left + lag]]
        manhattan = np.abs(counts[i] - counts[i + lag]).sum(axis=1)
        i = i[manhattan <= distance]
        i = i[np.bitwise_count(bits[i] ^ bits[i + lag]) <= distance]
        for p in i.tolist():
            a, b = root(p), root(p + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(i):
            label = parent.copy()
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    joined = np.flatnonzero(label != np.arange(n))
    return fp[joined], fp[label[joined]]


def _cell_links(distance: int):
    """Rows come sorted by group; a group may go on in the next batch."""
    def links(group, fp):
        u, v = links_in_groups(group, fp, distance)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))
            done, held = [x[:end] for x in held], [x[end:] for x in held]
            if end:
                yield links(*done)
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def near_links(distinct: DataFrame, cell_rows: int = CELL_ROWS, distance: int = MAX_DISTANCE) -> DataFrame:
    """u, v: pairs of fingerprints that connect what lies within the distance; distinct
    has fp, each once."""
    runs = runs_for(distinct.count(), distance)
    cells = distinct.select("fp").mapInArrow(_cell_rows(distance, runs), "cell long, fp long")
    crowded = (cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
               .select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tasks = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                    lambda j: F.least(chunk, j) * F.col("chunks") + F.greatest(chunk, j)))
    grouped = (cells.join(crowded, "cell", "left").select("cell", "fp", F.explode(tasks).alias("task"))
               .select(F.xxhash64("cell", "task").alias("grp"), "fp"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (grouped.repartition(parts, "grp").sortWithinPartitions("grp", "fp")
            .mapInArrow(_cell_links(distance), "u long, v long"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the least node reachable, for every node of an edge but the least
    ones themselves.

    Large-star / small-star: every round moves edges to the smallest neighbour; two
    equal rounds end it.  Each round is written to the shared folder.  More rounds than
    given (they grow with the logarithm of the edges) raise ValueError."""
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, edges = edges, staged(small, "edges")
        drop(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = now
    raise ValueError("components are not finished")


def stars(links: DataFrame) -> DataFrame:
    """u, v with the same components: each u with its least partner, and its partners with
    that one.  A u has a partner in each of its cells at most, so its set is small; many
    u of one group name the same few partners, so most pairs become one."""
    least = links.groupBy("u").agg(F.collect_set("v").alias("vs")).select("u", "vs", F.array_min("vs").alias("v"))
    return least.select(F.explode(F.array_union(F.array("u"), "vs")).alias("u"), "v").where("u <> v").distinct()


def groups_of(fps: DataFrame, cell_rows: int = CELL_ROWS, distance: int = MAX_DISTANCE) -> DataFrame:
    """fp, component (the least fingerprint reachable), each fingerprint once."""
    distinct = staged(fps.select("fp").distinct(), "distinct")
    comp = components(stars(near_links(distinct, cell_rows, distance)))
    return distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; a row per document."""
    fps = staged(fingerprints(docs), "fingerprints")
    groups = staged(groups_of(fps, cell_rows), "groups")
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("id")).join(groups, "fp").groupBy("component").agg(F.min("id").alias("component_id"))
    named = groups.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The stage's links: word shingles, least Jaccard similarity of their sets.
WORDS = 5
SIMILAR = 0.8
#: Bits of the 128 of both fingerprints by which similar texts may differ; a pair at
#: SIMILAR differs in 19.4 on average, with a deviation of 4.1, unrelated ones in 64.
REACH = 31
#: A count of two texts that differ in 12 of 64 bits, or are unrelated, agrees this often.
SAME, CHANCE = 0.68, 0.375
#: Probability with which such a pair shares a cell.
FOUND = 0.96
#: Strangers in a cell, as expected: more of them make fewer, fuller cells, which trades
#: shuffled rows for comparisons of 16 bytes each.
CELL_TEXTS = 2048
GROUP_ROWS = 512


def tables_for(texts: int) -> tuple[int, int]:
    """How many samples of counts make cells, and of how many counts: as many counts as
    leave CELL_TEXTS of the texts in a cell."""
    counts = min(24, max(3, int(np.ceil(np.log(max(texts, 1) / CELL_TEXTS) / -np.log(CHANCE)))))
    return int(np.ceil(np.log(1 - FOUND) / np.log(1 - SAME ** counts))), counts


def _mixed(h: np.ndarray) -> np.ndarray:
    """Second, independent hashes of hashes."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


def _texts(batches):
    """name, text -> name, two fingerprints over the set of shingles."""
    for b in batches:
        cols = [[], []]
        for t in b.column(1):
            h = np.unique(shingle_hashes(t.as_py(), WORDS))  # links are of sets: repeats must not move the fingerprints
            for c, v in zip(cols, (_signed(majority(h)), _signed(majority(_mixed(h))))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["name", "fp", "fp2"])


def _sampled_cells(tables: int, counts: int):
    draw = np.random.default_rng(17)
    picks = [draw.choice(32, counts, replace=False) for _ in range(tables)]
    power = 3 ** np.arange(counts, dtype=np.int64)

    def run(batches):
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fp):
                continue
            c = counts_of(fp.view(np.uint64)).astype(np.int64)
            cells = [c[:, p] @ power + k * 3 ** counts for k, p in enumerate(picks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *(pa.concat_arrays([b.column(i)] * tables) for i in range(3))], names=["cell", "name", "fp", "fp2"])

    return run


def forest(group: np.ndarray, compare) -> tuple[np.ndarray, np.ndarray]:
    """What the links within equal runs of the sorted array group connect: each row with
    the first row it is connected to, itself left out.  compare(i, j) tells which of the
    pairs of rows are links.  Rows are held against those so many places on, as long as a
    group reaches that far and they are not yet joined."""
    n = len(group)
    label, left = np.arange(n), np.arange(n)
    lag = 0
    while True:
        lag += 1
        left = left[left + lag < n]
        left = left[group[left] == group[left + lag]]
        if not len(left):
            joined = np.flatnonzero(label != np.arange(n))
            return joined, label[joined]
        i = left[label[left] != label[left + lag]]
        for p in i[compare(i, i + lag)].tolist():
            a, b = int(label[p]), int(label[p + lag])
            if a != b:
                lo, hi = np.searchsorted(group, group[p]), np.searchsorted(group, group[p], "right")
                part = label[lo:hi]
                part[part == max(a, b)] = min(a, b)


def _grouped(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows with grp for key: keys of more rows than most are cut into chunks by name, and
    every pair of chunks is a group of its own.  The crowded keys are written first: where
    they are few, Spark sees that by their size and broadcasts them, and the rows are
    dealt once."""
    crowded = staged(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
                     .select(key, F.ceil(F.col("n") / most).cast("int").alias("chunks")), "crowded")
    chunk = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    tasks = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(chunk, j) * F.col("chunks") + F.greatest(chunk, j)))
    rest = [c for c in rows.columns if c != key]
    return rows.join(crowded, key, "left").select(key, *rest, F.explode(tasks).alias("task")).select(F.xxhash64(key, "task").alias("grp"), *rest)


def _dealt(rows: DataFrame) -> DataFrame:
    """Dealt by grp and sorted by grp and name, so that many groups of the same rows name
    the same first one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "grp").sortWithinPartitions("grp", "name")


def _links(solve):
    """mapInArrow over rows sorted by their first column, by whole groups, of about a
    batch together; solve(columns) gives pairs of names."""
    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = held.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if end:
                yield _pairs(*solve(held.slice(0, end)))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield _pairs(*solve(held))

    return run


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _near(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows grp, name, fp, fp2: names whose fingerprints differ in REACH bits at most."""
    grp, name, fp, fp2 = (table.column(i).to_numpy() for i in range(4))
    counts = counts_of(fp.view(np.uint64)).astype(np.int8)
    one, two = fp.view(np.uint64), fp2.view(np.uint64)

    def compare(i, j):
        far = np.bitwise_count(two[i] ^ two[j])
        ok = far <= REACH
        # Manhattan distance of the counts as a lower bound, then the exact distance
        ok[ok] = np.abs(counts[i[ok]] - counts[j[ok]]).sum(axis=1) + far[ok] <= REACH
        ok[ok] = np.bitwise_count(one[i[ok]] ^ one[j[ok]]) + far[ok] <= REACH
        return ok

    a, b = forest(grp, compare)
    return name[a], name[b]


def _similar(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows grp, name, text: names whose sets of shingles have a Jaccard similarity of
    SIMILAR or more; two empty sets are equal.  Whole groups of about GROUP_ROWS rows at
    a time have their sets in memory."""
    grp, at, found = table.column(0).to_numpy(), 0, []
    while at < len(grp):
        end = int(np.searchsorted(grp, grp[min(at + GROUP_ROWS, len(grp)) - 1], "right"))
        found.append(_verified(table.slice(at, end - at)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _verified(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    grp, name = (table.column(i).to_numpy() for i in range(2))
    known = {}
    for x, text in zip(name.tolist(), table.column(2)):
        if x not in known:
            known[x] = np.unique(shingle_hashes(text.as_py(), WORDS))
    sets = [known[x] for x in name.tolist()]
    size = np.array([len(x) for x in sets])

    def compare(i, j):
        ok = np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j])
        for k in np.flatnonzero(ok).tolist():
            x, y = sets[i[k]], sets[j[k]]
            both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) if len(y) else 0
            ok[k] = both >= SIMILAR * (len(x) + len(y) - both)
        return ok

    a, b = forest(grp, compare)
    return name[a], name[b]


def similar_groups(texts: DataFrame, cell_rows: int = CELL_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """name, component of texts (name, text; rows of one name have one text) that are
    linked to another: links are similarities of SIMILAR or more over sets of WORDS-word
    shingles.

    Candidates are pairs whose two fingerprints differ in REACH bits at most together;
    they meet in cells of sampled counts of the first (a pair that differs in 12 bits
    shares one with probability FOUND).  What candidates connect is verified exactly, all against all
    that are not joined yet; a similar pair is lost only if no chain of candidates
    connects it.  Sets of shingles are larger than their texts, so none are written or
    dealt: candidates' texts travel, and their sets are made where they are compared."""
    t = staged(texts.select("name", "text").mapInArrow(_texts, "name long, fp long, fp2 long").dropDuplicates(["name"]), "fingerprints")
    tables, counts = tables_for(t.count())
    cells = t.select("name", "fp", "fp2").mapInArrow(_sampled_cells(tables, counts), "cell long, name long, fp long, fp2 long")
    near = components(stars(_dealt(_grouped(cells, "cell", cell_rows)).mapInArrow(_links(_near), "u long, v long")))
    near_names = staged(near.select(F.col("component").alias("group"), F.col("node").alias("name")), "near")
    near = near_names.unionByName(near_names.select("group", F.col("group").alias("name")).distinct())  # the least names
    # one text a name before the join, so that many copies of a text make no task long
    one = texts.groupBy("name").agg(F.first("text").alias("text"))
    groups = _grouped(near, "group", group_rows).join(one, "name").select("grp", "name", "text")
    out = components(stars(_dealt(groups).mapInArrow(_links(_similar), "u long, v long")))
    drop(t, near_names)  # components() has written what it needs
    return out.withColumnRenamed("node", "name")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of similar texts (similar_groups): that of the least
    doc_id (rows of null id come last), among rows of one id that of the least hash;
    repeated rows leave one."""
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    named = docs.select("*", F.xxhash64(text_of()).alias("_name"), F.xxhash64("doc_id", text_of()).alias("_k1"), F.xxhash64(F.lit(7), *plain).alias("_k2"))
    groups = staged(similar_groups(named.select(F.col("_name").alias("name"), text_of().alias("text"))), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    rows = named.groupBy("_name", "doc_id", "_k1", "_k2").count()
    first = rows.groupBy("_name").agg(F.min(F.struct(place.alias("p"), "count")).alias("f"))
    kept = staged(first.join(groups, F.col("_name") == F.col("name"), "left").groupBy(F.coalesce("component", "_name").alias("g")).agg(F.min("f").alias("f"))
                  .select("f.p._k1", "f.p._k2", (F.col("f.count") > 1).alias("_many")), "kept")
    one = named.join(kept.where("not _many").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi")
    many = named.join(kept.where("_many").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return one.unionByName(many).select(*docs.columns)

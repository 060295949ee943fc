"""Prefix trie of conversations: which openings are shared, and what sharing saves.

Every prefix of a conversation's turns is a node.  A prefix is named by 128 bits, the
running xor of hashes of (place, role, text), so equal prefixes meet by name anywhere.
Prefixes with at most SHARD turns below them (each member's remaining turns) are light:
the conversations under one light prefix are a shard, and shards travel to tasks as label
arrays.  There numpy builds a level-order (LOUDS) bitvector and label arrays for several
shards at a time and rolls leaves and savings up in reverse breadth-first order with
add.at.  Heavier prefixes, the few upper levels, are merged apart by grouped sums: a
shard's totals enter at its first member, running sums along that conversation's heavy
prefixes carry them upwards, and each heavy prefix adds up its members.

Places, names and running sums come from rows dealt by ranges: a conversation may span
ranges, whose at most one open conversation each is completed from the ranges before.
So neither a conversation nor a prefix with a third of all rows is held by one task; the
ids that end at one heavy node are hashed as a stream of blocks, in order.

Null roles and texts are empty.  Null turns come first; equal turns are ordered by the
hash of role and text, so repeated rows stay turns of their own.  Rows without conv_id
belong to no conversation.  An empty table has no nodes, not even a root.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import staged

#: Turns below a prefix that are worked on in one shard, and turns of shards taken together.
SHARD = 1 << 14
GROUP = 1 << 16
#: Ids in one block of the stream that is hashed.
BLOCK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------- running values along long groups

def along(rows: DataFrame, key: str, order: list, xors: list[str] = (), sums: list[str] = (), what: str = "along") -> DataFrame:
    """rows (written) with at: place among the rows of their long key in the order, from
    0, and for the long columns of xors and sums their running value, run_<name>.  The
    order must tell unequal rows of a key apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*xors, *sums]
    ops = [np.bitwise_xor] * len(xors) + [np.add] * len(sums)
    fields = [f.name for f in rows.schema]
    schema = StructType(rows.schema.fields + StructType.fromDDL(", ".join(["at long", "range int", *(f"run_{n} long" for n in names)])).fields)

    def run(batches):
        part, last, count, carry = TaskContext.get().partitionId(), None, 0, [0] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(fields.index(key)).to_numpy()
            first = np.flatnonzero(np.concatenate([[k[0] != last], k[1:] != k[:-1]]))
            start = np.zeros(len(k), np.int64)
            start[first] = first
            start = np.maximum.accumulate(start)
            going = start == 0 if not len(first) or first[0] else np.zeros(len(k), bool)
            at = np.arange(len(k)) - start + np.where(going, count, 0)
            cols = []
            for i, (n, op) in enumerate(zip(names, ops)):
                x = b.column(fields.index(n)).to_numpy()
                acc = op.accumulate(x)
                before = np.where(start > 0, acc[np.maximum(start - 1, 0)], 0)
                acc = acc ^ before if op is np.bitwise_xor else acc - before
                acc = op(acc, np.where(going, carry[i], op.identity))
                cols.append(pa.array(acc))
                carry[i] = int(acc[-1])
            last, count = k[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.full(len(k), part, np.int32)), *cols], schema=_arrow(b, names))

    def _arrow(b, names):
        more = [pa.field("at", pa.int64()), pa.field("range", pa.int32()), *(pa.field(f"run_{n}", pa.int64()) for n in names)]
        return pa.schema([*b.schema, *more])

    put = staged(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema), what)
    edges = sorted(put.groupBy("range").agg(F.min(key), F.max(key)).collect())
    open_keys = sorted({b[1] for a, b in zip(edges, edges[1:]) if a[2] == b[1]})
    if not open_keys:
        return put.drop("range")
    total = [F.count("*").alias("n"), *(F.max_by(f"run_{n}", "at").alias(n) for n in names)]
    so_far, offsets = {}, []
    for r in sorted(put.where(F.col(key).isin(open_keys)).groupBy(key, "range").agg(*total).collect(), key=lambda r: (r[0], r[1])):
        count, values = so_far.get(r[0], (0, [0] * len(names)))
        offsets.append((r[0], r[1], count, *values))
        so_far[r[0]] = (count + r.n, [int(op(np.int64(v), np.int64(r[n]))) for op, v, n in zip(ops, values, names)])
    # at most two rows a range
    added = put.sparkSession.createDataFrame(offsets, ", ".join([f"{key} long", "range int", "_n long", *(f"_{n} long" for n in names)]))
    out = put.join(F.broadcast(added), [key, "range"], "left").withColumn("at", F.col("at") + F.coalesce("_n", F.lit(0)))
    for n in names:
        more = F.coalesce(f"_{n}", F.lit(0))
        out = out.withColumn(f"run_{n}", F.col(f"run_{n}").bitwiseXOR(more) if n in xors else F.col(f"run_{n}") + more)
    return out.select(*fields, "at", *(f"run_{n}" for n in names))


# ------------------------------------------------- rebuilt conversations

def labelled(conversations: DataFrame) -> DataFrame:
    """conv_id, at, l1, l2, bytes: every turn in its place, its role and text as a name of
    128 bits, and the UTF-8 bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("l1"),
                                                             F.xxhash64(F.lit(2), role, text).alias("l2"), F.octet_length(text).cast("long").alias("bytes"))
    return along(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("l1"), F.col("l2")], what="turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of every conversation and (conv_id, depth, size, l1, l2, bytes) of
    its turns, when each opens with the first crc32(id) % 9 turns of conversation
    id - id % 5 in place of as many turns of its own."""
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", base)
    lender = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    lent = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = staged(own.join(lender, "base", "left").withColumn("lent", lent).withColumn(
        "size", F.when(F.col("conv_id") == F.col("base"), F.col("n")).otherwise(F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))), "conversations")
    others = convs.where("conv_id != base")
    kept = turns.where(base == F.col("conv_id")).join(convs.select("conv_id", "size"), "conv_id").withColumn("depth", F.col("at") + 1)
    rest = turns.where((base != F.col("conv_id")) & (F.col("at") >= h)).join(others.select("conv_id", "size", "lent"), "conv_id").withColumn("depth", F.col("at") - h + F.col("lent") + 1)
    opening = turns.where((F.col("conv_id") % 5 == 0) & (F.col("at") < 8)).select(F.col("conv_id").alias("base"), "at", "l1", "l2", "bytes")
    borrowed = others.select("conv_id", "base", "h", "size").join(opening, "base").where("at < h").withColumn("depth", F.col("at") + 1)
    cols = ["conv_id", "depth", "size", "l1", "l2", "bytes"]
    return convs.select("conv_id", "size"), kept.select(*cols).unionByName(rest.select(*cols)).unionByName(borrowed.select(*cols))


# ------------------------------------------------- tries of shards

class Louds:
    """A forest in level order below one super-root: bits hold, for each node, a one per
    child and a zero; labels, the nodes' turn names; levels, where each level begins."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray, levels: list[int]):
        zeros = np.cumsum(degrees) + np.arange(len(degrees))
        bits = np.ones(int(zeros[-1]) + 1, np.uint8)
        bits[zeros] = 0
        self.bits, self.n_bits, self.labels, self.levels = np.packbits(bits), len(bits), labels, levels

    def parents(self) -> np.ndarray:
        """The k-th one belongs to node k, and stands in its parent's run: the zeros
        before it are the parents passed.  -1 for the super-root."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.n_bits))
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(np.unpackbits(self.bits, count=self.n_bits) == 0), prepend=-1) - 1

    def roll_up(self, *values: np.ndarray) -> None:
        """Adds every node's values to its parent's, deepest level first."""
        parent = self.parents()
        for lo, hi in zip(self.levels[-2::-1], self.levels[:0:-1]):
            if lo > 0:
                for v in values:
                    np.add.at(v, parent[lo:hi], v[lo:hi])


def grow(shard: np.ndarray, cut: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of sequences (labels cut[i]:cut[i+1] of sequence i) of shards 0, 1, ...,
    and the node of every label."""
    node, at = np.empty(len(l1), np.int64), shard + 1
    n_shards = int(shard.max()) + 1
    size, levels, n = np.diff(cut), [0, 1], 1 + n_shards
    degrees, labels = [np.array([n_shards])], [np.zeros((1, 2), np.int64), np.zeros((n_shards, 2), np.int64)]
    live, parent_lo = np.arange(len(size)), 1
    node[cut[live]] = at  # all sequences of a shard begin alike
    labels[1][at - 1] = np.stack([l1[cut[live]], l2[cut[live]]], 1)
    levels.append(n)
    for depth in range(1, int(size.max()) + 1):
        live = live[size[live] > depth]
        k = cut[live] + depth
        parent = node[k - 1]
        order = np.lexsort([l2[k], l1[k], parent])
        p, a, b = parent[order], l1[k][order], l2[k][order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(k) else np.zeros(0, bool)
        node[k[order]] = n + np.cumsum(new) - 1
        degrees.append(np.bincount(p[new] - parent_lo, minlength=n - parent_lo))
        labels.append(np.stack([a[new], b[new]], 1))
        parent_lo, n = n, n + int(new.sum())
        if n == parent_lo:
            break
        levels.append(n)
    return Louds(np.concatenate(degrees), np.concatenate(labels), levels), node


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, p1 long, p2 long"


def _tries(batches):
    """Nodes of shards, which come together; p1 and p2 name the parent of a shard's root."""
    def solve(rows):
        conv, s1, s2, p1, p2, depth = (np.array([r[i] for r in rows], np.int64) for i in range(6))
        shard = np.cumsum(np.concatenate([[0], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]))
        cut = np.concatenate([[0], np.cumsum([len(r[6]) for r in rows])])
        l1, l2, size = (np.concatenate([r[i] for r in rows]) for i in (6, 7, 8))
        trie, node = grow(shard, cut, l1, l2)
        n, who = trie.levels[-1], np.repeat(np.arange(len(rows)), np.diff(cut))
        least, members, width = np.full(n, np.iinfo(np.int64).max), np.bincount(node, minlength=n), np.zeros(n, np.int64)
        np.minimum.at(least, node, conv[who])
        width[node] = size
        degrees, parent = trie.degrees(), trie.parents()
        leaves, saved = (degrees == 0).astype(np.int64), np.maximum(members - 1, 0) * width
        trie.roll_up(leaves, saved)
        level = np.searchsorted(trie.levels, np.arange(n), "right") - 2
        top = np.zeros(n, np.int64)
        top[node] = depth[who]
        ends = np.full(n, EMPTY, object)
        last = node[cut[1:] - 1]
        order = np.lexsort([conv, last])
        bounds = np.flatnonzero(np.concatenate([[True], last[order][1:] != last[order][:-1], [True]]))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            ends[last[order[a]]] = hashlib.sha256(",".join(map(str, conv[order[a:z]].tolist())).encode()).hexdigest()
        root = np.zeros(n, bool)
        root[1:trie.levels[2]] = True
        q1, q2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        q1[shard + 1], q2[shard + 1] = p1, p2
        cols = [least, top + level, least[parent], members, degrees, leaves, saved, ends, q1, q2]
        masks = [None, None, root, None, None, None, None, None, ~root, ~root]
        kinds = [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c[1:], k, mask=None if m is None else m[1:]) for c, m, k in zip(cols, masks, kinds)], names=[f.split(" ")[0] for f in _NODE.split(", ")])

    held, turns = [], 0
    for b in batches:
        plain, lists = [b.column(i).to_pylist() for i in range(6)], [b.column(i) for i in range(6, 9)]
        flat = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in lists]
        for i in range(b.num_rows):
            row = [c[i] for c in plain] + [v[o[i]:o[i + 1]] for o, v in flat]
            if turns > GROUP and held[-1][1:3] != row[1:3]:
                yield solve(held)
                held, turns = [], 0
            held.append(row)
            turns += len(row[6])
    if held:
        yield solve(held)


# ------------------------------------------------- the whole trie

def _ends(rows: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of (k1, k2, conv_id): ids in order, blocks by ranges, then one
    running hash for each node as its blocks stream by."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        held, last = [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*last, held[0])] + [pa.array([",".join(map(str, held))])], names=["k1", "k2", "first", "ids"])
        for b in batches:
            for k1, k2, c in zip(*(x.to_pylist() for x in b.columns)):
                if held and ((k1, k2) != last or len(held) >= BLOCK):
                    yield out()
                    held = []
                last = (k1, k2)
                held.append(c)
        if held:
            yield out()

    def digests(batches):
        last, state = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([state.hexdigest()])], names=["k1", "k2", "ends_sha256"])
        for b in batches:
            for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (k1, k2) != last:
                    if last is not None:
                        yield out()
                    last, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if last is not None:
            yield out()

    order = ["k1", "k2", "conv_id"]
    put = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(blocks, "k1 long, k2 long, first long, ids string")
    return put.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def nodes(convs: DataFrame, turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie's nodes, from (conv_id, size) and (conv_id, depth, size, l1, l2, bytes)."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = [F.xxhash64(F.lit(k), "depth", "l1", "l2").alias(f"c{k}") for k in (1, 2)]
    rows = along(turns.select("*", *name), "conv_id", ["depth"], xors=["c1", "c2"], what="prefixes")
    rows = rows.select("conv_id", "depth", (F.col("size") - F.col("depth") + 1).alias("left"), "l1", "l2", "bytes", F.col("run_c1").alias("k1"), F.col("run_c2").alias("k2"),
                       F.col("run_c1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("run_c2").bitwiseXOR(F.col("c2")).alias("p2"))
    key, up = ["k1", "k2"], ["p1", "p2"]
    heavy = staged(rows.groupBy(*key).agg(F.sum("left").alias("weight"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
                                          F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")).where(F.col("weight") > shard).drop("weight"), "heavy-prefixes")
    light = (rows.join(heavy.select(*key), key, "left_anti").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("depth", "l1", "l2", "bytes"))).alias("t"), F.min_by(F.struct(*key, *up), "depth").alias("s"), F.min("depth").alias("top"))
             .select("conv_id", "s.*", "top", "t.l1", "t.l2", "t.bytes"))
    below = staged(light.repartition(parts, *key).sortWithinPartitions(*key, "conv_id").mapInArrow(_tries, _NODE), "light-nodes")

    root = convs.agg(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*key, "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    entering = below.where("p1 is not null")
    upper = heavy.unionByName(root)
    n_children = (heavy.select(*up).unionByName(entering.select(*up)).groupBy(*up).agg(F.count("*").alias("n_children"))
                  .withColumnsRenamed({"p1": "k1", "p2": "k2"}))
    upper = staged(upper.join(n_children, key, "left").fillna(0, "n_children").withColumns({
        "leaf": (F.col("n_children") == 0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("bytes")}), "upper-nodes")

    # what enters the heavy prefixes of a conversation, by depth, summed upwards
    items = (upper.select("conv_id", "depth", "leaf", "own").unionByName(entering.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaf"), F.col("saved_tokens").alias("own")))
             .groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")))
    items = staged(items, "entering")
    path = rows.join(heavy.select(*key), key, "left_semi").select("conv_id", "depth", *key)
    path = path.join(items, ["conv_id", "depth"], "left").fillna(0, ["leaf", "own"])
    path = along(path, "conv_id", [F.col("depth").desc()], sums=["leaf", "own"], what="upwards")
    sums = path.groupBy(*key).agg(F.sum("run_leaf").alias("n_leaves"), F.sum("run_own").alias("saved_tokens"))
    sums = sums.unionByName(items.agg(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved_tokens")))
    ending = (rows.where("left = 1").join(heavy.select(*key), key, "left_semi").select(*key, "conv_id")
              .unionByName(convs.where("size = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")))
    parent = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = upper.join(sums, key).join(_ends(ending), key, "left").join(parent, up, "left").fillna(EMPTY, "ends_sha256")
    first = entering.drop("parent_conv_id").join(parent, up).select(*cols)
    return above.select(*cols).unionByName(first).unionByName(below.where("p1 is null").select(*cols))


def report(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of every node of the rebuilt conversations' trie."""
    convs, turns = rebuilt(labelled(conversations))
    return nodes(convs, turns, shard)

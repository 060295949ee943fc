"""The conversation trie against prefixes in dictionaries."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arbor.llm import queries, trie

SF = "/root/testdata/sf0.001"
COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trunc(c):
    return c - (abs(c) % 5) * (1 if c >= 0 else -1)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(trunc(c), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items())


def result(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


def made(seed=3):
    """Hot openings, copies, negative ids, a long conversation, repeated and null turns."""
    rng = random.Random(seed)
    rows, opening = [], [(f"u{i}", f"shared opening {i} ü" * 3) for i in range(12)]
    for c in [*range(-9, 90), *range(200, 260, 5), 1000, 1001, 1003]:
        turns = opening[:rng.randint(0, 12)] + [(rng.choice("ua"), f"text {rng.randint(0, 5)}") for _ in range(rng.randint(0, 5))] or opening[:1]
        rows += [(c, i if i else None, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(500 + i, j, "u", f"copy {j}") for i in range(60) for j in range(9)]
    rows += [(c, i, "u", f"long {i}" if i < 120 else f"{c} {i}") for c in (2000, 2005, 2006) for i in range(200)]
    rows += [(7, None, None, None), (7, None, None, None), (None, 1, "u", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard", [trie.SHARD, 40, 3])
def test_matches_dictionaries(spark, shard, monkeypatch):
    """Without, with some and with nearly all prefixes heavy."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "GROUP", 60)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(trie.report(df, shard)) == plain(rows)


def test_given_table_and_sql(spark):
    import duckdb

    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert result(queries.op12_trie(spark, SF)) == want
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op12_trie"])
    assert Counter(tuple(r[rel.columns.index(c)] for c in COLS) for r in rel.fetchall()) == want


def test_edge_tables(spark):
    none = spark.createDataFrame([], SCHEMA + ", size long, depth int, l1 string, at long")
    assert trie.report(none).collect() == []
    rows = [(3, 0, "u", "alone")]  # its opening is borrowed from an absent conversation
    assert result(trie.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    clash = [(c, t, r, x, 9, 9, "z", 9) for c, t, r, x in made(5)[:100]]
    assert result(trie.report(spark.createDataFrame(clash, none.schema))) == plain([r[:4] for r in clash])


def test_ties_follow_content(spark):
    """Equal turns of other texts: one order, however rows are dealt."""
    rows = [(5 * (i % 4), 1, "u", f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(trie.report(df.repartition(7))) == result(trie.report(df.coalesce(1)))


def test_louds_parents_and_rollup():
    shard, cut = np.array([0, 0, 1]), np.array([0, 3, 5, 6])
    t, node = trie.grow(shard, cut, np.array([1, 2, 3, 1, 9, 4]), np.zeros(6, np.int64))
    assert t.parents().tolist() == [-1, 0, 0, 1, 1, 3] and t.degrees().tolist() == [2, 2, 0, 1, 0, 0]
    assert node.tolist() == [1, 3, 5, 1, 4, 2] and t.n_bits == 2 * 6 - 1
    leaves = (t.degrees() == 0).astype(np.int64)
    t.roll_up(leaves)
    assert leaves[1:].tolist() == [2, 1, 1, 1, 1]


def test_running_values_span_ranges(spark):
    """One key holds most rows."""
    rows = [(0 if i % 5 else i, i, i * 7919 % 1009) for i in range(900)]
    got = {(r.k, r.o): (r["at"], r.run_x, r.run_y) for r in trie.along(spark.createDataFrame([(*r, r[2]) for r in rows], "k long, o long, x long, y long").repartition(6), "k", ["o"], ["x"], ["y"]).collect()}
    seen = defaultdict(lambda: (0, 0, 0))
    for k, o, x in sorted(rows):
        n, a, b = seen[k]
        assert got[k, o] == (n, a ^ x, b + x)
        seen[k] = (n + 1, a ^ x, b + x)

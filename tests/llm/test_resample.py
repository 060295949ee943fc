"""Importance resampling against plain counters."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from arbor.llm import queries, resample

SF = "/root/testdata/sf0.001"


def features(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target):
    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    best = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = Counter((r[0], *r[2:], k + 1 if k < 5 * len(best) // 100 else None) for k, r in enumerate(best))
    return ranks + Counter((r[0], *r[2:], None) for r in out if r[1] < 20)


def result(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_matches_plain_counters(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(rows, target)
    assert result(queries.op11_resample(spark, SF)) == want and any(k[4] for k in want)


def test_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op11_resample"])
    at = [rel.columns.index(c) for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert Counter(tuple(r[i] for i in at) for r in rel.fetchall()) == result(queries.op11_resample(spark, SF))


def test_edge_rows(spark, edge, edge_rows, nothing):
    texts = ["one two three", None, "", "Ünï ünï 123 \x00 a\x00b"]
    target = spark.createDataFrame([(t, None) for t in texts], "text string, doc_id string")
    want = plain([(r[0], r[1]) for r in edge_rows], texts)
    assert result(resample.resample(edge, target)) == want
    assert resample.resample(nothing, target).collect() == []
    none = result(resample.resample(edge, nothing))
    assert none == plain([(r[0], r[1]) for r in edge_rows], [])


def test_ranks_run_over_many_ranges(spark):
    """Equal texts score by their ids; every second document is drawn."""
    rows = [(i % 301, " ".join(f"w{(i * k) % 53}" for k in range(20 + i % 7))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resample.resample(df, df.limit(0), percent=50).collect()
    drawn = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 301)) and [d[1:] for d in drawn] == sorted(d[1:] for d in drawn)
    assert min(-d[1] for d in drawn) >= max(r.score for r in got if r["rank"] is None)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 77, 4097, 70_000])
def test_crc_of_joined_strings(n):
    a, b = b"some head", bytes(i * 31 % 256 for i in range(n))
    got = resample.crc32_append(pa.array([zlib.crc32(a), 0], pa.uint32()), pa.array([n, n]), pa.array([zlib.crc32(b)] * 2, pa.uint32()))
    assert got.to_pylist() == [zlib.crc32(a + b), zlib.crc32(b)]

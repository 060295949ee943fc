"""Queries take every row of their tables, and their results hold against brute force."""
import math

import numpy as np
from pyspark.sql import functions as F

from arbor import queries
from arbor.operators import foliage, growth
from arbor.sources import writers

SF = "/root/testdata/sf0.001"


def test_grow_trees_takes_all_endpoints_and_generations(spark, monkeypatch):
    seen = {}

    def grow(roots, endpoints, generations, **kw):
        seen.update(roots=roots, endpoints=endpoints, generations=generations)
        return roots

    monkeypatch.setattr(growth, "grow", grow)
    queries.grow_trees(spark, SF)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert seen["endpoints"].count() == e.count() and seen["generations"] == 40
    assert seen["roots"].count() == e.select("label").distinct().count()


SHAPE, TRIS = [(0, 0, 0), (-.04, .02, 0), (0, .1, 0), (.04, .02, 0)], [(0, 1, 2), (0, 2, 3)]


def greedy(rows, target):
    """A sequential pass over one tree's leaves: id -> direction and normal."""
    def turned(v, axis, angle):
        return v * math.cos(angle) + np.cross(axis, v) * math.sin(angle) + axis * (axis @ v) * (1 - math.cos(angle))

    def corners(r, d, n):
        at = np.array([r.sx, r.sy, r.sz])
        v = [at + r.size * (x * np.cross(n, d) + y * d + z * n) for x, y, z in SHAPE]
        return [[v[i] for i in t] for t in TRIS]

    def through(a, b):
        for p, q in ((t[i], t[(i + 1) % 3]) for t in a for i in range(3)):
            for o, e1, e2 in ((t[0], t[1] - t[0], t[2] - t[0]) for t in b):
                m = np.array([e1, e2, p - q]).T
                if abs(np.linalg.det(m)) > 1e-15:
                    u, v, t = np.linalg.solve(m, p - o)
                    if u > 0 and v > 0 and u + v < 1 and 0 < t < 1:
                        return True
        return False

    kept, out, spent = [], {}, 0.0
    for r in sorted(rows, key=lambda r: (r.key, r.leaf_id)):
        if spent >= target:
            break
        d, n = np.array([r.dx, r.dy, r.dz]), np.array([r.nx, r.ny, r.nz])
        for axis, deg in ((n, 0), (n, 45), (n, -45), (d, 30), (d, -30), (np.cross(n, d), 30), (np.cross(n, d), -30)):
            d2, n2 = turned(d, axis, math.radians(deg)), turned(n, axis, math.radians(deg))
            t = corners(r, d2, n2)
            if not any(through(t, o) or through(o, t) for o in kept):
                kept.append(t)
                out[r.tree_id, r.leaf_id] = np.concatenate([d2, n2])
                spent += r.leaf_area
                break
    return out


def leaves(spark, trees, n, wide):
    rng, rows = np.random.default_rng(3), []
    for t in range(trees):
        for i in range(n):
            d, n_ = np.linalg.qr(rng.normal(size=(3, 3)))[0][:2]
            size = float(rng.uniform(.8, 1.2))
            rows.append((t, t * 1000 + i, *(float(v) for v in (*rng.uniform(0, wide, 3), *d, *n_)), size, .004 * size * size))
    return spark.createDataFrame(rows, "tree_id int, leaf_id long, sx double, sy double, sz double, dx double, dy double, dz double, nx double, ny double, nz double, size double, leaf_area double")


def test_leaves_equal_a_sequential_pass(spark):
    rows = leaves(spark, 2, 14, .06)
    keyed = rows.withColumn("key", F.xxhash64("tree_id", "leaf_id", F.lit(9))).collect()
    for target in (.02, 9.0):  # reached, and never reached
        want = {k: v for t in (0, 1) for k, v in greedy([r for r in keyed if r.tree_id == t], target).items()}
        got = foliage.accept(rows, SHAPE, TRIS, target)
        assert got.columns == rows.columns
        found = {(r.tree_id, r.leaf_id): np.array([r.dx, r.dy, r.dz, r.nx, r.ny, r.nz]) for r in got.collect()}
        assert found.keys() == want.keys() and len(found) < len(keyed)
        assert all(np.allclose(found[k], want[k], atol=1e-9) for k in want)
        first = {(r.tree_id, r.leaf_id): (r.dx, r.dy, r.dz) for r in keyed}
        assert any(not np.allclose(want[k][:3], first[k]) for k in want)
    assert foliage.accept(rows.limit(0), SHAPE, TRIS, 1.0).count() == 0


def test_accept_leaves_serves_every_label(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert queries.accept_leaves(spark, SF).select("tree_id").distinct().count() == e.select("label").distinct().count()


def test_lines_are_written_in_ordered_parts(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 8).select((199_999 - F.col("id")).alias("row")).withColumn("line", F.format_string("%060d", "row"))
    joined = "spark.sql.adaptive.coalescePartitions.enabled"  # a few MB would be one part
    spark.conf.set(joined, "false")
    try:
        writers.write_lines(rows, str(tmp_path / "lines"), ["row"])
    finally:
        spark.conf.unset(joined)
    parts = sorted((tmp_path / "lines").glob("part-*"))
    assert len(parts) > 1
    assert [int(x) for p in parts for x in p.read_text().split()] == list(range(200_000))


def vectors(spark):
    rows = sorted((r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float32).astype(float)


def test_nearest_open_offers_every_open_row(spark):
    ids, label, v = vectors(spark)
    got = {r.ep_id: (r.node_id, r.dist) for r in queries.nearest_open_whole(spark, SF).collect()}
    for i, p in zip(ids, v):
        d = np.where(label % 2 == 0, np.sqrt(((v[:, :3] - p[:3]) ** 2).sum(1)), np.inf)
        k = int(d.argmin())
        assert got[i] == ((ids[k], round(d[k], 6)) if d[k] < .2 else (-2, None))


def test_box_overlap_joins_every_pair(spark):
    ids, _, v = vectors(spark)
    low, high = v[:, :3] - .03, v[:, :3] + .03
    meet = ((low[:, None] <= high[None]) & (low[None] <= high[:, None])).all(-1)
    want = sorted((ids[i], ids[j]) for i, j in zip(*np.nonzero(meet)) if ids[i] < ids[j])
    assert want and sorted(map(tuple, queries.box_overlap_whole(spark, SF).collect())) == want


def test_edge_conflicts_take_every_length(spark):
    ids, label, v = vectors(spark)
    u = v[:, 3:6] / np.linalg.norm(v[:, 3:6], axis=1)[:, None] * (np.abs(v[:, 6]) + .01)[:, None]
    a, b = v[:, :3], v[:, :3] + u
    near = lambda p, q, d: np.linalg.norm(p - q - np.clip(((p - q) * d).sum(-1) / (d * d).sum(-1), 0, 1)[..., None] * d, axis=-1)
    # the least distance is at an end of either segment, or inside both
    ends = [near(p[:, None], a[None], np.broadcast_to(u[None], (len(u), *u.shape))) for p in (a, b)]
    far = np.minimum(*ends)
    far = np.minimum(far, far.T)
    w, uu, uv = a[:, None] - a[None], (u * u).sum(1), u @ u.T
    den = uu[:, None] * uu[None] - uv ** 2
    uw, vw = (u[:, None] * w).sum(-1), (u[None] * w).sum(-1)
    with np.errstate(all="ignore"):
        s, t = (uv * vw - uu[None] * uw) / den, (uu[:, None] * vw - uv * uw) / den
    inside = (den > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    gap = np.linalg.norm(w + np.nan_to_num(s)[..., None] * u[:, None] - np.nan_to_num(t)[..., None] * u[None], axis=-1)
    far = np.where(inside, np.minimum(far, gap), far)
    want = sorted(ids[((far < .02) & (label[:, None] != label[None])).any(1)])
    got = sorted(r.edge_id for r in queries.edge_conflicts_whole(spark, SF).collect())
    assert got == want

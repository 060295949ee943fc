"""The voxel hull, probes to its edge, and leaf places by density."""
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arbor.operators import hull

P = "tree_id long, x double, y double, z double"


def plain_hull(points, edge, hole):
    """Flood fill of empty cells from outside, then cavities by size."""
    solid = defaultdict(set)
    for t, *p in points:
        solid[t].add(tuple(math.floor(v / edge) for v in p))
    out = {}
    for t, s in solid.items():
        lo, hi = [min(c[i] for c in s) - 1 for i in range(3)], [max(c[i] for c in s) + 1 for i in range(3)]
        free = {(x, y, z) for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1) for z in range(lo[2], hi[2] + 1)} - s
        filled = set(s)
        first = True
        start = [tuple(lo)]
        while free:
            todo = start if first else [next(iter(free))]
            free -= set(todo)
            part = []
            while todo:
                c = todo.pop()
                part.append(c)
                for i in range(3):
                    for d in (-1, 1):
                        n = tuple(c[j] + d * (i == j) for j in range(3))
                        if n in free:
                            free.discard(n)
                            todo.append(n)
            if not first and len(part) * edge**3 < hole:
                filled |= set(part)
            first = False
        out[t] = filled
    return out


def cloud(rng):
    """A ring, a hollow ball, a ball with a small cavity and random dust."""
    rows = []
    for i in range(6000):
        a, b = rng.uniform(0, 2 * math.pi), rng.uniform(0, 2 * math.pi)
        rows.append((1, (4 + math.cos(b)) * math.cos(a), (4 + math.cos(b)) * math.sin(a), math.sin(b)))
        u = rng.uniform(-1, 1)
        r = math.sqrt(1 - u * u)
        for t, size in ((2, 4.0), (3, 1.6)):
            rows.append((t, size * r * math.cos(a), size * r * math.sin(a), size * u))
    rows += [(4, *(rng.uniform(-3, 3) for _ in range(3))) for _ in range(900)]
    return rows


@pytest.fixture(scope="module")
def points():
    return cloud(random.Random(4))


def cells_of(df):
    out = defaultdict(set)
    for r in hull.cells(df).collect():
        assert (r.cx, r.cy, r.cz) not in out[r.tree_id]
        out[r.tree_id].add((r.cx, r.cy, r.cz))
    return dict(out)


def test_hull_is_a_flood_fill(spark, points):
    got = cells_of(hull.solid_runs(spark.createDataFrame(points, P).repartition(5), .5, 10.0))
    want = plain_hull(points, .5, 10.0)
    assert got == want
    assert not any((x, y, 0) in got[1] for x in (-1, 0) for y in (-1, 0))  # the ring keeps its hole
    assert (0, 0, 0) not in got[2] and (0, 0, 0) in got[3]  # only the small cavity is filled


def test_empty_cloud(spark):
    none = spark.createDataFrame([], P)
    assert hull.solid_runs(none, .5).collect() == []


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in hull.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}


def test_probe_stops_at_the_first_gap(spark, points):
    edge, reach = .5, 5.0
    df = spark.createDataFrame(points, P)
    solid = hull.cells(hull.solid_runs(df, edge, 10.0))
    rays = [(i, t, sx, 0.0, z, c, reach) for i, (t, sx, z, c) in enumerate((t, sx, z, c) for t in (1, 2, 3, 9) for sx in (0.0, 4.0) for z in (0.1, 1.2) for c in (0.0, .7, 2.2, 4.0, 6.2))]
    got = {r.ray: r.edge_distance for r in hull.with_edge_distance(spark.createDataFrame(rays, "ray long, tree_id long, sx double, sy double, z double, compass double, reach double"), solid, edge, "ray").collect()}
    want = plain_hull(points, edge, 10.0)
    for ray, t, sx, sy, z, c, reach in rays:
        y = [2 * reach * i / 99 for i in range(100)]
        inside = [(math.floor((sx - math.sin(c) * d) / edge), math.floor((sy + math.cos(c) * d) / edge), math.floor(z / edge)) in want.get(t, ()) for d in y]
        k = inside.index(False) if False in inside else 100
        assert got[ray] == pytest.approx(0.0 if k < 2 else y[k - 1])
    assert len(got) == len(rays) and any(v > 0 for v in got.values())


STEM = [(t, z, 0.1 * t * (z > 0), 0.0) for t in (2, 3, 4) for z in (-5.0, 0.5, 6.0)]


@pytest.mark.parametrize("mode", ["none", "h", "hc", "hcd"])
def test_leaves_follow_their_density(spark, points, mode):
    rows = [p for p in points if p[0] == 3]
    df = spark.createDataFrame(rows, P)
    edge, total, bins = .5, 1500, 4
    solid = hull.cells(hull.solid_runs(df, edge, 10.0)).cache()
    h = (lambda x: x * (1 - x)) if mode != "none" else None
    c = (lambda x: 1 + F.sin(x)) if "c" in mode else None
    d = (lambda x: x) if "d" in mode else None
    weights = (0.0, .3, .5, 1.0)
    voxels = df.select("tree_id", *[F.floor(F.col(n) / .3).cast("long").alias(f"c{n}") for n in "xyz"]).groupBy("tree_id", "cx", "cy", "cz").count().where("count >= 2").cache()
    stem = spark.createDataFrame(STEM, "tree_id long, z double, sx double, sy double")
    got = hull.leaf_positions(df, solid, stem, edge, total, h, c, d, voxels, weights, .3).cache()
    rows_ = got.collect()
    assert len({r.leaf_id for r in rows_}) == len(rows_)
    taken = {(r.tree_id, r.cx, r.cy, r.cz) for r in voxels.collect()}
    for t in (3,):
        mine = [r for r in rows_ if r.tree_id == t]
        assert abs(len(mine) - total) <= 1
        levels = hull.level_quota(hull.extents(df), solid, edge, total, h, bins).where(f"tree_id = {t}").collect()
        n_bin = Counter()
        for r in levels:
            n_bin[r.bin] += r.n
        for b in range(bins):
            own = [r for r in mine if r.bin == b]
            assert len(own) == n_bin[b]
            fit = [r for r in own if r.cloud]
            assert all((t, *(math.floor(v / .3) for v in (r.x, r.y, r.z))) in taken for r in fit)
            if mode in ("none", "h") and n_bin[b]:  # slices without voxels give theirs back
                assert len(fit) <= weights[b] * len(own) + 1
        if mode == "h":
            dens = [x * (1 - x) for x in ((k + .5) / 100 for k in range(100))]
            bottom, top = min(r[3] for r in rows if r[0] == t), max(r[3] for r in rows if r[0] == t)
            solid_z = {r.cz for r in solid.where(f"tree_id = {t}").collect()}
            mass = [m * (math.floor((bottom + (k + .5) / 100 * (top - bottom)) / edge) in solid_z) for k, m in enumerate(dens)]
            for b in range(bins):
                assert abs(n_bin[b] - total * sum(mass[b * 25:b * 25 + 25]) / sum(mass)) <= 1
        if mode in ("none", "h"):
            inside = got.where(f"tree_id = {t} and not cloud")
            assert hull.inside(inside, solid, edge).count() == inside.count()
        if mode == "hcd":
            # three densities: two thirds out from the stem on the mean, more where sin is positive
            free = [r for r in mine if not r.cloud]
            turn = [math.atan2(-(r.x - 0.1 * t * .5), r.y) % (2 * math.pi) for r in free]
            assert sum(a < math.pi for a in turn) > .6 * len(free)


def test_cloud_quota_follows_the_running_share(spark):
    for w in (0.0, .17, .5, .83, 1.0):
        n, got = 0, []
        for r in range(60):
            take = n <= w * r
            n += take
            got.append(take)
        df = spark.range(60).select("id", hull.from_cloud(F.col("id"), F.lit(w)).alias("c"))
        assert [r.c for r in df.orderBy("id").collect()] == got


def test_densities_come_in_order(spark):
    none = spark.createDataFrame([], P)
    with pytest.raises(ValueError):
        hull.leaf_positions(none, none, none, .5, 10, density_d=lambda x: x)

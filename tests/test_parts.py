"""Parameter checks, table forms, export options, hindered growth, the direct driver."""
import math

import pytest
from pyspark.sql import functions as F

from arbor import queries
from arbor.operators import foliage, growth, mesh, sampling, validation
from arbor.sources import readers, writers

TRI = "tri_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def test_validation():
    good = {"height": ("beta", [8, 3]), "distance": ("weibull", [2, 1.5]), "direction": ("vonmises", [1, .1]), "total_area": 20, "base_area": .004, "petiole": (.01, .02)}
    assert validation.direct(good) is good
    for bad in ({"height": ("gamma", [1])}, {"height": ("beta", [8])}, {"distance": ("weibull", [-2, 1])}, {"height": ("polynomial", [1, -1, 0])}, {"total_area": 0}, {"petiole": (.2, .1)},
                {"height": ("betamixture", [1, 1, 1, 1, 1.5])}):
        with pytest.raises(ValueError):
            validation.direct(good | bad)
    with pytest.raises(ValueError):
        validation.library({"nodes": {"length": [.2, .1]}, "base_area": 1})
    with pytest.raises(ValueError):
        validation.hull({"voxel": .1, "leaves": 5, "cloud_share": 2})


def test_row_rules(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, length double")
    assert validation.required(df, {"length": F.col("length") > 0}).collect() == df.collect()
    with pytest.raises(Exception, match="length"):
        validation.required(df.withColumn("length", F.col("length") - 2), {"length": F.col("length") > 0}).collect()


def test_cylinder_forms(spark, tmp_path):
    flat = readers.example_tree(spark)
    want = sorted(map(tuple, flat.collect()), key=lambda r: r[1])

    def same(df):
        got = sorted(map(tuple, readers.cylinder_table(df).collect()), key=lambda r: r[1])
        assert got == want

    writers.nested(flat).write.parquet(str(tmp_path / "qsm"))
    same(spark.read.parquet(str(tmp_path / "qsm")))
    vectors = flat.select("tree_id", "cyl_id", F.array("sx", "sy", "sz").alias("start"), F.array("ax", "ay", "az").alias("axis"), "length", "radius", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), "branch_index", "added")
    same(vectors)
    order = {k: c for c, k in readers.LEGACY.items()}
    values = F.array(*[F.coalesce(F.col(order[k]).cast("double"), F.lit(0.0)) if k in order else F.lit(0.0) for k in range(1, 15)])
    same(flat.select("tree_id", "cyl_id", values.alias("values")))
    with pytest.raises(ValueError):
        readers.cylinder_table(flat.drop("radius"))


def test_export(spark):
    with pytest.warns(UserWarning, match="nonsense"):
        o = writers.ExportOptions.of({"precision": 3, "nonsense": 1})
    assert o.precision == 3
    leaf = spark.createDataFrame([(0, *(0.0,) * 3, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, .5)], "leaf_no long, petx double, pety double, petz double, sx double, sy double, sz double, dx double, dy double, dz double, nx double, ny double, nz double, size double")
    lines = [r.line for r in writers.extended_obj(leaf, [(0, 0, 0), (-.04, .02, 0)], [(0, 1, 0)]).orderBy("part", "row").collect()]
    assert lines == ["v 0 0 0", "v -0.04 0.02 0", "f 1 2 1", "L 0 0 0 1 2 3 1 0 0 0 0 1 0.5 0.5 0.5"]
    assert mesh.shape_metrics([(0, 0, 0), (1, 0, 0), (0, 2, 0)], [(0, 1, 2)]) == {"dimensions": (1, 2, 0), "area": 1.0}


def test_hindered_growth(spark):
    roots = spark.createDataFrame([(1, 0., 0., 0.)], "tree_id long, x double, y double, z double")
    ends = spark.createDataFrame([(1, i, math.cos(i), math.sin(i), 1.0) for i in range(6)], "tree_id long, ep_id long, x double, y double, z double")
    ceiling = spark.createDataFrame([(0, -5., -5., .4, 5., -5., .4, 0., 9., .4)], TRI)
    free = growth.grow(roots, ends, 3, .25, 15., .1, least=0.0)
    low = growth.grow(roots, ends, 3, .25, 15., .1, least=0.0, terrain=ceiling)
    assert free.agg(F.max("z")).first()[0] > .4 > low.agg(F.max("z")).first()[0]
    ruled = growth.grow(roots, ends, 3, .25, 15., .1, least=0.0, control=(1.0, 0.0, 1.0, 1.0))
    assert ruled.where("parent_id is not null").groupBy("parent_id").count().where("count > 1").count() == 0


def test_direct_leaves_meet_their_budget(spark):
    c = readers.example_tree(spark).withColumn("branch_index", F.col("branch_index").cast("long"))
    rows = foliage.direct(c, queries.MASSES, 5.0, .004, ("uniform", (.8, 1.2)), ("spherical", "uniform", (), ()), (.02, .05)).collect()
    area = sum(r.leaf_area for r in rows)
    assert 0 < area <= 5.0 + max(r.leaf_area for r in rows)
    for r in rows[:200]:
        d, n = (r.dx, r.dy, r.dz), (r.nx, r.ny, r.nz)
        assert math.hypot(*d) == pytest.approx(1) and sum(a * b for a, b in zip(d, n)) == pytest.approx(0, abs=1e-9)


def test_thinning_and_tables(spark):
    m = spark.range(10).withColumn("shade", F.when(F.col("id") < 5, 1.0).otherwise(0.0))
    assert sampling.thinned(m, F.col("shade"), F.lit(.5)).count() == 5
    t = sampling.poisson_table(2.5)
    assert t[0] == pytest.approx(math.exp(-2.5)) and t[-1] == pytest.approx(1)


def test_leaves_that_meet_cylinders(spark):
    """Every frame of every leaf against dense points of its triangles; near misses, where
    points decide nothing, are left to neither side."""
    import numpy as np

    from arbor.operators import foliage

    shape, tris = [(0, 0, 0), (-.4, .2, 0), (0, 1., 0), (.4, .2, 0)], [(0, 1, 2), (0, 2, 3)]
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    cyl, leaves = [], []
    for i in range(12):
        cyl.append((i % 2, i, *rng.uniform(-1, 1, 3), *(unit(rng.normal(size=3)) if i else (0., 0., 1.)), float(rng.uniform(.1, 2)), float(rng.uniform(.02, .4))))
    for i in range(40):
        d = unit(rng.normal(size=3)) if i else np.array([1., 0, 0])
        n = unit(np.cross(d, rng.normal(size=3))) if i else np.array([0, 0, 1.])
        leaves.append((i % 2, i, *rng.uniform(-1, 1, 3), *d, *n, float(rng.uniform(.1, .8))))
    names = lambda p: ", ".join(f"{v}{c} double" for v in p for c in "xyz")
    c = spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in cyl], f"tree_id int, cyl_id int, {names('sa')}, length double, radius double")
    f = spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in leaves], f"tree_id int, leaf_id int, {names('sdn')}, size double")
    got = {r.leaf_id: r.bits for r in foliage.frames_blocked(f, c, shape, tris).collect()}
    grid = [(i / 60, j / 60) for i in range(61) for j in range(61 - i)]
    u, v = np.array(grid).T
    sure = 0
    for t, i, sx, sy, sz, dx, dy, dz, nx, ny, nz, size in leaves:
        for k in range(len(foliage.TURNS)):
            d, n = foliage._frame(np.array([[dx, dy, dz]]), np.array([[nx, ny, nz]]), k)
            tri = foliage._triangles(shape, tris, np.array([[sx, sy, sz]]), np.array([size]), d, n)[0]
            p = np.concatenate([a + u[:, None] * (b - a) + v[:, None] * (e - a) for a, b, e in tri])
            hit, near = False, False
            for tc, _, *g in cyl:
                if tc == t:
                    w = p - np.array(g[:3])
                    z = w @ np.array(g[3:6])
                    r = np.linalg.norm(w - z[:, None] * np.array(g[3:6]), axis=1)
                    hit |= bool(((z > 0) & (z < g[6]) & (r < g[7])).any())
                    near |= bool(((z > -.02) & (z < g[6] + .02) & (r < g[7] + .02)).any())
            if hit or not near:
                sure += 1
                assert bool(got.get(i, 0) >> k & 1) == hit, (i, k)
    assert sure > 200 and 0 < len(got) < len(leaves)
    assert foliage.frames_blocked(f.limit(0), c, shape, tris).count() == 0 and foliage.frames_blocked(f, c.limit(0), shape, tris).count() == 0


def test_merge_moves_parents_and_takes_shares(spark):
    from arbor.operators import cylinders

    rows = [(1, i, b, p, 0., 0., z, 0., 0., 1., ln, .1 * i) for i, b, p, z, ln in
            [(1, 0, None, 0., .1), (2, 0, 1, .1, .1), (3, 0, 2, .2, .1), (4, 0, 3, .3, .1), (5, 0, 4, .4, .05), (6, 1, 2, .2, .3), (7, 2, 5, .45, .01)]]
    c = spark.createDataFrame(rows, "tree_id int, cyl_id long, branch_index int, parent long, sx double, sy double, sz double, ax double, ay double, az double, length double, radius double")
    got = {r.cyl_id: (r.parent, round(r.length, 9), round(r.radius, 9)) for r in cylinders.merge_short(c, .2).collect()}
    assert got == {1: (None, .2, .15), 3: (1, .2, .35), 5: (3, .05, .5), 6: (1, .3, .6), 7: (5, .01, .7)}  # a short rest stays by itself
    got = {r.cyl_id: round(r.length, 9) for r in cylinders.merge_short(c, .6, relative=True).collect()}
    assert got == {1: .3, 4: .15, 6: .3, 7: .01}
    assert cylinders.merge_short(c.limit(0), .2).count() == 0


def test_lengths_come_into_their_span(spark):
    """Against a walk along each branch; ids beyond 2^53 beside null parents stay exact."""
    import random

    import numpy as np

    from arbor.operators import cylinders

    rng, rows, top = random.Random(4), [], 2**53 + 1
    for b in range(12):
        at = np.zeros(3)
        for k in range(rng.randint(1, 9)):
            a = np.array([rng.gauss(0, 1) for _ in range(3)])
            a /= np.linalg.norm(a)
            n = rng.choice((.03, .08, .15, .22, .5, .9))
            rows.append((1, top + 2 * len(rows), b, top + 2 * len(rows) - 2 if k else None, *at.tolist(), *a.tolist(), n, rng.random()))
            at = at + n * a
    want = []
    for b in range(12):
        own, i = [r for r in rows if r[2] == b], 0
        while i < len(own):
            j, total = i, own[i][10]
            while total < .1 and j + 1 < len(own):
                j += 1
                total += own[j][10]
            start, last = np.array(own[i][4:7]), own[j]
            end = np.array(last[4:7]) + last[10] * np.array(last[7:10])
            axis = (end - start) / np.linalg.norm(end - start) if j > i else np.array(own[i][7:10])
            n = int(np.ceil(total / .2)) if j == i and total > .2 else 1
            n = n if total / n > .1 else 1
            for p in range(n):
                want.append((own[i][1], p, last[1], *np.round(start + p * total / n * axis, 9).tolist(), *np.round(axis, 9).tolist(), round(total / n, 9), round(float(np.mean([r[11] for r in own[i:j + 1]])), 9)))
            i = j + 1
    c = spark.createDataFrame(rows, "tree_id int, cyl_id long, branch_index int, parent long, sx double, sy double, sz double, ax double, ay double, az double, length double, radius double").repartition(3)
    got = cylinders.preprocessed(c, .1, .2).collect()
    cols = ("cyl_id", "part", "last_id", "sx", "sy", "sz", "ax", "ay", "az", "length", "radius")
    assert sorted(tuple(round(r[x], 9) if isinstance(r[x], float) else r[x] for x in cols) for r in got) == sorted(want)
    firsts = {r.cyl_id: r.parent for r in got}
    into = {x[1]: max(w[0] for w in want if w[0] <= x[1]) for x in rows}
    assert all(firsts[r[1]] == (r[3] and into[r[3]]) for r in rows if r[1] in firsts)

"""The drivers: from configurations to trees, and plants between them."""
import math

import pytest
from pyspark.sql import functions as F

from arbor.operators import growth, spatial
from arbor.plans import forest

TRI = "tri_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
RAMP = [(0, 0., 0., 0., 12., 0., 0., 12., 12., 2.4), (1, 0., 0., 0., 12., 12., 2.4, 0., 12., 2.4)]
CONFIGS = [{"crown_type": "columnar", "crown_width": (2.0, .2), "crown_height": 3.0, "stem_height": 3.0, "crown_offset": 1.0, "numberOfEndpoints": (30, 4), "interNodeLength": .5, "influenceRange": 15.0, "trunk_radius": (.3, .02), "scale": .1},
           {"crown_type": "spreading", "crown_width": 2.5, "stem_height": 2.0, "numberOfEndpoints": 25, "interNodeLength": (.6, .05), "influenceRange": 8.0, "killDistance": .5}]


@pytest.fixture(scope="module")
def made(spark):
    terrain = spark.createDataFrame(RAMP, TRI)
    masses = ([.1] * 10, [.1] * 10, [.1] * 10)
    f = forest.forest(spark, terrain, CONFIGS, [1.0, 1.0], generations=6, least=.2, tries=3, leaf_masses=masses, leaf_area=2.0, seed=3)
    for name in ("trees", "nodes", "cylinders"):
        setattr(f, name, getattr(f, name).cache())
    return f


def test_trees_stand_on_the_terrain_and_grow(made):
    trees = {r.tree_id: r for r in made.trees.collect()}
    assert len(trees) > 2 and {r.crown_type for r in trees.values()} == {"columnar", "spreading"}
    nodes = made.nodes.collect()
    at = {(n.tree_id, n.node_id): n for n in nodes}
    for t, r in trees.items():
        own = [n for n in nodes if n.tree_id == t]
        assert not own or len(own) >= 2
        for n in own:
            if n.parent_id is None:
                assert (n.x, n.y, n.z) == pytest.approx((r.x, r.y, r.z))
            else:
                p = at[t, n.parent_id]
                assert math.dist((n.x, n.y, n.z), (p.x, p.y, p.z)) == pytest.approx(r.interNodeLength)
                assert n.radius <= p.radius * (1 + 1e-12)
    steps = {round(r.interNodeLength, 6) for r in trees.values() if r.crown_type == "spreading"}
    assert len(steps) > 1 or sum(r.crown_type == "spreading" for r in trees.values()) == 1  # each tree has its own draw


def test_cylinders_skin_and_leaves_follow(made):
    nodes, cyl = made.nodes.collect(), made.cylinders.collect()
    assert {(c.tree_id, c.cyl_id) for c in cyl} == {(n.tree_id, n.node_id) for n in nodes if n.parent_id is not None}
    by = {(c.tree_id, c.cyl_id): c for c in cyl}
    for c in cyl:
        b = by[c.tree_id, c.branch_index]
        assert not (b.continues and b.parent_cyl is not None)
        assert c.branch_index == (by[c.tree_id, c.parent_cyl].branch_index if c.continues and c.parent_cyl is not None else c.cyl_id)
    assert made.skin_vertices.count() == 3 * len(nodes) and made.skin_faces.count() == 3 * len(cyl)
    area = {r.tree_id: (r.a, r.m) for r in made.leaves.groupBy("tree_id").agg(F.sum("leaf_area").alias("a"), F.max("leaf_area").alias("m")).collect()}
    assert area and all(a <= 2.0 + m for a, m in area.values())
    assert made.leaves.select("tree_id", "cyl_id").distinct().join(made.cylinders, ["tree_id", "cyl_id"], "left_anti").count() == 0


def test_parameters_are_checked_first(spark):
    t = spark.createDataFrame([], TRI)
    for bad in ({"crown_type": "cube"}, {"trunk_radius": "wide"}):
        with pytest.raises(ValueError):
            forest.forest(spark, t, [bad], [1.0])
    with pytest.raises(ValueError):
        forest.forest(spark, t, [{}], [1.0, 2.0])
    with pytest.raises(ValueError):
        forest.forest(spark, t, [{}], [1.0], petiole=(.2, .1))


def test_each_tree_by_its_own_parameters(spark):
    """Two trees grown together are as if grown alone with their values."""
    roots = spark.createDataFrame([(1, 0., 0., 0., .3, 6., .4), (2, 50., 0., 0., .7, 9., .8)], "tree_id long, x double, y double, z double, s double, i double, k double")
    ends = spark.createDataFrame([(t, j, 50. * (t - 1) + (j % 3) - 1, (j % 4) - 1.5, 2. + j % 5) for t in (1, 2) for j in range(12)] + [(1, 99, 0., 8., 1.), (2, 99, 50., 8., 1.)],
                                 "tree_id long, ep_id long, x double, y double, z double")
    both = growth.grow(roots, ends, 4, "s", "i", "k", least=0.0)
    got = {(r.tree_id, r.node_id): (r.parent_id, r.x, r.y, r.z) for r in both.collect()}
    want = {}
    for t, s, i, k in ((1, .3, 6., .4), (2, .7, 9., .8)):
        own = growth.grow(roots.where(f"tree_id = {t}"), ends.where(f"tree_id = {t}"), 4, s, i, k, least=0.0)
        want |= {(r.tree_id, r.node_id): (r.parent_id, r.x, r.y, r.z) for r in own.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:]) for k, v in want.items())


def test_low_vegetation_keeps_off_trees(spark):
    terrain = spark.createDataFrame(RAMP, TRI)
    models = {"fern": (-.2, .2, -.2, .2, 0., .5), "shrub": (-.6, .6, -.5, .5, 0., 1.2)}
    boxes = spark.createDataFrame([(1, 2., 4., 2., 4., 0., 9.), (2, 8., 11., 5., 6., 0., 9.)], "tree_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = forest.low_vegetation(spark, terrain, models, 1.0, boxes, tries=4).collect()
    free = forest.low_vegetation(spark, terrain, models, 1.0, boxes.limit(0), tries=4).collect()
    hits = lambda r: any(r.x + m[0] <= b[1] and r.x + m[1] >= b[0] and r.y + m[2] <= b[3] and r.y + m[3] >= b[2] and r.z + m[4] <= 9 and r.z + m[5] >= 0
                         for b in ((2., 4., 2., 4.), (8., 11., 5., 6.)) for m in [models[r.model]])
    assert {r.plant_id for r in got} == {r.plant_id for r in free if not hits(r)} and 0 < len(got) < len(free)
    assert {r.model for r in free} == {"fern", "shrub"}
    for i, a in enumerate(free):
        assert all(math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) > .99 for b in free[:i])
        n = (0., -.2, 1.)
        size = math.hypot(*n)
        assert (a.nx, a.ny, a.nz) == pytest.approx([v / size for v in n], abs=1e-9)
        assert a.z == pytest.approx(.2 * a.y, abs=1e-6)
    assert forest.low_vegetation(spark, terrain, {}, 1.0, boxes).count() == 0
    normals = spatial.terrain_normal(spark.createDataFrame([(1, 99., 99.)], "p long, x double, y double"), terrain, "p", 1.0)
    assert normals.count() == 0

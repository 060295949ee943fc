"""The leaf-cylinder library from lookup to leaves in place."""
import math
import random

import numpy as np
import pytest
from arbor.operators import library

NODES = {"length": [.1, .2], "radius": [.01, .05], "inclination": [math.pi / 4, 3 * math.pi / 4], "azimuth": [math.pi / 4 + k * math.pi / 2 for k in range(4)], "area": [.02, .05, .08],
         "inc1": [-1.0, 0.0, 1.0], "inc2": [2.0, 3.0, 4.0], "az1": [k * math.pi / 2 for k in range(4)], "az2": [.01, .5], "size1": [.002, .0025], "size2": [.003, .0035]}
BASE = .004
CYL = "tree_id long, cyl_id long, sx double, sy double, sz double, ax double, ay double, az double, length double, radius double, area double, h double"


def cylinders(n=60, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a = np.array([rng.gauss(0, 1) for _ in range(3)])
        a = (0.0, 0.0, 1.0) if i == 0 else (0.0, 0.0, -1.0) if i == 1 else tuple((a / np.linalg.norm(a)).tolist())
        rows.append((i % 3, i, rng.random(), rng.random(), rng.random(), *a, rng.uniform(.05, .4), rng.uniform(.005, .09), rng.uniform(0.001, .1), rng.random()))
    return rows


PARAMS = {"inc1": "h * 2 - 1", "inc2": "2.6D", "az1": "h * 5", "az2": "0.3D", "size1": "0.0024D", "size2": "0.003D"}


def close(nodes, v):
    return min(range(len(nodes)), key=lambda i: (abs(nodes[i] - v), -nodes[i]))


def node_of(r):
    """The linear key (replicate 0) and the node's values, as the rules say."""
    a = np.array(r[5:8])
    inc = math.acos(max(-1, min(1, a[2])))
    up = abs(a[2]) > 1 - 1e-9
    az = NODES["azimuth"][0] if up else math.atan2(-a[0], a[1]) % (2 * math.pi)
    last = NODES["azimuth"][-1]
    i_az = (3 if az - last < 2 * math.pi - az else 0) if az > last else close(NODES["azimuth"], az)
    floor = lambda n, v: max([i for i, x in enumerate(n) if x <= v], default=0)
    area = next((i for i, x in enumerate(NODES["area"]) if x > r[10]), 2)
    i = [floor(NODES["length"], r[8]), floor(NODES["radius"], r[9]), close(NODES["inclination"], inc), i_az, area, close(NODES["inc1"], r[11] * 2 - 1), close(NODES["inc2"], 2.6),
         close(NODES["az1"], r[11] * 5), close(NODES["az2"], .3), close(NODES["size1"], .0024), close(NODES["size2"], .003)]
    key, radix = 0, 1
    for k, name in zip(i, library.VARIABLES):
        key, radix = key + k * radix, radix * len(NODES[name])
    return key, i, inc, az, up


def turned(v, axis, angle):
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return (np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k) @ v


@pytest.fixture(scope="module")
def cyl(spark):
    return spark.createDataFrame(cylinders(), CYL).repartition(3)


def test_keys_name_the_grid(spark, cyl):
    grid = library.node_grid(spark, {n: NODES[n] for n in library.VARIABLES}, 3)
    assert grid.count() == 82_944
    one = {r.node_id: r for r in library.decoded(grid, NODES).where("node_id % 977 = 0").collect()}
    for r in grid.where("node_id % 977 = 0").collect():
        assert all(r[n] == one[r.node_id][f"v_{n}"] for n in library.VARIABLES)
    got = {r.cyl_id: r for r in library.located(cyl, NODES, PARAMS).collect()}
    for r in cylinders():
        key, i, inc, az, up = node_of(r)
        g = got[r[1]]
        assert g.node_id == key
        assert (g.by_length, g.by_radius) == pytest.approx((r[8] / NODES["length"][i[0]], r[9] / NODES["radius"][i[1]]))
        assert g.more_inc == pytest.approx(inc - NODES["inclination"][i[2]]) and g.more_az == pytest.approx(az - NODES["azimuth"][i[3]])
    far = {r.cyl_id: r.node_id // 27_648 for r in library.located(cyl, NODES, PARAMS, replicates=3).collect()}
    assert set(far.values()) == {0, 1, 2}


def test_leaves_of_a_node(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 5, 40_000, 27_647)], "node_id long")
    rows = library.leaves_of(keys, NODES, BASE, (.01, .02)).collect()
    info = {r.node_id: r for r in library.decoded(keys, NODES).collect()}
    for key, v in info.items():
        own = sorted((r for r in rows if r.node_id == key), key=lambda r: r.leaf_no)
        total = sum(r.leaf_area for r in own)
        assert total >= v.v_area > total - own[-1].leaf_area
        a = np.array([-math.sin(v.v_inclination) * math.sin(v.v_azimuth), math.sin(v.v_inclination) * math.cos(v.v_azimuth), math.cos(v.v_inclination)])
        for r in own:
            p, e, d = (np.array([r[f"{n}{k}"] for k in "xyz"]) for n in "ped")
            assert v.v_size1 <= r.leaf_area <= v.v_size2 and r.size == pytest.approx(math.sqrt(r.leaf_area / BASE))
            assert 0 <= p @ a <= v.v_length and np.linalg.norm(p - (p @ a) * a) == pytest.approx(v.v_radius)
            assert .01 <= np.linalg.norm(e - p) <= .02 and np.cross(e - p, d) == pytest.approx(np.zeros(3), abs=1e-12)
    # a node's leaves don't depend on which others are asked for
    again = library.leaves_of(keys.where("node_id = 5"), NODES, BASE, (.01, .02)).collect()
    assert sorted(again) == sorted(r for r in rows if r.node_id == 5)


def test_leaves_move_with_their_cylinder(spark, cyl):
    where = library.located(cyl, NODES, PARAMS)
    leaves = library.leaves_of(where.select("node_id").distinct(), NODES, BASE, (.01, .02)).cache()
    by_node = {}
    for r in leaves.collect():
        by_node.setdefault(r.node_id, []).append(r)
    got = {(r.cyl_id, r.leaf_no): r for r in library.placed(where, leaves, NODES).collect()}
    n = 0
    for c in cylinders():
        key, i, inc, az, up = node_of(c)
        i_inc, i_az = NODES["inclination"][i[2]], NODES["azimuth"][i[3]]
        a = np.array([-math.sin(i_inc) * math.sin(i_az), math.sin(i_inc) * math.cos(i_az), math.cos(i_inc)])
        h = np.cross([0, 0, 1], a)
        h /= np.linalg.norm(h)
        turn = lambda v: turned(turned(v, h, inc - i_inc), np.array([0, 0, 1.]), az - i_az)
        for r in by_node[key]:
            p, e, d, m = (np.array([r[f"{v}{k}"] for k in "xyz"]) for v in "pedn")
            along = p @ a
            q = c[8] / NODES["length"][i[0]] * along * a + c[9] / NODES["radius"][i[1]] * (p - along * a)
            s, normal, g = np.array(c[2:5]), turn(m), got[c[1], r.leaf_no]
            for name, want in (("p", s + turn(q)), ("s", s + turn(q + e - p)), ("d", turn(d)), ("n", normal * (-1 if normal[2] < 0 else 1))):
                assert [g[f"{name}{k}"] for k in "xyz"] == pytest.approx(want.tolist(), abs=1e-9)
            # the petiole starts on the cylinder itself
            v = np.array([g[f"p{k}"] for k in "xyz"]) - s
            t = v @ np.array(c[5:8])
            assert -1e-9 <= t <= c[8] + 1e-9 and (up or np.linalg.norm(v - t * np.array(c[5:8])) == pytest.approx(c[9]))
            n += 1
    assert n == len(got) > 500


def test_budgets_and_total(spark, cyl):
    where = library.located(cyl, NODES, PARAMS)
    leaves = library.placed(where, library.leaves_of(where.select("node_id").distinct(), NODES, BASE), NODES).cache()
    whole = library.trimmed_to(leaves, 1e9).collect()
    for c in cylinders():
        own, have = [r for r in whole if r.cyl_id == c[1]], sorted((r for r in leaves.collect() if r.cyl_id == c[1]), key=lambda r: r.leaf_no)
        if c[10] <= have[0].leaf_area / 2:
            assert not own
            continue
        total = sum(r.leaf_area for r in own)
        assert len(own) == len(have) or total >= c[10] > total - max(own, key=lambda r: r.leaf_no).leaf_area
    cut = library.trimmed_to(leaves, .2).collect()
    for t in range(3):
        mine, all_ = sum(r.leaf_area for r in cut if r.tree_id == t), sum(r.leaf_area for r in whole if r.tree_id == t)
        assert mine == pytest.approx(all_) if all_ < .2 else .2 <= mine < .2 + .004


def test_stored_library_serves_the_same_leaves(spark, cyl):
    where = library.located(cyl, NODES, PARAMS)
    made = library.leaves_of(where.select("node_id").distinct(), NODES, BASE)
    kept = library.stored(made, 4)
    assert sorted(kept.collect()) == sorted(made.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = where.select("cyl_id", "node_id").join(kept, "node_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(node_id") == 1  # only the cylinders move


def test_missing_parameters(cyl):
    with pytest.raises(ValueError):
        library.from_library(cyl, NODES, ([1.0], [1.0], [1.0]), 1.0, BASE, {"inc1": "1.0D"})

"""Growth with assignments kept up to date against a full search every generation."""
import math
import random

import pytest

from arbor.operators import growth, spatial


def plain_growth(roots, ends, generations, step, influence, kill, tropism):
    nodes = {t: [(0, None, *p)] for t, *p in roots}
    alive = {(t, i): p for t, i, *p in ends}
    for _ in range(generations):
        kids, pull, gone = {}, {}, []
        for t, ns in nodes.items():
            for n in ns:
                if n[1] is not None:
                    kids[t, n[1]] = kids.get((t, n[1]), 0) + 1
        for (t, i), p in alive.items():
            near = min(((math.dist(p, n[2:]), n[0]) for n in nodes[t] if kids.get((t, n[0]), 0) <= 1), default=None)
            if near is None or near[0] >= influence:
                continue
            if near[0] <= kill:
                gone.append((t, i))
                continue
            at = next(n for n in nodes[t] if n[0] == near[1])
            v = pull.setdefault((t, near[1]), [0.0] * 3)
            for k in range(3):
                v[k] += (p[k] - at[2 + k]) / near[0]
        for e in gone:
            del alive[e]
        grown = 0
        top = {t: max(n[0] for n in ns) for t, ns in nodes.items()}
        number = {}
        for (t, n), v in sorted(pull.items()):
            size = math.hypot(*v)
            if size <= 1e-12:
                continue
            number[t] = number.get(t, 0) + 1
            at = next(x for x in nodes[t] if x[0] == n)
            nodes[t].append((top[t] + number[t], n, *[at[2 + k] + step * v[k] / size + (tropism if k == 2 else 0) for k in range(3)]))
            grown += 1
        if not grown:
            break
    return {(t, n[0]): n[1:] for t, ns in nodes.items() for n in ns}


def test_growth_equals_the_full_search(spark):
    rng = random.Random(6)
    roots = [(t, float(8 * t), 0.0, 0.0) for t in range(3)]
    ends = [(t, i, 8 * t + rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(1, 4)) for t in range(3) for i in range(18)] + [(0, 99, 100.0, 0.0, 0.0)]
    got = growth.grow(spark.createDataFrame(roots, "tree_id long, x double, y double, z double"), spark.createDataFrame(ends, "tree_id long, ep_id long, x double, y double, z double"),
                      9, .7, 6.0, .8, least=0.0, tropism=.01)
    got = {(r.tree_id, r.node_id): (r.parent_id, r.x, r.y, r.z) for r in got.collect()}
    want = plain_growth(roots, ends, 9, .7, 6.0, .8, .01)
    assert got.keys() == want.keys() and len(got) > 25
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:], abs=1e-9)


def test_second_children_release_their_endpoints(spark):
    nodes = spark.createDataFrame([(1, 0, None, 0., 0., 0.), (1, 1, 0, 1., 0., 0.), (1, 2, 0, 0., 1., 0.)], "tree_id long, node_id long, parent_id long, x double, y double, z double")
    ends = spark.createDataFrame([(1, 7, 0., 0., 5., 0, 5.), (1, 8, 0., 9., 0., 2, 8.), (1, 9, 40., 0., 0., -2, None)], "tree_id long, ep_id long, x double, y double, z double, node_id long, dist double")
    grown = nodes.where("node_id = 2")
    got = {r.ep_id: (r.node_id, r.dist and round(r.dist, 6)) for r in growth.reassigned(ends, nodes, grown, 6., .1).collect()}
    assert got == {7: (1, round(math.sqrt(26), 6)), 8: (growth.FAR, None), 9: (growth.FAR, None)}


def test_rings_find_the_nearest(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 3)) for i in range(150)] + [(900, 500., 0., 0.)]
    nodes = [(i, rng.gauss(8, 3), rng.gauss(8, 3), 1.0) for i in range(120)] + [(500, 2., 2., 1.), (400, 2., 2., 1.)]
    a, b = spark.createDataFrame(points, "p long, x double, y double, z double"), spark.createDataFrame(nodes, "n long, x double, y double, z double")
    got = {r.p: (r.n, r.d2) for r in spatial.nearest_by_rings(a, b, 20., ["p"], "n", first=.5).collect()}
    for p, *xyz in points:
        d, n = min((math.dist(xyz, q[1:]), q[0]) for q in nodes)
        assert (p not in got) if d >= 20 else got[p][0] == n and got[p][1] == pytest.approx(d * d)

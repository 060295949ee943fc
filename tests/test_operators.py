"""Fixtures with known values, and invariants of the operators with keyed randomness."""
import math

import pytest
from pyspark.sql import functions as F

from arbor.functions import rng, scalars
from arbor.functions.vec import cols, with_segment_distance2
from arbor.operators import canopy, cylinders, foliage, growth, hierarchy, library, lookup, placement, spatial
from arbor.sources import readers, writers

TRI = "tri_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


@pytest.fixture(scope="module")
def tree(spark):
    c = readers.example_tree(spark)
    o = hierarchy.branch_order(c.select(F.col("cyl_id").alias("node"), F.col("parent_id").alias("parent"), F.col("branch_index").alias("branch")))
    return c.join(o.withColumnRenamed("node", "cyl_id"), "cyl_id").cache()


def test_example_measures(tree):
    m = cylinders.measures(tree).first()
    assert m.volume == pytest.approx(1.1191610, abs=1e-6) and m.area == pytest.approx(11.5057688, abs=1e-6)
    assert m.length == pytest.approx(10.656) and m.n == 9 and m.height == pytest.approx(2.0, abs=1e-3)
    assert cylinders.measures(tree, F.col("order") == 0).first().volume == pytest.approx(.4918477, abs=1e-6)
    empty = cylinders.measures(tree, F.col("order") > 9).first()
    assert (empty.volume, empty.n, empty.height) == (0, 0, 0)
    assert cylinders.breast_diameter(tree).first().dbh == pytest.approx(.4)


def test_example_orders(tree):
    rows = tree.orderBy("cyl_id").collect()
    assert [r.order for r in rows] == [0, 0, 0, 1, 1, 1, 1, 1, 1]
    assert [r.index_in_branch for r in rows] == [1, 2, 3, 1, 2, 1, 2, 1, 2]
    crown = hierarchy.crown(tree, "cyl_id", "parent_id")
    assert sorted(r.node for r in crown.collect()) == [4, 5, 6, 7, 8, 9]
    p = cylinders.relative_position(tree, ["tree_id", "branch_index"], ["cyl_id"]).where("branch_index = 2").orderBy("cyl_id").collect()
    assert [r.rel_pos for r in p] == [pytest.approx(.585750, abs=1e-6), 1]
    b = {r.branch_index: r for r in cylinders.branch_table(tree.withColumn("cyl_id", F.col("cyl_id"))).collect()}
    assert b[2].angle == pytest.approx(45, abs=1e-6) and b[2].parent_branch == 1 and b[1].angle is None
    assert {r.cyl_id: r.node for r in hierarchy.extension(tree, "cyl_id", "parent_id", "branch_index").withColumnRenamed("node", "cyl_id").withColumnRenamed("extension", "node").collect()}[1] == 2


def test_tessellation_and_voxels(spark, tree):
    t = cylinders.tessellate(tree, 5)
    assert t.count() == 90 and t.where("isnan(x) or x is null").count() == 0
    v = cylinders.voxels(tree.where("cyl_id = 1"), 0.5)
    assert v.count() > 0 and v.agg(F.max("iz")).first()[0] == 2
    lines = writers.ring_obj(t.withColumn("cyl_no", F.col("cyl_id") - 1), 5)
    assert lines.where("line like 'f %'").count() == 45
    assert writers.cylinder_text(tree).count() == 9


def test_split_and_merge(tree):
    s = cylinders.split_long(tree, F.lit(0.5))
    assert s.agg(F.sum("length")).first()[0] == pytest.approx(10.656) and s.agg(F.max("length")).first()[0] <= .5
    m = cylinders.merge_short(tree.select(*readers.CYLINDER and [c.split()[0] for c in readers.CYLINDER.split(", ")]), 2.0)
    assert m.count() == 5 and m.agg(F.sum("length")).first()[0] == pytest.approx(10.656)


def test_transforms(tree):
    t = cylinders.turned(cylinders.translated(tree, 1, 2, 3), 90, (0, 0, 1)).where("cyl_id = 3").first()
    assert (t.sx, t.sy, t.sz) == (pytest.approx(-2), pytest.approx(2), pytest.approx(5)) and t.ay == pytest.approx(1)
    assert cylinders.measures(cylinders.scaled(tree, 2)).first().volume == pytest.approx(8 * 1.1191610, abs=1e-5)


def test_segment_distance(spark):
    rows = [(0., 0., 0., 1., 0., 0., 0., 1., 0., 1., 1., 0., 1.), (0., 0., 0., 1., 0., 0., .5, -1., 2., .5, 1., 2., 4.), (0., 0., 0., 1., 0., 0., 3., 0., 0., 4., 0., 0., 4.)]
    d = spark.createDataFrame(rows, ",".join(f"{p}{n} double" for p in ("p0", "p1", "q0", "q1") for n in "xyz") + ", want double")
    for r in with_segment_distance2(d, *map(cols, ("p0", "p1", "q0", "q1"))).collect():
        assert r.d2 == pytest.approx(r.want)


def test_lookups(spark):
    n = [.2, .5, .8]
    v = lambda c: spark.range(1).select(c).first()[0]
    # a tie must be exact in doubles: .35 - .2 is less than .5 - .35 there, .375 lies midway
    assert v(lookup.nearest_node(F.lit(.375), [.25, .5, .75])) == .5 and v(lookup.nearest_node(F.lit(.35), n)) == .2 and v(lookup.floor_node(F.lit(.6), n)) == .5
    assert v(lookup.ceiling_node(F.lit(.6), n)) == .8 and v(lookup.ceiling_node(F.lit(.9), n)) == .8 and v(lookup.floor_node(F.lit(.1), n)) == .2
    assert v(lookup.nearest_node(F.lit(350.), [0, 90, 180, 270], 360.)) == 0
    assert v(lookup.right_closed_bin(F.lit(.1), [0, .1, .2])) == 1 and v(lookup.right_closed_bin(F.lit(9.), [0, .1, .2])) == 2
    assert v(lookup.right_closed_bin(F.lit(None).cast("double"), [0, .1, .2])) is None
    assert v(scalars.leaf_area(F.lit(.5), F.lit(10.))) == pytest.approx(63.2455532, abs=1e-6)


def test_terrain_and_rays(spark):
    flat = spark.createDataFrame([(0, 0., 0., 0., 25., 0., 2.5, 25., 25., 2.5), (1, 0., 0., 0., 25., 25., 2.5, 0., 25., 0.)], TRI)
    p = spark.createDataFrame([(1, 12., 3.), (2, 30., 3.)], "id long, x double, y double")
    assert [(r.id, r.z) for r in spatial.terrain_height(p, flat, "id", 5.).collect()] == [(1, pytest.approx(1.2))]
    seg = spark.createDataFrame([(1, 12., 3., 5., 12., 3., -5.), (2, 12., 3., 5., 12., 3., 4.)], "edge_id long, " + ",".join(f"p{i}{n} double" for i in "01" for n in "xyz"))
    assert [r.edge_id for r in spatial.segment_hits(seg, flat, 5.).collect()] == [1]


def test_growth_step(spark):
    roots = spark.createDataFrame([(1, 0., 0., 0.)], "tree_id long, x double, y double, z double")
    ends = spark.createDataFrame([(1, 0, 3., 0., 0.), (1, 1, 0., 4., 0.)], "tree_id long, ep_id long, x double, y double, z double")
    n = growth.grow(roots, ends, 1, .25, 15., .1).where("gen = 1").first()
    assert (n.x, n.y, n.parent_id) == (pytest.approx(.1767767, abs=1e-6), pytest.approx(.1767767, abs=1e-6), 0)


def test_growth_keeps_distance(spark):
    roots = spark.createDataFrame([(1, 0., 0., 0.), (2, 1., 0., 0.)], "tree_id long, x double, y double, z double")
    ends = spark.createDataFrame([(t, i, t - 1 + .5 * math.cos(i), .5 * math.sin(i), 1 + i / 8) for t in (1, 2) for i in range(8)], "tree_id long, ep_id long, x double, y double, z double")
    n = growth.grow(roots, ends, 3, .25, 15., .1, least=.4)
    assert growth.too_close(n, .4, .25).count() == 0
    e = growth.edges(n)
    length = F.sqrt(sum((F.col(f"p1{c}") - F.col(f"p0{c}")) ** 2 for c in "xyz"))
    assert e.where(F.abs(length - .25) > 1e-9).count() == 0
    kids = n.where("parent_id is not null").groupBy("tree_id", "parent_id").count()
    assert kids.where("count > 2").count() == 0


def test_placement(spark):
    flat = spark.createDataFrame([(0, 0., 0., 0., 12., 0., 0., 12., 12., 0.), (1, 0., 0., 0., 12., 12., 0., 0., 12., 0.)], TRI)
    p = placement.place(spark, flat, [{"crown_width": (3., .4)}], [1.], tries=3).collect()
    assert len(p) > 5
    for a in p:
        for b in p:
            if a.cand_id < b.cand_id:
                d = math.dist((a.x, a.y, a.z), (b.x, b.y, b.z))
                assert d > max(a.crown_width, b.crown_width) / 2 + .2 * min(a.crown_width, b.crown_width)


def test_keyed_numbers_do_not_depend_on_partitions(spark):
    get = lambda n: {r.id: r.u for r in spark.range(0, 500, 1, n).select("id", rng.uniform(1, 0, "id").alias("u")).collect()}
    one = get(1)
    assert one == get(7) and all(0 < u < 1 for u in one.values()) and abs(sum(one.values()) / 500 - .5) < .05


def test_leaves(spark, tree):
    c = tree.withColumn("area", F.col("length") / 50)
    leaves = foliage.leaf_angles(foliage.leaf_sizes(c, "normal", (1.0, .05), .004), "spherical", "uniform")
    n = scalars.upward(scalars.leaf_normal(F.col("inc"), F.col("az")))
    d = (F.cos("az"), F.sin("az"), F.lit(0.0))
    rows = leaves.select("tree_id", F.xxhash64("cyl_id", "leaf_no").alias("leaf_id"), *[(F.col(f"s{k}") + F.col(f"a{k}") * rng.uniform(4, 1, "cyl_id", "leaf_no")).alias(f"s{k}") for k in "xyz"],
                         *[v.alias(f"d{k}") for v, k in zip(d, "xyz")], *[v.alias(f"n{k}") for v, k in zip(n, "xyz")], "size", "leaf_area")
    got = foliage.accept(rows, [(0, 0, 0), (-.04, .02, 0), (0, .1, 0), (.04, .02, 0)], [(0, 1, 2), (0, 2, 3)], .1)
    area = [r.leaf_area for r in got.collect()]
    assert .1 <= sum(area) < .1 + max(area)
    assert abs(sum(foliage.bin_masses(lambda x: x ** 7 * (1 - x) ** 2)) - 1) < 1e-9


def test_library(spark):
    nodes = {"length": [.1, .2], "area": [.2, .5, .8]}
    g = library.node_grid(spark, nodes, 3)
    assert g.count() == 18 and g.select("node_id").distinct().count() == 18
    cyl = spark.createDataFrame([(1, 1, .14, .36), (1, 2, .9, .9)], "tree_id long, cyl_id long, length double, area double")
    hit = library.fetch(library.lookup(cyl, nodes, {"length": "floor", "area": "nearest"}, {"length": F.col("length"), "area": F.col("area")}), g, list(nodes))
    assert sorted((r.lib_length, r.lib_area) for r in hit.collect()) == [(.1, .5), (.2, .8)]


def test_canopy(spark):
    p = spark.range(4000).select(*[(rng.uniform(1, i, "id") * s).alias(n) for i, (n, s) in enumerate({"x": 2., "y": 2., "z": 4.}.items())])
    hull = canopy.outline(canopy.crown_voxels(canopy.normalised(p), .5), .5)
    at = canopy.positions(hull, 100, .5)
    assert at.count() >= 100 and at.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).first()[0] <= hull.agg(F.max("reach")).first()[0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"crown_width": [3, 0.4], "stem_height": 10, "crown_type": "columnar", "scale": 0.02}')
    c = readers.read_configs(spark, [str(tmp_path / "a.json")], [2.0])
    got = {r.key: (r.mean, r["std"], r.text) for r in c.collect()}
    assert got["crown_width"][:2] == (3.0, .4) and got["stem_height"][:2] == (10.0, 0.0) and got["crown_type"][2] == "columnar"
    assert readers.leaf_params(c).first().leaf_params.totalLeafArea == 20
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0.5\nf 1 2 3\n")
    v, f = readers.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 3 and f.first().corners == [1, 2, 3]
    (tmp_path / "s.csv").write_text("x,y,z,SemClassID,MaterialID\n1,2,3,4,1\n1.5,2,3,4,10\n")
    s = readers.read_scan(spark, str(tmp_path / "s.csv"))
    assert [(r.X, r.classification) for r in writers.las_records(s).orderBy("X").collect()] == [(0, 0), (500, 2)]
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_scan(spark, str(tmp_path / "bad.csv"))


def test_empty_tables(spark):
    t = spark.createDataFrame([], "node long, parent long, gen int, branch long, sz double, order int")
    for got in (hierarchy.subtree_size(t), hierarchy.children(t), hierarchy.pipe_radii(t, 1.0), hierarchy.trunk_path(t), hierarchy.branch_order(t), hierarchy.extension(t),
                hierarchy.crown(t), hierarchy.touched(t), hierarchy.prune(t, 1)):
        assert got.count() == 0


def test_trees_do_not_mix(spark, tree):
    """Two trees with the same cylinder ids give what each gives alone."""
    c = tree.select("cyl_id", "parent_id", "branch_index", "order", "sz", (F.col("cyl_id") % 4).alias("gen"))
    two = c.withColumn("tree_id", F.lit(1)).unionByName(c.where("cyl_id <= 5").withColumn("tree_id", F.lit(2)))
    names = {"node": "cyl_id", "parent": "parent_id"}
    for f in (hierarchy.subtree_size, lambda d, **k: hierarchy.pipe_radii(d, .5, **k), hierarchy.trunk_path, lambda d, **k: hierarchy.branch_order(d, branch="branch_index", **k),
              lambda d, **k: hierarchy.extension(d, branch="branch_index", **k), hierarchy.crown, hierarchy.touched, hierarchy.children, hierarchy.roles,
              lambda d, **k: hierarchy.prune(d, 1, **k)):
        both = [r.asDict() for r in f(two, keys=["tree_id"], **names).collect()]
        for k in (1, 2):
            alone = [r.asDict() for r in f(two.where(F.col("tree_id") == k).drop("tree_id"), **names).collect()]
            mine = [{a: b for a, b in r.items() if a != "tree_id"} for r in both if r["tree_id"] == k]
            assert sorted(map(repr, mine)) == sorted(repr({a: r[a] for a in mine[0]}) for r in alone) and mine


def test_deep_chains_and_cycles(spark):
    c = spark.range(20000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert hierarchy.subtree_size(c).where("size <> 20000 - node").count() == 0
    with pytest.raises(ValueError):
        hierarchy.subtree_size(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "node long, parent long"))


@pytest.mark.parametrize("parts", [4, 8, 32])
def test_ranges_are_dealt_once(spark, parts):
    """Wide rows and several partition counts: running totals, picks and numbers."""
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r.o_orderkey, r.o_totalprice, r.cum) for r in lookup.with_running_total(o, "o_totalprice", ["o_orderkey"]).collect())
        total = 0.0
        for _, w, cum in got:
            total += w
            assert cum == pytest.approx(total)
        keys, upto = [g[0] for g in got], [g[2] for g in got]
        draws = spark.range(500).select("id", ((F.col("id") + 0.5) / 500).alias("u"))
        picks = lookup.weighted_pick(o, draws, "o_totalprice", ["o_orderkey"], "u").select("id", "u", "o_orderkey").collect()
        assert len(picks) == 500
        for r in picks:
            i = keys.index(r.o_orderkey)
            assert upto[i] >= r.u * total - 1e-3 and (i == 0 or upto[i - 1] < r.u * total + 1e-3)
        n = hierarchy.numbered(o, ["o_orderkey"]).select("o_orderkey", "number").collect()
        assert sorted((r.o_orderkey, r.number) for r in n) == [(k, i) for i, k in enumerate(keys)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

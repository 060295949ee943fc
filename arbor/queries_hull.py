"""Queries of hulls and leaf places: order lines are the points of three clouds, by their
return flag; parts are rays."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import scalars
from .operators import hull, library
from .queries import CYL, MASSES, PI, _cyl, _t, query

EDGE, LEAST, HOLE = 0.5, 3, 10.0
CLOUD = "cloud AS (SELECT ascii(l_returnflag) AS tree_id, (l_quantity - 25) / 5 AS x, l_extendedprice / 20000 - 2.5::DOUBLE AS y, (l_discount + l_tax) * 50 AS z FROM lineitem)"
#: Flood fill from a corner of each bounding box, then the cavities that are left by size.
HULL = f"""{CLOUD},
solid AS (SELECT tree_id, floor(x / {EDGE})::BIGINT AS cx, floor(y / {EDGE})::BIGINT AS cy, floor(z / {EDGE})::BIGINT AS cz FROM cloud GROUP BY ALL HAVING count(*) >= {LEAST}),
box AS (SELECT tree_id, min(cx) - 1 AS x0, max(cx) + 1 AS x1, min(cy) - 1 AS y0, max(cy) + 1 AS y1, min(cz) - 1 AS z0, max(cz) + 1 AS z1 FROM solid GROUP BY tree_id),
grid AS (SELECT tree_id, cx, cy, unnest(range(z0, z1 + 1)) AS cz FROM (SELECT tree_id, cx, unnest(range(y0, y1 + 1)) AS cy, z0, z1 FROM (SELECT tree_id, unnest(range(x0, x1 + 1)) AS cx, y0, y1, z0, z1 FROM box))),
free AS (SELECT * FROM grid ANTI JOIN solid USING (tree_id, cx, cy, cz)),
step(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
outside AS (SELECT tree_id, x0 AS cx, y0 AS cy, z0 AS cz FROM box
 UNION SELECT f.tree_id, f.cx, f.cy, f.cz FROM outside o, step s, free f WHERE f.tree_id = o.tree_id AND f.cx = o.cx + dx AND f.cy = o.cy + dy AND f.cz = o.cz + dz),
closed AS (SELECT * FROM free ANTI JOIN outside USING (tree_id, cx, cy, cz)),
reach AS (SELECT tree_id, cx, cy, cz, cx AS x, cy AS y, cz AS z FROM closed
 UNION SELECT r.tree_id, r.cx, r.cy, r.cz, f.cx, f.cy, f.cz FROM reach r, step s, closed f WHERE f.tree_id = r.tree_id AND f.cx = r.x + dx AND f.cy = r.y + dy AND f.cz = r.z + dz),
hull AS (SELECT tree_id, cx, cy, cz FROM solid UNION ALL SELECT tree_id, cx, cy, cz FROM reach GROUP BY ALL HAVING count(*) * {EDGE ** 3} < {HOLE})"""


def _cloud(spark, sf_dir):
    one = F.lit(1.0)
    return _t(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("long").alias("tree_id"), ((F.col("l_quantity") - 25) / 5 * one).alias("x"), (F.col("l_extendedprice") / 20000 - 2.5).alias("y"), ((F.col("l_discount") + F.col("l_tax")) * 50).alias("z"))


def _solid(spark, sf_dir):
    points = _cloud(spark, sf_dir)
    return points, hull.cells(hull.solid_runs(points, EDGE, HOLE, LEAST))


@query(f"WITH RECURSIVE {HULL} SELECT tree_id::BIGINT AS tree_id, cx, cy, cz FROM hull")
def cloud_hull(spark, sf_dir):
    """Every solid cell of the clouds' hulls."""
    return _solid(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {HULL},
rays AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 65 WHEN 1 THEN 78 ELSE 82 END AS tree_id, p_size * 0.18::DOUBLE AS z, p_partkey * 0.01::DOUBLE AS c FROM part),
far AS (SELECT tree_id, max(sqrt(x * x + y * y)) AS reach FROM cloud GROUP BY tree_id),
probes AS (SELECT p_partkey, tree_id, i, reach, floor(-sin(c) * (2 * reach / 99 * i) / {EDGE})::BIGINT AS cx, floor(cos(c) * (2 * reach / 99 * i) / {EDGE})::BIGINT AS cy, floor(z / {EDGE})::BIGINT AS cz FROM rays JOIN far USING (tree_id), (SELECT unnest(range(100)) AS i) n),
first AS (SELECT p_partkey, any_value(reach) AS reach, coalesce(min(i) FILTER (hull.cx IS NULL), 100) AS k FROM probes LEFT JOIN hull USING (tree_id, cx, cy, cz) GROUP BY p_partkey)
SELECT p_partkey, round(CASE WHEN k < 2 THEN 0 ELSE 2 * reach / 99 * (k - 1) END, 6) AS edge_distance FROM first""")
def hull_probe(spark, sf_dir):
    """How far the hull reaches from the axis along a ray of every part."""
    points, solid = _solid(spark, sf_dir)
    k = F.col("p_partkey") % 3
    rays = _t(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, 65).when(k == 1, 78).otherwise(82).cast("long").alias("tree_id"), (F.col("p_size") * 0.18).alias("z"),
                                            (F.col("p_partkey") * 0.01).alias("compass"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
    rays = rays.join(hull.extents(points).select("tree_id", "reach"), "tree_id")
    return hull.with_edge_distance(rays, solid, EDGE, "p_partkey").select("p_partkey", F.round("edge_distance", 6).alias("edge_distance"))


@query()
def hull_leaves(spark, sf_dir):
    """20,000 leaves a cloud by height, compass and distance, part of them in its voxels."""
    points, solid = _solid(spark, sf_dir)
    ends = points.groupBy("tree_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    stem = (ends.select("tree_id", F.col("lo").alias("z"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
            .unionByName(ends.select("tree_id", F.col("hi").alias("z"), F.col("x").alias("sx"), F.col("y").alias("sy"))))
    voxels = points.select("tree_id", *[F.floor(F.col(c) / 0.25).cast("long").alias(f"c{c}") for c in "xyz"]).groupBy("tree_id", *hull.CELL).count().where("count >= 5").drop("count")
    return hull.leaf_positions(points, solid, stem, EDGE, 20_000, lambda h: h * (1 - h), lambda c: 1 + F.cos(c - math.pi) / 2, lambda d: d, voxels, (0.0, 0.2, 0.5, 0.2, 0.0), 0.25)


LIBRARY = {"length": [0.1, 0.2], "radius": [0.01, 0.05], "inclination": [math.pi / 4, 3 * math.pi / 4], "azimuth": [math.pi / 4 + k * math.pi / 2 for k in range(4)], "area": [0.2, 0.5, 0.8],
           "inc1": [-1.0, 0.0, 1.0], "inc2": [2.0, 3.0, 4.0], "az1": [k * math.pi / 2 for k in range(4)], "az2": [0.01, 0.5], "size1": [0.002, 0.0025], "size2": [0.003, 0.0035]}
#: Parameters of angles and sizes by relative height, distance along the branch and compass.
BY_PLACE = {"inc1": "rel_height * 2 - 1", "inc2": "rel_pos * 2 + 2", "az1": "compass", "az2": "rel_height / 2", "size1": "0.0021D", "size2": "rel_pos / 2000 + 0.003D"}


@query()
def library_foliage(spark, sf_dir):
    """Every cylinder's leaves from the 82,944 nodes of the library, 20 square metres a tree."""
    return library.from_library(_cyl(spark, sf_dir), LIBRARY, MASSES, 20.0, 0.004, BY_PLACE, (0.02, 0.05), replicates=3)


def _near(v: str, nodes: list[float]) -> str:
    """Place of the nearest node in SQL, ties to the upper one."""
    return f"(SELECT arg_min(i, (abs(n - ({v})), -n)) FROM (SELECT unnest(range({len(nodes)})) AS i, unnest([{', '.join(map(repr, nodes))}]::DOUBLE[]) AS n))"


def _floor(v: str, nodes: list[float]) -> str:
    return f"greatest(len(list_filter([{', '.join(map(repr, nodes))}]::DOUBLE[], lambda n: n <= {v})) - 1, 0)"


@query(f"""WITH {CYL}, p AS (SELECT cyl_id, length, radius, acos(az) AS inc, CASE WHEN ax > 0 THEN 2 * {PI} - acos(ay / sqrt(ax * ax + ay * ay)) ELSE acos(ay / sqrt(ax * ax + ay * ay)) END AS turn, 0.1::DOUBLE * (cyl_id % 10) AS area FROM cyl),
i AS (SELECT cyl_id, {_floor('length', LIBRARY['length'])} AS i0, {_floor('radius', LIBRARY['radius'])} AS i1, {_near('inc', LIBRARY['inclination'])} AS i2,
 CASE WHEN turn > {LIBRARY['azimuth'][-1]!r} THEN CASE WHEN turn - {LIBRARY['azimuth'][-1]!r} < 2 * {PI} - turn THEN 3 ELSE 0 END ELSE {_near('turn', LIBRARY['azimuth'])} END AS i3,
 least({_floor('area', LIBRARY['area'])} + CASE WHEN area < 0.2::DOUBLE THEN 0 ELSE 1 END, 2) AS i4, {_near('inc - 1.5', LIBRARY['inc1'])} AS i5, {_near('area * 5', LIBRARY['inc2'])} AS i6, {_near('turn', LIBRARY['az1'])} AS i7, {_near('area', LIBRARY['az2'])} AS i8 FROM p)
SELECT cyl_id, i0 + 2 * (i1 + 2 * (i2 + 2 * (i3 + 4 * (i4 + 3 * (i5 + 3 * (i6 + 3 * (i7 + 4 * (i8 + 2 * (1 + 2 * 0))))))))) AS node_id FROM i""")
def library_nodes(spark, sf_dir):
    """The library node of every cylinder, by all eleven variables."""
    c = _cyl(spark, sf_dir).withColumn("area", 0.1 * (F.col("cyl_id") % 10)).withColumn("_inc", F.acos("az")).withColumn("_turn", scalars.axis_azimuth(F.col("ax"), F.col("ay"), F.lit(0.0)))
    params = {"inc1": F.col("_inc") - 1.5, "inc2": F.col("area") * 5, "az1": F.col("_turn"), "az2": F.col("area"), "size1": F.lit(0.0024), "size2": F.lit(0.0031)}
    return library.located(c, LIBRARY, params).select("cyl_id", "node_id")

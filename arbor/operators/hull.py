"""The hull of a point cloud as solid voxels, probes to its edge, and leaf places in it.

A concave crown keeps its bays and rings: a cell is solid if it holds points, or lies in
a cavity smaller than the hole threshold.  What is a cavity follows from the gaps between
solid cells of a column: a gap is open if it meets the outside next to it, gaps that
touch are one cavity, and a cavity with an open gap is outside.  So the graph has one
node per gap, not one per empty cell, and its components are found by stars that shrink
to their least member.  Every table has a tree column; clouds of many trees are one job.

Leaf places come by four densities: none, by height, by height and compass, or by height,
distance and compass.  A tree's leaves are shared out over height levels by the rounded
prefix sums of the density, so each bin's share is within one leaf of its quota; inside a
bin a weighted part of the leaves is put into occupied voxels of the cloud instead."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import compass
from ..plans.stage import cut, drop
from .lookup import asof_interpolate
from .spatial import with_cell

#: Probes of a ray (fixed value), height levels of a tree, directions and distances told apart.
PROBES = 100
LEVELS = 100
DIRECTIONS = 360
#: New draws for a leaf whose ray leaves the hull at once.
TRIES = 8
CELL = ["cx", "cy", "cz"]
Density = Callable[[Column], Column]


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the least id reachable) of every id in pairs (a, b): each round
    links larger neighbours, then smaller ones, to the least; every row that travels is an
    edge, and a node's edges are never gathered."""
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    e = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        with_m = large.join(least(large), "u")
        small = cut(with_m.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(with_m.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(e, large)
        e = small
        links, sources = e.agg(F.count("*"), F.countDistinct("u")).first()
        if links == sources and e.select(F.col("v").alias("u")).join(e, "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    raise ValueError("components did not settle")


def solid_runs(points: DataFrame, edge: float, hole: float = 10.0, least: int = 1, tree: str = "tree_id") -> DataFrame:
    """tree, cx, cy, z0, z1: vertical runs of solid cells (written), each a cell that
    holds at least so many points or a gap of a cavity whose volume is below hole."""
    column = [tree, "cx", "cy"]
    held = cut(with_cell(points.select(tree, "x", "y", "z"), edge).groupBy(tree, *CELL).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n"), "solid")
    next_ = F.lead("cz").over(Window.partitionBy(*column).orderBy("cz"))
    gaps = cut(held.withColumn("z1", next_ - 1).withColumn("z0", F.col("cz") + 1).where("z1 >= z0")
               .select(*column, "z0", "z1", F.xxhash64(*column, "z0").alias("id")), "gaps")
    beside = lambda steps: F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps]))
    moved = lambda steps: gaps.withColumn("_c", beside(steps)).select(tree, "_c.cx", "_c.cy", F.col("z0").alias("a0"), F.col("z1").alias("a1"), F.col("id").alias("a"))
    spans = held.groupBy(*column).agg(F.min("cz").alias("lo"), F.max("cz").alias("hi"))
    open_ = (moved([(1, 0), (-1, 0), (0, 1), (0, -1)]).join(spans, column, "left")
             .where("lo is null or a0 < lo or a1 > hi").select(F.col("a").alias("id")).distinct().withColumn("open", F.lit(1)))
    touching = moved([(1, 0), (0, 1)]).join(gaps, column).where("a0 <= z1 and z0 <= a1").select("a", F.col("id").alias("b"))
    cavity = gaps.join(components(touching), "id", "left").withColumn("component", F.coalesce("component", "id")).join(open_, "id", "left")
    cavity = cut(cavity, "cavities")
    kept = (cavity.groupBy("component").agg(F.max("open").alias("open"), (F.sum(F.col("z1") - F.col("z0") + 1) * edge**3).alias("volume"))
            .where(F.col("open").isNull() & (F.col("volume") < hole)).select("component"))
    filled = cavity.join(kept, "component", "left_semi").select(*column, "z0", "z1")
    out = cut(held.select(*column, F.col("cz").alias("z0"), F.col("cz").alias("z1")).unionByName(filled), "hull")
    drop(held, gaps, cavity)
    return out


def cells(runs: DataFrame, tree: str = "tree_id") -> DataFrame:
    """tree, cx, cy, cz of every solid cell."""
    return runs.select(tree, "cx", "cy", F.explode(F.sequence("z0", "z1")).alias("cz"))


def inside(points: DataFrame, hull: DataFrame, edge: float, tree: str = "tree_id") -> DataFrame:
    """points that lie in a solid cell of their tree."""
    return with_cell(points, edge).join(hull.select(tree, *CELL), [tree, *CELL], "left_semi").drop(*CELL)


def with_edge_distance(rays: DataFrame, hull: DataFrame, edge: float, ray: str, tree: str = "tree_id") -> DataFrame:
    """rays (ray, tree, sx, sy, z, compass, reach) with edge_distance: of PROBES points
    evenly spaced from the stem's centre (sx, sy) to twice the reach, the last before the
    first outside the hull; 0 where one of the first two is outside."""
    step = 2 * F.col("reach") / (PROBES - 1)
    probes = rays.select(ray, tree, F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1))).alias("i"), "sx", "sy", "z", "compass", step.alias("step"))
    probes = probes.select(ray, tree, "i", "z", (F.col("sx") - F.sin("compass") * F.col("step") * F.col("i")).alias("x"), (F.col("sy") + F.cos("compass") * F.col("step") * F.col("i")).alias("y"))
    hits = inside(probes, hull, edge, tree).groupBy(ray).agg(F.collect_set("i").alias("_in"))  # at most PROBES
    first = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(PROBES - 1)), F.coalesce("_in", F.array().cast("array<int>")))), F.lit(PROBES))
    return rays.join(hits, ray, "left").withColumn("edge_distance", F.when(first < 2, 0.0).otherwise(step * (first - 1))).drop("_in")


def extents(points: DataFrame, tree: str = "tree_id") -> DataFrame:
    """tree, z_min, z_max, reach: heights, and the greatest distance from the axis."""
    return points.groupBy(tree).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("reach"))


def _inverse(spark, density: Density, upper: float, steps: int, u: Column) -> Column:
    """A draw from the density on [0, upper] by its prefix sums over equal steps."""
    mass = [max(0.0, r[0]) for r in spark.range(steps).select(density((F.col("id") + 0.5) * (upper / steps)).cast("double")).collect()]
    total, sums = sum(mass), [0.0]
    for m in mass:
        sums.append(sums[-1] + m)
    if total <= 0:
        return u * upper
    below = F.array(*[F.lit(s / total) for s in sums])
    at = F.least(F.size(F.filter(below, lambda s: s <= u)) - 1, F.lit(steps - 1))
    lo, hi = F.get(below, at), F.get(below, at + 1)
    return (at + F.when(hi > lo, (u - lo) / (hi - lo)).otherwise(0.5)) * (upper / steps)


def level_quota(bounds: DataFrame, hull: DataFrame, edge: float, total: int, density_h: Density | None, bins: int, tree: str = "tree_id") -> DataFrame:
    """tree, level, n (leaves of the height level), before (leaves of lower levels of the
    same bin), bin: shares by the rounded prefix sums of density times solid levels; with
    no density, of the solid cells at each level."""
    level = bounds.select(tree, "z_min", "z_max", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    mid = (F.col("level") + 0.5) / LEVELS
    level = level.withColumn("cz", F.floor((F.col("z_min") + mid * (F.col("z_max") - F.col("z_min"))) / edge).cast("long"))
    solid = hull.groupBy(tree, "cz").agg(F.count("*").alias("solid"))
    mass = F.col("solid").cast("double") if density_h is None else F.greatest(density_h(mid), F.lit(0.0))
    level = level.join(solid, [tree, "cz"], "left").withColumn("mass", F.when(F.col("solid") > 0, mass).otherwise(0.0)).withColumn("bin", F.floor(F.col("level") * bins / LEVELS).cast("int"))
    w = Window.partitionBy(tree)  # LEVELS rows
    level = level.withColumn("sum", F.sum("mass").over(w.orderBy("level"))).withColumn("all", F.sum("mass").over(w))
    upto = F.round(total * F.col("sum") / F.col("all"))
    level = level.where("all > 0").withColumn("upto", upto.cast("long")).withColumn("n", F.col("upto") - F.coalesce(F.lag("upto").over(w.orderBy("level")), F.lit(0)))
    before = F.sum("n").over(Window.partitionBy(tree, "bin").orderBy("level")) - F.col("n")
    return level.withColumn("before", before).where("n > 0").select(tree, "level", "cz", "bin", "n", "before", "z_min", "z_max")


def from_cloud(rank: Column, weight: Column) -> Column:
    """Whether the leaf of this rank (from 0) in its bin goes to a voxel of the cloud, when
    each leaf does so while the share of earlier ones is at most the weight."""
    return (weight >= 1) | (rank == 0) | (F.floor(weight * rank) > F.floor(weight * (rank - 1)))


def _picked(leaves: DataFrame, solid: DataFrame, tree: str, draw: Column) -> DataFrame:
    """leaves with cx and cy of a cell drawn evenly from their tree's cells at their cz;
    null where there is none."""
    w = Window.partitionBy(tree, "cz").orderBy("cx", "cy")  # one slice of a crown
    numbered = solid.select(tree, *CELL, (F.row_number().over(w) - 1).alias("_k"))
    sizes = solid.groupBy(tree, "cz").agg(F.count("*").alias("_size"))
    return leaves.join(sizes, [tree, "cz"], "left").withColumn("_k", F.floor(draw * F.col("_size")).cast("int")).join(numbered, [tree, "cz", "_k"], "left").drop("_k", "_size")


def _picked_sector(leaves: DataFrame, voxels: DataFrame, tree: str, draw: Column, width: float = 2 * math.pi / 10) -> DataFrame:
    """As _picked, of the voxels (with compass) whose direction lies within half a width
    of the leaf's, to a degree: prefix counts per slice and degree give the range."""
    degree = lambda c: F.least(F.greatest(F.floor(c * (DIRECTIONS / (2 * math.pi))), F.lit(0)), F.lit(DIRECTIONS - 1)).cast("int")
    v = voxels.withColumn("_d", degree(F.col("compass")))
    numbered = v.select(tree, *CELL, (F.row_number().over(Window.partitionBy(tree, "cz").orderBy("_d", "cx", "cy")) - 1).alias("_k"))
    per = v.groupBy(tree, "cz", "_d").agg(F.count("*").alias("_n")).groupBy(tree, "cz").agg(F.map_from_entries(F.collect_list(F.struct("_d", "_n"))).alias("_m"))  # DIRECTIONS at most
    lo, hi = degree(F.col("compass") - width / 2), degree(F.col("compass") + width / 2)
    count = lambda keep: F.aggregate(F.map_entries("_m"), F.lit(0).cast("long"), lambda a, x: a + F.when(keep(x["key"]), x["value"]).otherwise(0))
    d = leaves.join(per, [tree, "cz"], "left").withColumn("_from", count(lambda k: k < lo)).withColumn("_size", count(lambda k: k <= hi) - F.col("_from"))
    d = d.withColumn("_k", F.when(F.col("_size") > 0, F.col("_from") + F.floor(draw * F.col("_size"))).cast("int"))
    return d.join(numbered, [tree, "cz", "_k"], "left").drop("_k", "_size", "_from", "_m")


def leaf_positions(points: DataFrame, hull: DataFrame, stem: DataFrame, edge: float, total: int, density_h: Density | None = None, density_c: Density | None = None,
                   density_d: Density | None = None, voxels: DataFrame | None = None, weights: tuple[float, ...] = (), voxel_edge: float = 0.15, seed: int = 8, tree: str = "tree_id") -> DataFrame:
    """tree, leaf_id, bin, cloud (whether in a voxel), x, y, z of `total` leaves a tree.

    stem: tree, z, sx, sy of the stem's centres, which cover the crown's heights (levels
    beyond take the nearest end).  voxels: tree, cx, cy, cz of edge voxel_edge; weights:
    the cloud's target share in each height bin.  density_c needs density_h, density_d
    both.  A leaf whose ray leaves the hull at once is drawn again with three densities,
    up to TRIES times, and then put into a solid cell of its level; with two it stays at
    the stem.  Trees without solid cells at any level with density get no leaves."""
    spark = points.sparkSession
    if density_c is not None and density_h is None or density_d is not None and density_c is None:
        raise ValueError("densities come in the order h, c, d")
    bins = max(1, len(weights))
    bounds = extents(points, tree)
    quota = level_quota(bounds, hull, edge, total, density_h, bins, tree)
    ids = [tree, "level", "_i"]
    draw = lambda k: rng.uniform(seed, k, *ids)
    height = F.col("z_min") + (F.col("level") + draw(0)) / LEVELS * (F.col("z_max") - F.col("z_min"))
    # the height stays in the level's solid slice of cells
    inside_cell = F.least(F.greatest(height, F.col("cz") * edge), (F.col("cz") + 1 - 1e-9) * F.lit(edge))
    leaves = quota.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("z", inside_cell)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("bin")) if weights else F.lit(0.0)
    leaves = leaves.withColumn("cloud", (from_cloud(F.col("before") + F.col("_i"), weight)) & F.lit(voxels is not None and sum(weights) > 0))
    if density_c is not None:
        leaves = leaves.withColumn("compass", _inverse(spark, density_c, 2 * math.pi, DIRECTIONS, draw(1)))
    leaves = cut(leaves.select(*ids, "bin", "cz", "z", "cloud", *(["compass"] if density_c is not None else [])), "leaves")
    axis = _stem_at_levels(bounds, stem, tree)

    done, rest = [], leaves
    if voxels is not None and sum(weights) > 0:
        some = leaves.where("cloud").withColumn("_slice", F.col("cz")).withColumn("cz", F.floor(F.col("z") / voxel_edge).cast("long"))
        if density_c is not None and density_d is None:
            with_direction = _voxel_compass(voxels, axis, bounds, voxel_edge, tree)
            got = _picked_sector(some, with_direction, tree, draw(2))
        else:
            got = _picked(some, voxels, tree, draw(2))
        got = cut(got, "in-voxels")
        done.append(got.where("cx is not null").select(*ids, "bin", "cloud", ((F.col("cx") + draw(3)) * voxel_edge).alias("x"), ((F.col("cy") + draw(4)) * voxel_edge).alias("y"), "z"))
        rest = leaves.where("not cloud").unionByName(got.where("cx is null").withColumn("cz", F.col("_slice")).withColumn("cloud", F.lit(False)).select(*leaves.columns))
    if density_c is None:
        done.append(_in_cells(rest, hull, edge, tree, draw))
    else:
        rays = rest.join(bounds.select(tree, "reach"), tree).join(axis, [tree, "level"])
        for t in range(TRIES if density_d is not None else 1):
            if t:
                rays = rays.withColumn("compass", _inverse(spark, density_c, 2 * math.pi, DIRECTIONS, draw(10 + 3 * t)))
            far = _inverse(spark, density_d, 1.0, LEVELS, draw(11 + 3 * t)) if density_d is not None else draw(11)
            rays = rays.withColumn("_ray", F.xxhash64(*ids))
            at = cut(with_edge_distance(rays, hull, edge, "_ray", tree).withColumn("_d", far * F.col("edge_distance")), "rays")
            ok = at.where("edge_distance > 0") if density_d is not None else at
            done.append(ok.select(*ids, "bin", "cloud", (F.col("sx") - F.sin("compass") * F.col("_d")).alias("x"), (F.col("sy") + F.cos("compass") * F.col("_d")).alias("y"), "z"))
            rays = at.where("edge_distance <= 0").drop("edge_distance", "_d", "_ray")
            if density_d is None or rays.isEmpty():
                break
        else:
            done.append(_in_cells(rays, hull, edge, tree, draw))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(tree, F.xxhash64(*ids).alias("leaf_id"), "bin", "cloud", "x", "y", "z")


def _in_cells(leaves: DataFrame, hull: DataFrame, edge: float, tree: str, draw) -> DataFrame:
    got = _picked(leaves, hull, tree, draw(5)).where("cx is not null")
    return got.select(tree, "level", "_i", "bin", "cloud", ((F.col("cx") + draw(6)) * edge).alias("x"), ((F.col("cy") + draw(7)) * edge).alias("y"), "z")


def _stem_at_levels(bounds: DataFrame, stem: DataFrame, tree: str) -> DataFrame:
    """tree, level, sx, sy: the stem's centre at the middle of every level."""
    level = bounds.select(tree, F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"), "z_min", "z_max")
    level = level.select(tree, "level", (F.col("z_min") + (F.col("level") + 0.5) / LEVELS * (F.col("z_max") - F.col("z_min"))).alias("z"))
    ends = stem.groupBy(tree).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    level = level.join(ends, tree).withColumn("z", F.least(F.greatest("z", "_lo"), F.col("_hi"))).select(tree, "level", "z")
    return asof_interpolate(level, stem.select(tree, "z", "sx", "sy"), tree, "z", ["sx", "sy"]).select(tree, "level", "sx", "sy")


def _voxel_compass(voxels: DataFrame, axis: DataFrame, bounds: DataFrame, edge: float, tree: str) -> DataFrame:
    """voxels with compass: their centre's direction from the stem at its level."""
    z = (F.col("cz") + 0.5) * edge
    level = F.least(F.greatest(F.floor((z - F.col("z_min")) / (F.col("z_max") - F.col("z_min")) * LEVELS), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    d = voxels.select(tree, *CELL).join(bounds, tree).withColumn("level", F.coalesce(level, F.lit(0))).join(axis, [tree, "level"])
    return d.select(tree, *CELL, compass((F.col("cx") + 0.5) * edge - F.col("sx"), (F.col("cy") + 0.5) * edge - F.col("sy")).alias("compass"))

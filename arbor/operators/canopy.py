"""Foliage in the hull of a point cloud.

The hull is the voxel occupancy of the cloud and, per height slice, the greatest
distance of occupied voxels from the stem in each compass sector: an approximation of
an alpha shape that needs only aggregations."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import compass
from .lookup import asof_interpolate
from .spatial import occupied

SECTORS = 16


def normalised(points: DataFrame, base: float = 1.0) -> DataFrame:
    """The cloud with least z at 0, centred on the mean xy of points below base."""
    low = points.agg(F.min("z").alias("_z"))
    d = points.join(F.broadcast(low)).withColumn("z", F.col("z") - F.col("_z")).drop("_z")
    mid = d.where(F.col("z") < base).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    return d.join(F.broadcast(mid)).withColumn("x", F.col("x") - F.coalesce("_x", F.lit(0.0))).withColumn("y", F.col("y") - F.coalesce("_y", F.lit(0.0))).drop("_x", "_y")


def crown_voxels(points: DataFrame, edge: float = 0.15, least: int = 5) -> DataFrame:
    """Occupied cells with their centre x, y, z."""
    c = occupied(points.where("is_attractor") if "is_attractor" in points.columns else points, edge, least)
    return c.select("*", *[((F.col(f"c{n}") + 0.5) * edge).alias(n) for n in "xyz"])


def outline(voxels: DataFrame, slice_: float) -> DataFrame:
    """slice, sector, reach: greatest distance of a voxel from the axis."""
    s = F.floor(compass(F.col("x"), F.col("y"), 1e-9) / (2 * math.pi) * SECTORS).cast("int")
    return (voxels.withColumn("slice", F.floor(F.col("z") / slice_).cast("int")).withColumn("sector", F.least(s, F.lit(SECTORS - 1)))
            .groupBy("slice", "sector").agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("reach")))


def positions(hull: DataFrame, n: int, slice_: float, seed: int = 8) -> DataFrame:
    """leaf_id, x, y, z: leaf places uniform in the hull's area: a sector of each slice
    gets leaves in proportion to the square of its reach."""
    total = hull.agg(F.sum(F.col("reach") ** 2).alias("_t"))
    per = hull.join(F.broadcast(total)).withColumn("_n", F.ceil(n * F.col("reach") ** 2 / F.col("_t")).cast("int"))
    d = per.where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    draw = lambda k: rng.uniform(seed, k, "slice", "sector", "_i")
    a, r = (F.col("sector") + draw(0)) * (2 * math.pi / SECTORS), F.col("reach") * F.sqrt(draw(1))
    return d.select(F.xxhash64("slice", "sector", "_i").alias("leaf_id"), (-r * F.sin(a)).alias("x"), (r * F.cos(a)).alias("y"), ((F.col("slice") + draw(2)) * slice_).alias("z"))


def compass_to_stem(points: DataFrame, stem: DataFrame, tree: str = "tree_id") -> DataFrame:
    """points (tree, x, y, z) with compass: the direction from the stem's centre at the
    point's height, interpolated along stem (tree, z, sx, sy); trees without a stem are
    left out."""
    named = points.columns
    with_key = points.withColumn("_xyz", F.struct(*named))
    got = asof_interpolate(with_key.select(tree, "z", "_xyz"), stem.select(tree, "z", "sx", "sy"), tree, "z", ["sx", "sy"])
    return got.select("_xyz.*", compass(F.col("_xyz.x") - F.col("sx"), F.col("_xyz.y") - F.col("sy")).alias("compass"))

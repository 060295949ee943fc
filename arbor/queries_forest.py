"""Queries of the drivers: nations are the corners of a 20 m terrain, their regions its
height; suppliers are the boxes that plants keep off."""
from __future__ import annotations

from pyspark.sql import functions as F

from .plans import forest
from .queries import MASSES, _t, query

CONFIGS = [{"crown_type": "columnar", "crown_width": (4.0, 0.4), "crown_height": (8.0, 1.5), "crown_offset": (3.0, 0.75), "stem_height": (5.0, 1.2), "numberOfEndpoints": (90, 5), "interNodeLength": 1.8, "killDistance": 1.8, "influenceRange": (15.0, 2.0),
            "trunk_radius": (0.5, 0.05), "surface_bias": (2.5, 0.2), "top_bias": (2.0, 0.2)},
           {"crown_type": "ellipsoid", "crown_width": 5.0, "crown_height": 3.5, "crown_offset": 4.0, "stem_height": 8.0, "numberOfEndpoints": 80, "interNodeLength": 2.0, "killDistance": 2.0, "influenceRange": 40.0, "surface_bias": 1.5, "top_bias": 1.0},
           {"crown_type": "spreading", "crown_width": 6.0, "crown_offset": 1.0, "stem_height": 6.0, "numberOfEndpoints": 100, "interNodeLength": 2.0, "killDistance": 2.0, "surface_bias": 1.5, "top_bias": 1.0}]
#: Boxes of plants about their foot.
MODELS = {"fern": (-0.3, 0.3, -0.3, 0.3, 0.0, 0.6), "grass": (-0.2, 0.2, -0.2, 0.2, 0.0, 0.4), "shrub": (-0.8, 0.8, -0.7, 0.7, 0.0, 1.5)}


def _terrain(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("i"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("j"), (F.col("n_regionkey") / 5).cast("double").alias("h"))
    corner = lambda p, di, dj: n.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), *[(F.col(k) * 5.0).cast("double").alias(f"{p}{c}") for k, c in (("i", "x"), ("j", "y"))], F.col("h").alias(f"{p}z"))
    square = corner("p", 0, 0).join(corner("q", 1, 0), ["i", "j"]).join(corner("r", 1, 1), ["i", "j"]).join(corner("s", 0, 1), ["i", "j"])
    half = lambda k, names: square.select((F.col("i") * 10 + F.col("j") * 2 + k).cast("long").alias("tri_id"), *[F.col(f"{v}{c}").alias(f"{to}{c}") for to, v in zip("abc", names) for c in "xyz"])
    return half(0, "pqr").unionByName(half(1, "prs"))


@query()
def forest_leaves(spark, sf_dir):
    """Leaves of a forest from three configurations: placed, grown for 10 generations,
    each tree with values of its own, made into cylinders."""
    f = forest.forest(spark, _terrain(spark, sf_dir), CONFIGS, [2.0, 1.0, 1.0], generations=10, tries=4, leaf_masses=MASSES, seed=4)
    return f.leaves.select("tree_id", "cyl_id", "leaf_no", *[f"{v}{c}" for v in "sdn" for c in "xyz"], "size", "leaf_area")


@query()
def low_plants(spark, sf_dir):
    """Plants on the terrain, none where it meets a supplier's box."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 197) / F.lit(10.0), (k * 53 % 193) / F.lit(10.0)
    boxes = _t(spark, sf_dir, "supplier").select(k.alias("tree_id"), x.alias("x0"), (x + 0.5).alias("x1"), y.alias("y0"), (y + 0.5).alias("y1"), F.lit(0.0).alias("z0"), F.lit(9.0).alias("z1"))
    return forest.low_vegetation(spark, _terrain(spark, sf_dir), MODELS, 0.7, boxes, tries=8)

"""From configurations and a terrain to trees: placement, growth, radii, cylinders, skin
and leaves, and the low vegetation between them.

A configuration maps names to a number or a pair of mean and deviation, drawn for every
tree; crown_type is ellipsoid, columnar or spreading."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import config_value, cylinder_point, ellipsoid_point, expected_height, hemisphere_point, scaled_radius
from ..operators import foliage, growth, hierarchy, mesh, placement, validation
from ..operators.spatial import box_overlaps, terrain_height, terrain_normal
from ..sources.readers import LEAF_DEFAULTS
from .stage import cut

# What a configuration leaves out.
DEFAULTS = {"numberOfEndpoints": 100, "interNodeLength": 0.25, "killDistance": 0.1, "influenceRange": 15.0, "tropism": 0.0, "trunk_radius": 0.25, "stem_height": 0.0,
            "crown_width": 1.0, "crown_height": 1.0, "crown_offset": 0.0, "surface_bias": 1.0, "top_bias": 1.0}
CROWNS = ("ellipsoid", "columnar", "spreading")


@dataclass
class Forest:
    trees: DataFrame
    nodes: DataFrame
    cylinders: DataFrame
    skin_vertices: DataFrame
    skin_faces: DataFrame
    leaves: DataFrame | None


def checked(config: dict) -> dict:
    """The configuration with defaults; unknown crown types and values that are no number
    or pair raise ValueError, unknown names are left out."""
    kind = config.get("crown_type", "ellipsoid")
    if kind not in CROWNS:
        raise ValueError(f"unknown crown type {kind}")
    out = {"crown_type": kind}
    for name, value in {**DEFAULTS, **{k: v for k, v in config.items() if k in DEFAULTS}}.items():
        mean, std = value if isinstance(value, (tuple, list)) else (value, 0.0)
        if not all(isinstance(v, (int, float)) for v in (mean, std)):
            raise ValueError(f"{name} must be a number or a pair of mean and deviation")
        out[name] = (float(mean), float(std))
    return out


def drawn(trees: DataFrame, configs: list[dict], key: str = "tree_id", seed: int = 11) -> DataFrame:
    """trees (key, config_id) with crown_type and every value of DEFAULTS, drawn for the
    tree; a value that trees has already stays."""
    made = [checked(c) for c in configs]
    pick = lambda f: F.coalesce(*[F.when(F.col("config_id") == i, F.lit(f(c))) for i, c in enumerate(made)])
    out = trees.withColumn("crown_type", pick(lambda c: c["crown_type"]))
    for k, name in enumerate(DEFAULTS):
        if name not in trees.columns:
            out = out.withColumn(name, config_value(name, pick(lambda c: c[name][0]), pick(lambda c: c[name][1]), rng.normal(seed, k, key)))
    return out


def endpoints(trees: DataFrame, seed: int = 12) -> DataFrame:
    """tree_id, ep_id, x, y, z: each tree's own number of points of its crown, which stands
    on the stem less the offset."""
    d = trees.withColumn("ep_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("numberOfEndpoints").cast("long") - 1)))
    u, v, w = (rng.uniform(seed, k, "tree_id", "ep_id") for k in range(3))
    wide, high, surface, top = (F.col(c) for c in ("crown_width", "crown_height", "surface_bias", "top_bias"))
    kinds = {"ellipsoid": ellipsoid_point(u, v, w, wide, high, surface, top), "columnar": cylinder_point(u, v, w, wide, high, surface, top), "spreading": hemisphere_point(u, v, w, wide, surface, top)}
    at = [F.coalesce(*[F.when(F.col("crown_type") == k, p[i]) for k, p in kinds.items()]) for i in range(3)]
    return d.select("tree_id", "ep_id", (F.col("x") + at[0]).alias("x"), (F.col("y") + at[1]).alias("y"), (F.col("z") + F.col("stem_height") - F.col("crown_offset") + at[2]).alias("z"))


def grown(trees: DataFrame, generations: int = 40, least: float = 0.8, pruned: int = 0, terrain: DataFrame | None = None, excluded: DataFrame | None = None,
          control: tuple[float, float, float, float] | None = None, exponent: float = 2.0, seed: int = 13) -> DataFrame:
    """tree_id, node_id, parent_id, x, y, z, gen, radius of trees (drawn(), with x, y, z):
    grown in lockstep with each tree's own step, influence, kill distance and tropism,
    without nodes of generations below pruned, radii by the pipe model from the trunk's,
    scaled by the height that was reached against the one expected.  Trees with fewer than
    two nodes are left out."""
    roots = trees.select("tree_id", "x", "y", "z", "interNodeLength", "influenceRange", "killDistance", "tropism")
    n = growth.grow(roots, endpoints(trees, seed), generations, "interNodeLength", "influenceRange", "killDistance", least, "tropism", seed + 1, terrain, excluded, control)
    if pruned:
        n = hierarchy.prune(n, pruned, "node_id", "parent_id", "gen", ["tree_id"]).select("tree_id", F.col("new_node").alias("node_id"), F.col("new_parent").alias("parent_id"), "x", "y", "z", "gen")
    sizes = n.groupBy("tree_id").agg(F.count("*").alias("_n"), (F.max("z") - F.min("z")).alias("_height")).where("_n >= 2")
    whole = n.join(sizes.select("tree_id", "_height"), "tree_id")
    r = hierarchy.pipe_radii(whole, 1.0, exponent, "node_id", "parent_id", ["tree_id"])
    trunk = scaled_radius(F.col("trunk_radius"), F.col("_height"), expected_height(F.col("stem_height"), F.col("crown_height"), F.col("crown_offset")))
    return (whole.join(r, ["tree_id", "node_id"]).join(trees.select("tree_id", "trunk_radius", "stem_height", "crown_height", "crown_offset"), "tree_id")
            .withColumn("radius", F.col("radius") * trunk).select("tree_id", "node_id", "parent_id", "x", "y", "z", "gen", "radius"))


def as_cylinders(nodes: DataFrame) -> DataFrame:
    """The cylinders of grown() with branch_index: a branch is named by the cylinder that
    begins it, and a first child goes on its parent's."""
    c = cut(hierarchy.skeleton_to_cylinders(nodes), "cylinders")
    begins = F.when(F.coalesce(F.col("continues"), F.lit(False)) & F.col("parent_cyl").isNotNull(), F.lit(None).cast("long")).otherwise(F.col("cyl_id"))
    branch = hierarchy.gather(c, up={"branch_index": (begins, lambda low, high: F.coalesce(low, high))}, node="cyl_id", parent="parent_cyl", keys=["tree_id"])
    return c.join(branch, ["tree_id", "cyl_id"])


def forest(spark: SparkSession, terrain: DataFrame, configs: list[dict], weights: list[float], generations: int = 40, least: float = 0.8, pruned: int = 0, tries: int = 30,
           leaf_masses: tuple | None = None, leaf_area: float = LEAF_DEFAULTS["totalLeafArea"], base_area: float = 0.004, leaf_size: tuple = ("uniform", (0.8, 1.2)),
           angles: tuple = ("spherical", "uniform", (), ()), petiole: tuple[float, float] = (0.08, 0.10), excluded: DataFrame | None = None, control: tuple | None = None,
           avoid_terrain: bool = False, seed: int = 1) -> Forest:
    """Trees of the configurations on a terrain (tri_id, ax..cz), from placement to leaves
    (none without leaf_masses).  Parameters are checked before any job starts."""
    validation.positive(generations=generations, leaf_area=leaf_area, base_area=base_area)
    if len(weights) != len(configs) or not configs or any(w < 0 for w in weights):
        raise ValueError("one weight of 0 or more for each configuration")
    if not 0 <= petiole[0] <= petiole[1]:
        raise ValueError("petiole lengths ascend from 0")
    widths = [{"crown_width": checked(c)["crown_width"]} for c in configs]
    spots = placement.place(spark, terrain, widths, weights, tries, seed)
    trees = cut(drawn(spots.withColumnRenamed("cand_id", "tree_id"), configs, seed=seed + 10), "trees")
    nodes = cut(grown(trees, generations, least, pruned, terrain if avoid_terrain else None, excluded, control, seed=seed + 20), "nodes")
    cyl = cut(as_cylinders(nodes), "cylinders")
    leaves = None if leaf_masses is None else foliage.direct(cyl, leaf_masses, leaf_area, base_area, leaf_size, angles, petiole, seed + 30)
    return Forest(trees, nodes, cyl, mesh.skin_vertices(nodes), mesh.skin_faces(nodes), leaves)


def low_vegetation(spark: SparkSession, terrain: DataFrame, models: dict[str, tuple[float, float, float, float, float, float]], spacing: float, tree_boxes: DataFrame, tries: int = 30, seed: int = 2) -> DataFrame:
    """plant_id, model, x, y, z, nx, ny, nz: plants at least `spacing` apart on the
    terrain, of models (name -> box x0, x1, y0, y1, z0, z1 about the foot) drawn evenly,
    without those whose box, at their place, meets a box of tree_boxes (tree_id, x0..z1);
    the normal is the terrain's under the plant, on which its +z stands (mesh.aligned)."""
    validation.positive(spacing=spacing)
    if not models:
        return spark.createDataFrame([], "plant_id long, model string, x double, y double, z double, nx double, ny double, nz double")
    # spacings of 1 in units of the pair rule: 0.7 of a crown's width
    spots = placement.place(spark, terrain, [{"crown_width": (spacing / 0.7, 0.0)}], [1.0], tries, seed)
    names = sorted(models)
    which = F.floor(rng.uniform(seed + 5, 0, "cand_id") * len(names)).cast("int")
    plants = cut(spots.withColumn("_k", which).select(F.col("cand_id").alias("plant_id"), F.get(F.array(*[F.lit(n) for n in names]), F.col("_k")).alias("model"), "_k", "x", "y", "z"), "plants")
    side = lambda i, axis: F.col(axis) + F.get(F.array(*[F.lit(float(models[n][i])) for n in names]), F.col("_k"))
    boxes = plants.select("plant_id", *[side(2 * i + j, axis).alias(f"{axis}{j}") for i, axis in enumerate("xyz") for j in (0, 1)])
    widest = max(max(b[1] - b[0], b[3] - b[2], b[5] - b[4]) for b in models.values())
    met = box_overlaps(boxes, tree_boxes, max(widest, spacing), "plant_id", "tree_id").select("plant_id").distinct()
    free = plants.join(met, "plant_id", "left_anti").drop("_k")
    return terrain_normal(free, terrain, "plant_id", max(spacing, 1.0))

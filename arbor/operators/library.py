"""The leaf-cylinder library: a node grid, its population and lookups into it.

A node is named by one number, the mixed-radix key of its place in the grid, so that the
lookup of eleven variables and a replicate is one equi-join, a stored library is bucketed
by it, and a node's values follow from its name.  Leaves are functions of seed, node and
leaf number: only nodes that are asked for need be populated."""
from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import axis_azimuth, leaf_normal, upward
from ..functions.vec import add, cols, cross, dot, named, norm, rotate, scale, sub, unit, vec
from ..plans.stage import shared_dir
from .cylinders import compass_of_midpoints, preprocessed, relative_height, relative_position
from .foliage import allocate, inverse_table, with_petiole, within_budget
from .lookup import ceiling_node, floor_node, nearest_node, with_running_total

#: The variables of a node in the order of its key: the first varies fastest, replicates slowest.
VARIABLES = ("length", "radius", "inclination", "azimuth", "area", "inc1", "inc2", "az1", "az2", "size1", "size2")
#: Cylinders whose leaf area is below this get no leaves (fixed value, square metres).
LEAST_AREA = 0.01 ** 2
TWO_PI = 2 * math.pi


def node_grid(spark: SparkSession, nodes: dict[str, list[float]], replicates: int = 3) -> DataFrame:
    """node_id, one column per variable, replicate: every combination."""
    total = reduce(lambda a, v: a * len(v), nodes.values(), replicates)
    d = spark.range(total).withColumnRenamed("id", "node_id")
    k, out = F.col("node_id"), []
    for name, values in nodes.items():
        out.append(F.get(F.array(*[F.lit(float(v)) for v in values]), (k % len(values)).cast("int")).alias(name))
        k = F.floor(k / len(values))
    return d.select("node_id", *out, k.cast("int").alias("replicate"))


def populate(grid: DataFrame, area: str, sizes: tuple[str, str], base_area: float, oversample: int = 10, seed: int = 4) -> DataFrame:
    """Leaves of every node: sizes uniform between two of its variables, on the cylinder
    at a keyed place along and around it, until the node's area times oversample."""
    per = base_area * ((F.col(sizes[0]) + F.col(sizes[1])) / 2) ** 2
    n = F.ceil(F.col(area) * oversample / per * 1.5).cast("int") + 8
    d = grid.withColumn("leaf_no", F.explode(F.sequence(F.lit(0), n - 1)))
    draw = lambda k: rng.uniform(seed, k, "node_id", "leaf_no")
    d = d.withColumn("size", F.col(sizes[0]) + (F.col(sizes[1]) - F.col(sizes[0])) * draw(0)).withColumn("leaf_area", base_area * F.col("size") ** 2)
    d = d.withColumn("along", draw(1)).withColumn("turn", draw(2)).withColumn("_target", F.col(area) * oversample)
    return within_budget(d, ["node_id"], ["leaf_no"], "leaf_area", "_target").drop("_target")


def lookup(cyl: DataFrame, nodes: dict[str, list[float]], how: dict[str, str], values: dict[str, Column], replicates: int = 3, seed: int = 6) -> DataFrame:
    """cyl with the node value of every variable (floor, ceiling, nearest or an angle's
    circular nearest) and a keyed replicate: the key of the equi-join with the library."""
    kinds = {"floor": floor_node, "ceiling": ceiling_node, "nearest": nearest_node, "circular": lambda v, n: nearest_node(v, n, 6.283185307179586)}
    out = cyl
    for name, list_ in nodes.items():
        out = out.withColumn(f"lib_{name}", kinds[how.get(name, "nearest")](values[name], list_))
    return out.withColumn("replicate", F.floor(rng.uniform(seed, 0, "tree_id", "cyl_id") * replicates).cast("int"))


def fetch(cyl: DataFrame, grid: DataFrame, names: list[str]) -> DataFrame:
    """cyl with node_id of its library entry."""
    g = grid.select("node_id", "replicate", *[F.col(n).alias(f"lib_{n}") for n in names])
    return cyl.join(g, ["replicate", *[f"lib_{n}" for n in names]])


def _index(v: Column, nodes: list[float], how: str) -> Column:
    """Place of v's node, from 0: floor and ceiling clamp to the ends; circular takes the
    nearest, and beyond the last node the first one if a full turn is nearer."""
    at = lambda node: (F.array_position(F.array(*[F.lit(float(n)) for n in nodes]), node) - 1).cast("int")
    if how == "circular":
        beyond = F.when(v - nodes[-1] < TWO_PI - v, F.lit(float(nodes[-1]))).otherwise(F.lit(float(nodes[0])))
        return at(F.when(v > nodes[-1], beyond).otherwise(nearest_node(v, nodes)))
    return at({"floor": floor_node, "ceiling": ceiling_node, "nearest": nearest_node}[how](v, nodes))


def located(cyl: DataFrame, nodes: dict[str, list[float]], params: dict[str, Column | str], replicates: int = 1, seed: int = 6) -> DataFrame:
    """cyl (tree_id, cyl_id, a*, length, radius, area) with node_id, its library entry, and
    what the fetched leaves need: by_length and by_radius, factors over the node's, and
    more_inc and more_az, the turn beyond the node's angles.  params gives a Column or
    SQL expression for inc1 ... size2, of any columns of cyl (relative height, distance,
    direction).  Length
    and radius take the node at or below, the area the one above, the rest the nearest;
    a vertical axis takes the first azimuth."""
    unit_z = F.try_divide(F.col("az"), norm(cols("a")))
    upright = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + (F.abs("az") - norm(cols("a"))) ** 2) < 1e-6 * norm(cols("a"))
    d = cyl.withColumn("_inc", F.acos(F.greatest(F.least(unit_z, F.lit(1.0)), F.lit(-1.0)))).withColumn("_az", F.when(upright, F.lit(float(nodes["azimuth"][0]))).otherwise(axis_azimuth(F.col("ax"), F.col("ay"), F.lit(0.0))))
    values = {"length": F.col("length"), "radius": F.col("radius"), "inclination": F.col("_inc"), "azimuth": F.col("_az"), "area": F.col("area"), **{n: F.expr(v) if isinstance(v, str) else v for n, v in params.items()}}
    how = {"length": "floor", "radius": "floor", "azimuth": "circular", "area": "ceiling"}
    key, radix = F.lit(0).cast("long"), 1
    for name in VARIABLES:
        d = d.withColumn(f"_i_{name}", _index(values[name], nodes[name], how.get(name, "nearest")))
        key, radix = key + F.col(f"_i_{name}") * radix, radix * len(nodes[name])
    key = key + F.floor(rng.uniform(seed, 0, "tree_id", "cyl_id") * replicates) * radix
    node = lambda name: F.get(F.array(*[F.lit(float(v)) for v in nodes[name]]), F.col(f"_i_{name}"))
    return d.select(*cyl.columns, key.alias("node_id"), (F.col("length") / node("length")).alias("by_length"), (F.col("radius") / node("radius")).alias("by_radius"),
                    (F.col("_inc") - node("inclination")).alias("more_inc"), (F.col("_az") - node("azimuth")).alias("more_az"))


def decoded(keys: DataFrame, nodes: dict[str, list[float]]) -> DataFrame:
    """keys (node_id) with the value v_<name> of every variable, and i_<name> its place."""
    k, out = F.col("node_id"), []
    for name in VARIABLES:
        i = (k % len(nodes[name])).cast("int")
        out += [i.alias(f"i_{name}"), F.get(F.array(*[F.lit(float(v)) for v in nodes[name]]), i).alias(f"v_{name}")]
        k = F.floor(k / len(nodes[name]))
    return keys.select("node_id", *out)


def leaves_of(keys: DataFrame, nodes: dict[str, list[float]], base_area: float, petiole: tuple[float, float] = (0.0, 0.0), seed: int = 4) -> DataFrame:
    """Leaves of the nodes in keys (node_id), on a cylinder that starts at the origin:
    node_id, leaf_no, size, leaf_area, p* and e* (where petiole and leaf start), d*, n*.
    Leaf areas are uniform between size1 and size2, drawn until they reach the node's
    area; inclinations follow the cosine law 1 + inc1 cos(inc2 x), azimuths von Mises
    (az1, az2); places along and around the cylinder are uniform."""
    d = decoded(keys, nodes)
    n = F.ceil(F.col("v_area") / F.least("v_size1", "v_size2")).cast("int")
    d = d.withColumn("leaf_no", F.explode(F.sequence(F.lit(0), n)))
    draw = lambda k: rng.uniform(seed, k, "node_id", "leaf_no")
    d = d.withColumn("leaf_area", F.col("v_size1") + (F.col("v_size2") - F.col("v_size1")) * draw(0)).withColumn("size", F.sqrt(F.col("leaf_area") / base_area))
    d = within_budget(d, ["node_id"], ["leaf_no"], "leaf_area", "v_area")
    inc = inverse_table([lambda x, a=a, b=b: 1 + a * np.cos(b * x) for a in nodes["inc1"] for b in nodes["inc2"]], 0, math.pi / 2)
    az = inverse_table([lambda x, m=m, k=k: np.exp(k * (np.cos(x - m) - 1)) for m in nodes["az1"] for k in nodes["az2"]], 0, TWO_PI)
    d = d.withColumn("_inc", inc(draw(1), F.col("i_inc1") * len(nodes["inc2"]) + F.col("i_inc2"))).withColumn("_az", az(draw(2), F.col("i_az1") * len(nodes["az2"]) + F.col("i_az2")))
    d = d.select("node_id", "leaf_no", "size", "leaf_area", F.col("v_length").alias("length"), F.col("v_radius").alias("radius"), *named(_axis(F.col("v_inclination"), F.col("v_azimuth")), "a"),
                 *[F.lit(0.0).alias(f"s{k}") for k in "xyz"], *named(upward(leaf_normal(F.col("_inc"), F.col("_az"))), "n"), (petiole[0] + (petiole[1] - petiole[0]) * draw(3)).alias("petiole"))
    d = with_petiole(d, draw(4), draw(5) * TWO_PI, F.col("petiole"))
    return d.select("node_id", "leaf_no", "size", "leaf_area", *[(F.col(f"e{k}") - F.col("petiole") * F.col(f"d{k}")).alias(f"p{k}") for k in "xyz"], *[f"{v}{k}" for v in "edn" for k in "xyz"])


def _axis(inclination: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Unit axis of an inclination from the zenith and a compass direction."""
    return vec(-F.sin(inclination) * F.sin(azimuth), F.sin(inclination) * F.cos(azimuth), F.cos(inclination))


def stored(leaves: DataFrame, buckets: int) -> DataFrame:
    """The library written to the shared folder, bucketed and sorted by node: a join on
    node_id moves only the cylinders."""
    spark, name = leaves.sparkSession, f"leaf_library_{uuid.uuid4().hex}"
    leaves.write.bucketBy(buckets, "node_id").sortBy("node_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def placed(cyl: DataFrame, leaves: DataFrame, nodes: dict[str, list[float]]) -> DataFrame:
    """The leaves of every located cylinder in its place: stretched along the node's axis
    by by_length and across it by by_radius (petioles keep their length), turned by
    more_inc about the horizontal axis and by more_az about the vertical, moved to the
    cylinder; normals point up.  tree_id, cyl_id (and original, if cyl has it), leaf_no,
    area (the cylinder's budget), size, leaf_area, p*, s*, d*, n*."""
    more = ["original"] if "original" in cyl.columns else []
    at = decoded(cyl.select("node_id").distinct(), nodes).select("node_id", F.col("v_inclination").alias("_inc"), F.col("v_azimuth").alias("_naz"))
    c = cyl.select("tree_id", "cyl_id", *more, "area", *[F.col(f"s{k}").alias(f"_c{k}") for k in "xyz"], "node_id", "by_length", "by_radius", "more_inc", "more_az").join(at, "node_id")
    d = c.join(leaves, "node_id")
    put = lambda d, name, v: d.withColumns({f"{name}{k}": x for k, x in zip("xyz", v)})
    d = put(d, "_a", _axis(F.col("_inc"), F.col("_naz")))
    d = d.withColumn("_along", dot(cols("p"), cols("_a")))
    across = sub(cols("p"), scale(cols("_a"), F.col("_along")))
    d = put(d, "_p", add(scale(cols("_a"), F.col("by_length") * F.col("_along")), scale(across, F.col("by_radius"))))
    d = put(d, "_e", add(cols("_p"), sub(cols("e"), cols("p"))))
    upright = F.abs("_az") > 1 - 1e-12
    up = vec(0.0, 0.0, 1.0)
    d = put(d, "_t", cross(up, cols("_a")))
    d = put(d, "_h", [F.when(upright, F.lit(x)).otherwise(c) for x, c in zip((-1.0, 0.0, 0.0), unit(cols("_t")))])
    more_az = F.when(upright, 0.0).otherwise(F.col("more_az"))
    turn = lambda name: rotate(rotate(cols(name), cols("_h"), F.col("more_inc")), up, more_az)
    d = put(d, "_n", turn("n"))
    back = F.when(F.col("_nz") < 0, -1.0).otherwise(1.0)
    out = [*named(add(cols("_c"), turn("_p")), "p"), *named(add(cols("_c"), turn("_e")), "s"), *named(turn("d"), "d"), *named(scale(cols("_n"), back), "n")]
    return d.select("tree_id", "cyl_id", *more, "leaf_no", "area", "size", "leaf_area", *out)


def trimmed_to(leaves: DataFrame, total: float, seed: int = 7) -> DataFrame:
    """leaves without the area beyond the cylinders' budgets and each tree's total: a
    cylinder keeps the shortest run of its leaves that reaches its budget (none if that is
    at most half its first leaf), then a tree the shortest run in a keyed random order."""
    w = Window.partitionBy("tree_id", "cyl_id").orderBy("leaf_no")  # one node's leaves
    first = F.first("leaf_area").over(w)
    before = F.sum("leaf_area").over(w) - F.col("leaf_area")
    kept = leaves.withColumn("_before", before).withColumn("_first", first).where((F.col("_before") < F.col("area")) & (F.col("area") > F.col("_first") / 2)).drop("_before", "_first")
    kept = kept.withColumn("_draw", rng.uniform(seed, 0, "tree_id", "cyl_id", "leaf_no"))
    summed = with_running_total(kept, "leaf_area", ["tree_id", "_draw", "cyl_id", "leaf_no"], "_sum")
    start = summed.groupBy("tree_id").agg(F.min(F.col("_sum") - F.col("leaf_area")).alias("_start"))
    return summed.join(start, "tree_id").where(F.col("_sum") - F.col("leaf_area") - F.col("_start") < total - 1e-9).drop("_draw", "_sum", "_start")


def from_library(cyl: DataFrame, nodes: dict[str, list[float]], masses: tuple[list[float], list[float], list[float]], total: float, base_area: float,
                 params: dict[str, Column | str], petiole: tuple[float, float] = (0.0, 0.0), replicates: int = 1, library: DataFrame | None = None, seed: int = 4) -> DataFrame:
    """Foliage of every tree from the library: the total's share of each cylinder by
    allocate(), its node, the node's leaves in place, trimmed to budgets and total.
    params are expressions of rel_height, rel_pos and compass.  library: leaves_of() of all
    nodes, as stored; without it the nodes that cylinders need are populated here.
    Cylinders are joined and split to the span of the length nodes before; original names
    the cylinder of cyl that a leaf sits on, cyl_id and part the piece."""
    missing = set(VARIABLES) - set(nodes) or set(VARIABLES[5:]) - set(params)
    if missing:
        raise ValueError(f"no nodes or parameters for {sorted(missing)}")
    c = preprocessed(cyl, nodes["length"][0], nodes["length"][-1]).withColumnRenamed("last_id", "original")
    c = relative_position(compass_of_midpoints(relative_height(c)), ["tree_id", "branch_index"], ["cyl_id", "part"])
    c = allocate(c, F.col("rel_height"), F.col("rel_pos"), F.col("compass"), masses, total)
    # keys of draws and windows below: a piece is a cylinder of its own
    c = c.withColumn("cyl_id", F.when(F.col("part") > 0, F.xxhash64("cyl_id", "part")).otherwise(F.col("cyl_id")))
    c = located(c.where(F.col("area") >= LEAST_AREA), nodes, params, replicates, seed + 1)
    leaves = library if library is not None else leaves_of(c.select("node_id").distinct(), nodes, base_area, petiole, seed)
    return trimmed_to(placed(c, leaves, nodes), total, seed + 2)

"""The cylinder table: derived columns, roll-ups, branch windows, split and merge.

cylinder(tree_id, cyl_id, sx, sy, sz, ax, ay, az, length, radius, parent_id?,
branch_index, added); sums and windows are per tree."""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compass
from ..functions.vec import Vec, arccos, cross, norm, rotate, vec


def with_ends(cyl: DataFrame) -> DataFrame:
    """Adds ex, ey, ez and mx, my, mz."""
    for n in "xyz":
        cyl = (cyl.withColumn(f"e{n}", F.col(f"s{n}") + F.col("length") * F.col(f"a{n}"))
               .withColumn(f"m{n}", F.col(f"s{n}") + F.col("length") * F.col(f"a{n}") / 2))
    return cyl


def measures(cyl: DataFrame, subset: Column | None = None) -> DataFrame:
    """tree_id, volume, area, length, n, height of a subset (zero where it is empty)."""
    on = F.lit(True) if subset is None else subset
    r, h = F.col("radius"), F.col("length")
    low, high = F.least("sz", "ez"), F.greatest("sz", "ez")
    pick = lambda c: F.when(on, c)
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return with_ends(cyl).groupBy("tree_id").agg(
        zero(F.sum(pick(math.pi * r * r * h)), "volume"), zero(F.sum(pick(2 * math.pi * r * h)), "area"), zero(F.sum(pick(h)), "length"),
        F.count(pick(F.lit(1))).alias("n"), zero(F.max(pick(high)) - F.min(pick(low)), "height"))


def breast_diameter(cyl: DataFrame, height: float = 1.3) -> DataFrame:
    """tree_id, dbh: twice the radius of the last stem cylinder (order 0) whose foot,
    along the stem, is below the height."""
    w = Window.partitionBy("tree_id").orderBy("cyl_id").rowsBetween(Window.unboundedPreceding, -1)
    stem = cyl.where(F.col("order") == 0).withColumn("foot", F.coalesce(F.sum("length").over(w), F.lit(0.0)))
    return stem.where(F.col("foot") < height).groupBy("tree_id").agg((2 * F.max_by("radius", "cyl_id")).alias("dbh"))


def branch_table(cyl: DataFrame) -> DataFrame:
    """tree_id, branch_index, order, volume (litres), length, angle (degrees to the
    parent's axis, by the second cylinder where the first was added), height, parent_branch."""
    p = cyl.select("tree_id", F.col("cyl_id").alias("parent_id"), *[F.col(f"a{n}").alias(f"p{n}") for n in "xyz"], F.col("branch_index").alias("parent_branch"))
    c = with_ends(cyl).withColumn("rank", F.row_number().over(Window.partitionBy("tree_id", "branch_index").orderBy("cyl_id")))
    first = c.where("rank = 1").join(p, ["tree_id", "parent_id"], "left").select("tree_id", "branch_index", F.col("added").alias("_added"), "px", "py", "pz", "parent_branch")
    axis = F.struct("ax", "ay", "az")
    rolled = c.groupBy("tree_id", "branch_index").agg(
        F.min_by("order", "rank").alias("order"), (1000 * F.sum(math.pi * F.col("radius") ** 2 * F.col("length"))).alias("volume"), F.sum("length").alias("length"),
        F.avg("mz").alias("height"), F.min_by(axis, "rank").alias("a1"), F.max(F.when(F.col("rank") == 2, axis)).alias("a2"))
    j = rolled.join(first, ["tree_id", "branch_index"], "left")
    a = F.when(F.col("_added") & F.col("a2").isNotNull(), F.col("a2")).otherwise(F.col("a1"))
    cosine = sum(a[f"a{n}"] * F.col(f"p{n}") for n in "xyz")
    return j.select("tree_id", "branch_index", "order", "volume", "length",
                    F.degrees(arccos(cosine)).alias("angle"), "height", "parent_branch")


def bounds(cyl: DataFrame) -> DataFrame:
    """tree_id and the least and greatest of starts and ends, radius included."""
    c = with_ends(cyl)
    out = []
    for n in "xyz":
        out += [F.min(F.least(f"s{n}", f"e{n}") - F.col("radius")).alias(f"{n}0"), F.max(F.greatest(f"s{n}", f"e{n}") + F.col("radius")).alias(f"{n}1")]
    return c.groupBy("tree_id").agg(*out)


def relative_position(rows: DataFrame, keys: list[str], order: list[str], length: str = "length") -> DataFrame:
    """Adds rel_pos: length up to the row's end over the whole branch's."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rel_pos", F.sum(length).over(upto) / F.sum(length).over(w))


def relative_step(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds rel_step: rel_pos less that of the row before (the first keeps its own)."""
    return rows.withColumn("rel_step", F.col("rel_pos") - F.coalesce(F.lag("rel_pos").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0)))


def relative_height(cyl: DataFrame) -> DataFrame:
    """Adds rel_height: mid height between the tree's least and greatest z."""
    c, w = with_ends(cyl), Window.partitionBy("tree_id")
    low, high = F.min(F.least("sz", "ez")).over(w), F.max(F.greatest("sz", "ez")).over(w)
    return c.withColumn("rel_height", F.when(high > low, (F.col("mz") - low) / (high - low)).otherwise(F.lit(0.0)))


def compass_of_midpoints(cyl: DataFrame, weighted: bool = True) -> DataFrame:
    """Adds compass: direction of the mid point from the tree's mean mid point."""
    c, w = with_ends(cyl), Window.partitionBy("tree_id")
    weight = F.col("length") if weighted else F.lit(1.0)
    mean = lambda n: F.sum(F.col(n) * weight).over(w) / F.sum(weight).over(w)
    return c.withColumn("compass", compass(F.col("mx") - mean("mx"), F.col("my") - mean("my"), 1e-6))


def eased_radius(chain: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds smooth: r never above the cosine-eased way from the chain's first radius to
    its last, over the distance covered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("length").over(whole)
    e = 0.5 - 0.5 * F.cos(math.pi * t)
    way = (1 - e) * F.first("radius").over(whole) + e * F.last("radius").over(whole)
    return chain.withColumn("smooth", F.least(F.col("radius"), way))


def origin(cyl: DataFrame) -> DataFrame:
    return cyl.groupBy("tree_id").agg(*[F.coalesce(F.min_by(f"s{n}", "cyl_id"), F.lit(0.0)).alias(f"o{n}") for n in "xyz"])


def translated(cyl: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    for n, d in zip("xyz", (dx, dy, dz)):
        cyl = cyl.withColumn(f"s{n}", F.col(f"s{n}") + d)
    return cyl


def turned(cyl: DataFrame, degrees: float, axis: tuple[float, float, float], about: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """Turned about an axis through a point."""
    n = math.sqrt(sum(a * a for a in axis))
    u, k = vec(*[a / n for a in axis]), F.lit(math.radians(degrees))
    s = rotate(tuple(F.col(f"s{c}") - o for c, o in zip("xyz", about)), u, k)
    a = rotate(vec("ax", "ay", "az"), u, k)
    return cyl.select(*[c for c in cyl.columns if c not in {"sx", "sy", "sz", "ax", "ay", "az"}],
                      *[(v + o).alias(f"s{c}") for v, o, c in zip(s, about, "xyz")], *[v.alias(f"a{c}") for v, c in zip(a, "xyz")])


def scaled(cyl: DataFrame, k: float) -> DataFrame:
    for c in ("sx", "sy", "sz", "length", "radius"):
        cyl = cyl.withColumn(c, F.col(c) * k)
    return cyl


def split_long(cyl: DataFrame, most: Column, least: Column | float = 0.0, keep: Column | None = None) -> DataFrame:
    """Each cylinder as ceil(length / most) equal parts: part (from 0), parts.  It stays
    whole where the parts would not be longer than least, or where keep holds."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / most)).cast("int")
    whole = (F.col("length") / n <= least) if keep is None else (F.col("length") / n <= least) | keep
    out = cyl.withColumn("parts", F.when(whole, 1).otherwise(n)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    step = F.col("length") / F.col("parts")
    for n in "xyz":
        out = out.withColumn(f"s{n}", F.col(f"s{n}") + F.col(f"a{n}") * step * F.col("part"))
    return out.withColumn("length", step)


def _joined(batches):
    """Rows tree, branch, cyl_id, length, need, whole branches in order, with first: the
    id of the cylinder that each is joined to.  One running length is all the state."""
    branch, first, total, need = None, None, 0.0, 0.0
    for b in batches:
        firsts = []
        for t, k, i, x, least in zip(*(c.to_pylist() for c in b.columns)):
            if (t, k) != branch or total >= need:
                branch, first, total = (t, k), i, 0.0
            need = least
            total += x
            firsts.append(first)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(firsts, pa.int64())], names=["tree_id", "branch_index", "cyl_id", "_first"])


def merge_short(cyl: DataFrame, least: float, relative: bool = False) -> DataFrame:
    """Within a branch, forward: a cylinder shorter than the least length (a share of the
    branch's length if relative) is joined with those after it until together they reach
    it or the branch ends; a short rest at the end stays by itself.  A joined cylinder has
    the columns of its first one, the sum of the lengths, the direction from its start to
    the end of its last one and the mean radius.  last_id is its last one's id, joined how
    many it holds; parent, if cyl has it, names the joined cylinder that the former parent
    went into.

    Branches stream through tasks in order; the rest is aggregation."""
    parts = int(cyl.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = cyl.groupBy("tree_id", "branch_index").agg((least * F.sum("length") if relative else F.lit(float(least))).alias("_need"))
    keys = cyl.select(*[F.col(c).cast("long").alias(c) for c in ("tree_id", "branch_index", "cyl_id")], F.col("length").cast("double").alias("length"))
    order = ["tree_id", "branch_index", "cyl_id"]
    firsts = (keys.join(need, ["tree_id", "branch_index"]).select(*order, "length", "_need").repartition(parts, "tree_id", "branch_index").sortWithinPartitions(*order)
              .mapInArrow(_joined, "tree_id long, branch_index long, cyl_id long, _first long"))
    named = cyl.join(firsts, order)
    last = F.max_by(F.struct("cyl_id", *[(F.col(f"s{n}") + F.col("length") * F.col(f"a{n}")).alias(n) for n in "xyz"]), "cyl_id")
    one = named.groupBy("tree_id", "branch_index", "_first").agg(F.min_by(F.struct(*cyl.columns), "cyl_id").alias("_a"), last.alias("_b"), F.avg("radius").alias("_r"),
                                                                 F.sum("length").alias("_l"), F.count("*").alias("joined"))
    way = [F.col(f"_b.{n}") - F.col(f"_a.s{n}") for n in "xyz"]
    chord, many = F.sqrt(sum(w * w for w in way)), F.col("joined") > 1
    new = {"length": F.col("_l"), "radius": F.col("_r")} | {f"a{n}": F.when(many & (chord > 0), F.try_divide(w, chord)).otherwise(F.col(f"_a.a{n}")) for n, w in zip("xyz", way)}
    out = one.select(*[new.get(c, F.col(f"_a.{c}")).cast(cyl.schema[c].dataType).alias(c) for c in cyl.columns], F.col("_b.cyl_id").alias("last_id"), "joined")
    if "parent" not in cyl.columns:
        return out
    went = named.select("tree_id", F.col("cyl_id").alias("parent"), F.col("_first").alias("_to"))
    return out.join(went, ["tree_id", "parent"], "left").withColumn("parent", F.coalesce("_to", "parent")).select(*cyl.columns, "last_id", "joined")


def preprocessed(cyl: DataFrame, least: float, most: float, relative: bool = False) -> DataFrame:
    """Cylinders of lengths between least and most where that can be had: short ones are
    joined (merge_short), long ones that were not joined are split where their parts are
    longer than least.  Both lengths are shares of the branch's length if relative.  cyl_id
    and part (from 0) name a row, last_id the former cylinder it stands for."""
    m = merge_short(cyl, least, relative)
    if not relative:
        return split_long(m, F.lit(float(most)), float(least), F.col("joined") > 1)
    whole = cyl.groupBy("tree_id", "branch_index").agg(F.sum("length").alias("_whole"))
    return split_long(m.join(whole, ["tree_id", "branch_index"]), most * F.col("_whole"), least * F.col("_whole"), F.col("joined") > 1).drop("_whole")


def tessellate(cyl: DataFrame, sides: int = 5) -> DataFrame:
    """Ring vertices: tree_id, cyl_id, ring (0, 1), corner, x, y, z.  Corners go round
    from an axis normal to the cylinder, also for vertical ones."""
    axis = vec("ax", "ay", "az")
    upright = F.abs(F.col("az")) > 0.999999
    pole: Vec = tuple(F.when(upright, F.lit(a)).otherwise(F.lit(b)) for a, b in zip((1.0, 0.0, 0.0), (0.0, 0.0, 1.0)))
    side = cross(pole, axis)
    n = norm(side)
    first = tuple(c / n for c in side)
    out = (cyl.withColumn("ring", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))))
    around = rotate(first, axis, F.col("corner") * (2 * math.pi / sides))
    return out.select("tree_id", "cyl_id", "ring", "corner", *[
        (F.col(f"s{c}") + F.col("ring") * F.col("length") * F.col(f"a{c}") + F.col("radius") * v).alias(c) for c, v in zip("xyz", around)])


def voxels(cyl: DataFrame, edge: float) -> DataFrame:
    """tree_id, cyl_id, ix, iy, iz: cells met by samples at half-edge steps along,
    outward and around each cylinder."""
    steps = lambda c: F.sequence(F.lit(0), F.ceil(c / (edge / 2)).cast("int"))
    axis = vec("ax", "ay", "az")
    upright = F.abs(F.col("az")) > 0.999999
    pole: Vec = tuple(F.when(upright, F.lit(a)).otherwise(F.lit(b)) for a, b in zip((1.0, 0.0, 0.0), (0.0, 0.0, 1.0)))
    side = cross(pole, axis)
    n = norm(side)
    first = tuple(c / n for c in side)
    d = (cyl.withColumn("_i", F.explode(steps(F.col("length")))).withColumn("_j", F.explode(steps(F.col("radius"))))
         .withColumn("_h", F.least(F.col("length"), F.col("_i") * edge / 2)).withColumn("_r", F.least(F.col("radius"), F.col("_j") * edge / 2)))
    d = d.withColumn("_m", F.greatest(F.lit(1), F.ceil(2 * math.pi * F.col("_r") / (edge / 2))).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    around = rotate(first, axis, F.col("_k") * (2 * math.pi) / F.col("_m"))
    return d.select("tree_id", "cyl_id", *[F.floor((F.col(f"s{c}") + F.col("_h") * F.col(f"a{c}") + F.col("_r") * v) / edge).alias(f"i{c}") for c, v in zip("xyz", around)]).distinct()

"""Leaf area: allocation to cylinders, sampling of sizes and directions, acceptance."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import axis_azimuth, leaf_normal, upward
from ..functions.vec import arccos, cols, cross, dot, named, rotate, scale, sub, unit
from ..plans.stage import cut
from .cylinders import compass_of_midpoints, relative_height, relative_position, split_long
from .lookup import right_closed_bin
from .spatial import cell, radius_pairs

BINS = 10


def bin_masses(density, low: float = 0.0, high: float = 1.0, bins: int = BINS, points: int = 1000) -> list[float]:
    """Share of a density in equal bins, by the trapezoid rule; an infinite value at an
    edge is extended in a straight line.  density maps an array to values."""
    out = []
    for k in range(bins):
        x = np.linspace(low + (high - low) * k / bins, low + (high - low) * (k + 1) / bins, points)
        with np.errstate(all="ignore"):
            y = np.asarray(density(x), float)
        if not np.isfinite(y[0]):
            y[0] = 2 * y[1] - y[2]
        if not np.isfinite(y[-1]):
            y[-1] = 2 * y[-2] - y[-3]
        out.append(float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()))
    total = sum(out)
    return [v / total for v in out]


def equal_mass_edges(density, bins: int = BINS, points: int = 10000) -> list[float]:
    x = np.linspace(0, 1, points)
    y = np.asarray(density(x), float)
    y[~np.isfinite(y)] = 0
    c = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
    return [0.0, *np.interp(np.arange(1, bins) / bins, c / c[-1], x).tolist(), 1.0]


def allocate(cyl: DataFrame, h: Column, d: Column, c: Column, masses: tuple[list[float], list[float], list[float]],
             total: float, length: str = "length", tree: str = "tree_id") -> DataFrame:
    """Adds share and area.  A cylinder gets Ph Pd Pc times its part of the length in its
    (h, d, c) cell; empty cells fall out and shares are normalised to 1 in each tree."""
    edges = [i / BINS for i in range(BINS + 1)]
    turn = [2 * math.pi * i / BINS for i in range(BINS + 1)]
    b = cyl.withColumn("bh", right_closed_bin(h, edges)).withColumn("bd", right_closed_bin(d, edges)).withColumn("bc", right_closed_bin(c, turn))
    mass = lambda m, k: F.element_at(F.array(*[F.lit(float(x)) for x in m]), F.col(k))
    within = F.col(length) / F.sum(length).over(Window.partitionBy(tree, "bh", "bd", "bc"))
    raw = b.withColumn("_raw", mass(masses[0], "bh") * mass(masses[1], "bd") * mass(masses[2], "bc") * within)
    share = F.col("_raw") / F.sum("_raw").over(Window.partitionBy(tree))
    return raw.withColumn("share", share).withColumn("area", F.col("share") * total).drop("_raw")


def leaf_sizes(cyl: DataFrame, kind: str, p: tuple[float, float], base_area: float, seed: int = 1) -> DataFrame:
    """One row per candidate leaf of cylinders with an area budget: cyl_id, leaf_no,
    size, leaf_area.  Leaves are given out while the budget left is at least a mean leaf;
    normal sizes that are not positive are drawn again (up to 8 keyed draws)."""
    mean = p[0] if kind != "uniform" else (p[0] + p[1]) / 2
    per = base_area * mean * mean
    n = F.floor(F.greatest(F.col("area"), F.lit(0.0)) / per * 4).cast("int") + 8
    rows = cyl.withColumn("leaf_no", F.explode(F.sequence(F.lit(0), n - 1)))
    keys = ("tree_id", "cyl_id", "leaf_no")
    if kind == "constant":
        size = F.lit(float(p[0]))
    elif kind == "uniform":
        size = p[0] + (p[1] - p[0]) * rng.uniform(seed, 0, *keys)
    else:
        size = F.lit(mean)
        for k in range(7, -1, -1):
            z = p[0] + p[1] * rng.normal(seed, k, *keys)
            size = F.when(z > 0, z).otherwise(size)
    before = Window.partitionBy("tree_id", "cyl_id").orderBy("leaf_no").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("size", size).withColumn("leaf_area", base_area * F.col("size") ** 2)
    return out.withColumn("_spent", F.coalesce(F.sum("leaf_area").over(before), F.lit(0.0))).where(F.col("area") - F.col("_spent") >= per).drop("_spent")


def leaf_angles(leaves: DataFrame, inclination: str, azimuth: str, seed: int = 2, p_inc: tuple = (), p_az: tuple = ()) -> DataFrame:
    """Adds inc and az.  De Wit, beta and von Mises angles come from a table of the
    inverse distribution at 1024 nodes, made on the driver."""
    u, v = rng.uniform(seed, 0, "tree_id", "cyl_id", "leaf_no"), rng.uniform(seed, 1, "tree_id", "cyl_id", "leaf_no")
    if inclination == "uniform":
        inc = u * (math.pi / 2)
    elif inclination == "spherical":
        inc = F.acos(1 - u)
    elif inclination == "constant":
        inc = F.lit(float(p_inc[0]))
    elif inclination == "dewit":
        inc = inverse(u, lambda x: 1 + p_inc[0] * np.cos(p_inc[1] * x), 0, math.pi / 2)
    elif inclination == "beta":
        inc = inverse(u, lambda x: (x / (math.pi / 2)) ** (p_inc[0] - 1) * (1 - x / (math.pi / 2)) ** (p_inc[1] - 1), 0, math.pi / 2)
    else:
        raise ValueError(f"unknown inclination {inclination}")
    if azimuth == "uniform":
        az = v * (2 * math.pi)
    elif azimuth == "constant":
        az = F.lit(float(p_az[0]))
    elif azimuth == "vonmises":
        az = inverse(v, lambda x: np.exp(p_az[1] * (np.cos(x - p_az[0]) - 1)), 0, 2 * math.pi)
    else:
        raise ValueError(f"unknown azimuth {azimuth}")
    return leaves.withColumn("inc", inc).withColumn("az", az)


def inverse(u: Column, density, low: float, high: float, nodes: int = 1024) -> Column:
    """Inverse distribution function by a table, linear between nodes."""
    x = np.linspace(low, high, nodes * 8 + 1)
    with np.errstate(all="ignore"):
        y = np.nan_to_num(np.asarray(density(x), float), nan=0.0, posinf=0.0)
    c = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
    table = np.interp(np.linspace(0, 1, nodes + 1), c / c[-1], x)
    t = F.split(F.lit(",".join(f"{v:.12g}" for v in table)), ",").cast("array<double>")
    k = F.least(F.floor(u * nodes), F.lit(nodes - 1)).cast("int")
    return F.get(t, k) + (u * nodes - k) * (F.get(t, k + 1) - F.get(t, k))


def inverse_table(densities: list, low: float, high: float, nodes: int = 256):
    """inverse() for a choice of densities: a function of u and the density's place."""
    x, tables = np.linspace(low, high, nodes * 8 + 1), []
    for density in densities:
        y = np.asarray(density(x), float)
        c = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
        tables.append(np.interp(np.linspace(0, 1, nodes + 1), c / c[-1], x))
    t = F.split(F.lit(",".join(f"{v:.12g}" for table in tables for v in table)), ",").cast("array<double>")

    def of(u: Column, which: Column) -> Column:
        k = which * (nodes + 1) + F.least(F.floor(u * nodes), F.lit(nodes - 1)).cast("int")
        return F.get(t, k) + (u * nodes - F.floor(u * nodes)) * (F.get(t, k + 1) - F.get(t, k))
    return of


def within_budget(rows: DataFrame, keys: list[str], order: list[str], area: str, target: float | str) -> DataFrame:
    """Rows taken while the sum before them is below the target: the last one overshoots."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col(target) if isinstance(target, str) else F.lit(float(target))
    return rows.withColumn("_before", F.coalesce(F.sum(area).over(w), F.lit(0.0))).where(F.col("_before") < t).drop("_before")


def trimmed(rows: DataFrame, keys: list[str], order: list[str], area: str, target: float) -> DataFrame:
    """Rows dropped from the end while what remains without them still reaches the target."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(area).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_b", before).where(F.col("_b") < target).drop("_b")


def _turned(v: np.ndarray, axis: np.ndarray, degrees: float) -> np.ndarray:
    """Rows of v turned about the unit rows of axis."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return v * c + np.cross(axis, v) * s + axis * (axis * v).sum(-1, keepdims=True) * (1 - c)


#: The frames a candidate tries, in order: about the normal, the direction and the side.
TURNS = [(None, 0.0), ("n", 45.0), ("n", -45.0), ("d", 30.0), ("d", -30.0), ("s", 30.0), ("s", -30.0)]


def _frame(d: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and normals (rows) in frame k."""
    about, degrees = TURNS[k]
    if about is None:
        return d, n
    axis = {"n": n, "d": d, "s": np.cross(n, d)}[about]
    return _turned(d, axis, degrees), _turned(n, axis, degrees)


def _triangles(shape: list[tuple], tris: list[tuple], start, size, direction, normal) -> np.ndarray:
    """Row, triangle, corner, axis of the leaves given as rows."""
    side = np.cross(normal, direction)
    v = np.array(shape, float)[None] * np.asarray(size, float)[:, None, None]
    p = v[..., :1] * side[:, None] + v[..., 1:2] * direction[:, None] + v[..., 2:] * normal[:, None] + start[:, None]
    return p[:, np.array(tris)]


def _edges_hit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row, whether an edge of a triangle of a passes strictly through one of b."""
    p = a.reshape(len(a), -1, 1, 3)
    d = np.roll(a, -1, axis=2).reshape(len(a), -1, 1, 3) - p
    o = b[:, None, :, 0]
    e1, e2 = b[:, None, :, 1] - o, b[:, None, :, 2] - o
    h = np.cross(d, e2)
    det = (e1 * h).sum(-1)
    w = p - o
    with np.errstate(all="ignore"):
        u = (w * h).sum(-1) / det
        k = np.cross(w, e1)
        v, t = (d * k).sum(-1) / det, (e2 * k).sum(-1) / det
        return ((np.abs(det) > 1e-15) & (u > 0) & (v > 0) & (u + v < 1) & (t > 0) & (t < 1)).any(axis=(1, 2))


GEOMETRY = ("sx", "sy", "sz", "dx", "dy", "dz", "nx", "ny", "nz", "size")


def _blocked(pairs: DataFrame, shape: list[tuple], tris: list[tuple], rows: int = 4096) -> DataFrame:
    """tree_id, leaf_id, hits (bit k: frame k meets this rival) of candidates (GEOMETRY)
    beside one accepted rival each (GEOMETRY prefixed b_, its frame b_frame)."""
    def parts(pdf, prefix):
        return [np.array(pdf[[f"{prefix}{v}{c}" for c in "xyz"]], float) for v in "sdn"] + [pdf[f"{prefix}size"].to_numpy(float)]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), rows):
                pdf = batch.iloc[at:at + rows]
                (s, d, n, size), (bs, bd, bn, bsize) = parts(pdf, ""), parts(pdf, "b_")
                frame = pdf["b_frame"].to_numpy()
                for k in range(len(TURNS)):
                    of = frame == k
                    if of.any():
                        bd[of], bn[of] = _frame(bd[of], bn[of], k)
                rival = _triangles(shape, tris, bs, bsize, bd, bn)
                hits = np.zeros(len(pdf), np.int32)
                for k in range(len(TURNS)):
                    own = _triangles(shape, tris, s, size, *_frame(d, n, k))
                    hits |= (_edges_hit(own, rival) | _edges_hit(rival, own)).astype(np.int32) << k
                yield pd.DataFrame({"tree_id": pdf["tree_id"], "leaf_id": pdf["leaf_id"], "hits": hits})

    ids = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("tree_id", "leaf_id"))
    return pairs.mapInPandas(run, f"{ids}, hits int")


def _in_cylinder(tris: np.ndarray, start: np.ndarray, axis: np.ndarray, length: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per row, whether a triangle (row, triangle, corner, axis) comes nearer to the axis
    than the radius, strictly between the cylinder's end planes."""
    w = tris - start[:, None, None]
    z = (w * axis[:, None, None]).sum(-1)
    flat = w - z[..., None] * axis[:, None, None]
    top = length[:, None, None]
    between = (z.max(-1) > 0) & (z.min(-1) < length[:, None])

    def near(a, b):
        """Least squared distance from the axis to segments a b across it."""
        d = b - a
        dd = (d * d).sum(-1)
        t = np.clip(np.where(dd > 0, -(a * d).sum(-1) / np.where(dd > 0, dd, 1), 0), 0, 1)
        return ((a + t[..., None] * d) ** 2).sum(-1)

    z1, f1 = np.roll(z, -1, axis=-1), np.roll(flat, -1, axis=-2)
    rise = z1 - z
    safe = np.where(rise == 0, 1, rise)
    at0, at1 = -z / safe, (top - z) / safe
    level = rise == 0
    lo = np.where(level, 0, np.clip(np.minimum(at0, at1), 0, 1))
    hi = np.where(level, 1, np.clip(np.maximum(at0, at1), 0, 1))
    some = np.where(level, (z >= 0) & (z <= top), (np.maximum(at0, at1) >= 0) & (np.minimum(at0, at1) <= 1))
    point = lambda t: flat + t[..., None] * (f1 - flat)
    least = np.where(some, near(point(lo), point(hi)), np.inf).min(-1)
    for at in (at0, at1):
        crosses = ~level & (at >= 0) & (at <= 1)
        p = point(np.clip(at, 0, 1))
        both = crosses & np.roll(crosses, -1, axis=-1)
        least = np.minimum(least, np.where(both, near(p, np.roll(p, -1, axis=-2)), np.inf).min(-1))
    # the axis itself through the triangle's inside
    e1, e2 = flat[..., 1, :] - flat[..., 0, :], flat[..., 2, :] - flat[..., 0, :]
    turn = lambda a, b: (np.cross(a, b) * axis[:, None]).sum(-1)
    area = turn(e1, e2)
    area_ = np.where(area == 0, 1, area)
    u, v = turn(-flat[..., 0, :], e2) / area_, turn(e1, -flat[..., 0, :]) / area_
    height = z[..., 0] + u * (z[..., 1] - z[..., 0]) + v * (z[..., 2] - z[..., 0])
    through = (area != 0) & (u >= 0) & (v >= 0) & (u + v <= 1) & (height > 0) & (height < length[:, None])
    return (between & (through | (least < radius[:, None] ** 2))).any(-1)


def frames_blocked(leaves: DataFrame, cyl: DataFrame, shape: list[tuple], tris: list[tuple], rows: int = 4096) -> DataFrame:
    """tree_id, leaf_id, bits of the leaves (GEOMETRY) that meet a cylinder of their tree
    in some frame: bit k is set where frame k does.  A leaf is looked for in the cell of
    its start; cylinders are dealt, in parts of an edge's length, to the cells that a leaf
    near them can start in.  Leaves without a size or a place meet nothing."""
    key = ["tree_id", "leaf_id"]
    reach = max(math.sqrt(sum(c * c for c in v)) for v in shape)
    widest = leaves.agg(F.max("size")).first()[0]
    ids = ", ".join(f"{c} {leaves.schema[c].dataType.simpleString()}" for c in key)
    if widest is None:
        return leaves.sparkSession.createDataFrame([], f"{ids}, bits int")
    away = max(reach * float(widest), 1e-9) * (1 + 1e-9)
    names = ["sx", "sy", "sz", "ax", "ay", "az", "length", "radius"]
    parts = split_long(cyl.select("tree_id", *names, *[F.col(c).cast("double").alias(f"b_{c}") for c in names]), F.lit(2 * away))
    for n in "xyz":
        a, b = F.col(f"s{n}"), F.col(f"s{n}") + F.col("length") * F.col(f"a{n}")
        low, high = F.least(a, b) - F.col("radius") - away, F.greatest(a, b) + F.col("radius") + away
        parts = parts.withColumn(f"c{n}", F.explode(F.sequence(cell(low, 2 * away), cell(high, 2 * away))))
    cells = ["cx", "cy", "cz"]
    parts = parts.select("tree_id", *cells, *[f"b_{c}" for c in names]).distinct()
    placed = leaves.where("size is not null").select(*key, *GEOMETRY, *[cell(F.col(f"s{n}"), 2 * away).alias(f"c{n}") for n in "xyz"])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), rows):
                pdf = batch.iloc[at:at + rows]
                s, d, n, bs, ba = (np.array(pdf[[f"{v}{c}" for c in "xyz"]], float) for v in ("s", "d", "n", "b_s", "b_a"))
                size, length, radius = (pdf[c].to_numpy(float) for c in ("size", "b_length", "b_radius"))
                bits = np.zeros(len(pdf), np.int32)
                for k in range(len(TURNS)):
                    hit = _in_cylinder(_triangles(shape, tris, s, size, *_frame(d, n, k)), bs, ba, length, radius)
                    bits |= hit.astype(np.int32) << k
                yield pd.DataFrame({"tree_id": pdf["tree_id"], "leaf_id": pdf["leaf_id"], "bits": bits})

    met = placed.join(parts, ["tree_id", *cells]).mapInPandas(run, f"{ids}, bits int")
    return met.groupBy(*key).agg(F.bit_or("bits").alias("bits")).where("bits <> 0")


def _settled(p: DataFrame, shape: list[tuple], tris: list[tuple], rounds: int) -> DataFrame:
    """tree_id, leaf_id, frame of the candidates p (with _order, and _bits for the frames
    that branches block) that a sequential pass in that order would accept.  Each round
    decides all whose earlier rivals are decided."""
    key = ["tree_id", "leaf_id"]
    reach = max(math.sqrt(sum(c * c for c in v)) for v in shape)
    widest = p.agg(F.max("size")).first()[0]
    if widest is None:
        return p.select(*key, F.lit(0).alias("frame"))
    at = p.select(*key, "_order", "size", *[F.col(f"s{c}").alias(c) for c in "xyz"])
    apart = reach * (F.col("size") + F.col("b_size")) * (1 + 1e-9)
    earlier = (F.col("b__order") < F.col("_order")) | (F.col("b__order") == F.col("_order")) & (F.col("b_leaf_id") < F.col("leaf_id"))
    pairs = cut(radius_pairs(at, at, max(2 * reach * float(widest), 1e-9) * (1 + 1e-9))
                .where((F.col("tree_id") == F.col("b_tree_id")) & (F.col("d2") <= apart * apart) & earlier).select(*key, F.col("b_leaf_id").alias("rival")))
    rival = ["tree_id", F.col("leaf_id").alias("rival")]
    free = lambda bits: F.coalesce(*[F.when(bits.bitwiseAND(F.lit(1 << k)) == 0, k) for k in range(len(TURNS))])
    open_, won = p.select(*key, "_bits"), None
    for _ in range(rounds):
        waits = pairs.join(open_.select(*rival), ["tree_id", "rival"], "left_semi").select(*key).distinct()
        ready = cut(open_.join(waits, key, "left_anti"))
        if won is None:
            now = ready.select(*key, free(F.col("_bits")).alias("frame")).where("frame is not null")
        else:
            taken = p.join(won, key).select("tree_id", F.col("leaf_id").alias("rival"), F.col("frame").alias("b_frame"), *[F.col(c).alias(f"b_{c}") for c in GEOMETRY])
            beside = p.select(*key, *GEOMETRY).join(ready.select(*key), key).join(pairs, key).join(taken, ["tree_id", "rival"])
            hits = _blocked(beside, shape, tris).groupBy(*key).agg(F.bit_or("hits").alias("hits"))
            blocked = F.coalesce("hits", F.lit(0)).bitwiseOR(F.col("_bits"))
            now = ready.join(hits, key, "left").select(*key, free(blocked).alias("frame")).where("frame is not null")
        won = cut(now if won is None else won.unionByName(now))
        open_ = cut(open_.join(ready, key, "left_anti"))
        if open_.isEmpty():
            return won
    raise ValueError("leaves did not settle")


def accept(leaves: DataFrame, shape: list[tuple], tris: list[tuple], target: float, rounds: int = 10000, branches: DataFrame | None = None) -> DataFrame:
    """Greedy acceptance per tree, in the order of a keyed shuffle: a candidate takes the
    first of its own and six turned frames (45 degrees about the normal, 30 about the
    direction and the side, both ways) that meets no accepted leaf and none of the
    branches (cylinders with a tree_id, if given), until the target area is reached.  leaves: tree_id, leaf_id, sx.., dx.., nx.., size, leaf_area.

    The order is that of a hash, so a candidate's fate depends only on lesser hashes: a
    tree's candidates below a bound are settled first, and the bound is doubled for trees
    whose accepted leaves do not reach the target yet.  The budget then cuts by window."""
    shuffled = cut(leaves.withColumn("_order", F.xxhash64("tree_id", "leaf_id", F.lit(9))))
    place = (F.col("_order").cast("double") + float(1 << 63)) / float(1 << 64)
    area = shuffled.groupBy("tree_id").agg(F.sum("leaf_area").alias("_all"))
    todo = cut(area.select("tree_id", F.when(F.col("_all") > 4 * target, 4 * target / F.col("_all")).otherwise(1.0).alias("_part")))
    done = None
    while not todo.isEmpty():
        p = cut(shuffled.join(todo, "tree_id").where((F.col("_part") >= 1) | (place < F.col("_part"))).drop("_part"))
        if branches is None:
            p = p.withColumn("_bits", F.lit(0))
        else:
            blocked = frames_blocked(p, branches, shape, tris).withColumnRenamed("bits", "_bits")
            p = cut(p.join(blocked, ["tree_id", "leaf_id"], "left").withColumn("_bits", F.coalesce("_bits", F.lit(0))))
        won = cut(p.join(_settled(p, shape, tris, rounds), ["tree_id", "leaf_id"]))
        reached = won.groupBy("tree_id").agg(F.sum("leaf_area").alias("_got"))
        state = cut(todo.join(reached, "tree_id", "left").withColumn("_ends", (F.col("_part") >= 1) | (F.coalesce("_got", F.lit(0.0)) >= target)))
        part = won.join(state.where("_ends").select("tree_id"), "tree_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = cut(state.where("not _ends").select("tree_id", (F.col("_part") * 2).alias("_part")))
    if done is None:
        return leaves.limit(0)
    kept = within_budget(done, ["tree_id"], ["_order", "leaf_id"], "leaf_area", target)
    d, n = cols("d"), cols("n")
    about = {"n": n, "d": d, "s": cross(n, d)}
    for v, p in (("d", d), ("n", n)):
        for i, c in enumerate("xyz"):
            out = p[i]
            for k, (axis, degrees) in enumerate(TURNS):
                if axis is not None:
                    out = F.when(F.col("frame") == k, rotate(p, about[axis], F.lit(math.radians(degrees)))[i]).otherwise(out)
            kept = kept.withColumn(f"_{v}{c}", out)
    return kept.select(*[F.col(f"_{c}" if c in GEOMETRY[3:9] else c).cast(leaves.schema[c].dataType).alias(c) for c in leaves.columns])


def sizes_to_total(draws: DataFrame, keys: list[str], order: list[str], total: str, base_area: float, size: Column, constant: float | None = None) -> DataFrame:
    """Leaves to a total area: of a constant size as many as its area goes into the total,
    rounded; else drawn until their areas reach it.  draws has the keys, the order (from
    0), the total and whatever size needs; size and leaf_area are added."""
    if constant is not None:
        n = F.round(F.col(total) / (base_area * constant ** 2))
        return draws.where(F.col(order[-1]) < n).withColumn("size", F.lit(float(constant))).withColumn("leaf_area", F.lit(base_area * constant ** 2))
    sized = draws.withColumn("size", size).withColumn("leaf_area", base_area * F.col("size") ** 2)
    return within_budget(sized, keys, order, "leaf_area", total)


def phyllotaxis(cyl: DataFrame, spacing: float, rotation: float, per_node: int = 1, separation: float = math.pi) -> DataFrame:
    """cyl with place (0 base, 1 tip), turn and leaf_no: nodes from the tip down at a fixed
    spacing, each turned on by rotation, with per_node leaves separation apart; the last
    node is the one before the base is passed."""
    nodes = F.floor(F.col("length") / spacing + 1e-12).cast("int")
    d = cyl.withColumn("_node", F.explode(F.sequence(F.lit(0), nodes))).withColumn("_leaf", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    place = F.greatest(F.lit(0.0), 1 - F.col("_node") * spacing / F.col("length"))
    turn = (F.col("_node") * rotation + F.col("_leaf") * separation) % (2 * math.pi)
    return d.withColumn("place", place).withColumn("turn", turn).withColumn("leaf_no", F.col("_node") * per_node + F.col("_leaf")).drop("_node", "_leaf")


def leaf_bounds(leaves: DataFrame, tree: str = "tree_id") -> DataFrame:
    """tree and the least and greatest leaf start, widened by the greatest size."""
    most = F.max("size")
    return leaves.groupBy(tree).agg(*[c for n in "xyz" for c in ((F.min(f"s{n}") - most).alias(f"{n}0"), (F.max(f"s{n}") + most).alias(f"{n}1"))])


def with_petiole(rows: DataFrame, along: Column, turn: Column, petiole: Column, nudge: Column | None = None) -> DataFrame:
    """rows (a*, n*, s*, length, radius) with d*, the leaf's direction, and e*, the end of
    its petiole: it leaves the cylinder's surface at the share along of the length, turned
    by turn from the upmost radial direction (the northmost if the axis is within 1e-3 of
    vertical), and runs across the side that the radial direction and the normal span.  Where
    those two are parallel, the radial direction is turned on by nudge (pi / 12 if not given).
    Each step is a set of columns, so that no expression is repeated in the next."""
    axis, normal = cols("a"), cols("n")
    d = rows.withColumns({"_along": along, "_turn": turn, "_long": petiole})
    upright = F.abs(axis[2]) > math.cos(1e-3)
    pole = tuple(F.when(upright, F.lit(p)).otherwise(F.lit(q)) for p, q in zip((0.0, 1.0, 0.0), (0.0, 0.0, 1.0)))
    step = lambda d, name, v: d.withColumns({f"{name}{k}": c for k, c in zip("xyz", v)})
    d = d.withColumn("_dot", dot(pole, axis))
    d = step(d, "_q", sub(pole, scale(axis, F.col("_dot"))))
    d = step(d, "_u", unit(cols("_q")))
    d = step(d, "_r", rotate(cols("_u"), axis, F.col("_turn")))
    apart = lambda sign: F.sqrt(sum((F.col(f"_r{k}") - sign * F.col(f"n{k}")) ** 2 for k in "xyz"))
    d = d.withColumn("_more", F.when((apart(1) <= 1e-3) | (apart(-1) <= 1e-3), F.lit(math.pi / 12) if nudge is None else nudge).otherwise(0.0))
    d = step(d, "_r", rotate(cols("_r"), axis, F.col("_more")))
    d = step(d, "_c", cross(cols("_r"), normal))
    d = step(d, "_s", unit(cols("_c")))
    d = step(d, "_f", cross(normal, cols("_s")))
    d = step(d, "d", unit(cols("_f")))
    end = [F.col(f"s{k}") + F.col("_along") * F.col("length") * F.col(f"a{k}") + F.col("radius") * F.col(f"_r{k}") + F.col("_long") * F.col(f"d{k}") for k in "xyz"]
    d = step(d, "e", end)
    return d.select(*rows.columns, *[f"{p}{k}" for p in "de" for k in "xyz"])


def direct(cyl: DataFrame, masses: tuple[list[float], list[float], list[float]], total: float, base_area: float, sizes: tuple[str, tuple[float, float]],
           angles: tuple[str, str, tuple, tuple], petiole: tuple[float, float] = (0.0, 0.0), seed: int = 1, petiole_density=None) -> DataFrame:
    """Leaves on cylinders, from densities to a leaf table: relative height, distance and
    direction, area by allocate(), sizes by leaf_sizes(), angles by leaf_angles(), the
    petiole frame at a keyed place, and the budget by window (no collisions; accept()
    takes the rows for those).  leaf_id, tree_id, cyl_id, s*, d*, n*, size, leaf_area.
    petiole_density: a function for sampling.petiole_turns(), in place of a uniform turn."""
    c = compass_of_midpoints(relative_height(cyl))
    c = relative_position(c, ["tree_id", "branch_index"], ["cyl_id"])
    c = allocate(c, F.col("rel_height"), F.col("rel_pos"), F.col("compass"), masses, total)
    # leaf_angles names the leaf's azimuth as cylinders name their axis' z
    leaves = leaf_angles(leaf_sizes(c, *sizes, base_area, seed).withColumn("_axis_z", F.col("az")), angles[0], angles[1], seed + 1, angles[2], angles[3])
    draw = lambda k: rng.uniform(seed + 2, k, "tree_id", "cyl_id", "leaf_no")
    normal = upward(leaf_normal(F.col("inc"), F.col("az")))
    leaves = leaves.select("*", *named(normal, "n")).withColumn("az", F.col("_axis_z")).drop("_axis_z", "inc")
    turn = draw(1) * (2 * math.pi)
    if petiole_density is not None:
        from .sampling import petiole_turns

        shaped = leaves.withColumn("inclination", arccos(F.col("az"))).withColumn("azimuth", axis_azimuth(F.col("ax"), F.col("ay"), F.col("az")))
        leaves, turn = petiole_turns(shaped, petiole_density, ["tree_id", "cyl_id", "leaf_no"], seed + 3), F.col("turn")
    d = with_petiole(leaves, draw(0), turn, petiole[0] + (petiole[1] - petiole[0]) * draw(2), math.pi / 6 - draw(3) * (math.pi / 3))
    rows = d.select("tree_id", "cyl_id", "leaf_no", F.xxhash64("tree_id", "cyl_id", "leaf_no").alias("leaf_id"), *[F.col(f"e{k}").alias(f"s{k}") for k in "xyz"],
                    "dx", "dy", "dz", "nx", "ny", "nz", "size", "leaf_area")
    return within_budget(rows, ["tree_id"], ["leaf_id"], "leaf_area", total)

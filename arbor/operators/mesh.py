"""Triangle meshes: areas, samples on faces, skins of skeletons, vertex remaps.

A triangle table has tri_id and the corners ax..cz."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec, arccos, cols, cross, norm, rotate, sub
from .lookup import weighted_pick
from .spatial import nearest


def face_normal() -> Vec:
    """Twice-area normal of a triangle."""
    a = cols("a")
    return cross(sub(cols("b"), a), sub(cols("c"), a))


def with_area(tri: DataFrame) -> DataFrame:
    return tri.withColumn("area", norm(face_normal()) / 2)


def total_area(tri: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, area: the sum over the faces (null corners count nothing)."""
    return with_area(tri).groupBy(*keys).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def shape_metrics(vertices: list[tuple], tris: list[tuple]) -> dict:
    """Dimensions (greatest less least) and area of a base shape given as literals."""
    def area(t):
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (vertices[i] for i in t)
        u, v = (bx - ax, by - ay, bz - az), (cx - ax, cy - ay, cz - az)
        w = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        return sum(c * c for c in w) ** 0.5 / 2

    return {"dimensions": tuple(max(c) - min(c) for c in zip(*vertices)), "area": sum(map(area, tris))}


def sample_faces(tri: DataFrame, draws: DataFrame, pick: str = "u", first: str = "v", second: str = "w") -> DataFrame:
    """draws with tri_id, x, y, z: a face by its share of the area, then a point by two
    more uniforms, folded into the triangle."""
    got = weighted_pick(with_area(tri), draws, "area", ["tri_id"], pick)
    fold = F.col(first) + F.col(second) > 1
    s, t = F.when(fold, 1 - F.col(first)).otherwise(F.col(first)), F.when(fold, 1 - F.col(second)).otherwise(F.col(second))
    at = [F.col(f"a{n}") + s * (F.col(f"b{n}") - F.col(f"a{n}")) + t * (F.col(f"c{n}") - F.col(f"a{n}")) for n in "xyz"]
    return got.select(*draws.columns, "tri_id", *[c.alias(n) for c, n in zip(at, "xyz")])


#: A skin's ring about a node: three corners at these multiples of the radius, horizontal.
RING = [(-1.0, 0.0), (0.5, -0.866), (0.5, 0.866)]


def skin_vertices(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, corner, x, y, z: the ring of every node (x, y, z, radius)."""
    ring = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(RING)])
    d = nodes.withColumn("_r", F.explode(ring))
    return d.select("tree_id", "node_id", F.col("_r.corner").alias("corner"), (F.col("x") + F.col("radius") * F.col("_r.dx")).alias("x"),
                    (F.col("y") + F.col("radius") * F.col("_r.dy")).alias("y"), "z")


def skin_faces(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, side, v0..v3: the quads between each node's ring and its
    parent's; vertices are numbered node * 3 + corner."""
    d = nodes.where("parent_id is not null").withColumn("side", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    a, b, k = F.col("parent_id") * 3, F.col("node_id") * 3, F.col("side")
    return d.select("tree_id", "node_id", "side", (a + k).alias("v0"), (a + (k + 1) % 3).alias("v1"), (b + (k + 1) % 3).alias("v2"), (b + k).alias("v3"))


def aligned(v: Vec, normal: Vec) -> Vec:
    """v turned as +z is turned onto the unit normal; about x where that points down."""
    flat = F.sqrt(normal[0] * normal[0] + normal[1] * normal[1])
    axis = (F.when(flat > 1e-12, -normal[1] / flat).otherwise(F.lit(1.0)), F.when(flat > 1e-12, normal[0] / flat).otherwise(F.lit(0.0)), F.lit(0.0))
    return rotate(v, axis, arccos(normal[2]))


def remap(vertices: DataFrame, targets: DataFrame, influence: float) -> DataFrame:
    """vertex, target: the nearest target (x, y, z) of each vertex, -2 if none is near."""
    return nearest(vertices, targets, influence, "vertex", "target").select("vertex", "target")


def modal_target(faces: DataFrame, mapped: DataFrame) -> DataFrame:
    """face, target: the target most of a face's vertices map to, ties to the least.
    faces has (face, vertex) rows."""
    n = faces.join(mapped, "vertex").groupBy("face", "target").count()
    return n.groupBy("face").agg(F.min_by("target", F.struct((-F.col("count")).alias("n"), "target")).alias("target"))


def nearer_class(points: DataFrame, trunk: DataFrame, branch: DataFrame, influence: float, point: str) -> DataFrame:
    """point, material: 0 where the nearest trunk node's surface is nearer than the
    nearest branch node's, else 1.  trunk and branch: node_id, x, y, z, radius."""
    def gap(nodes: DataFrame, name: str) -> DataFrame:
        r = nodes.select("node_id", F.col("radius").alias("_r"))
        return nearest(points, nodes, influence, point, "node_id").join(r, "node_id", "left").select(point, (F.col("dist") - F.col("_r")).alias(name))

    far = F.lit(float("inf"))
    both = gap(trunk, "_t").join(gap(branch, "_b"), point)
    return both.select(point, F.when(F.coalesce("_t", far) < F.coalesce("_b", far), 0).otherwise(1).alias("material"))



"""Cylinders as meshes in full: rings of varying side counts, quads or triangles, end
fans, global vertex and face numbers, and their text forms.

Numbers come from running totals of the side counts over ranges of cylinders, so a mesh
of any size is numbered without one task seeing all of it."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import cols, norm
from ..sources.writers import ExportOptions
from .lookup import running_totals


def with_sides(cyl: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """cyl with sides: low, or from low at the least radius of all to high at the greatest,
    linear in the radius and rounded."""
    if high is None or high == low:
        return cyl.withColumn("sides", F.lit(low))
    ends = cyl.agg(F.min("radius").alias("_r0"), F.max("radius").alias("_r1"))
    d = cyl.join(F.broadcast(ends))
    p = (F.col("radius") - F.col("_r0")) / (F.col("_r1") - F.col("_r0"))
    return d.withColumn("sides", F.when(F.col("_r1") > F.col("_r0"), F.round(p * (high - low) + low)).otherwise(low).cast("int")).drop("_r0", "_r1")


def numbered(cyl: DataFrame, quads: bool = True, closed: bool = False, order: tuple[str, ...] = ("tree_id", "cyl_id")) -> DataFrame:
    """cyl (with sides) with first_vertex and first_face, the numbers, from 0, of its first
    vertex and face when all cylinders are listed in the order (which must be unique)."""
    d = running_totals(cyl.withColumn("_one", F.lit(1).cast("long")), {"_sides": "sides", "_count": "_one"}, list(order))
    sides, count = F.col("_sides") - F.col("sides"), F.col("_count") - 1
    faces = (1 if quads else 2) + (2 if closed else 0)
    return d.withColumn("first_vertex", 2 * sides + (2 * count if closed else F.lit(0))).withColumn("first_face", faces * sides).drop("_one", "_sides", "_count")


def vertices(cyl: DataFrame, closed: bool = False) -> DataFrame:
    """tree_id, cyl_id, vertex, x, y, z of numbered cylinders: the foot's ring, the head's
    ring, and both centres where closed.  A ring is the circle about the vertical, from
    +x on, tilted to the axis about the horizontal normal of both; a cylinder that points
    straight down is turned about +x."""
    d = cyl.withColumn("_n", F.nullif(norm(cols("a")), F.lit(0.0))).withColumns({f"_{k}": F.col(f"a{k}") / F.col("_n") for k in "xyz"}).withColumn("_s", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))
    rim = d.withColumn("_ring", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    turn = F.col("_i") * (2 * math.pi) / F.col("sides")
    rim = rim.withColumn("_u", F.cos(turn)).withColumn("_v", F.sin(turn)).withColumn("_w", (F.col("_x") * F.col("_v") - F.col("_y") * F.col("_u")) * (1 - F.col("_z")) / F.nullif(F.col("_s") ** 2, F.lit(0.0)))
    upright = F.col("_s") < 1e-12
    x = F.when(upright, F.col("_u")).otherwise(F.col("_z") * F.col("_u") - F.col("_y") * F.col("_w"))
    y = F.when(upright, F.col("_v") * F.signum("_z")).otherwise(F.col("_z") * F.col("_v") + F.col("_x") * F.col("_w"))
    z = F.when(upright, F.lit(0.0)).otherwise(-(F.col("_x") * F.col("_u") + F.col("_y") * F.col("_v")))
    place = lambda axis, k: F.col(f"s{k}") + F.col("_ring") * F.col("length") * F.col(f"_{k}") + F.col("radius") * axis
    out = rim.select("tree_id", "cyl_id", (F.col("first_vertex") + F.col("_ring") * F.col("sides") + F.col("_i")).alias("vertex"), *[place(c, k).alias(k) for k, c in zip("xyz", (x, y, z))])
    if not closed:
        return out
    ends = d.withColumn("_ring", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.unionByName(ends.select("tree_id", "cyl_id", (F.col("first_vertex") + 2 * F.col("sides") + F.col("_ring")).alias("vertex"), *[place(F.lit(0.0), k).alias(k) for k in "xyz"]))


def faces(cyl: DataFrame, quads: bool = True, closed: bool = False) -> DataFrame:
    """tree_id, cyl_id, face, corners (vertex numbers from 0) of numbered cylinders: the
    sides, then the fan of the foot and that of the head."""
    d = cyl.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides").cast("long") - 1)))
    n, i = F.col("sides").cast("long"), F.col("_i")
    j = (i + 1) % n
    kinds = [[i, j, n + j, n + i]] if quads else [[i, j, n + i], [n + i, j, n + j]]
    if closed:
        kinds += [[i, 2 * n, j], [n + i, n + j, 2 * n + 1]]
    each = F.array(*[F.struct((F.col("first_face") + k * n + i).alias("face"), F.array(*[F.col("first_vertex") + c for c in kind]).alias("corners")) for k, kind in enumerate(kinds)])
    return d.select("tree_id", "cyl_id", F.explode(each).alias("f")).select("tree_id", "cyl_id", "f.*")


def ramp(colours: int = 64) -> list[tuple[int, int, int]]:
    """From dark blue over green to yellow, by rule."""
    step = [k / (colours - 1) for k in range(colours)]
    return [(round(255 * t ** 2), round(255 * (0.1 + 0.8 * t)), round(255 * (0.6 - 0.5 * t))) for t in step]


def coloured(cyl: DataFrame, source: str, palette: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """cyl with red, green, blue: the palette's entry at source's place between its least
    and greatest value."""
    palette = palette or ramp()
    ends = cyl.agg(F.min(source).alias("_c0"), F.max(source).alias("_c1"))
    d = cyl.join(F.broadcast(ends))
    at = F.when(F.col("_c1") > F.col("_c0"), F.floor((F.col(source) - F.col("_c0")) / (F.col("_c1") - F.col("_c0")) * (len(palette) - 1))).otherwise(0).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in palette]), at)
    return d.select(*cyl.columns, *[pick(k).alias(c) for k, c in enumerate(("red", "green", "blue"))])


def mesh_text(cyl: DataFrame, form: str, options: ExportOptions | None = None) -> DataFrame:
    """part, row, line of an OBJ or PLY file of the cylinders.  Read of the options:
    filter (which cylinders), facecount (one or a pair), quads, closed, origin,
    precision, header (the lines header_lines are written), comments and color (PLY)."""
    o = options or ExportOptions()
    if form not in ("obj", "ply"):
        raise ValueError(f"unknown form {form}")
    low, high = o.facecount if isinstance(o.facecount, (tuple, list)) else (o.facecount, None)
    c = with_sides(cyl if o.filter is None else cyl.where(o.filter), low, high)
    if o.color is not None and form == "ply":
        c = coloured(c, o.color)
    c = numbered(c, o.quads, o.closed)
    v, f = vertices(c, o.closed), faces(c, o.quads, o.closed)
    xyz = [F.format_string(f"%.{o.precision}f", F.col(k) - float(w)) for k, w in zip("xyz", o.origin)]
    paint = []
    if o.color is not None and form == "ply":
        v = v.join(c.select("tree_id", "cyl_id", "red", "green", "blue"), ["tree_id", "cyl_id"])
        paint = [F.col(k).cast("string") for k in ("red", "green", "blue")]
    note = lambda number, text: [F.when(F.col(number) == 0, F.lit(text))] if o.comments and form == "ply" else []
    first = 1 if form == "obj" else 0
    lead = lambda word, size: [F.lit(word)] if form == "obj" else [] if size is None else [size.cast("string")]
    vl = v.select(F.lit(1).alias("part"), F.col("vertex").alias("row"), F.concat_ws(" ", *lead("v", None), *xyz, *paint, *note("vertex", "{ start of vertex list }")).alias("line"))
    fl = f.select(F.lit(2).alias("part"), F.col("face").alias("row"), F.concat_ws(" ", *lead("f", F.size("corners")), F.array_join(F.transform("corners", lambda x: (x + first).cast("string")), " "),
                                                                              *note("face", "{ start of face list }")).alias("line"))
    counts = c.agg(F.coalesce(F.sum(2 * F.col("sides") + (2 if o.closed else 0)), F.lit(0)).cast("long").alias("v"),
                   F.coalesce(F.sum(((1 if o.quads else 2) + (2 if o.closed else 0)) * F.col("sides")), F.lit(0)).cast("long").alias("f"))
    lines = [F.lit(x) for x in (o.header_lines if o.header else ())]
    if form == "ply":
        lines = [F.lit("ply"), F.lit("format ascii 1.0"), *lines, F.concat(F.lit("element vertex "), F.col("v").cast("string")), *[F.lit(f"property float {k}") for k in "xyz"],
                 *[F.lit(f"property uchar {k}") for k in ("red", "green", "blue") if paint], F.concat(F.lit("element face "), F.col("f").cast("string")),
                 F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    out = vl.unionByName(fl)
    if lines:
        out = counts.select(F.lit(0).alias("part"), F.posexplode(F.array(*lines)).alias("row", "line")).withColumn("row", F.col("row").cast("long")).unionByName(out)
    return out

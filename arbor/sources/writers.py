"""Text forms of meshes, cylinders and scans, as rows that any text sink can write.

Rows carry a number that orders them; vertex numbers follow from counts per leaf or
cylinder, so ranges of rows can be written apart."""
from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import leaf_vertex, semantic_code
from ..functions.vec import vec


def general(v: Column, digits: int = 5) -> Column:
    """Shortest of so many significant digits, like %g for everyday magnitudes."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(v))).cast("int"))
    scaled = F.round(v * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
    return F.when(v == 0, F.lit("0")).otherwise(F.regexp_replace(F.format_string("%.12f", scaled), r"\.?0+$", ""))


def number(v: Column, digits: int = 6) -> Column:
    """An integer without a point, another value with so many decimals."""
    return F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).otherwise(F.format_string(f"%.{digits}f", v))


def leaf_obj(leaves: DataFrame, shape: list[tuple], tris: list[tuple], digits: int = 5, keep: Column | None = None) -> DataFrame:
    """row, line of an OBJ file: all vertices by leaf, then all faces.  leaves: leaf_no
    (dense from 0), s*, d*, n*, size."""
    d = leaves if keep is None else leaves.where(keep)
    nv, nt = len(shape), len(tris)
    size = tuple(F.col("size") for _ in range(3))
    lines = []
    for k, p in enumerate(shape):
        at = leaf_vertex(p, size, vec("dx", "dy", "dz"), vec("nx", "ny", "nz"), vec("sx", "sy", "sz"))
        lines.append(F.struct(F.lit(0).alias("part"), (F.col("leaf_no") * nv + k).alias("row"), F.concat_ws(" ", F.lit("v"), *[general(c, digits) for c in at]).alias("line")))
    for k, t in enumerate(tris):
        lines.append(F.struct(F.lit(1).alias("part"), (F.col("leaf_no") * nt + k).alias("row"),
                              F.concat_ws(" ", F.lit("f"), *[(F.col("leaf_no") * nv + i + 1).cast("string") for i in t]).alias("line")))
    return d.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def ring_obj(rings: DataFrame, sides: int, ply: bool = False) -> DataFrame:
    """part, row, line of open cylinders from tessellate(); rings has cyl_no (dense from
    0).  OBJ is 1-based, PLY 0-based with the corner count first."""
    place = (F.col("cyl_no") * 2 + F.col("ring")) * sides + F.col("corner")
    v = rings.select(F.lit(0).alias("part"), place.alias("row"), F.concat_ws(" ", *([] if ply else [F.lit("v")]), *[number(F.col(c)) for c in "xyz"]).alias("line"))
    a = F.col("cyl_no") * 2 * sides + F.col("corner")
    b = F.col("cyl_no") * 2 * sides + (F.col("corner") + 1) % sides
    quad = [(c + (0 if ply else 1)).cast("string") for c in (a, b, b + sides, a + sides)]
    f = rings.where("ring = 0").select(F.lit(1).alias("part"), (F.col("cyl_no") * sides + F.col("corner")).alias("row"), F.concat_ws(" ", F.lit("4" if ply else "f"), *quad).alias("line"))
    return v.unionByName(f)


def cylinder_text(cyl: DataFrame, origin: tuple[float, float, float] = (0, 0, 0), extra: list[str] = ()) -> DataFrame:
    """tree_id, cyl_id, line: branch, start, axis, length, radius and extra columns."""
    start = [F.col(f"s{c}") - o for c, o in zip("xyz", origin)]
    values = [F.col("branch_index").cast("double"), *start, F.col("ax"), F.col("ay"), F.col("az"), F.col("length"), F.col("radius"), *[F.col(c).cast("double") for c in extra]]
    return cyl.select("tree_id", "cyl_id", F.concat_ws(" ", *[number(v) for v in values]).alias("line"))


def las_records(scan: DataFrame, scale: float = 0.001) -> DataFrame:
    """Integer records of a scan: X, Y, Z from the least corner in steps of the scale,
    instance_id, classification, and the offsets."""
    low = scan.agg(*[F.min(c).alias(f"{c}0") for c in "xyz"])
    d = scan.join(F.broadcast(low))
    return d.select(*[F.round((F.col(c) - F.col(f"{c}0")) / scale).cast("int").alias(c.upper()) for c in "xyz"], F.col("SemClassID").alias("instance_id"),
                    semantic_code(F.col("MaterialID")).alias("classification"), "x0", "y0", "z0")


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """Ordered text as part files by ranges of the order: the parts in the order of their
    names are the file."""
    rows.orderBy(*order).select("line").write.text(path)


@dataclass
class ExportOptions:
    """How meshes and cylinders are written; of() takes any mapping."""
    precision: int = 5
    facecount: int | tuple[int, int] = 5
    closed: bool = False
    quads: bool = True
    comments: bool = True
    header: bool = True
    header_lines: tuple[str, ...] = ()
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    extra: tuple[str, ...] = ()
    filter: Column | None = None
    color: str | None = None

    @classmethod
    def of(cls, given: dict) -> ExportOptions:
        """Unknown names are left out, with a warning."""
        known = {f.name for f in fields(cls)}
        for name in sorted(set(given) - known):
            warnings.warn(f"unknown export option {name}", stacklevel=2)
        return cls(**{k: v for k, v in given.items() if k in known})


def extended_obj(leaves: DataFrame, shape: list[tuple], tris: list[tuple], digits: int = 5, extra: list[str] = ()) -> DataFrame:
    """part, row, line: the base shape once, then an L row for each leaf (leaf_no, pet*,
    s*, d*, n*, size and extra columns)."""
    base = [(0, k, " ".join(["v", *(f"{c:g}" for c in p)])) for k, p in enumerate(shape)] + [(1, k, " ".join(["f", *(str(i + 1) for i in t)])) for k, t in enumerate(tris)]
    head = leaves.sparkSession.createDataFrame(base, "part int, row long, line string")
    values = [F.col(f"{p}{c}") for p in ("pet", "s", "d", "n") for c in "xyz"] + [F.col("size")] * 3 + [F.col(c).cast("double") for c in extra]
    return head.unionByName(leaves.select(F.lit(2).alias("part"), F.col("leaf_no").cast("long").alias("row"), F.concat_ws(" ", F.lit("L"), *[general(v, digits) for v in values]).alias("line")))


#: Fields of a cylinder row of the text form, in order.
CYLINDER_FIELDS = ["radius", "length", "sx", "sy", "sz", "ax", "ay", "az", "parent", "extension", "branch_index", "order", "index_in_branch", "added"]
BRANCH_FIELDS = ["order", "parent_branch", "volume", "length", "angle", "height"]


def model_text(cyl: DataFrame, branches: DataFrame, trees: DataFrame, scalars: list[str]) -> DataFrame:
    """tree_id, part, row, line: cylinder rows, branch rows, then one row for each of the
    tree's scalars; a missing value is 0."""
    line = lambda names: F.concat_ws(" ", *[number(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in names])
    a = cyl.select("tree_id", F.lit(0).alias("part"), F.col("cyl_id").cast("long").alias("row"), line(CYLINDER_FIELDS).alias("line"))
    b = branches.select("tree_id", F.lit(1).alias("part"), F.col("branch_index").cast("long").alias("row"), line(BRANCH_FIELDS).alias("line"))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("row"), F.concat_ws(" ", F.lit(c), number(F.col(c).cast("double"))).alias("line")) for k, c in enumerate(scalars)]))
    c = trees.select("tree_id", F.lit(2).alias("part"), each.alias("l")).select("tree_id", "part", "l.*")
    return a.unionByName(b).unionByName(c)


def nested(cyl: DataFrame) -> DataFrame:
    """tree_id and qsm.cylinder: the cylinder columns as a nested struct, for Parquet."""
    rest = [c for c in cyl.columns if c != "tree_id"]
    return cyl.select("tree_id", F.struct(F.struct(*rest).alias("cylinder")).alias("qsm"))


def narrowed(v: Column, kind: str) -> Column:
    """v as uint8 or uint16 (rounded half away from zero, limited to the type's range; not
    a number is 0), float32 or logical."""
    if kind == "float32":
        return v.cast("float")
    if kind == "logical":
        return v != 0
    top = {"uint8": 255, "uint16": 65535}[kind]
    return F.when(v.isNotNull(), F.when(F.isnan(v.cast("double")), 0).otherwise(F.least(F.lit(top), F.greatest(F.lit(0), F.round(v))))).cast("int")

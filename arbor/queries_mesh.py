"""Queries of meshes and files: embeddings are cylinders or scan points; what a file holds
is read back from the shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import tessellation
from .plans.stage import shared_dir
from .queries import CYL, PI, _cyl, _t, query, r6
from .sources import las, readers, writers

LOW, HIGH = 3, 9
#: Sides, numbers and the tilted rings of closed cylinders.
MESH = f"""{CYL}, span AS (SELECT min(radius) AS r0, max(radius) AS r1 FROM cyl),
sided AS (SELECT cyl.*, round((radius - r0) / (r1 - r0) * {HIGH - LOW} + {LOW})::BIGINT AS n FROM cyl, span),
numbered AS (SELECT *, coalesce(sum(2 * n + 2) OVER w, 0)::BIGINT AS v0, coalesce(sum(n) OVER w, 0)::BIGINT AS before FROM sided WINDOW w AS (ORDER BY tree_id, cyl_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rim AS (SELECT *, cos(i * 2 * {PI} / n) AS u, sin(i * 2 * {PI} / n) AS v, sqrt(ax * ax + ay * ay) AS s FROM (SELECT *, unnest(range(n)) AS i FROM numbered), (SELECT unnest([0, 1]) AS ring)),
tilted AS (SELECT *, -ay / s AS kx, ax / s AS ky, (-ay * u + ax * v) / s AS along FROM rim),
vert AS (SELECT cyl_id, v0 + ring * n + i AS vertex, sx + ring * length * ax + radius * (az * u + kx * along * (1 - az)) AS x, sy + ring * length * ay + radius * (az * v + ky * along * (1 - az)) AS y, sz + ring * length * az - radius * (ax * u + ay * v) AS z FROM tilted
 UNION ALL SELECT cyl_id, v0 + 2 * n + ring, sx + ring * length * ax, sy + ring * length * ay, sz + ring * length * az FROM numbered, (SELECT unnest([0, 1]) AS ring))"""


def _numbered(spark, sf_dir, quads):
    return tessellation.numbered(tessellation.with_sides(_cyl(spark, sf_dir), LOW, HIGH), quads, True)


@query(f"WITH {MESH} SELECT cyl_id, vertex::BIGINT AS vertex, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vert")
def mesh_vertices(spark, sf_dir):
    """Vertices of all cylinders closed, of three to nine sides by their radius."""
    return tessellation.vertices(_numbered(spark, sf_dir, False), True).select("cyl_id", "vertex", *[r6(F.col(c), c) for c in "xyz"])


@query(f"""WITH {MESH}, each AS (SELECT *, unnest(range(n)) AS i FROM numbered), pair AS (SELECT *, (i + 1) % n AS j FROM each)
SELECT cyl_id, (4 * before + k * n + i)::BIGINT AS face, concat_ws(' ', v0 + CASE k WHEN 0 THEN i WHEN 1 THEN n + i WHEN 2 THEN i ELSE n + i END, v0 + CASE k WHEN 0 THEN j WHEN 1 THEN j WHEN 2 THEN 2 * n ELSE n + j END, v0 + CASE k WHEN 0 THEN n + i WHEN 1 THEN n + j WHEN 2 THEN j ELSE 2 * n + 1 END) AS corners FROM pair, (SELECT unnest(range(4)) AS k)""")
def mesh_faces(spark, sf_dir):
    """Their triangles: sides and end fans, with vertex numbers of the whole mesh."""
    f = tessellation.faces(_numbered(spark, sf_dir, False), False, True)
    return f.select("cyl_id", "face", F.array_join(F.transform("corners", lambda x: x.cast("string")), " ").alias("corners"))


@query(f"WITH {MESH} SELECT vertex::BIGINT AS line, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM (SELECT vertex, x::DECIMAL(18, 6)::DOUBLE AS x, y::DECIMAL(18, 6)::DOUBLE AS y, z::DECIMAL(18, 6)::DOUBLE AS z FROM vert)")
def mesh_file(spark, sf_dir):
    """The mesh as an OBJ file of many parts, written to the shared folder and read back:
    its vertices in the order of the file."""
    path = f"{shared_dir(spark)}/mesh-{uuid.uuid4().hex}"
    writers.write_lines(tessellation.mesh_text(_cyl(spark, sf_dir), "obj", writers.ExportOptions(facecount=(LOW, HIGH), closed=True, quads=False, precision=6)), path, ["part", "row"])
    v, _ = readers.read_obj(spark, path, as_one=True)
    return v.select("line", *[F.round(c, 3).alias(c) for c in "xyz"])


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label, vec_id % 12 AS material FROM embeddings), low AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM p)
SELECT label::INT AS instance_id, CASE material WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 10 THEN 2 ELSE material END::INT AS classification, round(round((x - x0) / 0.001::DOUBLE) * 0.001::DOUBLE + x0, 6) AS x, round(round((y - y0) / 0.001::DOUBLE) * 0.001::DOUBLE + y0, 6) AS y, round(round((z - z0) / 0.001::DOUBLE) * 0.001::DOUBLE + z0, 6) AS z FROM p, low""")
def las_file(spark, sf_dir):
    """Embeddings as a scan, written as LAS tiles and read back from their bytes."""
    path = f"{shared_dir(spark)}/las-{uuid.uuid4().hex}"
    e, d = _t(spark, sf_dir, "embeddings"), F.col("embedding")
    las.write_las(e.select(*[d[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.col("label").alias("SemClassID"), (F.col("vec_id") % 12).cast("int").alias("MaterialID")), path)
    return las.read_las(spark, path).select("instance_id", "classification", *[r6(F.col(c), c) for c in "xyz"])

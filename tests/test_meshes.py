"""Meshes of cylinders in full, texts read in splits, LAS tiles."""
import json
import math
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbor.operators import tessellation
from arbor.sources import las, readers, writers

CYL = "tree_id long, cyl_id long, sx double, sy double, sz double, ax double, ay double, az double, length double, radius double"


def cylinders(n=17):
    rng, rows = random.Random(3), []
    for i in range(n):
        a = np.array([rng.gauss(0, 1) for _ in range(3)])
        a = (0., 0., 1.) if i == 3 else (0., 0., -1.) if i == 5 else tuple((a / np.linalg.norm(a)).tolist())
        rows.append((i % 2, i, rng.random(), rng.random(), rng.random(), *a, rng.uniform(.1, 2), rng.uniform(.01, .2)))
    return rows


def plain_mesh(rows, low, high, quads, closed):
    """Vertices and 1-based faces, cylinder after cylinder."""
    rows = sorted(rows)
    r = [x[9] for x in rows]
    verts, faces = [], []
    for _, _, *c in rows:
        n = low if max(r) == min(r) else math.floor((c[7] - min(r)) / (max(r) - min(r)) * (high - low) + low + .5)
        s, a = np.array(c[:3]), np.array(c[3:6])
        axis = np.cross([0, 0, 1], a)
        if np.linalg.norm(axis) < 1e-12:
            turn = np.diag([1., np.sign(a[2]), np.sign(a[2])])
        else:
            axis /= np.linalg.norm(axis)
            k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
            t = math.acos(a[2])
            turn = np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k
        at = len(verts)
        for h in (0, c[6]):
            verts += [s + a * h + turn @ (c[7] * np.array([math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n), 0])) for i in range(n)]
        if closed:
            verts += [s, s + a * c[6]]
        j = lambda i: (i + 1) % n
        own = [[i, j(i), n + j(i), n + i] for i in range(n)] if quads else [[i, j(i), n + i] for i in range(n)] + [[n + i, j(i), n + j(i)] for i in range(n)]
        own += [[i, 2 * n, j(i)] for i in range(n)] + [[n + i, n + j(i), 2 * n + 1] for i in range(n)] if closed else []
        faces += [[at + v + 1 for v in f] for f in own]
    return verts, faces


@pytest.mark.parametrize("quads,closed,high", [(True, False, 5), (False, True, 9), (True, True, 12), (False, False, 7)])
def test_meshes(spark, quads, closed, high):
    cyl = spark.createDataFrame(cylinders(), CYL).repartition(3)
    c = tessellation.numbered(tessellation.with_sides(cyl, 5, high), quads, closed)
    want_v, want_f = plain_mesh(cylinders(), 5, high, quads, closed)
    v, f = {r.vertex: (r.x, r.y, r.z) for r in tessellation.vertices(c, closed).collect()}, {r.face: r.corners for r in tessellation.faces(c, quads, closed).collect()}
    assert sorted(v) == list(range(len(want_v))) and sorted(f) == list(range(len(want_f)))
    for i, p in enumerate(want_v):
        assert v[i] == pytest.approx(p.tolist(), abs=1e-9)
    assert [[x + 1 for x in f[i]] for i in range(len(f))] == want_f


def test_ply_and_obj_open_again(spark, tmp_path):
    cyl = spark.createDataFrame(cylinders(), CYL).repartition(3)
    o = writers.ExportOptions.of({"facecount": (4, 8), "closed": True, "quads": True, "precision": 4, "color": "radius", "origin": (1.0, 0.0, 0.0), "header_lines": ("comment made here",), "filter": F.col("cyl_id") != 2})
    lines = [r.line for r in tessellation.mesh_text(cyl, "ply", o).orderBy("part", "row").collect()]
    want_v, want_f = plain_mesh([r for r in cylinders() if r[1] != 2], 4, 8, True, True)
    end = lines.index("end_header")
    assert lines[:3] == ["ply", "format ascii 1.0", "comment made here"] and f"element vertex {len(want_v)}" in lines[:end] and f"element face {len(want_f)}" in lines[:end]
    body = [x.split("{")[0].split() for x in lines[end + 1:]]
    assert len(body) == len(want_v) + len(want_f) and lines[end + 1].endswith("{ start of vertex list }")
    for got, p in zip(body, want_v):
        assert [float(x) for x in got[:3]] == pytest.approx((p - [1, 0, 0]).tolist(), abs=6e-5) and all(0 <= int(x) <= 255 for x in got[3:]) and len(got) == 6
    assert [[int(x) + 1 for x in got[1:]] for got in body[len(want_v):]] == want_f and all(int(got[0]) == len(got) - 1 for got in body[len(want_v):])

    writers.write_lines(tessellation.mesh_text(cyl, "obj", writers.ExportOptions(closed=True, quads=False)).repartition(4), str(tmp_path / "obj"), ["part", "row"])
    v, f = readers.read_obj(spark, str(tmp_path / "obj"), as_one=True)
    want_v, want_f = plain_mesh(cylinders(), 5, 5, False, True)
    assert [(r.x, r.y, r.z) for r in v.orderBy("line").collect()] == [pytest.approx(p.tolist(), abs=6e-6) for p in want_v]
    assert [r.corners for r in f.orderBy("line").collect()] == want_f
    with pytest.raises(ValueError):
        tessellation.mesh_text(cyl, "stl")


def test_one_file_in_several_splits_reads_the_same(spark, tmp_path):
    rng = random.Random(1)
    lines = [f"v {rng.random()} {i} 0" if i % 3 else "f " + " ".join(str(rng.randint(1, 99)) for _ in range(rng.choice((3, 70)))) for i in range(900)] + ["", "# ende"]
    for name in ("a", "b"):
        (tmp_path / f"{name}.obj").write_text("\n".join(lines) + "\n")
    paths = [str(tmp_path / f"{n}.obj") for n in "ab"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.numbered_lines(spark, paths)
        assert got.select(F.spark_partition_id()).distinct().count() > 3
        got = sorted((r.file[-5:], r.line, r.text) for r in got.collect())
        v, f = readers.read_obj(spark, paths[0])
        v, f = sorted((r.line, r.y) for r in v.collect()), sorted((r.line, len(r.corners)) for r in f.collect())
        through = sorted((r.line, r.text) for r in readers.numbered_lines(spark, paths, as_one=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(f"{n}.obj", i, x) for n in "ab" for i, x in enumerate(lines)]
    assert through == list(enumerate(lines + lines))
    assert v == [(i, float(i)) for i in range(900) if i % 3] and f == [(i, len(x.split()) - 1) for i, x in enumerate(lines[:900]) if not i % 3]


def test_las_tiles_parse_back(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.uniform(-50, 900), rng.uniform(5, 6), rng.uniform(0, 30), rng.randint(0, 10**6), rng.choice((1, 2, 10, 7))) for _ in range(500)]
    path = str(tmp_path / "las")
    las.write_las(spark.createDataFrame(rows, readers.SCAN).repartition(3), path)
    files = sorted(Path(path).glob("*.las"))
    points, low = [], [min(r[k] for r in rows) for k in range(3)]
    for f in files:
        d = f.read_bytes()
        assert d[:4] == b"LASF" and d[24:26] == b"\x01\x02" and struct.unpack_from("<H", d, 94) == (227,)
        start, n_vlr = struct.unpack_from("<II", d, 96)
        kind, size, n, first_returns = struct.unpack_from("<BHII", d, 104)
        assert (kind, size, n_vlr) == (2, 30, 1) and first_returns == n and len(d) == start + n * size
        scale, offset, box = struct.unpack_from("<3d", d, 131), struct.unpack_from("<3d", d, 155), struct.unpack_from("<6d", d, 179)
        assert scale == (.001,) * 3 and offset == pytest.approx(low)
        assert d[227 + 2:227 + 11] == b"LASF_Spec" and d[227 + 54 + 2] == 6 and d[227 + 54 + 4:227 + 54 + 15] == b"instance_id"
        own = []
        for i in range(n):
            x, y, z, _, _, cls, *_, inst = struct.unpack_from("<iiiHBBbBHHHHi", d, start + i * size)
            own.append(tuple(v * s + o for v, s, o in zip((x, y, z), scale, offset)) + (inst, cls))
        assert box == pytest.approx([g(p[k] for p in own) for k in range(3) for g in (max, min)])
        points += own
    code = {1: 0, 2: 1, 10: 2}
    want = sorted((r[3], code.get(r[4], r[4]), *r[:3]) for r in rows)
    for got, w in zip(sorted((p[3], p[4], *p[:3]) for p in points), want):
        assert got[:2] == w[:2] and got[2:] == pytest.approx(w[2:], abs=.00051)
    assert len(points) == len(rows) and len(files) > 1
    totals = json.loads(Path(path, "_summary.json").read_text())
    assert totals["points"] == 500 and totals["tiles"] == len(files) and totals["low"] == pytest.approx(low, abs=1e-3)
    back = las.read_las(spark, path)
    assert sorted((r.instance_id, r.classification) for r in back.collect()) == [w[:2] for w in want]
    # written anew, the old tiles go; a failing task leaves them
    las.write_las(spark.createDataFrame(rows[:5], readers.SCAN).coalesce(1), path)
    assert las.read_las(spark, path).count() == 5
    with pytest.raises(Exception, match="0 to 31"):
        las.write_las(spark.createDataFrame([(0., 0., 0., 1, 40)], readers.SCAN), path)
    assert las.read_las(spark, path).count() == 5 and not list(Path(path).glob("_tmp*"))
    las.write_las(spark.createDataFrame([], readers.SCAN), path)
    assert not list(Path(path).glob("*.las"))

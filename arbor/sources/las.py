"""LAS 1.2 files (point format 2 with an extra int32 instance_id) of scans, written and
read by Spark tasks.

A path is a folder of tiles: every task writes a whole LAS file of its points, with a
header of its own counts and bounds, beside the final name; the commit moves what the
tasks reported into place and writes the totals from their messages, so a failed or
repeated task leaves nothing behind.  All tiles have the same offsets (the least corner
of the scan) and a scale of a millimetre.  Paths are any that pyarrow.fs opens."""
from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.scalars import semantic_code

# Fixed values of the format: header size, descriptor record, point format and record layout.
HEADER, VLR_HEADER, DESCRIPTOR, FORMAT = 227, 54, 192, 2
POINT = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"),
                  ("red", "<u2"), ("green", "<u2"), ("blue", "<u2"), ("instance_id", "<i4")])
SCALE = 0.001
COLUMNS = "x double, y double, z double, instance_id int, classification int"


def header(count: int, low: list[float], high: list[float], offset: list[float]) -> bytes:
    """Header and the record that describes instance_id (type 6: int32)."""
    start = HEADER + VLR_HEADER + DESCRIPTOR
    box = [v for pair in zip(high, low) for v in pair]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I12d", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"arbor", 0, 0, HEADER, start, 1, FORMAT, POINT.itemsize, count,
                       count, 0, 0, 0, 0, SCALE, SCALE, SCALE, *offset, *box)
    record = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, DESCRIPTOR, b"Extra bytes")
    return head + record + struct.pack("<HBB32s", 0, 6, 0, b"instance_id").ljust(DESCRIPTOR, b"\0")


@dataclass
class Tile(WriterCommitMessage):
    name: str
    count: int
    low: list[float]
    high: list[float]


class LasWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.offset, self.overwrite = options["path"], [float(options[f"offset_{k}"]) for k in "xyz"], overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches) -> Tile:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        task = TaskContext.get()
        name, parts, low, high = f"part-{task.partitionId():05d}-{self.job}.las", [], np.full(3, np.inf), np.full(3, -np.inf)
        for b in batches:
            cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            if np.any((cols["classification"] < 0) | (cols["classification"] > 31)):
                raise ValueError("classifications must lie in 0 to 31")
            out = np.zeros(b.num_rows, POINT)
            for k, c in enumerate("xyz"):
                step = np.rint((cols[c] - self.offset[k]) / SCALE)
                if np.any(~np.isfinite(step)) or np.any(np.abs(step) > 2**31 - 1):
                    raise ValueError("coordinates must be finite and within 2,147 km of the offset")
                out[c.upper()] = step
                if b.num_rows:
                    at = step * SCALE + self.offset[k]
                    low[k], high[k] = min(low[k], at.min()), max(high[k], at.max())
            out["classification"], out["instance_id"], out["flags"] = cols["classification"], cols["instance_id"], 9  # one return of one
            parts.append(out)
        points = np.concatenate(parts) if parts else np.zeros(0, POINT)
        if not len(points):
            return Tile("", 0, [], [])
        store.create_dir(f"{root}/_tmp-{self.job}", recursive=True)
        with store.open_output_stream(f"{root}/_tmp-{self.job}/{task.attemptNumber()}-{name}") as f:
            f.write(header(len(points), low.tolist(), high.tolist(), self.offset))
            f.write(points.tobytes())
        return Tile(f"{task.attemptNumber()}-{name}", len(points), low.tolist(), high.tolist())

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.endswith(".las") or old.base_name == "_summary.json":
                    store.delete_file(old.path)
        tiles = [m for m in messages if m is not None and m.count]
        for m in tiles:
            store.move(f"{root}/_tmp-{self.job}/{m.name}", f"{root}/{m.name.split('-', 1)[1]}")
        self._clear(store, root)
        totals = {"points": sum(m.count for m in tiles), "tiles": len(tiles), "low": np.min([m.low for m in tiles], 0).tolist() if tiles else None, "high": np.max([m.high for m in tiles], 0).tolist() if tiles else None}
        with store.open_output_stream(f"{root}/_summary.json") as f:
            f.write(json.dumps(totals).encode())

    def abort(self, messages: list) -> None:
        self._clear(*(fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)))

    def _clear(self, store, root):
        if store.get_file_info(f"{root}/_tmp-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_tmp-{self.job}")


class LasSource(DataSource):
    """format("las"): write only; read_las() reads."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), overwrite)


def write_las(scan: DataFrame, path: str) -> None:
    """scan (x, y, z, SemClassID, MaterialID) as LAS tiles: SemClassID is the instance_id,
    the mapped MaterialID the classification.  Rows with a null or infinite coordinate
    raise; an empty scan has no tiles."""
    spark = scan.sparkSession
    spark.dataSource.register(LasSource)
    low = scan.agg(*[F.min(c) for c in "xyz"]).first()
    rows = scan.select(*[F.col(c).cast("double").alias(c) for c in "xyz"], F.coalesce(F.col("SemClassID"), F.lit(0)).cast("int").alias("instance_id"),
                       F.coalesce(semantic_code(F.col("MaterialID")), F.lit(0)).cast("int").alias("classification"))
    writer = rows.write.format("las").mode("overwrite").option("path", path)
    for k, v in zip("xyz", low):
        writer = writer.option(f"offset_{k}", repr(float(v or 0.0)))
    writer.save()


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z, instance_id, classification of the tiles in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size, start = struct.unpack_from("<HI", data, 94)
                kind, width, count = struct.unpack_from("<BHI", data, 104)
                if data[:4] != b"LASF" or size != HEADER or kind != FORMAT or width != POINT.itemsize:
                    raise ValueError(f"{name} is not of the form written here")
                p = np.frombuffer(data, POINT, count, start)
                scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
                xyz = [pa.array(p[c.upper()] * s + o) for c, s, o in zip("xyz", scale, offset)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * count), *xyz, pa.array(p["instance_id"]), pa.array(p["classification"].astype(np.int32))],
                                                 names=["file", "x", "y", "z", "instance_id", "classification"])

    return files.mapInArrow(run, f"file string, {COLUMNS}")

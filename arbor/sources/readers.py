"""Readers: tree configurations, OBJ meshes, scan tables, cylinder tables."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CYLINDER = ("tree_id long, cyl_id int, sx double, sy double, sz double, ax double, ay double, az double, length double, radius double, "
            "parent_id int, branch_index int, added boolean")
SCAN = "x double, y double, z double, SemClassID int, MaterialID int"
# Foliage parameters of a configuration without its own.
LEAF_DEFAULTS = {"pLADDh": [8.0, 3.0], "pLADDd": [2.0, 1.5], "fun_pLSD": [0.008, 0.00025 ** 2], "totalLeafArea": 20.0}
# The nine-cylinder demonstration tree (start, axis, length, radius, parent, branch).
_S = 0.7071067811865476
EXAMPLE = [
    (1, (0, 0, 0), (0, 0, 1), 1.0, .3, None, 1), (2, (0, 0, 1), (_S, 0, _S), 1.414, .2, 1, 1), (3, (1, 0, 2), (1, 0, 0), 1.0, .1, 2, 1),
    (4, (0, 0, 1), (0, _S, _S), 1.414, .2, 1, 2), (5, (0, 1, 2), (0, 1, 0), 1.0, .1, 4, 2), (6, (0, 0, 1), (0, -_S, _S), 1.414, .2, 1, 3),
    (7, (0, -1, 2), (0, -1, 0), 1.0, .1, 6, 3), (8, (0, 0, 1), (-_S, 0, _S), 1.414, .2, 1, 4), (9, (-1, 0, 2), (-1, 0, 0), 1.0, .1, 8, 4)]


def example_tree(spark: SparkSession) -> DataFrame:
    rows = [(1, i, *map(float, s), *map(float, a), n, r, p, b, False) for i, s, a, n, r, p, b in EXAMPLE]
    return spark.createDataFrame(rows, CYLINDER)


def read_configs(spark: SparkSession, paths: list[str], weights: list[float] | None = None) -> DataFrame:
    """config_id, weight, key, mean, std, text: one row per configuration key; a pair is
    a mean and a deviation, a scalar has deviation 0; unknown keys stay as they are and
    missing foliage parameters take the defaults."""
    w = weights or [1.0] * len(paths)
    if len(w) != len(paths) or any(x < 0 for x in w):
        raise ValueError("one weight of 0 or more for each configuration")
    out = None
    for i, (path, weight) in enumerate(zip(paths, w)):
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))
        num = F.from_json("text", "array<double>")
        one = raw.select(F.lit(i).alias("config_id"), F.lit(float(weight)).alias("weight"), "key",
                         F.when(F.col("text").startswith("["), F.get(num, F.lit(0))).otherwise(F.expr("try_cast(text as double)")).alias("mean"),
                         F.when(F.col("text").startswith("["), F.get(num, F.lit(1))).otherwise(F.lit(0.0)).alias("std"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def leaf_params(configs: DataFrame) -> DataFrame:
    """config_id, leaf_params struct, defaults where missing or not an object."""
    ddl = "pLADDh array<double>, pLADDd array<double>, fun_pLSD array<double>, totalLeafArea double"
    default = F.from_json(F.lit(str(LEAF_DEFAULTS).replace("'", '"')), ddl)
    got = configs.where("key = 'leaf_params' and text like '{%'").select("config_id", F.from_json("text", ddl).alias("p"))
    return (configs.select("config_id").distinct().join(got, "config_id", "left")
            .select("config_id", F.coalesce("p", default).alias("leaf_params")))


def read_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A scan table; the header must name every required column."""
    raw = spark.read.csv(paths, header=True)
    want = StructType.fromDDL(SCAN)
    if missing := [f.name for f in want if f.name not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in want], F.input_file_name().alias("file"))


def numbered_lines(spark: SparkSession, path: str | list[str], as_one: bool = False) -> DataFrame:
    """file, line (from 0), text of text files that are read in splits: lines are counted
    within each split, and a split begins where the counts of those before it in its file
    end (one row a split).  as_one numbers all files through, in the order of their names,
    as part files of one text."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def run(batches):
        at, count = None, 0
        for b in batches:
            files, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
            line = []
            for key in zip(files, blocks):
                at, count = (at, count + 1) if key == at else (key, 0)
                line.append(count)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(line, pa.int64())], names=["file", "block", "text", "line"])

    lines = raw.mapInArrow(run, "file string, block long, text string, line long")
    ends = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*([] if as_one else ["file"])).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(before), ["file", "block"]).select("file", (F.col("line") + F.col("before")).alias("line"), "text")


def read_obj(spark: SparkSession, path: str | list[str], as_one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices: file, line, x, y, z; faces: file, line, corners) of OBJ files; line is
    the place in the file, which numbers vertices in order.  Large files are read in
    splits; as_one takes part files of one mesh (numbered_lines)."""
    lines = numbered_lines(spark, path, as_one).withColumn("p", F.split(F.trim("text"), r"\s+"))
    number = lambda i: F.get("p", F.lit(i)).cast("double")
    v = lines.where(F.get("p", F.lit(0)) == "v").select("file", "line", number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    f = lines.where(F.get("p", F.lit(0)) == "f").select(
        "file", "line", F.transform(F.slice("p", F.lit(2), F.size("p")), lambda s: F.split(s, "/")[0].cast("int")).alias("corners"))
    return v, f


#: Columns of the older cell table, numbered from 1.
LEGACY = {"radius": 1, "length": 2, "sx": 3, "sy": 4, "sz": 5, "ax": 6, "ay": 7, "az": 8, "parent_id": 9, "branch_index": 11, "added": 14}


def cylinder_table(df: DataFrame) -> DataFrame:
    """The cylinder schema from any of four forms: nested (qsm.cylinder or cylinder),
    legacy rows (values: array of 14 numbers), columns of vectors (start, axis as arrays),
    or the flat schema itself; parent 0 means none.  Missing fields raise ValueError."""
    if "qsm" in df.columns:
        df = df.select(*[c for c in df.columns if c != "qsm"], "qsm.*")
    if "cylinder" in df.columns:
        df = df.select(*[c for c in df.columns if c != "cylinder"], "cylinder.*")
    if "values" in df.columns:
        df = df.select("tree_id", "cyl_id", *[F.get("values", F.lit(k - 1)).alias(c) for c, k in LEGACY.items()])
    for name, short in (("start", "s"), ("axis", "a")):
        if name in df.columns:
            df = df.select(*[c for c in df.columns if c != name], *[F.get(name, F.lit(i)).alias(f"{short}{c}") for i, c in enumerate("xyz")])
    want = StructType.fromDDL(CYLINDER)
    if missing := [f.name for f in want if f.name not in df.columns]:
        raise ValueError(f"missing fields: {missing}")
    return df.select(*[F.when(F.col(f.name) != 0, F.col(f.name)).cast(f.dataType).alias(f.name) if f.name == "parent_id" else F.col(f.name).cast(f.dataType) for f in want])


def single_cylinder(spark: SparkSession, length: float = 0.5, radius: float = 0.025) -> DataFrame:
    """One upright cylinder, to preview leaves on."""
    return spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, float(length), float(radius), None, 1, False)], CYLINDER)

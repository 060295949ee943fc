"""Poisson-disk placement with variable radii as a parallel maximal independent set."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import config_value, pair_spacing
from ..plans.stage import cut
from .lookup import weighted_choice
from .spatial import radius_pairs, terrain_height


def candidates(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, spacing: float, tries: int = 30, seed: int = 1) -> DataFrame:
    """cand_id, x, y: so many keyed uniform points in each square of the spacing, in the
    bounds (borders count)."""
    nx, ny = max(1, int(-(-(x1 - x0) // spacing))), max(1, int(-(-(y1 - y0) // spacing)))
    ids = spark.range(nx * ny * tries).withColumnRenamed("id", "cand_id")
    square = F.floor(F.col("cand_id") / tries)
    x = x0 + (square % nx + rng.uniform(seed, 0, "cand_id")) * spacing
    y = y0 + (F.floor(square / nx) + rng.uniform(seed, 1, "cand_id")) * spacing
    return ids.select("cand_id", x.alias("x"), y.alias("y")).where((F.col("x") <= x1) & (F.col("y") <= y1))


def assign_configs(points: DataFrame, configs: list[dict], weights: list[float], seed: int = 2) -> DataFrame:
    """Adds config_id and crown_width, drawn from mean and deviation of the chosen one."""
    k = weighted_choice(rng.uniform(seed, 0, "cand_id"), weights)
    width = F.lit(None).cast("double")
    for i, c in enumerate(configs):
        m, s = c.get("crown_width", (None, 0.0))
        if m is not None:
            width = F.when(F.col("config_id") == i, config_value("crown_width", F.lit(float(m)), F.lit(float(s)), rng.normal(seed, 1, "cand_id"))).otherwise(width)
    return points.withColumn("config_id", k).withColumn("crown_width", width)


def independent(points: DataFrame, most_width: float, seed: int = 3, rounds: int = 50) -> DataFrame:
    """A maximal subset in which every pair is farther apart, in three dimensions, than
    its pair spacing; points: cand_id, x, y, z, crown_width.  Each round accepts what
    has the least key among its undecided rivals and drops the rivals."""
    p = points.withColumn("key", rng.uniform(seed, 0, "cand_id"))
    reach = most_width * 0.7 if most_width > 0 else 0.7
    near = radius_pairs(p, p, reach).where(F.col("cand_id") != F.col("b_cand_id"))
    rivals = cut(near.where(F.sqrt("d2") <= pair_spacing(F.col("crown_width"), F.col("b_crown_width")))
                 .select("cand_id", "key", F.col("b_cand_id").alias("rival"), F.col("b_key").alias("rival_key")))
    open_ = cut(p.select("cand_id"))
    chosen = None
    for _ in range(rounds):
        live = rivals.join(open_, "cand_id", "left_semi").join(open_.select(F.col("cand_id").alias("rival")), "rival", "left_semi")
        beaten = live.where((F.col("rival_key") < F.col("key")) | (F.col("rival_key") == F.col("key")) & (F.col("rival") < F.col("cand_id"))).select("cand_id").distinct()
        won = cut(open_.join(beaten, "cand_id", "left_anti"))
        chosen = won if chosen is None else cut(chosen.unionByName(won))
        gone = live.join(won, "cand_id", "left_semi").select(F.col("rival").alias("cand_id")).distinct()
        open_ = cut(open_.join(won, "cand_id", "left_anti").join(gone, "cand_id", "left_anti"))
        if open_.isEmpty():
            return points.join(chosen, "cand_id", "left_semi")
    raise ValueError("placement did not settle")


def place(spark: SparkSession, terrain: DataFrame, configs: list[dict], weights: list[float], tries: int = 30, seed: int = 1, max_trees: int | None = None) -> DataFrame:
    """Trees on a terrain (tri_id, ax..cz): cand_id, x, y, z, config_id, crown_width."""
    b = terrain.agg(F.min(F.least("ax", "bx", "cx")), F.min(F.least("ay", "by", "cy")), F.max(F.greatest("ax", "bx", "cx")), F.max(F.greatest("ay", "by", "cy"))).first()
    widths = [c["crown_width"][0] + 4 * c["crown_width"][1] if "crown_width" in c else 1.0 for c in configs]
    least = min((c["crown_width"][0] if "crown_width" in c else 1.0) for c in configs)
    pool = candidates(spark, *b, spacing=0.7 * least, tries=tries, seed=seed) if b[0] is not None else spark.createDataFrame([], "cand_id long, x double, y double")
    p = assign_configs(pool, configs, weights, seed + 1).where(F.coalesce("crown_width", F.lit(1.0)) <= max(widths))
    on = p.join(terrain_height(p, terrain, "cand_id", max(max(widths), 1.0)), "cand_id")
    out = independent(cut(on), max(widths), seed + 2)
    return out if max_trees is None else out.orderBy("cand_id").limit(max_trees)

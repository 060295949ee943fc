"""Samplers by rejection, by low-discrepancy sequences and by counts."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import densities, rng
from ..functions.scalars import beta_density, polynomial_density, von_mises_density, weibull_density
from ..plans.stage import cut
from .spatial import inside_mesh


def accepted(x: Column, u: Column, density, most: float) -> Column:
    """Whether rejection takes x: u times the density's upper bound is below the density."""
    return u * most < density(x)


def by_rejection(rows: DataFrame, kind: str, p: list[float], keys: list[str], out: str = "x", seed: int = 21, rounds: int = 8, tries: int = 16) -> DataFrame:
    """rows with a draw of the density in column out, by rejection below its upper bound:
    each round looks at so many keyed proposals a row and takes the first below the
    density; what none hit goes to the next round.  Rows still without a draw then (fewer
    than one in 10^5 at a bound of 10) take the last proposal.  Densities of kind
    densities.density(); keys name a row."""
    shape = {"beta": lambda x: beta_density(x, *p[:2]), "weibull": lambda x: weibull_density(x, tuple(p[:2])), "vonmises": lambda x: von_mises_density(x, *p[:2]), "polynomial": lambda x: polynomial_density(x, p)}
    pure = kind.removesuffix("mixture")
    if kind.endswith("mixture"):
        # weights of the unnormalised halves
        c = [densities.density(pure, q)(0.37)[()] / _plain(pure, q, 0.37) for q in (p[:2], p[2:4])]
        two = {"beta": lambda x, q: beta_density(x, *q), "weibull": lambda x, q: weibull_density(x, tuple(q)), "vonmises": lambda x, q: von_mises_density(x, *q)}[pure]
        value = lambda x: p[4] * c[0] * two(x, p[:2]) + (1 - p[4]) * c[1] * two(x, p[2:4])
    else:
        scale = 1.0 if kind == "polynomial" else float(densities.density(kind, p)(0.37)[()] / _plain(kind, p, 0.37))
        value = lambda x: scale * shape[kind](x)
    most, high = densities.upper_bound(kind, p), densities.UPPER.get(kind, 1.0)
    left, done = rows, None
    for r in range(rounds):
        proposal = lambda k: rng.uniform(seed, k + r * tries * 2, *keys) * high  # noqa: E731, B023
        hit = F.filter(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: accepted(proposal(k * 2), rng.uniform(seed, k * 2 + 1 + r * tries * 2, *keys), value, most))  # noqa: B023
        at = cut(left.withColumn("_hit", F.get(hit, F.lit(0))), "rejection")
        got = at.where("_hit is not null").select(*rows.columns, proposal(F.col("_hit") * 2).alias(out))
        done = got if done is None else done.unionByName(got)
        left = at.where("_hit is null").drop("_hit")
        if left.isEmpty():
            return done
    return done.unionByName(left.withColumn(out, proposal(F.lit(0))))


def _plain(kind: str, p: list[float], x: float) -> float:
    """The density without its constant, as the Column forms have it."""
    if kind == "beta":
        return x ** (p[0] - 1) * (1 - x) ** (p[1] - 1)
    if kind == "weibull":
        return (x / p[0]) ** (p[1] - 1) * math.exp(-((x / p[0]) ** p[1]))
    return math.exp(p[1] * (math.cos(x - p[0]) - 1))


def petiole_turns(rows: DataFrame, density, keys: list[str], seed: int = 22, rounds: int = 1000) -> DataFrame:
    """rows (length, radius, inclination, azimuth of their cylinder) with turn, in [0, 2 pi),
    drawn from density(phi, length, radius, inclination, azimuth), a function of numpy
    arrays that broadcast: proposals in rounds, below the greatest value on a grid of
    thousandths and a tenth.  Draws are functions of seed, keys and round.  A density that
    takes none of so many proposals, or is negative or not finite on the grid, raises."""
    grid = np.arange(0, 2 * math.pi, 0.001)
    schema = StructType(rows.schema.fields + StructType.fromDDL("turn double").fields)
    names = rows.columns

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53

    def run(batches):
        for b in batches:
            key = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
            shape = np.stack([b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("length", "radius", "inclination", "azimuth")], 1)
            forms, of = np.unique(shape, axis=0, return_inverse=True)
            most = np.empty(len(forms))
            for i, form in enumerate(forms):
                y = np.broadcast_to(np.asarray(density(grid, *form), float), grid.shape)
                if not np.isfinite(y).all() or (y < 0).any():
                    raise ValueError("a petiole density must be finite and nowhere negative")
                most[i] = y.max() + 0.1
            turn, left = np.full(b.num_rows, np.nan), np.arange(b.num_rows)
            for r in range(rounds):
                if not len(left):
                    break
                phi = mixed(key[left] + np.uint64(2 * r)) * 2 * math.pi
                ok = mixed(key[left] + np.uint64(2 * r + 1)) * most[of.ravel()[left]] < density(phi, *shape[left].T)
                turn[left[ok]] = phi[ok]
                left = left[~ok]
            if len(left):
                raise ValueError("a petiole density takes no proposals")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(turn)], names=[*names, "turn"])

    return rows.withColumn("_key", F.xxhash64(*keys, F.lit(seed))).mapInArrow(run, schema)


def in_ellipsoid(u: Column, v: Column, w: Column, a: float, b: float, c: float) -> tuple[tuple[Column, Column, Column], Column]:
    """A point of the box around an ellipsoid, from three uniforms, and whether it lies in
    the ellipsoid."""
    p = tuple((2 * t - 1) * r for t, r in zip((u, v, w), (a, b, c)))
    return p, sum((x / r) * (x / r) for x, r in zip(p, (a, b, c))) <= 1


def halton_in_mesh(spark: SparkSession, n: int, tri: DataFrame, low: tuple, high: tuple, edge: float) -> DataFrame:
    """marker, x, y, z: of the first n Halton points (bases 2, 3, 5) of a box those in the
    closed mesh; none where more than 200 give less than one in a hundred."""
    i = F.col("marker")
    at = [F.lit(float(a)) + rng.halton(i, base) * float(b - a) for a, b, base in zip(low, high, (2, 3, 5))]
    p = spark.range(1, n + 1).withColumnRenamed("id", "marker").select("marker", *[c.alias(k) for c, k in zip(at, "xyz")])
    hits = p.join(inside_mesh(p, tri, "marker", edge), "marker", "left_semi")
    found = hits.agg(F.count("*").alias("found"))
    return hits.join(F.broadcast(found)).where((F.lit(n) <= 200) | (F.col("found") * 100 >= n)).drop("found")


def thinned(markers: DataFrame, shade: Column, u: Column) -> DataFrame:
    """Markers left by shadow: one in full shade (1) never stays, one in the light does."""
    return markers.where(u >= shade)


def poisson_table(mean: float) -> list[float]:
    """Distribution function of the Poisson law at 0, 1, 2, ... until it is 1 in doubles."""
    p, total, out = math.exp(-mean), 0.0, []
    while not out or total < 1.0 - 1e-15 and len(out) < 1000 + 10 * mean:
        total += p
        out.append(total)
        p *= mean / len(out)
    return out


def arrivals(entities: DataFrame, rate: float, horizon: float, u: Column, time) -> DataFrame:
    """One row (arrival, at) for each arrival of a Poisson process with so many arrivals
    per 1000 units of time on every entity: the count by its distribution function at u,
    the times as uniforms time(arrival), which given the count they are."""
    table = F.array(*[F.lit(v) for v in poisson_table(rate * horizon / 1000)])
    count = F.size(F.filter(table, lambda t: t < u))
    d = entities.withColumn("_n", count).where("_n > 0").withColumn("arrival", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return d.withColumn("at", time(F.col("arrival")) * horizon).drop("_n")

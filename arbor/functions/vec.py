"""3-vector algebra as Column expressions.  A vector is a tuple of three Columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x, y, z) -> Vec:
    return tuple(F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))


def cols(prefix: str) -> Vec:
    """The columns prefix + x, y, z."""
    return vec(f"{prefix}x", f"{prefix}y", f"{prefix}z")


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """Direction of a; null for the zero vector."""
    n = norm(a)
    return tuple(F.when(n > 0, p / n) for p in a)


def named(a: Vec, prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{k}") for c, k in zip(a, "xyz")]


def rotate(v: Vec, axis: Vec, angle: Column) -> Vec:
    """v turned about the unit axis by angle radians (Rodrigues)."""
    c, s = F.cos(angle), F.sin(angle)
    w, d = cross(axis, v), dot(axis, v) * (1 - c)
    return tuple(v[i] * c + w[i] * s + axis[i] * d for i in range(3))


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def arccos(x: Column) -> Column:
    """Angle of a cosine that rounding may have left a little outside [-1, 1]."""
    return F.when(x.isNotNull(), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))))


def with_segment_distance2(df: DataFrame, p0: Vec, p1: Vec, q0: Vec, q1: Vec, out: str = "d2", eps: float = 1e-12) -> DataFrame:
    """Adds the squared least distance of two segments, points included.

    The unconstrained minimum over both parameters is clamped to the first segment, the
    second parameter follows and is clamped, and the first is solved again for it.  Each
    step is a column of its own, so that no expression is repeated in the next."""
    u, v, w = sub(p1, p0), sub(q1, q0), sub(p0, q0)
    parts = {"uu": dot(u, u), "uv": dot(u, v), "vv": dot(v, v), "uw": dot(u, w), "vw": dot(v, w), "ww": dot(w, w)}
    d = df.select("*", *[c.alias(f"_{k}") for k, c in parts.items()])
    a, b, c, e, f, g = (F.col(f"_{k}") for k in parts)
    den = a * c - b * b
    d = d.withColumn("_s", F.when(den > eps, clamp01((b * f - c * e) / den)).otherwise(F.lit(0.0)))
    d = d.withColumn("_t", F.when(c > eps, clamp01((b * F.col("_s") + f) / c)).otherwise(F.lit(0.0)))
    d = d.withColumn("_s", F.when(a > eps, clamp01((b * F.col("_t") - e) / a)).otherwise(F.lit(0.0)))
    s, t = F.col("_s"), F.col("_t")
    # |w + s u - t v|^2, which rounding may leave a little below zero
    far = g + s * s * a + t * t * c + 2 * s * e - 2 * t * f - 2 * s * t * b
    return d.withColumn(out, F.greatest(F.lit(0.0), far)).drop(*[f"_{k}" for k in parts], "_s", "_t")


def with_segment_parts(df: DataFrame) -> DataFrame:
    """Adds mid and half_len of the segment p0-p1."""
    p0, p1 = cols("p0"), cols("p1")
    return df.select("*", *named(scale(add(p0, p1), 0.5), "mid"), (norm(sub(p1, p0)) / 2).alias("half_len"))

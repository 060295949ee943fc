"""Scalar formulas of trees and leaves as Column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec, arccos, cross

# Names of configuration keys by how a drawn value is limited.
INTEGER_KEYS = ("numberOfEndpoints", "maxIterations")
POSITIVE_KEYS = ("interNodeLength", "influenceRange", "trunk_radius", "stem_height", "stem_diameter", "crown_width", "crown_height", "surface_bias", "top_bias")
# Semantic classes of a scan and what they become.
SEMANTIC_CODES = {1: 0, 2: 1, 10: 2}


def config_value(key: str, mean: Column, std: Column, z: Column) -> Column:
    """A drawn configuration value: mean + max(std, 0) z, limited by the key's kind."""
    v = mean + F.greatest(std, F.lit(0.0)) * z
    if key in INTEGER_KEYS:
        return F.greatest(F.lit(1.0), F.round(v))
    return F.greatest(F.lit(1e-8), v) if key in POSITIVE_KEYS else v


def pair_spacing(a: Column, b: Column) -> Column:
    """Least distance of two trees with crown widths a and b (1 if missing)."""
    a, b = F.coalesce(a, F.lit(1.0)), F.coalesce(b, F.lit(1.0))
    return F.greatest(a, b) / 2 + 0.2 * F.least(a, b)


def annulus(x: Column, y: Column, radius: Column, u: Column, v: Column) -> tuple[Column, Column]:
    r, a = radius * (1 + u), 2 * math.pi * v
    return x + r * F.cos(a), y + r * F.sin(a)


def expected_height(stem: Column, crown: Column, offset: Column) -> Column:
    return stem + crown - offset


def scaled_radius(r: Column, actual: Column, expected: Column) -> Column:
    return F.when((actual > 0) & (expected > 0), r * F.pow(actual / expected, F.lit(0.75))).otherwise(r)


def leaf_area(r: Column, height: Column) -> Column:
    """Allometric leaf area of a tree of trunk radius r."""
    return 0.2 * F.pow(2 * r, F.lit(2.2)) * F.pow(height, F.lit(0.5)) * 100


def suppressed(control: Column, factor: Column, falloff: Column, u: Column) -> Column:
    """Whether apical control keeps a shoot from growing."""
    p = 1 - factor * control
    return F.when(control <= 0, F.lit(False)).when(p <= 0, F.lit(True)).otherwise(u > F.pow(p, falloff))


def apical_control(c0: Column, t0: Column, generation: Column) -> Column:
    return F.when(t0 > 0, F.greatest(F.lit(0.0), c0 * (1 - generation / t0))).otherwise(c0)


def semantic_code(c: Column) -> Column:
    out = c
    for k, v in SEMANTIC_CODES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def compass(dx: Column, dy: Column, still: float = 0.0) -> Column:
    """Angle of (dx, dy) from +y, in [0, 2 pi); north where no longer than still."""
    n = F.sqrt(dx * dx + dy * dy)
    a = arccos(dy / n)
    return F.when(n <= still, F.lit(0.0)).when(dx > 0, 2 * math.pi - a).otherwise(a)


def inclination(az: Column) -> Column:
    return arccos(az)


def axis_azimuth(ax: Column, ay: Column, az: Column) -> Column:
    """Compass of an axis; 0 where it is vertical, up or down."""
    return F.when(F.abs(az) > 0.999, F.lit(0.0)).otherwise(compass(ax, ay))


def leaf_normal(inc: Column, azimuth: Column) -> Vec:
    a = azimuth + math.pi / 2
    return F.sin(inc) * F.cos(a), F.sin(inc) * F.sin(a), F.cos(inc)


def upward(n: Vec) -> Vec:
    return tuple(F.when(n[2] < 0, -c).otherwise(c) for c in n)


def leaf_vertex(base: tuple[float, float, float], size: Vec, direction: Vec, normal: Vec, origin: Vec) -> Vec:
    """Where a vertex of the base shape lies: x along normal x dir, y along dir, z along normal."""
    side = cross(normal, direction)
    s = [base[i] * size[i] for i in range(3)]
    return tuple(s[0] * side[i] + s[1] * direction[i] + s[2] * normal[i] + origin[i] for i in range(3))


def colour_index(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.round(255 * (value - low) / (high - low))).otherwise(F.lit(0.0)).cast("int")


# densities over [0, 1] or an angle, up to a constant factor

def beta_density(x: Column, a: float, b: float) -> Column:
    return F.pow(x, F.lit(a - 1.0)) * F.pow(1 - x, F.lit(b - 1.0))


def weibull_density(x: Column, shape_scale: tuple[float, float]) -> Column:
    lam, k = shape_scale
    return F.pow(x / lam, F.lit(k - 1.0)) * F.exp(-F.pow(x / lam, F.lit(float(k))))


def von_mises_density(angle: Column, mean: float, kappa: float) -> Column:
    return F.exp(F.lit(float(kappa)) * (F.cos(angle - mean) - 1))


def de_wit_density(inc: Column, a: float, b: float) -> Column:
    return 1 + a * F.cos(b * inc)


def polynomial_density(x: Column, coefficients: list[float]) -> Column:
    """Coefficients from the highest power; negative values count as zero."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return F.greatest(F.lit(0.0), out)


def mixture(p: Column, q: Column, weight: float) -> Column:
    return weight * p + (1 - weight) * q


# crown volumes: three uniforms to a point

def ellipsoid_point(u: Column, v: Column, w: Column, rx: float, rz: float, surface: float, top: float) -> Vec:
    phi, theta = 2 * math.pi * u, math.pi * (v - 0.5)
    r = F.pow(w, F.lit(1.0 / surface))
    z = F.pow((F.sin(theta) + 1) / 2, F.lit(1.0 / top)) * 2 - 1
    return rx * r * F.cos(phi) * F.cos(theta), rx * r * F.sin(phi) * F.cos(theta), rz * r * z + rz


def cylinder_point(u: Column, v: Column, w: Column, radius: float, height: float, surface: float, top: float) -> Vec:
    phi, r = 2 * math.pi * u, radius * F.pow(v, F.lit(1.0 / surface))
    return r * F.cos(phi), r * F.sin(phi), height * F.pow(w, F.lit(1.0 / top))


def hemisphere_point(u: Column, v: Column, w: Column, radius: float, surface: float, top: float, down: bool = False) -> Vec:
    phi, theta = 2 * math.pi * u, F.pow(v, F.lit(1.0 / top)) * (math.pi / 2)
    r = radius * F.pow(w, F.lit(1.0 / surface))
    z = r * F.sin(theta)
    return r * F.cos(theta) * F.cos(phi), r * F.cos(theta) * F.sin(phi), -z if down else z


"""Checks of parameters before a job starts, and of rows within one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of parameters of each density.
DENSITIES = {"uniform": 0, "polynomial": None, "beta": 2, "weibull": 2, "betamixture": 5, "weibullmixture": 5, "vonmises": 2, "dewit": 2, "spherical": 0, "constant": 1}
MIXTURES = {"betamixture", "weibullmixture"}


def fail(what: str) -> None:
    raise ValueError(what)


def density(kind: str, p: list[float]) -> None:
    """A density's kind and parameters: how many, positive where they must be, a weight in
    [0, 1], a polynomial nowhere negative on a grid of thousandths."""
    if kind not in DENSITIES:
        fail(f"unknown density {kind}")
    n = DENSITIES[kind]
    if n is not None and len(p) != n or n is None and not p:
        fail(f"{kind} takes {n or 'one or more'} parameters")
    if any(not isinstance(v, (int, float)) or v != v for v in p):
        fail(f"{kind} takes numbers")
    if kind in {"beta", "weibull"} | MIXTURES and any(v <= 0 for v in p[:4]):
        fail(f"{kind} takes positive parameters")
    if kind in MIXTURES and not 0 <= p[4] <= 1:
        fail("a mixture's weight lies in [0, 1]")
    if kind == "polynomial":
        value = lambda x: sum(c * x ** k for k, c in enumerate(reversed(p)))
        if any(value(i / 1000) < 0 for i in range(1001)):
            fail("a density is nowhere negative")


def nodes(values: list[float], low: float | None = None, high: float | None = None) -> None:
    """A node grid ascends strictly within its bounds."""
    if not values or any(b <= a for a, b in zip(values, values[1:])):
        fail("nodes must ascend")
    if low is not None and values[0] < low or high is not None and values[-1] > high:
        fail("nodes lie outside their bounds")


def positive(**named: float) -> None:
    for name, v in named.items():
        if not isinstance(v, (int, float)) or not v > 0:
            fail(f"{name} must be positive")


def direct(p: dict) -> dict:
    """The parameters of the direct foliage driver, checked."""
    for key in ("height", "distance", "direction"):
        density(*p[key])
    positive(total_area=p["total_area"], base_area=p["base_area"])
    low, high = p.get("petiole", (0.0, 0.0))
    if not 0 <= low <= high:
        fail("petiole lengths ascend from 0")
    if p.get("size_kind", "uniform") not in ("uniform", "normal", "constant"):
        fail("unknown size distribution")
    return p


def library(p: dict) -> dict:
    """The parameters of the leaf-cylinder library, checked."""
    for values in p["nodes"].values():
        nodes(values)
    positive(base_area=p["base_area"], replicates=p.get("replicates", 3))
    return p


def hull(p: dict) -> dict:
    """The parameters of foliage in a point cloud's hull, checked."""
    for key in ("height", "direction", "distance"):
        if key in p:
            density(*p[key])
    positive(voxel=p["voxel"], leaves=p["leaves"])
    if not 0 <= p.get("cloud_share", 0.0) <= 1:
        fail("the share of the cloud lies in [0, 1]")
    return p


def required(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, unchanged; a row that breaks a rule stops the job and names it."""
    for name, rule in rules.items():
        first = df.columns[0]
        df = df.withColumn(first, F.when(F.coalesce(rule, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(f"a row breaks the rule {name}"))))
    return df

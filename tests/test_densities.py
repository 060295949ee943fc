"""Upper bounds of densities, and draws below them."""
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbor.functions import densities
from arbor.operators import sampling

CASES = [("beta", [2.0, 3.0]), ("beta", [8.0, 3.0]), ("beta", [1.0, 1.0]), ("beta", [1.0, 3.0]), ("beta", [3.0, 1.0]), ("weibull", [.6, 1.5]), ("weibull", [2.0, 1.5]), ("vonmises", [1.0, 2.0]),
         ("polynomial", [-1.0, 1.0, .2]), ("polynomial", [3.0, -4.0, 1.5]), ("betamixture", [2.0, 8.0, 9.0, 2.0, .4]), ("weibullmixture", [.3, 2.0, .9, 4.0, .3]), ("vonmisesmixture", [1.0, 3.0, 4.0, 8.0, .5])]


@pytest.mark.parametrize("kind,p", CASES)
def test_bounds_are_reached_and_not_passed(kind, p):
    high = densities.UPPER.get(kind, 1.0)
    x = np.linspace(0, high, 200_001)
    y = densities.density(kind, p)(x)
    assert densities.upper_bound(kind, p) == pytest.approx(y.max(), rel=1e-6)
    if kind != "polynomial":
        assert ((y[1:] + y[:-1]) / 2).sum() * high / 200_000 == pytest.approx(1.0, abs=1e-4)


def test_infinite_ends_are_capped():
    assert densities.upper_bound("beta", [.5, .5]) == densities.upper_bound("beta", [.5, 3.0]) == 10.0
    assert densities.upper_bound("weibull", [1.0, .5]) == 5.0
    assert densities.upper_bound("betamixture", [.2, 2.0, 2.0, 2.0, .9]) == 10.0
    with pytest.raises(ValueError):
        densities.upper_bound("cauchy", [1.0])


@pytest.mark.parametrize("kind,p", [CASES[0], CASES[5], CASES[8], CASES[10], CASES[12]])
def test_rejection_draws_the_density(spark, kind, p):
    n, high = 12_000, densities.UPPER.get(kind, 1.0)
    rows = spark.range(n).withColumnRenamed("id", "k")
    got = sampling.by_rejection(rows, kind, p, ["k"]).collect()
    assert len({r.k for r in got}) == len(got) == n
    f = densities.density(kind, p)
    x = np.linspace(0, high, 4001)
    y = f(x)
    mass = [y[i * 400:i * 400 + 401].sum() for i in range(10)]
    seen = Counter(min(9, int(r.x / high * 10)) for r in got)
    assert all(abs(seen[i] / n - mass[i] / sum(mass)) < .02 for i in range(10))
    assert sorted(got) == sorted(sampling.by_rejection(rows.repartition(5), kind, p, ["k"]).collect())


def test_petiole_density_is_a_function_of_the_cylinder(spark):
    rows = spark.range(8000).select(F.col("id").alias("leaf"), F.when(F.col("id") % 2 == 0, .1).otherwise(.4).alias("length"), F.lit(.02).alias("radius"), F.lit(1.0).alias("inclination"), F.lit(2.0).alias("azimuth"))
    upward = lambda phi, length, radius, inc, az: np.where(np.asarray(length) > .2, 1 + np.cos(phi), 1.0 + 0 * phi)
    got = sampling.petiole_turns(rows, upward, ["leaf"]).collect()
    long, short = ([r.turn for r in got if (r.length > .2) == side] for side in (True, False))
    assert all(0 <= t < 2 * math.pi for t in long + short) and len(long) == len(short) == 4000
    assert np.mean(np.cos(long)) == pytest.approx(.5, abs=.03) and np.mean(np.cos(short)) == pytest.approx(0, abs=.03)
    assert sorted(got) == sorted(sampling.petiole_turns(rows.repartition(3), upward, ["leaf"]).collect())
    with pytest.raises(Exception, match="nowhere negative"):
        sampling.petiole_turns(rows, lambda phi, *_: np.cos(phi), ["leaf"]).collect()
    assert sampling.petiole_turns(rows.limit(0), upward, ["leaf"]).collect() == []


def test_direct_foliage_takes_a_petiole_density(spark):
    """Leaves of a level cylinder that all leave it on the upper side."""
    from arbor.operators import foliage

    cyl = spark.createDataFrame([(1, 1, 0, 0., 0., 1., 1., 0., 0., 2.0, .1)], "tree_id long, cyl_id long, branch_index long, sx double, sy double, sz double, ax double, ay double, az double, length double, radius double")
    masses = ([.1] * 10, [.1] * 10, [.1] * 10)
    up = lambda phi, length, radius, inc, az: (np.cos(phi) > .5) * 1.0
    got = foliage.direct(cyl, masses, 1.0, .004, ("uniform", (.8, 1.2)), ("spherical", "uniform", (), ()), petiole_density=up).collect()
    assert len(got) > 100 and all(r.sz > 1 + .1 * .5 - 1e-9 for r in got)
    assert all(r.dx is not None for r in got)


def test_petioles_along_the_normal_are_turned_on(spark):
    from arbor.operators import foliage

    rows = spark.createDataFrame([(1., 0., 0., 0., 0., 1., 0., 0., 0., 1.0, .1), (1., 0., 0., 0., 0., -1., 0., 0., 0., 1.0, .1)], "ax double, ay double, az double, nx double, ny double, nz double, sx double, sy double, sz double, length double, radius double")
    for r in foliage.with_petiole(rows, F.lit(.5), F.lit(0.), F.lit(.1)).collect():
        d, n = np.array([r.dx, r.dy, r.dz]), np.array([r.nx, r.ny, r.nz])
        assert np.linalg.norm(d) == pytest.approx(1) and d @ n == pytest.approx(0, abs=1e-12)

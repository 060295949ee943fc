"""Densities with their normalisation, and upper bounds for rejection sampling.

Kinds and parameters: beta (a, b) and weibull (scale, shape; cut at 1) on [0, 1],
polynomial (coefficients from the highest power) on [0, 1], vonmises (mean, kappa) on
[0, 2 pi], and their mixtures of two with a weight: betamixture, weibullmixture,
vonmisesmixture (p1, q1, p2, q2, weight)."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

# Bounds of densities that are infinite at an end, and how near it they are looked at.
MOST_BETA, MOST_WEIBULL, NEAR = 10.0, 5.0, 0.001
UPPER = {"vonmises": 2 * math.pi, "vonmisesmixture": 2 * math.pi}


def _beta(x, a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * x ** (a - 1) * (1 - x) ** (b - 1)


def _weibull(x, scale, shape):
    with np.errstate(divide="ignore", invalid="ignore"):
        return shape / scale * (x / scale) ** (shape - 1) * np.exp(-((x / scale) ** shape)) / (1 - math.exp(-((1 / scale) ** shape)))


def _vonmises(x, mean, kappa):
    return np.exp(kappa * (np.cos(x - mean) - 1)) / (2 * math.pi * np.i0(kappa) * math.exp(-kappa))


_PLAIN = {"beta": _beta, "weibull": _weibull, "vonmises": _vonmises}


def density(kind: str, p: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    if kind == "polynomial":
        return lambda x: np.polyval(p, x)
    if kind in _PLAIN:
        return lambda x: _PLAIN[kind](np.asarray(x, float), *p)
    f = _PLAIN.get(kind.removesuffix("mixture"))
    if f is None or not kind.endswith("mixture"):
        raise ValueError(f"unknown density {kind}")
    return lambda x: p[4] * f(np.asarray(x, float), p[0], p[1]) + (1 - p[4]) * f(np.asarray(x, float), p[2], p[3])


def greatest(f: Callable, low: float, high: float, steps: int = 512, rounds: int = 60) -> tuple[float, float]:
    """Where f is greatest between the bounds, and its value there: the best of even steps,
    then thirds of the stretch around it that keep the greater side."""
    x = np.linspace(low, high, steps + 1)[1:-1]
    k = int(np.argmax(f(x)))
    a, b = x[k] - (high - low) / steps, x[k] + (high - low) / steps
    for _ in range(rounds):
        c, d = a + (b - a) / 3, b - (b - a) / 3
        a, b = (c, b) if f(np.array([c]))[0] < f(np.array([d]))[0] else (a, d)
    at = (a + b) / 2
    return at, float(f(np.array([at]))[0])


def upper_bound(kind: str, p: list[float]) -> float:
    """A bound of the density over its interval: at its modes, or capped where it is
    infinite at an end."""
    f = density(kind, p)
    at = lambda x: float(f(np.array([float(x)]))[0])
    if kind == "polynomial":
        roots = np.roots(np.polyder(p)) if len(p) > 1 else np.zeros(0)  # of the companion matrix
        real = roots[np.abs(roots.imag) < 1e-9].real
        return max(at(x) for x in [0.0, 1.0, *real[(real >= 0) & (real <= 1)]])
    if kind == "beta":
        a, b = p
        if a > 1 and b > 1:
            return min(at((a - 1) / (a + b - 2)), MOST_BETA)
        if a < 1 or b < 1:  # infinite at an end
            return MOST_BETA
        return min(max(at(0), at(1)), MOST_BETA)  # flat, or falling or rising to a finite end
    if kind == "weibull":
        scale, shape = p
        if shape <= 1:
            return min(at(NEAR), MOST_WEIBULL)
        return at(min(scale * ((shape - 1) / shape) ** (1 / shape), 1.0))
    if kind == "vonmises":
        return at(p[0])
    if kind == "betamixture":
        where, found = greatest(f, 0.0, 1.0)
        modes = [(a - 1) / (a + b - 2) for a, b in ((p[0], p[1]), (p[2], p[3])) if a > 1 and b > 1]
        return max([found if NEAR < where < 1 - NEAR else 0.0, min(at(NEAR), MOST_BETA), min(at(1 - NEAR), MOST_BETA), *[at(m) for m in modes]])
    if kind == "weibullmixture":
        if p[1] <= 1 or p[3] <= 1:
            return max(min(at(NEAR), MOST_WEIBULL), greatest(f, NEAR, 1.0)[1])
        modes = [s * ((k - 1) / k) ** (1 / k) for s, k in ((p[0], p[1]), (p[2], p[3]))]
        return max([greatest(f, 0.0, 1.0)[1], at(0), at(1), *[at(m) for m in modes if m <= 1]])
    if kind == "vonmisesmixture":
        return max(greatest(f, 0.0, 2 * math.pi)[1], at(0), at(p[0]), at(p[2]))
    raise ValueError(f"unknown density {kind}")

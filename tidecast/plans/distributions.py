"""Densities and draws of the distributions that priors may name."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

#: (log density, its derivative) at x, up to a constant, for parameters by name.
Density = Callable[[np.ndarray, Mapping[str, float]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Distribution:
    """defaults: parameters and their values where none is stated.  positive: whether x must be above 0."""

    defaults: Mapping[str, float]
    density: Density
    draw: Callable[[np.random.Generator, int, Mapping[str, float]], np.ndarray]
    positive: bool = False


def _normal(x, p):
    z = (x - p["mu"]) / p["sigma"]
    return -0.5 * z * z, -z / p["sigma"]


def _student(x, p):
    z, nu = (x - p["mu"]) / p["sigma"], p["nu"]
    return -0.5 * (nu + 1) * np.log1p(z * z / nu), -(nu + 1) * z / (nu + z * z) / p["sigma"]


def _laplace(x, p):
    return -np.abs(x - p["mu"]) / p["b"], -np.sign(x - p["mu"]) / p["b"]


def _half_normal(x, p):
    return -0.5 * (x / p["sigma"]) ** 2, -x / p["sigma"] ** 2


def _half_cauchy(x, p):
    return -np.log1p((x / p["beta"]) ** 2), -2 * x / (p["beta"] ** 2 + x * x)


def _exponential(x, p):
    return -p["lam"] * x, np.full_like(x, -p["lam"])


def _gamma(x, p):
    return (p["alpha"] - 1) * np.log(x) - p["beta"] * x, (p["alpha"] - 1) / x - p["beta"]


def _inverse_gamma(x, p):
    return -(p["alpha"] + 1) * np.log(x) - p["beta"] / x, -(p["alpha"] + 1) / x + p["beta"] / x**2


def _log_normal(x, p):
    z = (np.log(x) - p["mu"]) / p["sigma"]
    return -0.5 * z * z - np.log(x), (-z / p["sigma"] - 1) / x


def _beta(x, p):
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    value = (p["alpha"] - 1) * np.log(y) + (p["beta"] - 1) * np.log1p(-y)
    return np.where(inside, value, -np.inf), np.where(inside, (p["alpha"] - 1) / y - (p["beta"] - 1) / (1 - y), 0.0)


KNOWN: dict[str, Distribution] = {
    "normal": Distribution({"mu": 0.0, "sigma": 1.0}, _normal, lambda r, n, p: r.normal(p["mu"], p["sigma"], n)),
    "studentt": Distribution({"nu": 4.0, "mu": 0.0, "sigma": 1.0}, _student, lambda r, n, p: p["mu"] + p["sigma"] * r.standard_t(p["nu"], n)),
    "laplace": Distribution({"mu": 0.0, "b": 1.0}, _laplace, lambda r, n, p: r.laplace(p["mu"], p["b"], n)),
    "halfnormal": Distribution({"sigma": 1.0}, _half_normal, lambda r, n, p: np.abs(r.normal(0, p["sigma"], n)), True),
    "halfcauchy": Distribution({"beta": 1.0}, _half_cauchy, lambda r, n, p: np.abs(p["beta"] * r.standard_cauchy(n)), True),
    "exponential": Distribution({"lam": 1.0}, _exponential, lambda r, n, p: r.exponential(1 / p["lam"], n), True),
    "gamma": Distribution({"alpha": 1.0, "beta": 1.0}, _gamma, lambda r, n, p: r.gamma(p["alpha"], 1 / p["beta"], n), True),
    "inversegamma": Distribution({"alpha": 1.0, "beta": 1.0}, _inverse_gamma, lambda r, n, p: p["beta"] / r.gamma(p["alpha"], 1, n), True),
    "lognormal": Distribution({"mu": 0.0, "sigma": 1.0}, _log_normal, lambda r, n, p: r.lognormal(p["mu"], p["sigma"], n), True),
    "beta": Distribution({"alpha": 1.0, "beta": 1.0}, _beta, lambda r, n, p: r.beta(p["alpha"], p["beta"], n), True),
}


def zero_sum(rng: np.random.Generator, n: int, size: int, sigma: float = 1.0) -> np.ndarray:
    """n normal vectors of `size` entries that sum to 0: a normal vector less its mean."""
    x = rng.normal(0, sigma, (n, size))
    return x - x.mean(1, keepdims=True)


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def log_constant(name: str, p: Mapping[str, float | np.ndarray]) -> float | np.ndarray:
    """What a density leaves out as long as its parameters are fixed, up to a number."""
    return {
        "normal": lambda: -np.log(p["sigma"]),
        "studentt": lambda: -np.log(p["sigma"]) + _log_gamma((np.asarray(p["nu"]) + 1) / 2) - _log_gamma(np.asarray(p["nu"]) / 2) - 0.5 * np.log(p["nu"]),
        "laplace": lambda: -np.log(p["b"]),
        "halfnormal": lambda: -np.log(p["sigma"]),
        "halfcauchy": lambda: -np.log(p["beta"]),
        "exponential": lambda: np.log(p["lam"]),
        "gamma": lambda: p["alpha"] * np.log(p["beta"]) - _log_gamma(p["alpha"]),
        "inversegamma": lambda: p["alpha"] * np.log(p["beta"]) - _log_gamma(p["alpha"]),
        "lognormal": lambda: -np.log(p["sigma"]),
        "beta": lambda: _log_gamma(np.asarray(p["alpha"]) + p["beta"]) - _log_gamma(p["alpha"]) - _log_gamma(p["beta"]),
    }[name]()

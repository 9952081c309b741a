"""Declarative models: one specification both trains and forecasts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np

from tidecast.errors import HorizonError, MethodResolutionError
from tidecast.names import FUTURE_DIM, TIME_DIM
from tidecast.plans.distributions import KNOWN

FAMILIES = ("normal", "poisson", "studentt")


@dataclass(frozen=True)
class Prior:
    """A named distribution with its parameters: one of distributions.KNOWN, whatever its case.

    A parameter may be a Prior in turn.  In a ModelSpec such a hyperprior isn't sampled: its mean, over draws of a fixed
    seed, stands in.  dims may name "time", for a value a step; a hyperprior can't have that, as the horizon's steps
    couldn't share it with the data's.
    """

    dist: str
    params: Mapping[str, object] = field(default_factory=dict)
    dims: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, value in self.params.items():
            if isinstance(value, Prior) and {TIME_DIM, FUTURE_DIM} & set(value.dims):
                raise HorizonError(f"the hyperprior {name!r} has a value a step, which data and horizon can't share")
        known = KNOWN.get(self.name)
        if known is None:
            raise MethodResolutionError(f"no distribution {self.dist!r}; there are {', '.join(sorted(KNOWN))}")
        if wrong := set(self.params) - set(known.defaults):
            raise MethodResolutionError(f"{self.dist} has no {', '.join(sorted(wrong))}")

    @property
    def name(self) -> str:
        return self.dist.lower().replace("_", "")

    @property
    def positive(self) -> bool:
        return KNOWN[self.name].positive

    def numbers(self) -> dict[str, float]:
        given = {k: v.mean() if isinstance(v, Prior) else float(v) for k, v in self.params.items()}
        return {**KNOWN[self.name].defaults, **given}

    def mean(self) -> float:
        return float(self.draw(np.random.default_rng(0), 20_000).mean())

    def scale(self) -> float:
        return self.numbers().get("sigma", 1.0)

    def density(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return KNOWN[self.name].density(np.asarray(x, float), self.numbers())

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return KNOWN[self.name].draw(rng, n, self.numbers())


def create_normal(mu: float = 0.0, sigma: float = 1.0) -> Prior:
    return Prior("normal", {"mu": mu, "sigma": sigma})


def create_half_normal(sigma: float = 1.0) -> Prior:
    return Prior("halfnormal", {"sigma": sigma})


class PriorConfig:
    """Defaults with overrides by name."""

    defaults: Mapping[str, Prior] = {}

    def __init__(self, overrides: Mapping[str, Prior] | None = None) -> None:
        for name, prior in (overrides or {}).items():
            if not isinstance(prior, Prior):
                raise TypeError(f"{name} is no Prior")
        self.priors = {**self.defaults, **(overrides or {})}

    def create_prior(self, name: str) -> Prior:
        priors = getattr(self, "priors", self.defaults)
        if name not in priors:
            raise KeyError(f"no prior for {name!r}; there are {', '.join(sorted(priors))}")
        return priors[name]


@dataclass(frozen=True)
class ModelSpec:
    """mu = intercept + trend * pos + Fourier terms + covariates + a random-walk level; y ~ family(mu).

    All of mu is linear in coefficients, and the level in its innovations (the non-centred form), so gradients are
    closed.  In-sample innovations are latent; over the horizon they are drawn fresh from the replayed scale.
    """

    family: str = "normal"
    trend: bool = True
    period: float | None = None
    terms: int = 0
    covariates: tuple[str, ...] = ()
    level: bool = False
    priors: Mapping[str, Prior] = field(default_factory=dict)
    degrees: float = 4.0

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise MethodResolutionError(f"unknown family {self.family!r}")
        for name, prior in self.priors.items():
            if name not in (*self.names, "sigma", "level"):
                raise MethodResolutionError(f"a prior for {name!r}, which the model lacks")
            if (name in ("sigma", "level")) != prior.positive:
                raise MethodResolutionError(f"{prior.dist} is no prior for {name!r}")

    def prior(self, name: str) -> Prior:
        """The prior of a coefficient, of "sigma" or of "level" (the step of the random walk), on the scaled values."""
        if name in ("sigma", "level"):
            return self.priors.get(name) or create_half_normal(1.0 if name == "sigma" else 0.5)
        return self.priors.get(name) or create_normal(0.0, 2.0 if name == "intercept" else 1.0)

    def compile(self, y: np.ndarray, pos: np.ndarray, covariates: np.ndarray) -> Compiled:
        return Compiled(self, y, pos, covariates)

    def with_priors(self, **priors: Prior) -> ModelSpec:
        return replace(self, priors={**self.priors, **priors})

    @property
    def names(self) -> list[str]:
        """The coefficients in the order of design()."""
        fourier = [f"{f}_{k}" for f in ("sin", "cos") for k in range(1, self.terms + 1)] if self.period else []
        return ["intercept", *(["trend"] if self.trend else []), *fourier, *self.covariates]

    def design(self, pos: np.ndarray, covariates: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(pos))]
        if self.trend:
            columns.append(pos.astype(float))
        if self.period:
            angle = 2 * np.pi * np.outer(np.arange(1, self.terms + 1), pos) / self.period
            columns += [*np.sin(angle), *np.cos(angle)]
        return np.column_stack([*columns, *(covariates.T if len(self.covariates) else [])])


class Compiled:
    """A ModelSpec over one observed window: the log density of its unconstrained vector, with its gradient.

    Values are scaled by the window's mean and deviation for the normal and Student families.
    """

    def __init__(self, spec: ModelSpec, y: np.ndarray, pos: np.ndarray, covariates: np.ndarray) -> None:
        self.spec, self.n = spec, len(y)
        plain = spec.family == "poisson"
        self.centre, self.unit = (0.0, 1.0) if plain else (float(y.mean()), float(y.std()) or 1.0)
        self.y = (y - self.centre) / self.unit
        raw = spec.design(pos, covariates)
        self.shift, self.span = raw.mean(0), raw.std(0)
        self.shift[0], self.span = 0.0, np.where(self.span > 0, self.span, 1.0)
        self.x = (raw - self.shift) / self.span
        k = self.x.shape[1]
        self.priors = [spec.prior(name) for name in spec.names]
        self.sigma_prior, self.level_prior = spec.prior("sigma"), spec.prior("level")
        numbers = [p.numbers() for p in self.priors]
        self.normal = (np.array([p["mu"] for p in numbers]), np.array([p["sigma"] for p in numbers])) if all(p.name == "normal" for p in self.priors) else None
        self.beta = slice(0, k)
        self.noise = None if plain else k
        at = k + (not plain)
        self.step = at if spec.level else None
        self.eps = slice(at + 1, at + 1 + self.n) if spec.level else slice(at, at)
        self.dim = self.eps.stop

    def start(self) -> np.ndarray:
        out = np.zeros(self.dim)
        out[self.beta] = np.linalg.lstsq(self.x.T @ self.x + 1e-3 * np.eye(self.x.shape[1]), self.x.T @ (np.log1p(np.maximum(self.y, 0)) if self.noise is None else self.y), rcond=None)[0]
        if self.noise is not None:
            out[self.noise] = -1.0
        if self.step is not None:
            out[self.step] = -2.0
        return out

    def beta_prior(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        if self.normal is not None:
            mu, sd = self.normal
            z = (beta - mu) / sd
            return float(-0.5 * (z @ z)), -z / sd
        found = [prior.density(b) for prior, b in zip(self.priors, beta)]
        return float(sum(lp for lp, _ in found)), np.array([slope for _, slope in found], float)

    def parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mu, level) on the scaled values."""
        level = np.cumsum(np.exp(v[self.step]) * v[self.eps]) if self.step is not None else np.zeros(self.n)
        return self.x @ v[self.beta] + level, level

    def target(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        g = np.zeros(self.dim)
        mu, _ = self.parts(v)
        beta = v[self.beta]
        logp, g[self.beta] = self.beta_prior(beta)
        if self.spec.family == "poisson":
            rate = np.exp(np.clip(mu, -30, 30))
            logp += (self.y * mu - rate).sum()
            d = self.y - rate
        else:
            sigma = np.exp(v[self.noise])
            z = (self.y - mu) / sigma
            if self.spec.family == "normal":
                logp += -0.5 * (z * z).sum() - self.n * v[self.noise]
                d, into = z / sigma, (z * z).sum() - self.n
            else:
                nu = self.spec.degrees
                w = (nu + 1) / (nu + z * z)
                logp += -0.5 * (nu + 1) * np.log1p(z * z / nu).sum() - self.n * v[self.noise]
                d, into = w * z / sigma, (w * z * z).sum() - self.n
            # the scale's prior, with the logarithm's volume
            lp, slope = self.sigma_prior.density(sigma)
            logp += float(lp) + v[self.noise]
            g[self.noise] = into + sigma * slope + 1
        g[self.beta] += self.x.T @ d
        if self.step is not None:
            tau, e = np.exp(v[self.step]), v[self.eps]
            back = np.cumsum(d[::-1])[::-1]
            lp, slope = self.level_prior.density(tau)
            logp += -0.5 * (e @ e) + float(lp) + v[self.step]
            g[self.eps] = tau * back - e
            g[self.step] = tau * (back @ e) + tau * slope + 1
        return float(logp), g

    def draw(self, v: np.ndarray) -> dict[str, object]:
        """A posterior row on the data's own scale: coefficients, sigma, level step, last level and in-sample mu."""
        mu, level = self.parts(v)
        beta = v[self.beta] / self.span
        beta[0] -= (self.shift[1:] * beta[1:]).sum()
        beta = beta * self.unit
        beta[0] += self.centre
        return {
            "beta": beta.tolist(),
            "sigma": float(np.exp(v[self.noise]) * self.unit) if self.noise is not None else 0.0,
            "level_sd": float(np.exp(v[self.step]) * self.unit) if self.step is not None else 0.0,
            "level": float(level[-1] * self.unit),
            "mu_path": (mu * self.unit + self.centre).tolist(),
            "state": [],
        }

    def prior_draws(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """n vectors of the priors alone."""
        out = rng.standard_normal((n, self.dim))
        out[:, self.beta] = np.column_stack([prior.draw(rng, n) for prior in self.priors])
        for at, prior in ((self.noise, self.sigma_prior), (self.step, self.level_prior)):
            if at is not None:
                out[:, at] = np.log(prior.draw(rng, n) + 1e-12)
        return out

"""Models of one's own: parameters, a state that steps through time, and what is seen of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.errors import MethodResolutionError
from tidecast.functions.rng import key_of, normal
from tidecast.names import FUTURE_DIM, POS
from tidecast.plans.distributions import KNOWN, log_constant
from tidecast.plans.spec import FAMILIES, Prior, create_half_normal

Theta = Mapping[str, np.ndarray]


@dataclass(frozen=True)
class UserModel:
    """mu[t] = emit(state[t], theta, t, x[t]) with state[t] = step(state[t - 1], theta, eps[t], t, x[t]); y ~ family(mu).

    theta holds the parameters by name, x the covariates by name, eps `innovations` standard normal numbers a step.
    The state is an array with one row a component; init(theta) gives the one before the first step.  Without step
    there is no state, and emit alone is the model.

    All functions must work elementwise on numpy arrays, as each is called for many vectors of parameters at once: for
    the gradient's, when fitting, and for all draws when forecasting.  In sample, innovations are latent; over the
    horizon the state goes on from each draw's last one with fresh innovations.

    A parameter of a prior may be a Prior itself: it becomes a parameter of the model, named after both ("drift_mu"),
    is drawn once, and is replayed with the others.
    """

    params: Mapping[str, Prior]
    emit: Callable[[np.ndarray | None, Theta, float, Mapping[str, np.ndarray]], np.ndarray]
    step: Callable[[np.ndarray, Theta, np.ndarray, float, Mapping[str, np.ndarray]], np.ndarray] | None = None
    init: Callable[[Theta], np.ndarray] | None = None
    innovations: int = 1
    family: str = "normal"
    covariates: tuple[str, ...] = ()
    sigma: Prior | None = None
    degrees: float = 4.0

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise MethodResolutionError(f"unknown family {self.family!r}")
        if (self.step is None) != (self.init is None):
            raise MethodResolutionError("a step needs a first state, and a first state a step")

    @property
    def flat(self) -> dict[str, Prior]:
        """All parameters by name, hyperpriors before those that they shape."""
        out: dict[str, Prior] = {}

        def add(name: str, prior: Prior) -> None:
            for part, value in prior.params.items():
                if isinstance(value, Prior):
                    add(f"{name}_{part}", value)
            if name in out:
                raise MethodResolutionError(f"two parameters are named {name!r}")
            out[name] = prior

        for name, prior in self.params.items():
            add(name, prior)
        return out

    @property
    def names(self) -> list[str]:
        return list(self.flat)

    def compile(self, y: np.ndarray, pos: np.ndarray, covariates: np.ndarray) -> UserCompiled:
        return UserCompiled(self, y, pos, covariates)

    def run(self, theta: Theta, state: np.ndarray | None, eps: np.ndarray, pos: Sequence[float], x: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        """(mu, last state): mu has a column a step; eps is (innovations, rows, steps), x arrays that end in steps."""
        out = []
        for k, t in enumerate(pos):
            now = {name: values[..., k] for name, values in x.items()}
            if self.step is not None:
                state = np.asarray(self.step(state, theta, eps[..., k], t, now), float)
            out.append(self.emit(state, theta, t, now))
        rows = len(next(iter(theta.values()))) if theta else eps.shape[1]
        return np.stack([np.broadcast_to(np.asarray(m, float), (rows,)) for m in out], axis=-1), state

    def first(self, theta: Theta, rows: int) -> np.ndarray | None:
        if self.init is None:
            return None
        start = np.asarray(self.init(theta), float)
        start = start[None] if start.ndim < 2 else start
        return np.broadcast_to(start, (start.shape[0], rows)).copy()

    def simulate(self, grid: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
        """(keys, chain, draw, pos, sigma, mu_future): each series' draws step through the horizon side by side.

        Innovations come with the rows, each a function of seed, draw, series, step and its own number: neither the
        horizon's length nor the number of draws changes one.
        """
        model, keys = self, list(keys)
        label = [FUTURE_DIM] if FUTURE_DIM in grid.columns else []
        fresh = F.array(*(normal(key_of(seed, f"state{i}", F.col("chain"), F.col("draw"), *(F.col(k) for k in keys), F.col(POS))) for i in range(self.innovations)))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["chain", "draw", POS])
            rows = len(frame.drop_duplicates(["chain", "draw"]))
            steps = len(frame) // rows
            heads = frame.iloc[::steps]
            values = np.stack(heads["beta"].to_list()) if model.params else np.zeros((rows, 0))
            theta = {name: values[:, k] for k, name in enumerate(model.names)}
            state = np.stack(heads["state"].to_list()).T if model.step is not None else None
            x = {c: frame[c].to_numpy(float).reshape(rows, steps) for c in model.covariates}
            eps = np.stack(frame["_eps"].to_list()).reshape(rows, steps, model.innovations).transpose(2, 0, 1)
            mu, _ = model.run(theta, state, eps, frame[POS].to_numpy()[:steps].astype(float), x)
            return frame[[*keys, "chain", "draw", POS, "sigma", *label]].assign(mu_future=mu.ravel())

        kinds = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
        schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"chain int, draw long, {POS} long, sigma double, " + "".join(f"{c} {kinds[c]}, " for c in label) + "mu_future double"
        rows = grid.select(*keys, "chain", "draw", POS, "beta", "sigma", "state", *label, *self.covariates, fresh.alias("_eps"))
        return rows.groupBy(*keys).applyInPandas(run, schema)


class UserCompiled:
    """A UserModel over one observed window: its unconstrained vector is parameters, log sigma, innovations.

    Parameters whose prior is positive stand as logarithms.  Gradients are central differences, all taken in one pass.
    """

    def __init__(self, spec: UserModel, y: np.ndarray, pos: np.ndarray, covariates: np.ndarray) -> None:
        self.spec, self.y, self.pos, self.n = spec, y, pos.astype(float), len(y)
        self.x = {c: covariates[:, k].astype(float) for k, c in enumerate(spec.covariates)}
        self.flat = spec.flat
        self.priors = list(self.flat.values())
        self.k = len(self.priors)
        self.noisy = spec.family != "poisson"
        self.sigma_prior = spec.sigma or create_half_normal(float(np.std(y)) or 1.0)
        self.latent = spec.innovations * self.n if spec.step is not None else 0
        self.dim = self.k + self.noisy + self.latent

    def start(self) -> np.ndarray:
        out = np.zeros(self.dim)
        for k, prior in enumerate(self.priors):
            mean = float(np.median(prior.draw(np.random.default_rng(0), 999)))
            out[k] = np.log(max(mean, 1e-6)) if prior.positive else mean
        if self.noisy:
            out[self.k] = np.log((float(np.std(self.y)) or 1.0) / 2)
        return out

    def unpack(self, v: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(theta, sigma, eps) of the rows of v."""
        with np.errstate(over="ignore"):
            theta = {name: np.exp(v[:, k]) if prior.positive else v[:, k] for k, (name, prior) in enumerate(self.flat.items())}
            sigma = np.exp(v[:, self.k]) if self.noisy else np.zeros(len(v))
        eps = v[:, self.dim - self.latent :].reshape(len(v), self.spec.innovations, -1).transpose(1, 0, 2) if self.latent else np.zeros((self.spec.innovations, len(v), self.n))
        return theta, sigma, eps

    def numbers(self, name: str, theta: Theta) -> dict[str, float | np.ndarray]:
        """The parameters of a prior, those with a prior of their own as they were drawn."""
        prior = self.flat[name]
        return {**KNOWN[prior.name].defaults, **{part: theta[f"{name}_{part}"] if isinstance(value, Prior) else float(value) for part, value in prior.params.items()}}

    def mean(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        theta, _, eps = self.unpack(v)
        return self.spec.run(theta, self.spec.first(theta, len(v)), eps, self.pos, {c: x[None, :] for c, x in self.x.items()})

    def logp(self, v: np.ndarray) -> np.ndarray:
        theta, sigma, _ = self.unpack(v)
        out = -0.5 * (v[:, self.dim - self.latent :] ** 2).sum(1) if self.latent else np.zeros(len(v))
        for k, (name, prior) in enumerate(self.flat.items()):
            value, numbers = theta[name], self.numbers(name, theta)
            out = out + KNOWN[prior.name].density(value, numbers)[0] + (v[:, k] if prior.positive else 0)
            if any(isinstance(p, Prior) for p in prior.params.values()):
                out = out + log_constant(prior.name, numbers)
        mu, _ = self.mean(v)
        if not self.noisy:
            return out + (self.y * mu - np.exp(np.clip(mu, -30, 30))).sum(1)
        z = (self.y - mu) / sigma[:, None]
        nu = self.spec.degrees
        fit = -0.5 * z * z if self.spec.family == "normal" else -0.5 * (nu + 1) * np.log1p(z * z / nu)
        return out + fit.sum(1) - self.n * v[:, self.k] + self.sigma_prior.density(sigma)[0] + v[:, self.k]

    def target(self, v: np.ndarray, step: float = 1e-5) -> tuple[float, np.ndarray]:
        moved = np.eye(self.dim) * step
        with np.errstate(all="ignore"):
            found = self.logp(np.concatenate([v[None], v + moved, v - moved]))
        return float(found[0]), (found[1 : self.dim + 1] - found[self.dim + 1 :]) / (2 * step)

    def prior_draws(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = rng.standard_normal((n, self.dim))
        theta: dict[str, np.ndarray] = {}
        for k, (name, prior) in enumerate(self.flat.items()):
            theta[name] = KNOWN[prior.name].draw(rng, n, self.numbers(name, theta))
            out[:, k] = np.log(theta[name] + 1e-12) if prior.positive else theta[name]
        if self.noisy:
            out[:, self.k] = np.log(self.sigma_prior.draw(rng, n) + 1e-12)
        return out

    def draw(self, v: np.ndarray) -> dict[str, object]:
        theta, sigma, _ = self.unpack(v[None])
        mu, state = self.mean(v[None])
        return {"beta": [float(x[0]) for x in theta.values()], "sigma": float(sigma[0]), "level_sd": 0.0, "level": 0.0, "mu_path": mu[0].tolist(), "state": [] if state is None else state[:, 0].tolist()}


def time_series(loc: Prior, sigma: Prior) -> UserModel:
    """A random walk with drift `loc` and steps `sigma`, from a level of its own."""
    wide = Prior("normal", {"mu": 0.0, "sigma": 10.0})
    return UserModel(
        {"drift": loc, "step": sigma, "level": wide},
        emit=lambda s, p, t, x: s[0],
        step=lambda s, p, e, t, x: s + p["drift"] + p["step"] * e,
        init=lambda p: p["level"],
    )


def prior_rv_factory(prior: Prior, name: str) -> UserModel:
    """A latent with a value of its own at every step, drawn from a normal prior, over data and horizon alike.

    Hyperpriors of the prior are drawn once, as {name}_mu and {name}_sigma, and shared by both.
    """
    if prior.name != "normal":
        raise MethodResolutionError("a value a step is a normal prior's")
    numbers = {**KNOWN["normal"].defaults, **prior.params}
    own = {f"{name}_{part}": value for part, value in numbers.items() if isinstance(value, Prior)}
    of = lambda p, part: p[f"{name}_{part}"] if f"{name}_{part}" in own else float(numbers[part])
    return UserModel(own, emit=lambda s, p, t, x: s[0], step=lambda s, p, e, t, x: 0 * s + of(p, "mu") + of(p, "sigma") * e, init=lambda p: np.zeros(len(next(iter(p.values()))) if p else 1))


def prior_obs_factory(prior: Prior, model: UserModel) -> UserModel:
    """model with what is seen of it told by a prior: its family, its degrees of freedom, and the prior of its sigma.

    The prior leaves mu unset, which is the model's own."""
    if "mu" in prior.params:
        raise ValueError("what is seen has the model's mean: leave mu unset")
    if prior.name not in ("normal", "studentt"):
        raise MethodResolutionError(f"{prior.dist} isn't a family of observations")
    sigma = prior.params.get("sigma")
    if sigma is not None and not isinstance(sigma, Prior):
        raise MethodResolutionError("state a prior for sigma, which is learned")
    return replace(model, family=prior.name, sigma=sigma, degrees=float(prior.params.get("nu", model.degrees)))

"""Forecasters: fit a specification to every series at once, replay its draws, simulate the horizon."""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError, ConvergenceWarning, HorizonError, MethodResolutionError, NotFittedError
from tidecast.functions.features import fourier_features
from tidecast.functions.rng import key_of, normal, student
from tidecast.functions.samplers import poisson
from tidecast.names import FUTURE_DIM, POS, TIME_DIM
from tidecast.operators import index as time_index
from tidecast.operators.draws import thin_draws
from tidecast.operators.panel import validate_finite
from tidecast.operators.results import with_future_time
from tidecast.plans import diagnostics, kernels
from tidecast.plans.models import UserModel
from tidecast.plans.spec import Compiled, ModelSpec
from tidecast.scratch import stored

#: t_first and t_obs: a series' first step and the one after its last, each its own.  still_falling: see convergence().
#: fit_seconds: what all chains of the series took in their task.
DRAWS = "chain int, draw long, beta array<double>, sigma double, level_sd double, level double, mu_path array<double>, state array<double>, t_first long, t_obs long, still_falling boolean, fit_seconds double"


def local_trend_spec() -> ModelSpec:
    return ModelSpec(trend=True, period=7.0, terms=1)


class BaseForecaster:
    """spec: the model.  keys: columns that tell series apart; each is a task's work of its own.  seed: of all draws."""

    def __init__(self, spec: ModelSpec | UserModel, keys: Sequence[str] = (), seed: int = 0, num_draws: int = 200, chains: int = 1) -> None:
        self.spec, self.keys, self.seed, self.num_draws, self.chains = spec, list(keys), seed, num_draws, chains
        self.posterior_: DataFrame | None = None
        self.data_: DataFrame | None = None

    @property
    def is_fitted(self) -> bool:
        return self.posterior_ is not None

    def _require_fitted(self) -> None:
        if not self.is_fitted:
            raise NotFittedError("fit() first")

    def _sample(self, model: Compiled, rng: np.random.Generator) -> Iterable[np.ndarray]:
        raise NotImplementedError

    def fit(self, data: DataFrame, covariates: DataFrame | None = None) -> BaseForecaster:
        """Fit every series of data (keys, pos, y), covariates (keys or not, pos, columns) beside it; fitting again is fine.

        Covariates past the data aren't used.  A series is one group of one task: its length bounds the task.  The draws
        are written to the shared folder, so an executor that is lost later costs no fit.
        """
        names = list(self.spec.covariates)
        if names and covariates is None:
            raise AlignmentError("the model has covariates, and there are none")
        validate_finite(data, "y")
        on = [*(k for k in self.keys if covariates is not None and k in covariates.columns), POS]
        rows = data.select(*self.keys, POS, "y")
        if names:
            rows = rows.join(covariates.select(*on, *names), on, "left")
            validate_finite(rows, *names)
        # tasks get this forecaster, which must not hold tables then
        self.posterior_ = self.data_ = None
        keys, spec, seed, chains, sample = self.keys, self.spec, self.seed, self.chains, self._sample
        kinds = {f.name: f.dataType.simpleString() for f in data.schema.fields}

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            began = time.perf_counter()
            frame = frame.sort_values(POS)
            model = spec.compile(frame["y"].to_numpy(float), frame[POS].to_numpy(), frame[names].to_numpy(float))
            held = {"t_first": int(frame[POS].iloc[0]), "t_obs": int(frame[POS].iloc[-1]) + 1}
            key = [frame[k].iloc[0] for k in keys]
            word = int.from_bytes(__import__("hashlib").md5(repr((seed, [str(k) for k in key])).encode()).digest()[:8], "little")
            out = []
            for chain in range(chains):
                for d, v in enumerate(sample(model, np.random.default_rng([word, chain]))):
                    out.append({**dict(zip(keys, key)), "chain": chain, "draw": d, **model.draw(v), **held, "still_falling": getattr(model, "still_falling", None)})
            return pd.DataFrame(out).assign(fit_seconds=time.perf_counter() - began)

        schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + DRAWS
        # a stated number of partitions, as the rows of many series are few bytes that adaptive execution would put in one task
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        grouped = rows.repartition(parts, *keys).groupBy(*keys) if keys else rows.groupBy(F.lit("all"))
        self.posterior_ = stored(grouped.applyInPandas(run, schema), "posterior")
        self.data_ = data
        self.had_covariates_ = bool(names)
        return self

    def draw_posterior(self, num_samples: int = 100, seed: int | None = None) -> DataFrame:
        """num_samples draws of the fit, shared by all series and renumbered."""
        self._require_fitted()
        return thin_draws(self.posterior_, num_samples, self.seed if seed is None else seed)

    def _resolve(self, posterior: DataFrame | None, num_samples: int | None) -> DataFrame:
        if posterior is not None and num_samples is not None:
            raise HorizonError("state a posterior or a number of samples, not both")
        return posterior if posterior is not None else self.draw_posterior(num_samples or 100)

    def _features(self) -> Column:
        out = [F.lit(1.0)] + ([F.col(POS).cast("double")] if self.spec.trend else [])
        if self.spec.period:
            out += fourier_features(F.col(POS), self.spec.period, self.spec.terms)
        return F.array(*out, *(F.col(c).cast("double") for c in self.spec.covariates))

    def _noisy(self, rows: DataFrame, mu: str, name: str, seed: int) -> DataFrame:
        """rows with `name`, drawn about mu; a Poisson rate is exp(mu), and at most e**27, about 5e11."""
        key = key_of(seed, name, F.col("chain"), F.col("draw"), *(F.col(k) for k in self.keys), F.col(POS))
        if self.spec.family == "poisson":
            return rows.withColumn(name, poisson(key, F.exp(F.least(F.col(mu), F.lit(27.0)))))
        noise = student(key, self.spec.degrees) if self.spec.family == "studentt" else normal(key)
        return rows.withColumn(name, F.col(mu) + F.col("sigma") * noise)

    def forecast(self, horizon: int | None = None, covariates: DataFrame | None = None, future_covariates: DataFrame | None = None, future_index: DataFrame | None = None, posterior: DataFrame | None = None, num_samples: int | None = None, seed: int | None = None, var_names: Sequence[str] | None = None) -> DataFrame:
        """(keys, chain, draw, pos, mu_future, forecast), or var_names of the last two, over the horizon: exactly one of the first four says which.

        covariates span data and horizon, future_covariates the horizon alone (pos from 0), future_index its labels; keys
        among their columns give each series its own.  Where these have a time column, or a horizon follows data with
        one that is the same for all series and evenly spaced, time_future labels each step.
        Draws are replayed by key; noise is a function of seed, draw, series and step, so partitions don't matter.  Each
        series is forecast from its own last step on.
        """
        self._require_fitted()
        if sum(x is not None for x in (horizon, covariates, future_covariates, future_index)) != 1:
            raise HorizonError("state exactly one of horizon, covariates, future_covariates and future_index")
        if self.had_covariates_ and (horizon is not None or future_index is not None):
            raise HorizonError("a model with covariates needs theirs over the horizon")
        spark, labels = self.posterior_.sparkSession, None
        # steps after each series' own end, but for covariates, whose steps count from the start
        whole = covariates is not None
        if horizon is not None:
            if horizon < 1:
                raise HorizonError("the horizon must be 1 step or more")
            steps = spark.range(horizon).toDF(POS)
            labels = self._labels(horizon)
        elif whole:
            steps = covariates
        else:
            given = future_covariates if future_covariates is not None else future_index
            if TIME_DIM in given.columns and TIME_DIM in self.data_.columns:
                own = [k for k in self.keys if k in given.columns]
                time_index.concat_time_index(self.data_.select(*own, TIME_DIM, POS).distinct(), given.select(*own, TIME_DIM, POS).distinct(), keys=own)
            steps = given
        on = [k for k in self.keys if k in steps.columns]
        if whole:
            ends = self.data_.groupBy(*on).agg((F.max(POS) + 1).alias("_end"))
            ahead = steps.join(ends, on) if on else steps.crossJoin(F.broadcast(ends))
            if ahead.filter(F.col(POS) >= F.col("_end")).isEmpty():
                raise HorizonError("nothing lies beyond the data")
        elif steps.isEmpty():
            raise HorizonError("nothing lies beyond the data")
        seed = self.seed if seed is None else seed
        draws = self._resolve(posterior, num_samples)
        # a horizon alone is short; steps of all series may be many, and the planner sees how large they are
        grid = draws.join(steps, on) if on else draws.crossJoin(F.broadcast(steps) if horizon is not None else steps)
        grid = grid.filter(F.col(POS) >= F.col("t_obs")) if whole else grid.withColumn(POS, F.col(POS) + F.col("t_obs"))
        if labels is not None:
            grid = grid.join(F.broadcast(labels), POS, "left")
        return self._named(self._simulate(with_future_time(grid), seed), ("mu_future", "forecast"), var_names)

    def _labels(self, horizon: int) -> DataFrame | None:
        """(time, pos) of the data and `horizon` steps more, one row a step; None where the data have no labels, series
        have different ones, or the step can't be told."""
        if self.data_ is None or TIME_DIM not in self.data_.columns:
            return None
        known = self.data_.select(TIME_DIM, POS).distinct()
        n = known.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(POS).alias("steps"), (F.max(POS) - F.min(POS) + 1).alias("span")).first()
        if n["rows"] != n["steps"] or n["rows"] != n["span"]:
            return None
        try:
            return time_index.extend_time_index(known, horizon)
        except AlignmentError:
            return None

    def _named(self, drawn: DataFrame, known: Sequence[str], var_names: Sequence[str] | None) -> DataFrame:
        if unknown := set(var_names or ()) - set(known):
            raise ValueError(f"no variable {', '.join(sorted(unknown))}; there are {', '.join(known)}")
        return drawn.select(*self.keys, "chain", "draw", POS, *self._label(drawn), *(known if var_names is None else var_names))

    @staticmethod
    def _label(table: DataFrame) -> list[str]:
        return [FUTURE_DIM] if FUTURE_DIM in table.columns else []

    def _simulate(self, grid: DataFrame, seed: int) -> DataFrame:
        """The forecast of draws beside the steps of their horizon."""
        if isinstance(self.spec, UserModel):
            return self._noisy(self.spec.simulate(grid, self.keys, seed), "mu_future", "forecast", seed)
        linear = F.aggregate(F.zip_with(F.col("beta"), self._features(), lambda b, x: b * x), F.lit(0.0), lambda a, v: a + v)
        out = grid.withColumn("_linear", linear)
        if self.spec.level:
            from pyspark.sql import Window

            over = Window.partitionBy("chain", "draw", *self.keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
            walk = F.sum(F.col("level_sd") * normal(key_of(seed, "level", F.col("chain"), F.col("draw"), *(F.col(k) for k in self.keys), F.col(POS)))).over(over)
            out = out.withColumn("mu_future", F.col("_linear") + F.col("level") + walk)
        else:
            out = out.withColumn("mu_future", F.col("_linear"))
        return self._noisy(out, "mu_future", "forecast", seed).select(*self.keys, "chain", "draw", POS, *self._label(grid), "mu_future", "forecast")

    def predict_in_sample(self, posterior: DataFrame | None = None, num_samples: int | None = None, seed: int | None = None, var_names: Sequence[str] | None = None) -> DataFrame:
        """(keys, chain, draw, pos, mu, obs): observations resampled given the replayed latents."""
        self._require_fitted()
        rows = self._resolve(posterior, num_samples).select(*self.keys, "chain", "draw", "sigma", "t_first", F.posexplode("mu_path").alias("_at", "mu"))
        rows = rows.withColumn(POS, F.col("t_first") + F.col("_at"))
        return self._noisy(rows, "mu", "obs", self.seed if seed is None else seed).transform(self._named, ("mu", "obs"), var_names)


class PriorForecaster(BaseForecaster):
    """No inference: draws of the priors, on the scale of the data.  predict_in_sample() is the prior predictive of the
    observed window, forecast() that of the horizon."""

    def _sample(self, model: Compiled, rng: np.random.Generator) -> Iterable[np.ndarray]:
        return model.prior_draws(rng, self.num_draws)


class Forecaster(BaseForecaster):
    """Variational inference: method "advi" or "fullrank_advi"; optimizer None, or a learning rate for Adam."""

    def __init__(self, spec: ModelSpec, keys: Sequence[str] = (), method: str = "advi", num_steps: int = 10_000, optimizer: float | None = None, **settings: object) -> None:
        super().__init__(spec, keys, **settings)
        if method not in ("advi", "fullrank_advi"):
            raise MethodResolutionError(f"unknown method {method!r}")
        if optimizer is not None and not isinstance(optimizer, (int, float)):
            raise MethodResolutionError("an optimizer is a learning rate, or None")
        self.method, self.num_steps, self.rate = method, num_steps, float(optimizer or 0.01)

    def _sample(self, model: Compiled, rng: np.random.Generator) -> Iterable[np.ndarray]:
        draw, losses = kernels.advi(model.target, model.dim, rng, self.num_steps, self.rate, self.method == "fullrank_advi", model.start())
        model.still_falling = diagnostics.still_falling(losses)
        return draw(self.num_draws)

    def fit(self, data: DataFrame, covariates: DataFrame | None = None) -> BaseForecaster:
        """As BaseForecaster.fit(), and a warning where the loss of some series still falls or can't be assessed."""
        super().fit(data, covariates)
        if self.num_steps // 2 + max(self.num_steps // 10, 10) < self.num_steps:
            state = self.convergence().agg(F.count(F.lit(1)).alias("n"), F.count_if("still_falling").alias("falling"), F.count_if(F.col("still_falling").isNull()).alias("unknown")).first()
            if state["falling"]:
                warnings.warn(f"the loss still falls in {state['falling']} of {state['n']} fits; raise num_steps", ConvergenceWarning, stacklevel=2)
            if state["unknown"]:
                warnings.warn(f"the loss of {state['unknown']} of {state['n']} fits could not be assessed", ConvergenceWarning, stacklevel=2)
        return self

    def convergence(self) -> DataFrame:
        """(keys, chain, still_falling): whether the loss still fell by the rule of diagnostics; null where it isn't finite."""
        self._require_fitted()
        return self.posterior_.filter("draw = 0").select(*self.keys, "chain", "still_falling")


class HMCForecaster(BaseForecaster):
    """The no-U-turn sampler: num_draws after tune steps in each of `chains`."""

    def __init__(self, spec: ModelSpec, keys: Sequence[str] = (), num_draws: int = 1000, tune: int = 1000, chains: int = 2, **settings: object) -> None:
        super().__init__(spec, keys, num_draws=num_draws, chains=chains, **settings)
        self.tune = tune

    def _sample(self, model: Compiled, rng: np.random.Generator) -> Iterable[np.ndarray]:
        return kernels.nuts(model.target, model.start(), rng, self.num_draws, self.tune)


class PathfinderForecaster(BaseForecaster):
    """A quasi-Newton path's best normal."""

    def _sample(self, model: Compiled, rng: np.random.Generator) -> Iterable[np.ndarray]:
        return kernels.pathfinder(model.target, model.start(), rng)(self.num_draws)


class LevelModel(Compiled):
    """A local level and the spec's regression, the level integrated out by the Kalman filter: two log deviations."""

    def __init__(self, spec: ModelSpec, y: np.ndarray, pos: np.ndarray, covariates: np.ndarray) -> None:
        super().__init__(spec, y, pos, covariates)
        self.k = self.x.shape[1]
        self.dim = self.k + 2

    def start(self) -> np.ndarray:
        return np.concatenate([super().start()[: self.k], [-1.0, -2.0]])

    def filtered(self, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return kernels.kalman_loglik(self.y - self.x @ v[: self.k], np.exp(2 * v[self.k]), np.exp(2 * v[self.k + 1]), 0.0, 1e-6)

    def logp(self, v: np.ndarray) -> float:
        sd = np.exp(v[self.k :])
        return self.filtered(v)[0] + self.beta_prior(v[: self.k])[0] + float(self.sigma_prior.density(sd[0])[0] + self.level_prior.density(sd[1])[0]) + v[self.k :].sum()

    def target(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        """logp() and its gradient."""
        sd = np.exp(v[self.k :])
        if not np.isfinite(sd).all():
            return -np.inf, np.zeros(len(v))
        fit, by_y, d_obs, d_level = kernels.kalman_score(self.y - self.x @ v[: self.k], sd[0] ** 2, sd[1] ** 2, 0.0, 1e-6)
        beta, slope = self.beta_prior(v[: self.k])
        priors = [prior.density(s) for prior, s in zip((self.sigma_prior, self.level_prior), sd)]
        g = np.concatenate([slope - self.x.T @ by_y, 2 * sd**2 * np.array([d_obs, d_level]) + sd * np.array([p[1] for p in priors], float) + 1])
        return float(fit + beta + sum(p[0] for p in priors) + v[self.k :].sum()), g

    def path(self, v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The vector of the plain model: coefficients, log sigma, log step, and innovations of one smoothed path."""
        _, ms, ps = self.filtered(v)
        level = kernels.smooth_level(ms, ps, np.exp(2 * v[self.k + 1]), rng)
        return np.concatenate([v, np.diff(level, prepend=0.0) / np.exp(v[self.k + 1])])


class StatespaceForecaster(BaseForecaster):
    """Local level with regression, trend and Fourier terms: the level is marginalised, deviations are sampled by NUTS."""

    def __init__(self, spec: ModelSpec, keys: Sequence[str] = (), num_draws: int = 300, tune: int = 300, chains: int = 1, **settings: object) -> None:
        if not isinstance(spec, ModelSpec) or spec.family != "normal":
            raise MethodResolutionError("state-space models are normal model specifications")
        super().__init__(ModelSpec(**{**spec.__dict__, "level": True}), keys, num_draws=num_draws, chains=chains, **settings)
        self.tune = tune

    def _sample(self, model: Compiled, rng: np.random.Generator) -> Iterable[np.ndarray]:
        inner = LevelModel.__new__(LevelModel)
        inner.__dict__.update(model.__dict__)
        inner.k = model.x.shape[1]
        start = np.concatenate([Compiled.start(model)[: inner.k], [-1.0, -2.0]])
        found = kernels.nuts(inner.target, start, rng, self.num_draws, self.tune, depth=5)
        return [inner.path(v, rng) for v in found]


class SeasonalNaiveForecaster(BaseForecaster):
    """No model: draw d of a step is what was seen d + 1 periods before it, from each series' own last step on."""

    def __init__(self, keys: Sequence[str] = (), period: int = 1, num_draws: int = 1, seed: int = 0) -> None:
        super().__init__(ModelSpec(), keys, seed, num_draws)
        self.period = period

    def fit(self, data: DataFrame, covariates: DataFrame | None = None) -> BaseForecaster:
        validate_finite(data, "y")
        ends = data.groupBy(*self.keys).agg(F.min(POS).alias("t_first"), (F.max(POS) + 1).alias("t_obs"))
        draws = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.num_draws - 1).cast("long")))
        self.posterior_ = ends.select(*self.keys, F.lit(0).alias("chain"), draws.alias("draw"), "t_first", "t_obs")
        self.data_, self.had_covariates_ = data, False
        return self

    def draw_posterior(self, num_samples: int = 100, seed: int | None = None) -> DataFrame:
        """The first num_samples draws; there are no others."""
        self._require_fitted()
        return self.posterior_.filter(F.col("draw") < num_samples)

    def _simulate(self, grid: DataFrame, seed: int) -> DataFrame:
        back = (F.col("draw") + 1) * self.period
        asked = grid.filter(F.col("t_obs") - back >= F.col("t_first")).withColumn("_from", F.col(POS) - back)
        seen = self.data_.select(*self.keys, F.col(POS).alias("_from"), F.col("y").cast("double").alias("mu_future"))
        return asked.join(seen, [*self.keys, "_from"]).select(*self.keys, "chain", "draw", POS, *self._label(grid), "mu_future", F.col("mu_future").alias("forecast"))

    def predict_in_sample(self, *args: object, **settings: object) -> DataFrame:
        raise NotImplementedError("a seasonal-naive forecast has no latents to replay")


METHODS = {
    "advi": Forecaster,
    "fullrank_advi": lambda spec, **k: Forecaster(spec, method="fullrank_advi", **k),
    "nuts": HMCForecaster,
    "pathfinder": PathfinderForecaster,
    "statespace": StatespaceForecaster,
}

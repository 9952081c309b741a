"""State-space forecasters without Python: a model in two phases, its variances learned on a grid of their priors."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError, MethodResolutionError
from tidecast.functions import linalg
from tidecast.functions.rng import key_of, normal, uniforms
from tidecast.names import POS
from tidecast.operators import state_space
from tidecast.operators.folds import scan
from tidecast.operators.panel import validate_finite
from tidecast.operators.state_space import StateSpace
from tidecast.plans.forecaster import BaseForecaster
from tidecast.plans.spec import ModelSpec, Prior
from tidecast.scratch import stored

#: Values of a variance: stated ones, or a prior, whose quantiles are taken.
Values = Sequence[float] | Prior
#: Rows of a grid at most: it is broadcast.
MOST_ROWS = 100_000


class StatespaceModel:
    """Two phases: statespace() says what the states are, priors() what their parameters may be, by name."""

    covariates: tuple[str, ...] = ()

    def statespace(self) -> StateSpace:
        raise NotImplementedError

    def priors(self) -> Mapping[str, Values]:
        raise NotImplementedError


class Stated(StatespaceModel):
    """A model from its parts."""

    def __init__(self, space: StateSpace, priors: Mapping[str, Values], covariates: Sequence[str] = ()) -> None:
        self.space, self.values, self.covariates = space, priors, tuple(covariates)

    def statespace(self) -> StateSpace:
        return self.space

    def priors(self) -> Mapping[str, Values]:
        return self.values


def build(model: StatespaceModel, quantiles: int = 5) -> tuple[StateSpace, dict[str, list[float]]]:
    """The states and the values of every parameter, checked against one another.

    A prior becomes its quantiles at (i + 1/2) / quantiles, which weigh alike.  More than one block of covariates isn't
    written, as one block holds any number of them.
    """
    space = model.statespace()
    blocks = [c for c in space.components if isinstance(c, state_space.Regression)]
    if len(blocks) > 1:
        raise NotImplementedError("state the covariates as one block")
    if sum(b.count for b in blocks) != len(model.covariates):
        raise AlignmentError(f"the states take {sum(b.count for b in blocks)} covariates, and the model names {len(model.covariates)}")
    given, out = model.priors(), {}
    for name in space.parameters():
        if name not in given:
            raise KeyError(f"no prior for {name!r}; there are {', '.join(sorted(given))}")
        values = given[name]
        if isinstance(values, Prior):
            if not values.positive:
                raise MethodResolutionError(f"{values.dist} is no prior for {name!r}, which is above 0")
            drawn = np.sort(values.draw(np.random.default_rng(0), 20_000))
            values = [float(drawn[int((i + 0.5) / quantiles * len(drawn))]) for i in range(quantiles)]
        out[name] = [float(v) for v in values]
    if unknown := set(given) - set(out):
        raise MethodResolutionError(f"priors for {', '.join(sorted(unknown))}, which the states lack")
    if np.prod([len(v) for v in out.values()]) > MOST_ROWS:
        raise MethodResolutionError(f"the grid has more than {MOST_ROWS} rows; state fewer values")
    return space, out


class StructuralForecaster(BaseForecaster):
    """The states are integrated out by the filter, and the posterior of their parameters is exact on the grid.

    Nothing runs in Python: a fit is one fold for each series and grid row.  Draws take a grid row each, and states from
    its filtered normal, so a forecast's paths are joint over the horizon.
    """

    def __init__(self, model: StatespaceModel, keys: Sequence[str] = (), seed: int = 0, quantiles: int = 5) -> None:
        super().__init__(ModelSpec(trend=False, covariates=tuple(model.covariates)), keys, seed)
        self.space, self.values = build(model, quantiles)
        self.names = list(self.values)

    def fit(self, data: DataFrame, covariates: DataFrame | None = None) -> BaseForecaster:
        """Fit every series of data (keys, pos, y); a null y, and a step that isn't there, were not seen."""
        names = list(self.spec.covariates)
        if names and covariates is None:
            raise AlignmentError("the model has covariates, and there are none")
        validate_finite(data.filter("y is not null"), "y")
        ends = data.groupBy(*self.keys).agg(F.min(POS).cast("long").alias("t_first"), (F.max(POS) + 1).cast("long").alias("t_obs"))
        rows = ends.select(*self.keys, F.explode(F.sequence("t_first", F.col("t_obs") - 1)).alias(POS)).join(data.select(*self.keys, F.col(POS).cast("long").alias(POS), "y"), [*self.keys, POS], "left")
        if names:
            on = [*(k for k in self.keys if k in covariates.columns), POS]
            rows = rows.join(covariates.select(*on, *names), on, "left")
            validate_finite(rows, *names)
        spark = data.sparkSession
        grid = spark.createDataFrame(list(itertools.product(*self.values.values())), ", ".join(f"`{n}` double" for n in self.names))
        self.paths_ = stored(state_space.steps(rows, self.keys, covariates=names), "paths")
        run = self.space.filter(F.col("path"), {n: F.col(n) for n in self.names})
        whole = linalg.let(run, lambda f: F.struct(F.aggregate(f, F.lit(0.0), lambda s, e: s + e["ll"]).alias("loglik"), F.element_at(f, -1)["fa"].alias("fa"), F.element_at(f, -1)["fp"].alias("fp")))
        found = stored(self.paths_.crossJoin(F.broadcast(grid)).select(*self.keys, *self.names, whole.alias("_fit")).select(*self.keys, *self.names, "_fit.*"), "grid")
        weights = state_space.posterior(found, self.keys, self.names) if self.keys else state_space.posterior(found.withColumn("_all", F.lit(0)), ["_all"], self.names).drop("_all")
        self.weights_ = weights.select(*self.keys, *self.names, "weight").join(found, [*self.keys, *self.names])
        self.weights_ = stored(self.weights_.join(ends, self.keys) if self.keys else self.weights_.crossJoin(F.broadcast(ends)), "posterior")
        self.data_, self.had_covariates_ = data, bool(names)
        self.posterior_ = self.weights_
        return self

    def draw_posterior(self, num_samples: int = 100, seed: int | None = None) -> DataFrame:
        """(keys, chain, draw, the parameters, fa, fp, t_first, t_obs): each draw is a grid row, by its posterior weight."""
        self._require_fitted()
        row = F.struct("weight", *self.names, "loglik", "fa", "fp", "t_first", "t_obs")
        held = self.weights_.groupBy(*self.keys).agg(F.array_sort(F.collect_list(row)).alias("_grid"))
        u = uniforms(key_of(self.seed if seed is None else seed, "grid", F.col("draw"), *(F.col(k) for k in self.keys)))[0]
        held = held.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_samples - 1).cast("long")))).withColumn("_u", u)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"))
        step = lambda s, g: F.when(s["sum"] >= F.col("_u"), s).otherwise(F.struct((s["sum"] + g["weight"]).alias("sum"), (s["at"] + 1).alias("at")))
        chosen = F.get("_grid", F.aggregate("_grid", start, step, lambda s: s["at"]))
        return held.select(*self.keys, F.lit(0).alias("chain"), "draw", chosen.alias("_row")).select(*self.keys, "chain", "draw", *(f"_row.{n}" for n in (*self.names, "fa", "fp", "t_first", "t_obs")))

    def _key(self, seed: int, name: str, pos: Column) -> Column:
        return key_of(seed, name, F.col("chain"), F.col("draw"), *(F.col(k) for k in self.keys), pos)

    def _simulate(self, grid: DataFrame, seed: int) -> DataFrame:
        space, n = self.space, range(self.space.size)
        label = self._label(grid)
        p = {k: F.col(k) for k in self.names}
        step_row = F.struct(F.col(POS).cast("long").alias("pos"), F.array(*(F.col(c).cast("double") for c in self.spec.covariates)).cast("array<double>").alias("x"), *label)
        by = [*self.keys, "chain", "draw"]
        held = grid.groupBy(*by).agg(F.array_sort(F.collect_list(step_row)).alias("_path"), *(F.first(c).alias(c) for c in (*self.names, "fa", "fp", "t_obs")))
        full = F.array(*(F.array(*(space._get(F.col("fp"), i, j) + (F.lit(1e-12) * (1 + space._get(F.col("fp"), i, i)) if i == j else 0) for j in n)) for i in n))
        z = F.array(*(normal(self._key(seed, f"start{i}", F.col("t_obs"))) for i in n))
        held = held.withColumn("_a", linalg.added(F.col("fa"), linalg.times(linalg.cholesky(full, space.size), z)))

        def step(s: Column, o: Column) -> Column:
            t, q, load = space._transition(o, p), space._noise(o, p), space._loading(o)
            moved = []
            for i in n:
                terms = [state_space._product(t[i][k], F.get(s["a"], F.lit(k))) for k in n]
                if not state_space._is_zero(q[i]):
                    terms.append(F.sqrt(q[i]) * normal(self._key(seed, f"state{i}", o["pos"])))
                moved.append(state_space._sum(terms))
            now = state_space._array(moved)
            return linalg.let(now, lambda a: F.struct(o["pos"].alias("pos"), a.alias("a"), state_space._column(state_space._sum([state_space._product(load[i], F.get(a, F.lit(i))) for i in n])).alias("mu")))

        start = F.struct(F.lit(-1).cast("long").alias("pos"), F.col("_a").alias("a"), F.lit(0.0).alias("mu"))
        paths = scan(F.col("_path"), start, step, lambda s: s["mu"])
        out = held.select(*by, *self.names, F.explode(F.arrays_zip("_path", paths.alias("mu"))).alias("_e")).select(*by, *self.names, F.col("_e._path.pos").alias(POS), *(F.col(f"_e._path.{c}").alias(c) for c in label), F.col("_e.mu").alias("mu_future"))
        return self._seen(out, "mu_future", "forecast", seed).select(*by, POS, *label, "mu_future", "forecast")

    def _seen(self, rows: DataFrame, mu: str, name: str, seed: int) -> DataFrame:
        h = self.space.measurement
        return rows.withColumn(name, F.col(mu) + (F.sqrt(F.col(h)) * normal(self._key(seed, name, F.col(POS))) if h else 0.0))

    def predict_in_sample(self, posterior: DataFrame | None = None, num_samples: int | None = None, seed: int | None = None, var_names: Sequence[str] | None = None) -> DataFrame:
        """(keys, chain, draw, pos, mu, obs): each step's smoothed signal and what would be seen of it, steps drawn apart
        from one another; the smoother runs once for a series and each grid row that is drawn."""
        self._require_fitted()
        seed = self.seed if seed is None else seed
        draws = self._resolve(posterior, num_samples).select(*self.keys, "chain", "draw", *self.names)
        used = draws.select(*self.keys, *self.names).distinct()
        at = used.join(self.paths_, self.keys) if self.keys else used.crossJoin(self.paths_)
        by = [*self.keys, *self.names]
        smooth = state_space.smoothed(at, by, self.space, {n: F.col(n) for n in self.names}).select(*by, POS, "mean", "variance")
        drawn = draws.join(smooth, by).withColumn("mu", F.col("mean") + F.sqrt(F.greatest("variance", F.lit(0.0))) * normal(self._key(seed, "mu", F.col(POS))))
        return self._seen(drawn, "mu", "obs", seed).transform(self._named, ("mu", "obs"), var_names)

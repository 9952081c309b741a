"""Linear Gaussian state space of several components: filter, likelihood, smoother and forecast as array folds.

A series is one row with its steps in an array; a step that wasn't seen has a null y, so gaps inside a series and the
horizon after it are the same thing.  The matrices of a model are small and known when the plan is made, so the algebra
is written out entry by entry, zeros left out, and nothing runs in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.names import POS
from tidecast.operators.folds import let, scan

#: An entry of a matrix: a number, a Column, or 0, which costs nothing.
Entry = Column | float
Parameters = Mapping[str, Entry]


@dataclass(frozen=True)
class LevelTrend:
    """A level (order 1), with a trend (2) and its change (3); each has an innovation of variance {name}_{k}, or none
    where `innovations` says so."""

    order: int = 2
    innovations: Sequence[bool] | None = None
    name: str = "level"

    @property
    def size(self) -> int:
        return self.order

    def names(self) -> list[str]:
        return [f"{self.name}_{k}" for k in range(self.order)]

    def transition(self, step: Column, p: Parameters) -> list[list[Entry]]:
        return [[1.0 if j in (i, i + 1) else 0.0 for j in range(self.order)] for i in range(self.order)]

    def noise(self, step: Column, p: Parameters) -> list[Entry]:
        has = self.innovations or [True] * self.order
        return [p[n] if on else 0.0 for n, on in zip(self.names(), has)]

    def loading(self, step: Column) -> list[Entry]:
        return [1.0] + [0.0] * (self.order - 1)


@dataclass(frozen=True)
class Seasonal:
    """`period` effects that sum to an innovation of variance {name}."""

    period: int
    name: str = "season"

    @property
    def size(self) -> int:
        return self.period - 1

    def names(self) -> list[str]:
        return [self.name]

    def transition(self, step: Column, p: Parameters) -> list[list[Entry]]:
        return [[-1.0] * self.size] + [[float(j == i - 1) for j in range(self.size)] for i in range(1, self.size)]

    def noise(self, step: Column, p: Parameters) -> list[Entry]:
        return [p[self.name]] + [0.0] * (self.size - 1)

    def loading(self, step: Column) -> list[Entry]:
        return [1.0] + [0.0] * (self.size - 1)


@dataclass(frozen=True)
class Regression:
    """Coefficients of the step's covariates x[first:first + count], which don't change."""

    count: int = 1
    first: int = 0

    @property
    def size(self) -> int:
        return self.count

    def names(self) -> list[str]:
        return []

    def transition(self, step: Column, p: Parameters) -> list[list[Entry]]:
        return [[float(i == j) for j in range(self.count)] for i in range(self.count)]

    def noise(self, step: Column, p: Parameters) -> list[Entry]:
        return [0.0] * self.count

    def loading(self, step: Column) -> list[Entry]:
        return [F.get(step["x"], F.lit(self.first + k)) for k in range(self.count)]


@dataclass(frozen=True)
class Decay:
    """A deviation that forgets itself with time: the exponential kernel {name}_var * exp(-gap / {name}_scale), whose
    conditional normals the filter gives in time linear in the steps.  gap: which covariate is the time since the step
    before; None is 1."""

    name: str = "decay"
    gap: int | None = None

    @property
    def size(self) -> int:
        return 1

    def names(self) -> list[str]:
        return [f"{self.name}_var", f"{self.name}_scale"]

    def _kept(self, step: Column, p: Parameters) -> Column:
        gap = F.lit(1.0) if self.gap is None else F.get(step["x"], F.lit(self.gap))
        return F.exp(-gap / p[f"{self.name}_scale"])

    def transition(self, step: Column, p: Parameters) -> list[list[Entry]]:
        return [[self._kept(step, p)]]

    def noise(self, step: Column, p: Parameters) -> list[Entry]:
        kept = self._kept(step, p)
        return [p[f"{self.name}_var"] * (1 - kept * kept)]

    def loading(self, step: Column) -> list[Entry]:
        return [1.0]


def _is_zero(x: Entry) -> bool:
    return not isinstance(x, Column) and x == 0.0


def _product(a: Entry, b: Entry) -> Entry:
    if _is_zero(a) or _is_zero(b):
        return 0.0
    if not isinstance(a, Column) and a == 1.0:
        return b
    if not isinstance(b, Column) and b == 1.0:
        return a
    return a * b


def _sum(terms: Sequence[Entry]) -> Entry:
    left = [t for t in terms if not _is_zero(t)]
    out: Entry = left[0] if left else 0.0
    for t in left[1:]:
        out = out + t
    return out


def _column(x: Entry) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _array(entries: Sequence[Entry]) -> Column:
    return F.array(*map(_column, entries))


@dataclass(frozen=True)
class StateSpace:
    """Components side by side, seen through a measurement error of variance `measurement` (a parameter's name, or None).

    Parameters are variances by name, numbers or Columns of the series' row, so that each series or draw may have its
    own.  States start at mean0 with variance var0 each, a number or a parameter's name, before the first step's move.
    """

    components: Sequence[LevelTrend | Seasonal | Regression | Decay]
    measurement: str | None = "obs"
    mean0: float = 0.0
    var0: float | str = 1e4

    @property
    def size(self) -> int:
        return sum(c.size for c in self.components)

    def parameters(self) -> list[str]:
        return [n for c in self.components for n in c.names()] + ([self.measurement] if self.measurement else [])

    def _check(self, p: Parameters) -> None:
        missing = [n for n in self.parameters() if n not in p and any(n in c.names() and not _off(c, n) for c in self.components) or (n == self.measurement and n not in p)]
        if missing:
            raise AlignmentError(f"no value for {', '.join(missing)}")

    def _transition(self, step: Column, p: Parameters) -> list[list[Entry]]:
        out: list[list[Entry]] = [[0.0] * self.size for _ in range(self.size)]
        first = 0
        for c in self.components:
            for i, row in enumerate(c.transition(step, p)):
                out[first + i][first : first + c.size] = row
            first += c.size
        return out

    def _noise(self, step: Column, p: Parameters) -> list[Entry]:
        return [x for c in self.components for x in c.noise(step, p)]

    def _loading(self, step: Column) -> list[Entry]:
        return [x for c in self.components for x in c.loading(step)]

    def _place(self, i: int, j: int) -> int:
        """Where the entry (i, j) of a symmetric matrix is kept."""
        i, j = min(i, j), max(i, j)
        return i * self.size - i * (i - 1) // 2 + j - i

    def _pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.size) for j in range(i, self.size)]

    def _get(self, packed: Column, i: int, j: int) -> Column:
        return F.get(packed, F.lit(self._place(i, j)))

    def _through(self, packed: Column, matrix: list[list[Entry]], plus: Sequence[Entry] | None, body: Callable[[Column], Column]) -> Column:
        """body of matrix * packed * matrix' + diag(plus), packed."""
        n = range(self.size)
        half = _array([_sum([_product(matrix[i][k], self._get(packed, k, j)) for k in n]) for i in n for j in n])

        def whole(h: Column) -> Column:
            entries = [_sum([_product(F.get(h, F.lit(i * self.size + k)), matrix[j][k]) for k in n] + ([plus[i]] if plus is not None and i == j else [])) for i, j in self._pairs()]
            return let(_array(entries), body)

        return let(half, whole)

    def filter(self, path: Column, p: Parameters) -> Column:
        """array of struct(mean, f, v, ll, a, p, fa, fp) over path, an array of struct(pos, y, x).

        mean and f: what is expected of y at the step, and its variance, before it is seen; v: y less that; ll: its log
        likelihood (0 where y is null); a, p: the state then; fa, fp: the state once y is seen.  p and fp hold a
        symmetric matrix's upper rows.  Where y or a covariate is null, the step is unseen; a null covariate leaves mean
        and f null too.
        """
        self._check(p)
        n, m = range(self.size), self.size
        h = p[self.measurement] if self.measurement else 0.0
        zero = F.lit(0.0)
        start = p[self.var0] if isinstance(self.var0, str) else self.var0
        blank = {"mean": zero, "f": zero, "v": zero, "ll": zero, "a": _array([0.0] * m), "p": _array([0.0] * len(self._pairs())), "fa": _array([self.mean0] * m), "fp": _array([start if i == j else 0.0 for i, j in self._pairs()])}
        pack = lambda fields: F.struct(*(c.alias(k) for k, c in fields.items()))

        def step(s: Column, o: Column) -> Column:
            t, q, z = self._transition(o, p), self._noise(o, p), self._loading(o)
            moved = _array([_sum([_product(t[i][k], F.get(s["fa"], F.lit(k))) for k in n]) for i in n])

            def predicted(a: Column, big: Column) -> Column:
                pz = [_sum([_product(self._get(big, i, k), z[k]) for k in n]) for i in n]
                first = F.struct(_array(pz).alias("pz"), _column(_sum([_product(z[i], F.get(a, F.lit(i))) for i in n])).alias("mean"))
                return let(first, lambda e: seen(a, big, e))

            def seen(a: Column, big: Column, e: Column) -> Column:
                f = _column(_sum([*(_product(z[i], F.get(e["pz"], F.lit(i))) for i in n), h]))
                return let(F.struct(f.alias("f"), (o["y"] - e["mean"]).alias("v"), F.when((o["y"] - e["mean"]).isNotNull() & f.isNotNull() & (f > 0), 1 / f).alias("g")), lambda w: updated(a, big, e, w))

            def updated(a: Column, big: Column, e: Column, w: Column) -> Column:
                use = w["g"].isNotNull()
                fa = F.when(use, F.zip_with(a, e["pz"], lambda x, k: x + k * w["g"] * w["v"])).otherwise(a)
                fp = F.when(use, _array([self._get(big, i, j) - F.get(e["pz"], F.lit(i)) * F.get(e["pz"], F.lit(j)) * w["g"] for i, j in self._pairs()])).otherwise(big)
                ll = F.when(use, F.lit(-0.5) * (F.ln(F.lit(2 * math.pi) * w["f"]) + w["v"] * w["v"] * w["g"])).otherwise(F.lit(0.0))
                return pack({"mean": e["mean"], "f": w["f"], "v": F.when(use, w["v"]), "ll": ll, "a": a, "p": big, "fa": fa, "fp": fp})

            return let(moved, lambda a: self._through(s["fp"], t, q, lambda big: predicted(a, big)))

        return scan(path, pack(blank), step, lambda s: s)

    def smooth(self, path: Column, filtered: Column, p: Parameters) -> Column:
        """array of struct(mean, variance, a, p): the states given the whole path, and what is seen of them without its
        error, by a fold backwards over what filter() gave."""
        n, m = range(self.size), self.size
        pairs = self._pairs()
        both = F.zip_with(path, filtered, lambda o, s: F.struct(o.alias("o"), s.alias("s")))
        # a step back passes the transition of the step after it
        after = F.concat(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.greatest(F.size(path), F.lit(1)), 1))
        both = F.zip_with(both, after, lambda b, o: F.struct(b["o"].alias("o"), b["s"].alias("s"), o.alias("next")))
        blank = F.struct(_array([0.0] * m).alias("r"), _array([0.0] * len(pairs)).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"), _array([0.0] * m).alias("a"), _array([0.0] * len(pairs)).alias("p"))

        def step(acc: Column, e: Column) -> Column:
            z, t = self._loading(e["o"]), self._transition(e["next"], p)
            back = [[t[j][i] for j in n] for i in n]
            u = _array([_sum([_product(back[i][k], F.get(acc["r"], F.lit(k))) for k in n]) for i in n])
            pz = _array([_sum([_product(self._get(e["s"]["p"], i, k), z[k]) for k in n]) for i in n])
            g = F.when(e["s"]["v"].isNotNull(), 1 / e["s"]["f"])
            return self._through(acc["n"], back, None, lambda big: let(F.struct(u.alias("u"), pz.alias("pz"), g.alias("g")), lambda w: gains(e, z, big, w)))

        def gains(e: Column, z: list[Entry], big: Column, w: Column) -> Column:
            turned = _array([_sum([_product(self._get(big, i, k), F.get(w["pz"], F.lit(k))) for k in n]) for i in n])
            pull = _column(_sum([F.get(w["pz"], F.lit(i)) * F.get(w["u"], F.lit(i)) for i in n]))
            return let(F.struct(turned.alias("w"), ((e["s"]["v"] - pull) * w["g"]).alias("k")), lambda x: backward(e, z, big, w, x))

        def backward(e: Column, z: list[Entry], big: Column, w: Column, x: Column) -> Column:
            use = w["g"].isNotNull()
            twice = _column(_sum([F.get(w["pz"], F.lit(i)) * F.get(x["w"], F.lit(i)) for i in n]))
            r = F.when(use, _array([_sum([F.get(w["u"], F.lit(i)), _product(z[i], x["k"])]) for i in n])).otherwise(w["u"])
            entries = [
                _sum([self._get(big, i, j), _product(_product(z[i], z[j]), w["g"] + twice * w["g"] * w["g"]), _product(z[i], -F.get(x["w"], F.lit(j)) * w["g"]), _product(z[j], -F.get(x["w"], F.lit(i)) * w["g"])])
                for i, j in pairs
            ]
            return let(F.struct(r.alias("r"), F.when(use, _array(entries)).otherwise(big).alias("n")), lambda y: smoothed(e, z, y))

        def smoothed(e: Column, z: list[Entry], y: Column) -> Column:
            big = [[self._get(e["s"]["p"], i, j) for j in n] for i in n]
            a = _array([F.get(e["s"]["a"], F.lit(i)) + _column(_sum([big[i][k] * F.get(y["r"], F.lit(k)) for k in n])) for i in n])
            return let(a, lambda a_: self._through(y["n"], big, None, lambda lost: out(e, z, y, a_, lost)))

        def out(e: Column, z: list[Entry], y: Column, a: Column, lost: Column) -> Column:
            left = F.zip_with(e["s"]["p"], lost, lambda q, w: q - w)
            mean = _column(_sum([_product(z[i], F.get(a, F.lit(i))) for i in n]))
            return let(left, lambda v: F.struct(y["r"].alias("r"), y["n"].alias("n"), mean.alias("mean"), _column(_sum([_product(_product(z[i], z[j]), self._get(v, i, j)) for i in n for j in n])).alias("variance"), a.alias("a"), v.alias("p")))

        back = scan(F.reverse(both), blank, step, lambda s: F.struct(s["mean"].alias("mean"), s["variance"].alias("variance"), s["a"].alias("a"), s["p"].alias("p")))
        return F.reverse(back)


def _off(component, name: str) -> bool:
    has = getattr(component, "innovations", None)
    return has is not None and not has[component.names().index(name)]


def steps(series: DataFrame, keys: Sequence[str], y: str = "y", covariates: Sequence[str] = ()) -> DataFrame:
    """(keys, path): a row a series, its steps in order of pos; y is null where a step is to be foretold."""
    x = F.array(*(F.col(c).cast("double") for c in covariates)) if covariates else F.array().cast("array<double>")
    rows = F.array_sort(F.collect_list(F.struct(F.col(POS).cast("long").alias("pos"), F.col(y).cast("double").alias("y"), x.alias("x"))))
    return series.groupBy(*keys).agg(rows.alias("path"))


def filtered(paths: DataFrame, keys: Sequence[str], model: StateSpace, p: Parameters) -> DataFrame:
    """(keys, pos, y, mean, f, v, ll, a, p, fa, fp): one row a step, see StateSpace.filter."""
    held = paths.select(*keys, F.explode(F.arrays_zip(F.col("path"), model.filter(F.col("path"), p).alias("out"))).alias("_step"))
    return held.select(*keys, "_step.path.pos", "_step.path.y", "_step.out.*")


def smoothed(paths: DataFrame, keys: Sequence[str], model: StateSpace, p: Parameters) -> DataFrame:
    """(keys, pos, y, mean, variance, a, p): one row a step, see StateSpace.smooth."""
    both = let(model.filter(F.col("path"), p), lambda f: model.smooth(F.col("path"), f, p))
    held = paths.select(*keys, F.explode(F.arrays_zip(F.col("path"), both.alias("out"))).alias("_step"))
    return held.select(*keys, "_step.path.pos", "_step.path.y", "_step.out.*")


def likelihoods(paths: DataFrame, keys: Sequence[str], model: StateSpace, grid: DataFrame, prior: Column | None = None) -> DataFrame:
    """(keys, the grid's columns, loglik): the log likelihood of each series under each row of a grid of parameters, plus
    the log prior where one is stated.  The grid is broadcast; work is series x grid, linear in the steps."""
    at = paths.crossJoin(F.broadcast(grid))
    ll = F.aggregate(model.filter(F.col("path"), {n: F.col(n) for n in model.parameters() if n in grid.columns}), F.lit(0.0), lambda s, e: s + e["ll"])
    return at.select(*keys, *grid.columns, (ll if prior is None else ll + prior).alias("loglik"))


def most_likely(found: DataFrame, keys: Sequence[str], parameters: Sequence[str]) -> DataFrame:
    """The grid's best row for each series; ties to the smaller parameters."""
    best = F.max(F.struct("loglik", *((-F.col(n)).alias(n) for n in parameters))).alias("_best")
    return found.groupBy(*keys).agg(best).select(*keys, *((-F.col(f"_best.{n}")).alias(n) for n in parameters), "_best.loglik")


def posterior(found: DataFrame, keys: Sequence[str], parameters: Sequence[str]) -> DataFrame:
    """found with weight: the posterior of the grid's rows, which sums to 1 by series."""
    top = found.groupBy(*keys).agg(F.max("loglik").alias("_top"))
    raised = found.join(top, list(keys)).withColumn("_w", F.exp(F.col("loglik") - F.col("_top")))
    total = raised.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    return raised.join(total, list(keys)).select(*keys, *parameters, "loglik", (F.col("_w") / F.col("_total")).alias("weight"))


def forecast(paths: DataFrame, keys: Sequence[str], model: StateSpace, weights: DataFrame) -> DataFrame:
    """(keys, pos, mean, variance) of the unseen steps, averaged over a posterior of parameters (keys, parameters,
    weight): the mean's own spread between parameters is part of the variance."""
    names = [n for n in model.parameters() if n in weights.columns]
    at = paths.join(weights.select(*keys, *names, "weight"), list(keys))
    ahead = filtered(at, [*keys, "weight", *names], model, {n: F.col(n) for n in names}).filter("y is null")
    by = ahead.groupBy(*keys, "pos").agg(F.sum(F.col("weight") * F.col("mean")).alias("mean"), F.sum(F.col("weight") * (F.col("f") + F.col("mean") * F.col("mean"))).alias("_s"))
    return by.select(*keys, "pos", "mean", (F.col("_s") - F.col("mean") * F.col("mean")).alias("variance"))

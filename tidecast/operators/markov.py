"""Markov paths as Column folds: a state of one's own, innovations and covariates of each step, seeded draw by draw."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.functions.rng import key_of, normal
from tidecast.names import POS, SAMPLE_DIMS
from tidecast.operators.folds import scan

#: state (a struct), step (pos, the covariates by name, e: innovations) -> the next state, by name.
Transition = Callable[[Column, Column], Mapping[str, Column]]


def horizon_paths(steps: DataFrame, keys: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """(keys, _path): each series' steps in order of pos, with their covariates, in one array as long as the horizon."""
    row = F.struct(F.col(POS).cast("long").alias("pos"), *(F.col(c).cast("double").alias(c) for c in covariates))
    return steps.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_path"))


def paths(draws: DataFrame, steps: DataFrame, init: Mapping[str, Column], transition: Transition, seed: int, name: str, keys: Sequence[str] = (), covariates: Sequence[str] = (), innovations: int = 1, series: Sequence[str] = ()) -> DataFrame:
    """(series, chain, draw, pos, the state's columns): every draw's path over the steps.

    draws has chain, draw, the keys among its columns that `series` names, and whatever init and transition use; init
    gives the state before the first step, Columns of that row, so a path goes on from where another ended (see last).
    steps has pos, keys and covariates; keys that draws lack cross with them.  Each innovation is a standard normal
    function of seed, name, chain, draw, series, pos and its number, so neither the horizon nor partitions change it.
    A covariate that is null raises: covariates must cover the steps.
    """
    if steps.filter(" or ".join(f"`{c}` is null" for c in (*covariates, POS))).limit(1).count():
        raise AlignmentError("the covariates don't cover the steps")
    held = horizon_paths(steps, keys, covariates)
    own = [k for k in keys if k in draws.columns]
    at = draws.join(held, own) if own else draws.crossJoin(held)
    everything = list(dict.fromkeys([*series, *keys]))
    parts = (F.col("chain"), F.col("draw"), *(F.col(k) for k in everything))
    fresh = F.transform("_path", lambda s: s.withField("e", F.array(*(normal(key_of(seed, f"{name}{i}", *parts, s["pos"])) for i in range(innovations)))))

    def step(state: Column, s: Column) -> Column:
        now = transition(state, s)
        return F.struct(s["pos"].alias("pos"), *(now[n].cast("double").alias(n) for n in init))

    start = F.struct(F.lit(-1).cast("long").alias("pos"), *(c.cast("double").alias(n) for n, c in init.items()))
    out = at.select(*everything, *SAMPLE_DIMS, F.explode(scan(fresh, start, step, lambda s: s)).alias("_at"))
    return out.select(*everything, *SAMPLE_DIMS, F.col("_at.pos").alias(POS), *(F.col(f"_at.{n}") for n in init))


def last(found: DataFrame, state: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, chain, draw, state): where each path ended, which is what a horizon is seeded with."""
    return found.groupBy(*keys, *SAMPLE_DIMS).agg(F.max_by(F.struct(*state), F.col(POS)).alias("_last")).select(*keys, *SAMPLE_DIMS, "_last.*")

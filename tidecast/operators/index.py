"""Time indices: extension by a horizon, concatenation of later labels, the split at t_obs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.names import POS, TIME_DIM


@dataclass(frozen=True)
class Horizon:
    """t_obs observed steps and `future` steps after them."""

    t_obs: int
    future: int = 0

    @property
    def duration(self) -> int:
        return self.t_obs + self.future

    @classmethod
    def of(cls, data: DataFrame | None, covariates: DataFrame) -> Horizon:
        """From the lengths of both; without data every covariate step counts as observed."""
        total = covariates.select(POS).distinct().count()
        seen = total if data is None else data.select(POS).distinct().count()
        if seen > total:
            raise AlignmentError("the covariates are shorter than the data")
        return cls(seen, total - seen)

    def split(self, df: DataFrame) -> DataFrame:
        return df.withColumn("is_future", F.col(POS) >= self.t_obs)


#: A freq's step, or its count of months.
STEPS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}
MONTHS = {"month": 1, "month_end": 1, "quarter": 3, "year": 12}


def extend_time_index(index: DataFrame, horizon: int, freq: str | None = None, time: str = TIME_DIM) -> DataFrame:
    """index (time, pos) with `horizon` steps more.

    Numbers must be evenly spaced (1 apart where there are fewer than two).  Dates and timestamps step by freq: "second",
    "minute", "hour", "day", "week", "month", "month_end", "quarter", "year", or a count of one of these ("6 hours").
    Without freq the step is found from the data: one length of time, or else one count of months between equal days
    of the month at equal times of day, or between last days.  The time of day stays.
    """
    if horizon < 0:
        raise AlignmentError("a horizon can't be negative")
    if horizon == 0:
        return index.select(time, POS)
    kind = dict(index.dtypes)[time]
    at, before = F.col(time), F.lag(time).over(Window.orderBy(POS))
    dated = kind.startswith(("date", "timestamp"))
    columns = {"_d": at - before}
    if dated:
        months = F.year(at) * 12 + F.month(at)
        columns |= {"_m": months - F.lag(months).over(Window.orderBy(POS)), "_day": F.dayofmonth(at), "_end": F.last_day(at) == at.cast("date"), "_clock": at - F.date_trunc("day", at).cast(kind)}
    found = [F.max(time).alias("last"), F.max(POS).alias("n")]
    found += [f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)]
    ends = index.withColumns(columns).agg(*found)
    step, months, month_end = F.coalesce(F.col("_d_min"), F.lit(1)) if not dated else F.col("_d_min"), None, False
    if freq is None:
        row = ends.first()
        same = lambda c: row[f"{c}_min"] is not None and row[f"{c}_min"] == row[f"{c}_max"]
        if dated and row["_d_min"] is None:
            raise AlignmentError("one date has no step; state freq")
        if row["_d_min"] != row["_d_max"]:
            if not dated:
                raise AlignmentError("the steps are uneven")
            month_end = row["_end_min"] is True
            if not (same("_m") and row["_m_min"] > 0 and same("_clock") and (same("_day") or month_end)):
                raise AlignmentError("the steps are uneven; state freq")
            months = row["_m_min"]
    elif dated:
        count, _, unit = freq.rpartition(" ")
        unit, count = unit.removesuffix("s") if count else unit, count or "1"
        if not count.isdigit() or unit not in STEPS | MONTHS:
            raise AlignmentError(f"unknown freq {freq!r}")
        month_end = unit == "month_end"
        if unit in MONTHS:
            months = int(count) * MONTHS[unit]
        else:
            step = F.expr(f"interval {STEPS[unit]}") * int(count)
    k = F.col("k")
    nxt = F.col("last") + k * step
    if months is not None:
        nxt = F.col("last") + F.make_ym_interval(F.lit(0), (k * months).cast("int"))
        if month_end:
            nxt = F.last_day(nxt).cast(kind) + (F.col("last") - F.date_trunc("day", "last").cast(kind))
    more = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k")).select(nxt.cast(kind).alias(time), (F.col("n") + k).cast("long").alias(POS))
    return index.select(time, POS).unionByName(more)


def concat_time_index(index: DataFrame, future: DataFrame, time: str = TIME_DIM, keys: Sequence[str] = ()) -> DataFrame:
    """index (keys, time, pos) with the labels of future (keys, time, pos from 0) after it, each key's after its own.

    Gaps are fine; anything out of order raises, and so does a key of future that index lacks.
    """
    if dict(index.dtypes)[time] != dict(future.dtypes)[time]:
        raise AlignmentError("the future's labels are of another type")
    keys = list(keys)
    last = index.groupBy(*keys).agg(F.max(time).alias("_last"), F.max(POS).alias("_n"))
    later = future.withColumn("_b", F.lag(time).over(Window.partitionBy(*keys).orderBy(POS)))
    later = later.join(last, keys, "left") if keys else later.crossJoin(F.broadcast(last))
    state = later.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_last").isNull() | (F.col(time) <= F.col("_b")) | (F.col(time) <= F.col("_last"))).alias("bad")).first()
    if not state["rows"]:
        raise AlignmentError("the future is empty")
    if state["bad"]:
        raise AlignmentError("the future must rise strictly, after the last observed label of its key")
    rest = [c for c in future.columns if c not in (*keys, time, POS) and c in index.columns]
    placed = later.select(*keys, time, (F.col(POS) + F.col("_n") + 1).cast("long").alias(POS), *rest)
    return index.select(*keys, time, POS, *rest).unionByName(placed)


def concat_covariates(covariates: DataFrame, future: DataFrame, names: Sequence[str], future_names: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """covariates with future rows after them, each key's after its own: the same names in the same order, never
    aligned, reordered or filled."""
    if list(names) != list(names if future_names is None else future_names) or not set(names) <= set(future.columns):
        raise AlignmentError("the future's covariates differ in name or order")
    own = [*keys, TIME_DIM, POS, *names]
    whole = concat_time_index(covariates.select(*own), future.select(*own), keys=keys)
    return whole.select(*keys, TIME_DIM, POS, *names)

"""Registered queries of state-space models, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.catalog import DAILY, HORIZON, MONTHS, T_OBS, daily, nation_months, query, rounded
from tidecast.names import POS
from tidecast.operators import state_space

#: Months ahead, and the variances of the level, the trend and the measurement.
AHEAD, LEVEL, TREND, OBS, START = 6, 0.5, 0.01, 8.0, 1000.0
MODEL = state_space.StateSpace([state_space.LevelTrend(2), state_space.Regression(1)], var0=START)
FIXED = {"level_0": LEVEL, "level_1": TREND, "obs": OBS}


def month_paths(spark, d):
    """(nation, path): orders a month of each nation, null in months without any and in those ahead; x is 1 at a quarter's end."""
    seen = nation_months(spark, d)
    ends = seen.groupBy("nation").agg(F.min(POS).alias("lo"))
    last = seen.agg((F.max(POS) + AHEAD).alias("hi"))
    spine = ends.crossJoin(F.broadcast(last)).select("nation", F.explode(F.sequence("lo", "hi")).alias(POS))
    x = F.when(F.col(POS) % 3 == 2, 1.0).otherwise(0.0)
    return state_space.steps(spine.join(seen.select("nation", POS, "y"), ["nation", POS], "left").withColumn("x", x), ["nation"], covariates=["x"])


PATHS = f"""{MONTHS}, sp AS (SELECT nation, unnest(generate_series(min(pos), (SELECT max(pos) FROM om) + {AHEAD})) AS pos FROM om GROUP BY nation),
o AS MATERIALIZED (SELECT nation, sp.pos::BIGINT AS pos, row_number() OVER (PARTITION BY nation ORDER BY sp.pos) AS k, om.y, CASE WHEN sp.pos % 3 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM sp LEFT JOIN om USING (nation, pos))"""


def filter_sql(by: str = "nation", level: str = f"{LEVEL}::DOUBLE", trend: str = f"{TREND}::DOUBLE", obs: str = f"{OBS}::DOUBLE", grid: str = "") -> str:
    """The recursive twin of level, trend and one coefficient: f has the steps' expectations and filtered states."""
    g = f", {grid}" if grid else ""
    p = f"e0 + 2 * e1 + e3 + {level} AS p0, e1 + e3 AS p1, e2 + e4 AS p2, e3 + {trend} AS p3, e4 AS p4, e5 AS p5"
    moved = f"SELECT {by}{g}, k, c0 + c1 AS a0, c1 AS a1, c2 AS a2, {p} FROM f"
    seen = f"SELECT m.*, o.pos, o.y, o.x, p0 + x * p2 AS z0, p1 + x * p4 AS z1, p2 + x * p5 AS z2, a0 + x * a2 AS mean FROM ({moved}) m JOIN o ON o.nation = m.nation AND o.k = m.k + 1"
    var = f"SELECT *, z0 + x * z2 + {obs} AS f, y - mean AS v FROM ({seen})"
    gain = "SELECT *, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE 1 / f END AS g, coalesce(v, 0.0::DOUBLE) AS w FROM (" + var + ")"
    return f"""f AS (SELECT DISTINCT {by}{g}, 0::BIGINT AS k, NULL::BIGINT AS pos, NULL::DOUBLE AS y, 0.0::DOUBLE AS x, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS f, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2,
   0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS p3, 0.0::DOUBLE AS p4, 0.0::DOUBLE AS p5, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2,
   {START}::DOUBLE AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2, {START}::DOUBLE AS e3, 0.0::DOUBLE AS e4, {START}::DOUBLE AS e5 FROM o{", grid" if grid else ""}
 UNION ALL SELECT {by}{g}, k + 1, pos, y, x, mean, f, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE -0.5 * (ln(2 * pi() * f) + v * v / f) END, a0, a1, a2, p0, p1, p2, p3, p4, p5, a0 + z0 * g * w, a1 + z1 * g * w, a2 + z2 * g * w,
   p0 - z0 * z0 * g, p1 - z0 * z1 * g, p2 - z0 * z2 * g, p3 - z1 * z1 * g, p4 - z1 * z2 * g, p5 - z2 * z2 * g FROM ({gain}))"""


@query(f"""WITH RECURSIVE {PATHS}, {filter_sql()} SELECT nation, pos, y, round(mean, 6) + 0.0 AS mean, round(f, 6) + 0.0 AS variance, round(ll, 6) + 0.0 AS loglik, round(c0, 6) + 0.0 AS level, round(c1, 6) + 0.0 AS trend, round(c2, 6) + 0.0 AS coef FROM f WHERE k > 0""")
def state_space_filter(spark, d):
    """Level, trend and a quarter's end in the monthly orders of each nation, as known after each month."""
    out = state_space.filtered(month_paths(spark, d), ["nation"], MODEL, FIXED)
    state = lambda i, n: rounded(F.get("fa", F.lit(i))).alias(n)
    return out.select("nation", POS, "y", rounded("mean").alias("mean"), rounded("f").alias("variance"), rounded("ll").alias("loglik"), state(0, "level"), state(1, "trend"), state(2, "coef"))


SMOOTH = """n AS (SELECT nation, max(k) AS n FROM o GROUP BY 1),
s AS (SELECT nation, n + 1 AS k, NULL::BIGINT AS pos, 0.0::DOUBLE AS x, 0.0::DOUBLE AS r0, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 0.0::DOUBLE AS n0, 0.0::DOUBLE AS n1, 0.0::DOUBLE AS n2, 0.0::DOUBLE AS n3, 0.0::DOUBLE AS n4, 0.0::DOUBLE AS n5,
   0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS p3, 0.0::DOUBLE AS p4, 0.0::DOUBLE AS p5 FROM n
 UNION ALL SELECT nation, k, pos, x, u0 + h * w0, u1, u2 + x * h * w0, CASE WHEN y IS NULL THEN m0 ELSE m0 + q - 2 * t0 * g END, CASE WHEN y IS NULL THEN m1 ELSE m1 - t1 * g END, CASE WHEN y IS NULL THEN m2 ELSE m2 + x * q - t2 * g - x * t0 * g END,
   m3, CASE WHEN y IS NULL THEN m4 ELSE m4 - x * t1 * g END, CASE WHEN y IS NULL THEN m5 ELSE m5 + x * x * q - 2 * x * t2 * g END, a0, a1, a2, p0, p1, p2, p3, p4, p5
 FROM (SELECT *, g + (z0 * t0 + z1 * t1 + z2 * t2) * g * g AS q, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS w0, coalesce((y - mean - z0 * u0 - z1 * u1 - z2 * u2) * g, 0.0::DOUBLE) AS h
 FROM (SELECT *, m0 * z0 + m1 * z1 + m2 * z2 AS t0, m1 * z0 + m3 * z1 + m4 * z2 AS t1, m2 * z0 + m4 * z1 + m5 * z2 AS t2
 FROM (SELECT s.nation, f.k, f.pos, f.x, f.y, f.mean, 1 / f.f AS g, s.r0 AS u0, s.r0 + s.r1 AS u1, s.r2 AS u2, s.n0 AS m0, s.n0 + s.n1 AS m1, s.n2 AS m2, s.n0 + 2 * s.n1 + s.n3 AS m3, s.n2 + s.n4 AS m4, s.n5 AS m5,
   f.p0 + f.x * f.p2 AS z0, f.p1 + f.x * f.p4 AS z1, f.p2 + f.x * f.p5 AS z2, f.a0, f.a1, f.a2, f.p0, f.p1, f.p2, f.p3, f.p4, f.p5 FROM s JOIN ff f ON f.nation = s.nation AND f.k = s.k - 1 AND f.k > 0)))),
b AS (SELECT *, p0 * r0 + p1 * r1 + p2 * r2 + a0 AS l, p1 * r0 + p3 * r1 + p4 * r2 + a1 AS t, p2 * r0 + p4 * r1 + p5 * r2 + a2 AS c,
   p0 - (p0 * (n0 * p0 + n1 * p1 + n2 * p2) + p1 * (n1 * p0 + n3 * p1 + n4 * p2) + p2 * (n2 * p0 + n4 * p1 + n5 * p2)) AS v FROM s WHERE pos IS NOT NULL)"""


@query(f"""WITH RECURSIVE {PATHS}, {filter_sql()}, ff AS MATERIALIZED (SELECT * FROM f), {SMOOTH}
SELECT nation, pos, round(l, 6) + 0.0 AS level, round(t, 6) + 0.0 AS trend, round(c, 6) + 0.0 AS coef, round(v, 6) + 0.0 AS level_variance, round(l + x * c, 6) + 0.0 AS mean FROM b""")
def state_space_smoothed(spark, d):
    """The same states given all months, by a fold backwards."""
    out = state_space.smoothed(month_paths(spark, d), ["nation"], MODEL, FIXED)
    state = lambda i, n: rounded(F.get("a", F.lit(i))).alias(n)
    return out.select("nation", POS, state(0, "level"), state(1, "trend"), state(2, "coef"), rounded(F.get("p", F.lit(0))).alias("level_variance"), rounded("mean").alias("mean"))


GRID = [(lv, tr, ob) for lv in (0.05, 0.5, 5.0) for tr in (0.0001, 0.01) for ob in (2.0, 8.0, 32.0)]
GRIDS = f"grid AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in GRID)}) v(level_0, level_1, obs))"
LIKELIHOODS = f"""{PATHS}, {GRIDS}, {filter_sql(level="level_0", trend="level_1", obs="obs", grid="level_0, level_1, obs")},
lk AS MATERIALIZED (SELECT nation, level_0, level_1, obs, sum(ll) AS loglik FROM f GROUP BY ALL)"""


def month_likelihoods(spark, d):
    grid = spark.createDataFrame(GRID, "level_0 double, level_1 double, obs double")
    return state_space.likelihoods(month_paths(spark, d), ["nation"], MODEL, grid)


@query(f"""WITH RECURSIVE {LIKELIHOODS} SELECT nation, level_0, level_1, obs, round(loglik, 5) + 0.0 AS loglik FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY loglik DESC, level_0, level_1, obs) AS r FROM lk) WHERE r = 1""")
def state_space_most_likely(spark, d):
    """The variances of a grid under which each nation's orders are most likely."""
    return state_space.most_likely(month_likelihoods(spark, d), ["nation"], ["level_0", "level_1", "obs"]).withColumn("loglik", rounded("loglik", 5))


@query(f"""WITH RECURSIVE {LIKELIHOODS}, w AS (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY nation)) AS e FROM lk), ww AS (SELECT nation, level_0, level_1, obs, e / sum(e) OVER (PARTITION BY nation) AS weight FROM w)
SELECT nation, pos, round(sum(weight * mean), 5) + 0.0 AS mean, round(sum(weight * (f + mean * mean)) - sum(weight * mean) * sum(weight * mean), 5) + 0.0 AS variance FROM f JOIN ww USING (nation, level_0, level_1, obs) WHERE k > 0 AND y IS NULL GROUP BY ALL""")
def state_space_forecast(spark, d):
    """Months without orders, inside and ahead, averaged over the grid's posterior."""
    found = state_space.posterior(month_likelihoods(spark, d), ["nation"], ["level_0", "level_1", "obs"])
    out = state_space.forecast(month_paths(spark, d), ["nation"], MODEL, found)
    return out.select("nation", POS, rounded("mean", 5).alias("mean"), rounded("variance", 5).alias("variance"))


KERNELS = [(v, c, o) for v in (20.0, 80.0, 320.0) for c in (0.5, 2.0, 8.0) for o in (10.0, 40.0, 160.0)]
KERNEL = state_space.StateSpace([state_space.Decay()], var0="decay_var")
_KEPT = "exp(-1 / decay_scale)"


@query(f"""WITH RECURSIVE {DAILY}, mean AS (SELECT series, avg(y) AS m FROM daily WHERE pos < {T_OBS} GROUP BY 1),
o AS MATERIALIZED (SELECT series, pos, CASE WHEN pos < {T_OBS} THEN y - m END AS y, m FROM daily JOIN mean USING (series)),
grid AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in KERNELS)}) v(decay_var, decay_scale, obs)),
f AS (SELECT DISTINCT series, decay_var, decay_scale, obs, -1::BIGINT AS pos, NULL::DOUBLE AS y, 0.0::DOUBLE AS m, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS f, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS a, decay_var AS p FROM o, grid
 UNION ALL SELECT series, decay_var, decay_scale, obs, pos, y, m, mean, q + obs, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE -0.5 * (ln(2 * pi() * (q + obs)) + (y - mean) * (y - mean) / (q + obs)) END, CASE WHEN y IS NULL THEN mean ELSE mean + q / (q + obs) * (y - mean) END, CASE WHEN y IS NULL THEN q ELSE q - q * q / (q + obs) END
 FROM (SELECT f.series, decay_var, decay_scale, obs, o.pos, o.y, o.m, {_KEPT} * f.a AS mean, {_KEPT} * {_KEPT} * f.p + decay_var * (1 - {_KEPT} * {_KEPT}) AS q FROM f JOIN o ON o.series = f.series AND o.pos = f.pos + 1)),
lk AS (SELECT series, decay_var, decay_scale, obs, sum(ll) AS loglik FROM f GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY loglik DESC, decay_var, decay_scale, obs) AS r FROM lk) WHERE r = 1)
SELECT series, decay_var, decay_scale, obs, round(loglik, 6) + 0.0 AS loglik, pos, round(m + mean, 6) + 0.0 AS mean, round(f, 6) + 0.0 AS variance FROM f JOIN b USING (series, decay_var, decay_scale, obs) WHERE f.pos >= {T_OBS}""")
def kernel_learned(spark, d):
    """Conditional normals of daily counts about their mean: the exponential kernel that makes each series likeliest."""
    days = daily(spark, d)
    seen = F.col(POS) < T_OBS
    mean = days.filter(seen).groupBy("series").agg(F.avg("y").alias("m"))
    paths = state_space.steps(days.join(mean, "series").withColumn("y", F.when(seen, F.col("y") - F.col("m"))), ["series"])
    grid = spark.createDataFrame(KERNELS, "decay_var double, decay_scale double, obs double")
    names = KERNEL.parameters()
    best = state_space.most_likely(state_space.likelihoods(paths, ["series"], KERNEL, grid), ["series"], names)
    ahead = state_space.filtered(paths.join(best, "series"), ["series", *names, "loglik"], KERNEL, {n: F.col(n) for n in names}).filter("y is null").join(mean, "series")
    return ahead.select("series", *names, rounded("loglik").alias("loglik"), POS, rounded(F.col("m") + F.col("mean")).alias("mean"), rounded("f").alias("variance"))


@query(None)
def structural_forecast(spark, d):
    """A level, a trend and a week's effects in the daily counts, their variances learned on a grid: what 200 paths say."""
    from tidecast.plans import structural

    space = state_space.StateSpace([state_space.LevelTrend(2), state_space.Seasonal(7)], var0=2500.0)
    model = structural.Stated(space, {"level_0": [0.1, 1.0, 10.0], "level_1": [0.0001, 0.01], "season": [0.01, 1.0], "obs": [10.0, 40.0, 160.0]})
    made = structural.StructuralForecaster(model, ["series"]).fit(daily(spark, d).filter(F.col(POS) < T_OBS).select("series", POS, "y"))
    return made.forecast(horizon=HORIZON, num_samples=200).groupBy("series", POS).agg(F.avg("forecast").alias("mean"), F.stddev("forecast").alias("sd"))

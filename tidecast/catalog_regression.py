"""Registered queries of the regressions, each beside its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidecast.catalog import DAILY, MONTHS, PERIOD, T_OBS, daily, nation_months, query, rounded
from tidecast.functions import linalg
from tidecast.names import POS
from tidecast.plans import regression

ROUNDS, POISSON_ROUNDS = 20, 8
def _em_round(r: int) -> str:
    return f"""
d{r} AS (SELECT mo.*, c0, c1, nz, v11 / (v00 * v11 - v01 * v01) AS p00, -v01 / (v00 * v11 - v01 * v01) AS p01, v00 / (v00 * v11 - v01 * v01) AS p11 FROM mo JOIN q{r} USING (region)),
e{r} AS (SELECT *, s00 / nz + p00 AS a00, s01 / nz + p01 AS a01, s11 / nz + p11 AS a11, p00 * c0 + p01 * c1 + b0 / nz AS r0, p01 * c0 + p11 * c1 + b1 / nz AS r1 FROM d{r}),
f{r} AS (SELECT *, a11 / (a00 * a11 - a01 * a01) AS k00, -a01 / (a00 * a11 - a01 * a01) AS k01, a00 / (a00 * a11 - a01 * a01) AS k11 FROM e{r}),
g{r} AS MATERIALIZED (SELECT *, k00 * r0 + k01 * r1 AS m0, k01 * r0 + k11 * r1 AS m1 FROM f{r})"""


def _em_step(r: int) -> str:
    return f"""
q{r + 1} AS MATERIALIZED (SELECT region, avg(m0) AS c0, avg(m1) AS c1, avg(k00 + m0 * m0) - avg(m0) * avg(m0) AS v00, avg(k01 + m0 * m1) - avg(m0) * avg(m1) AS v01, avg(k11 + m1 * m1) - avg(m1) * avg(m1) AS v11,
   sum(yy - 2 * (m0 * b0 + m1 * b1) + s00 * (k00 + m0 * m0) + 2 * s01 * (k01 + m0 * m1) + s11 * (k11 + m1 * m1)) / sum(n) AS nz FROM g{r} GROUP BY region)"""


POOLED = f"""{MONTHS}, mo AS MATERIALIZED (SELECT region, nation, count(*) AS n, count(*)::DOUBLE AS s00, sum(pos / 12.0::DOUBLE) AS s01, sum((pos / 12.0::DOUBLE) * (pos / 12.0::DOUBLE)) AS s11, sum(y) AS b0, sum(y * (pos / 12.0::DOUBLE)) AS b1, sum(y * y) AS yy FROM om GROUP BY ALL),
w AS (SELECT region, sum(s00) + 1e-9 AS s00, sum(s01) AS s01, sum(s11) + 1e-9 AS s11, sum(b0) AS b0, sum(b1) AS b1, sum(yy) AS yy, sum(n) AS n FROM mo GROUP BY 1),
o AS (SELECT *, (s11 * b0 - s01 * b1) / (s00 * s11 - s01 * s01) AS c0, (s00 * b1 - s01 * b0) / (s00 * s11 - s01 * s01) AS c1 FROM w),
q0 AS MATERIALIZED (SELECT region, c0, c1, 1 + c0 * c0 AS v00, 0.0::DOUBLE AS v01, 1 + c1 * c1 AS v11, (yy - c0 * b0 - c1 * b1) / n AS nz FROM o),
{",".join(_em_round(r) + "," + _em_step(r) for r in range(ROUNDS))}, {_em_round(ROUNDS)}"""


@query(f"""WITH {POOLED} SELECT region, nation, n, round(m0, 6) + 0.0 AS base, round(m1, 6) + 0.0 AS trend, round(sqrt(k00), 6) + 0.0 AS base_sd, round(sqrt(k11), 6) + 0.0 AS trend_sd,
round(c0, 6) + 0.0 AS pool_base, round(c1, 6) + 0.0 AS pool_trend, round(nz, 6) + 0.0 AS noise FROM g{ROUNDS}""")
def hierarchical_trend(spark, d):
    """Trends of orders by nation, drawn towards their region's by as much as the data tell that nations are alike."""
    series, pools = regression.pooled(nation_months(spark, d), ["region", "nation"], [F.lit(1.0), F.col(POS) / 12.0], F.col("y"), ["region"], ROUNDS)
    sd = lambda i: rounded(F.sqrt(linalg.at(F.col("cov"), i, i)))
    pools = F.broadcast(pools.select("region", "centre", "noise"))
    return series.join(pools, "region").select(
        "region", "nation", "n", rounded(F.get("coef", F.lit(0))).alias("base"), rounded(F.get("coef", F.lit(1))).alias("trend"), sd(0).alias("base_sd"), sd(1).alias("trend_sd"),
        rounded(F.get("centre", F.lit(0))).alias("pool_base"), rounded(F.get("centre", F.lit(1))).alias("pool_trend"), rounded("noise").alias("noise"),
    )


def solve_sql(name: str, source: str, keep: str, size: int) -> str:
    """CTEs that invert the matrix a{i}_{j} of `source` by steps over pivots; {name} has its entries i{i}_{j}."""
    wide = ", ".join(f"a{i}_{j} AS m{i}_{j}" for i in range(size) for j in range(size)) + ", " + ", ".join(f"{float(i == j)}::DOUBLE AS m{i}_{size + j}" for i in range(size) for j in range(size))
    out, last = [f"{name}_0 AS (SELECT {keep}, {wide} FROM {source})"], f"{name}_0"
    for k in range(size):
        new = lambda i, j: f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * (m{k}_{j} / m{k}_{k})"  # noqa: B023, E731
        out.append(f"{name}_{k + 1} AS (SELECT {keep}, " + ", ".join(f"{new(i, j)} AS m{i}_{j}" for i in range(size) for j in range(2 * size)) + f" FROM {last})")
        last = f"{name}_{k + 1}"
    return ",\n".join(out) + f",\n{name} AS MATERIALIZED (SELECT {keep}, " + ", ".join(f"m{i}_{size + j} AS i{i}_{j}" for i in range(size) for j in range(size)) + f" FROM {last})"


def _sums(x: list[str], w: str = "1.0::DOUBLE") -> str:
    p = range(len(x))
    return ", ".join(f"sum({w} * {x[i]} * {x[j]}) AS a{i}_{j}" for i in p for j in p)


#: Design of daily counts: level, trend, weekend.
WEEKEND = ["1.0::DOUBLE", "(pos / 10.0::DOUBLE)", "(CASE WHEN isodow(time) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"]


def _irls(r: int) -> str:
    x, p = [f"x{i}" for i in range(3)], range(3)
    if r == 0:
        at = "h0 AS (SELECT *, y + 0.5 AS mu FROM dd)"
    else:
        at = f"h{r} AS (SELECT dd.*, exp(least({' + '.join(f'b{i} * x{i}' for i in p)}, 30.0)) AS mu FROM dd JOIN b{r - 1} USING (series))"
    sums = f"s{r} AS MATERIALIZED (SELECT series, {_sums(x, 'mu')}, {', '.join(f'sum(mu * x{i} * (ln(mu) + (y - mu) / mu)) AS r{i}' for i in p)} FROM {f'h{r}'} GROUP BY series)"
    ridge = f"t{r} AS (SELECT * REPLACE ({', '.join(f'a{i}_{i} + 1e-9 AS a{i}_{i}' for i in p)}) FROM s{r})"
    coef = ", ".join(" + ".join(f"i{i}_{j} * r{j}" for j in p) + f" AS b{i}" for i in p)
    return f"{at},\n{sums},\n{ridge},\n{solve_sql(f'v{r}', f't{r}', 'series, r0, r1, r2', 3)},\nb{r} AS MATERIALIZED (SELECT series, {coef}, i0_0, i1_1, i2_2 FROM v{r})"


@query(f"""WITH {DAILY}, dd AS MATERIALIZED (SELECT series, {', '.join(f'{c} AS x{i}' for i, c in enumerate(WEEKEND))}, y FROM daily),
{", ".join(_irls(r) for r in range(POISSON_ROUNDS))}
SELECT series, round(b0, 6) + 0.0 AS base, round(b1, 6) + 0.0 AS trend, round(b2, 6) + 0.0 AS weekend, round(sqrt(i0_0), 6) + 0.0 AS base_se, round(sqrt(i1_1), 6) + 0.0 AS trend_se, round(sqrt(i2_2), 6) + 0.0 AS weekend_se FROM b{POISSON_ROUNDS - 1}""")
def poisson_regression(spark, d):
    """Daily counts of each event type by level, trend and weekend, with a log link."""
    weekend = F.when(F.weekday("time") >= 5, 1.0).otherwise(0.0)
    fit = regression.poisson(daily(spark, d), ["series"], [F.lit(1.0), F.col(POS) / 10.0, weekend], F.col("y"), POISSON_ROUNDS)
    names = ("base", "trend", "weekend")
    return fit.select("series", *(rounded(F.get("coef", F.lit(i))).alias(n) for i, n in enumerate(names)), *(rounded(F.get("se", F.lit(i))).alias(f"{n}_se") for i, n in enumerate(names)))


#: Design of the conjugate fits: level, trend, and a week's first harmonic.
FOURIER = ["1.0::DOUBLE", "(pos / 10.0::DOUBLE)", f"sin(2 * pi() * pos / {PERIOD})", f"cos(2 * pi() * pos / {PERIOD})"]
PRECISION, SHAPE, RATE = (1e-2, 1e-1, 1e-1, 1e-1), 1.5, 2.0


def _fourier():
    turn = F.lit(2 * math.pi) * F.col(POS) / PERIOD
    return [F.lit(1.0), F.col(POS) / 10.0, F.sin(turn), F.cos(turn)]


def conjugate_fit(spark, d):
    return regression.conjugate(daily(spark, d).filter(F.col(POS) < T_OBS), ["series"], _fourier(), F.col("y"), PRECISION, None, SHAPE, RATE)


_P = range(4)
CONJUGATE = f"""{DAILY}, dd AS (SELECT series, {', '.join(f'{c} AS x{i}' for i, c in enumerate(FOURIER))}, y FROM daily WHERE pos < {T_OBS}),
s AS (SELECT series, count(*) AS n, sum(y * y) AS yy, {_sums([f'x{i}' for i in _P])}, {', '.join(f'sum(x{i} * y) AS r{i}' for i in _P)} FROM dd GROUP BY series),
t AS (SELECT * REPLACE ({', '.join(f'a{i}_{i} + {PRECISION[i]} AS a{i}_{i}' for i in _P)}) FROM s),
{solve_sql('v', 't', 'series, n, yy, r0, r1, r2, r3', 4)},
cj AS (SELECT *, {', '.join(' + '.join(f'i{i}_{j} * r{j}' for j in _P) + f' AS b{i}' for i in _P)}, {SHAPE} + n / 2.0::DOUBLE AS shape FROM v),
ck AS (SELECT *, {RATE} + 0.5 * (yy - ({' + '.join(f'b{i} * r{i}' for i in _P)})) AS rate FROM cj)"""


@query(f"""WITH {CONJUGATE} SELECT series, k AS term, round(CASE k {' '.join(f'WHEN {i} THEN b{i}' for i in _P)} END, 6) + 0.0 AS coef, round(sqrt(CASE k {' '.join(f'WHEN {i} THEN i{i}_{i}' for i in _P)} END * rate / (shape - 1)), 6) + 0.0 AS sd,
round(rate / (shape - 1), 6) + 0.0 AS noise FROM ck, range(4) g(k)""")
def conjugate_fourier(spark, d):
    """Posterior of trend and weekly terms, noise variance unknown."""
    noise = F.col("rate") / (F.col("shape") - 1)
    fit = conjugate_fit(spark, d).select("series", "cov", noise.alias("noise"), F.posexplode("coef").alias("term", "coef"))
    sd = F.sqrt(F.get(F.get("cov", F.col("term")), F.col("term")) * F.col("noise"))
    return fit.select("series", F.col("term").cast("long").alias("term"), rounded("coef").alias("coef"), rounded(sd).alias("sd"), rounded("noise").alias("noise"))


@query(f"""WITH {CONJUGATE}, fx AS (SELECT pos, {', '.join(f'{c} AS x{i}' for i, c in enumerate(FOURIER))} FROM (SELECT DISTINCT pos FROM daily WHERE pos >= {T_OBS}))
SELECT series, pos, round({' + '.join(f'b{i} * x{i}' for i in _P)}, 6) + 0.0 AS mean, round(sqrt(rate / shape * (1 + {' + '.join(f'x{i} * i{i}_{j} * x{j}' for i in _P for j in _P)})), 6) + 0.0 AS scale, 2 * shape AS df FROM ck, fx""")
def conjugate_forecast(spark, d):
    """Student's t of the days ahead under conjugate_fourier's posterior."""
    steps = daily(spark, d).filter(F.col(POS) >= T_OBS).select(POS).distinct()
    ahead = regression.predictive(conjugate_fit(spark, d), steps, ["series"], _fourier())
    return ahead.select("series", POS, rounded("mean").alias("mean"), rounded("scale").alias("scale"), "df")


@query(f"""WITH {CONJUGATE}, {", ".join(solve_sql(f'u{k}', f'(SELECT series, n, yy, shape, rate, {", ".join(f"a{i}_{j}" for i in range(k) for j in range(k))}, {", ".join(f"r{i}" for i in range(k))} FROM t JOIN (SELECT series, shape, rate FROM ck) USING (series))', "series, n, yy, " + ", ".join(f"r{i}" for i in range(k)) + ", " + ", ".join(f"a{i}_{i}" for i in range(k)), k) for k in (2,))},
e2 AS (SELECT series, '2' AS model, n, {RATE} + 0.5 * (yy - (r0 * (i0_0 * r0 + i0_1 * r1) + r1 * (i1_0 * r0 + i1_1 * r1))) AS rate, -ln(i0_0 * i1_1 - i0_1 * i1_0) AS logdet, {sum(math.log(x) for x in PRECISION[:2])}::DOUBLE AS prior FROM u2),
e4 AS (SELECT series, '4' AS model, ck.n, ck.rate, ln(v_0.m0_0) + ln(v_1.m1_1) + ln(v_2.m2_2) + ln(v_3.m3_3) AS logdet, {sum(math.log(x) for x in PRECISION)}::DOUBLE AS prior FROM ck JOIN v_0 USING (series) JOIN v_1 USING (series) JOIN v_2 USING (series) JOIN v_3 USING (series)),
le AS (SELECT series, model, {SHAPE * math.log(RATE) - math.lgamma(SHAPE)}::DOUBLE + 0.5 * prior + lgamma({SHAPE} + n / 2.0::DOUBLE) - ({SHAPE} + n / 2.0::DOUBLE) * ln(rate) - 0.5 * logdet - n / 2.0::DOUBLE * ln(2 * pi()) AS x FROM (SELECT series, model, n, rate, logdet, prior FROM e2 UNION ALL SELECT series, model, n, rate, logdet, prior FROM e4))
SELECT series, model, round(x, 6) + 0.0 AS log_evidence FROM le""")
def conjugate_evidence(spark, d):
    """How well a trend alone, and a trend with weekly terms, account for each series: log marginal likelihoods."""
    rows = daily(spark, d).filter(F.col(POS) < T_OBS)
    fits = [regression.conjugate(rows, ["series"], _fourier()[:k], F.col("y"), PRECISION[:k], None, SHAPE, RATE).select("series", F.lit(str(k)).alias("model"), rounded("log_evidence").alias("log_evidence")) for k in (2, 4)]
    return fits[0].union(fits[1])


#: A level and the effects of six weekdays over the seventh's, which is what they leave of 0.
DAYS = ["1.0::DOUBLE"] + [f"(CASE isodow(time) WHEN {k + 1} THEN 1.0::DOUBLE WHEN 7 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END)" for k in range(6)]
_D = range(7)


@query(f"""WITH {DAILY}, dd AS (SELECT series, {', '.join(f'{c} AS x{i}' for i, c in enumerate(DAYS))}, y FROM daily),
s AS (SELECT series, {_sums([f'x{i}' for i in _D])}, {', '.join(f'sum(x{i} * y) AS r{i}' for i in _D)} FROM dd GROUP BY series),
t AS (SELECT * REPLACE ({', '.join(f'a{i}_{i} + 0.01 AS a{i}_{i}' for i in _D)}) FROM s),
{solve_sql('v', 't', 'series, ' + ', '.join(f'r{i}' for i in _D), 7)},
b AS (SELECT series, {', '.join(' + '.join(f'i{i}_{j} * r{j}' for j in _D) + f' AS b{i}' for i in _D)} FROM v)
SELECT series, k AS weekday, round(CASE k {' '.join(f'WHEN {i} THEN b{i + 1}' for i in range(6))} ELSE -({' + '.join(f'b{i}' for i in range(1, 7))}) END, 6) + 0.0 AS effect FROM b, range(7) g(k)""")
def weekday_effects(spark, d):
    """Effects of the weekdays on daily counts, which sum to 0 in each series."""
    day = F.weekday("time")
    columns = [F.lit(1.0), *(F.when(day == k, 1.0).when(day == 6, -1.0).otherwise(0.0) for k in range(6))]
    fit = regression.conjugate(daily(spark, d), ["series"], columns, F.col("y"), [1e-2] * 7)
    effects = F.slice("coef", 2, 6)
    whole = F.concat(effects, F.array(-F.aggregate(effects, F.lit(0.0), lambda s, x: s + x)))
    return fit.select("series", F.posexplode(whole).alias("weekday", "effect")).select("series", F.col("weekday").cast("long").alias("weekday"), rounded("effect").alias("effect"))

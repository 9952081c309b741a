"""Registered queries of Markov paths, backtests from prefix moments, mixing diagnostics and samplers, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.catalog import DAILY, DURATION, POST, T_OBS, _normal_sql, daily, event_days, posterior_draws, query, read, rounded
from tidecast.names import POS
from tidecast.operators import markov, windows


def _step_sql(var: str) -> str:
    key = lambda i: f"concat_ws('|', '13', '{var}{i}', chain::VARCHAR, draw::VARCHAR, f.series, o.pos::VARCHAR)"
    return f"0.9 * slope + 0.05 * {_normal_sql(key(1))}", f"f.level + 0.9 * slope + 0.05 * {_normal_sql(key(1))} + drift * o.x + sigma * {_normal_sql(key(0))}"


_IN, _OUT = _step_sql("seen"), _step_sql("ahead")


@query(f"""WITH RECURSIVE {DAILY}, {POST}, o AS MATERIALIZED (SELECT series, pos, CASE WHEN isodow(time) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM daily),
f AS (SELECT chain, draw, series, -1::BIGINT AS pos, post.level, 0.0::DOUBLE AS slope, drift, sigma FROM post, (SELECT DISTINCT series FROM o)
 UNION ALL SELECT chain, draw, f.series, o.pos, CASE WHEN o.pos < {T_OBS} THEN {_IN[1]} ELSE {_OUT[1]} END, CASE WHEN o.pos < {T_OBS} THEN {_IN[0]} ELSE {_OUT[0]} END, drift, sigma FROM f JOIN o ON o.series = f.series AND o.pos = f.pos + 1)
SELECT series, chain, draw, pos, round(level, 6) + 0.0 AS level, round(slope, 6) + 0.0 AS slope FROM f WHERE pos >= {T_OBS}""")
def markov_covariate_forecast(spark, d):
    """Damped slopes with a weekend effect: in-sample paths of every draw, then a horizon seeded by where each ended."""
    x = F.when(F.weekday("time") >= 5, 1.0).otherwise(0.0)
    steps = daily(spark, d).select("series", POS, x.alias("x"))

    def transition(s, step):
        slope = 0.9 * s["slope"] + 0.05 * F.get(step["e"], F.lit(1))
        return {"level": s["level"] + slope + F.col("drift") * step["x"] + F.col("sigma") * F.get(step["e"], F.lit(0)), "slope": slope}

    parameters = posterior_draws(spark, d)
    seen = markov.paths(parameters, steps.filter(F.col(POS) < T_OBS), {"level": F.col("level"), "slope": F.lit(0.0)}, transition, 13, "seen", ["series"], ["x"], 2)
    ends = markov.last(seen, ["level", "slope"], ["series"]).join(parameters.drop("level", "slope"), ["chain", "draw"])
    out = markov.paths(ends, steps.filter(F.col(POS) >= T_OBS), {"level": F.col("level"), "slope": F.col("slope")}, transition, 13, "ahead", ["series"], ["x"], 2)
    return out.select("series", "chain", "draw", POS, rounded("level").alias("level"), rounded("slope").alias("slope"))


@query(f"""WITH {DAILY}, {DURATION}, w AS (SELECT greatest(k - 12, 0)::BIGINT AS t0, k::BIGINT AS t1, least(k + 4, n)::BIGINT AS t2 FROM n, unnest(generate_series(12, n - 4, 3)) g(k)),
m AS (SELECT series, t0, t1, t2, count(*) AS n, count(*) + 0.001::DOUBLE AS s00, sum(pos)::DOUBLE AS s01, sum(pos * pos) + 0.001::DOUBLE AS s11, sum(y) AS b0, sum(pos * y) AS b1, sum(y * y) AS yy FROM daily JOIN w ON pos >= t0 AND pos < t1 GROUP BY ALL),
c AS (SELECT *, (s11 * b0 - s01 * b1) / (s00 * s11 - s01 * s01) AS c0, (s00 * b1 - s01 * b0) / (s00 * s11 - s01 * s01) AS c1, s11 / (s00 * s11 - s01 * s01) AS k00, -s01 / (s00 * s11 - s01 * s01) AS k01, s00 / (s00 * s11 - s01 * s01) AS k11 FROM m),
e AS (SELECT *, (yy - 2 * (c0 * b0 + c1 * b1) + (s00 - 0.001) * c0 * c0 + 2 * s01 * c0 * c1 + (s11 - 0.001) * c1 * c1) / (n - 2) AS noise FROM c),
p AS (SELECT e.series, t0, t1, t2, d.y - c0 - c1 * d.pos AS err, sqrt(noise * (1 + k00 + 2 * k01 * d.pos + k11 * d.pos * d.pos)) AS sd FROM e JOIN daily d ON d.series = e.series AND d.pos >= t1 AND d.pos < t2)
SELECT t0, t1, t2, round(avg(abs(err)), 6) + 0.0 AS mae, round(sqrt(avg(err * err)), 6) + 0.0 AS rmse, round(avg(-0.5 * ln(2 * pi()) - ln(sd) - 0.5 * err * err / (sd * sd)), 6) + 0.0 AS log_score, count(*) AS n FROM p GROUP BY ALL""")
def backtest_prefix_moments(spark, d):
    """Rolling trends of every event type, all windows from one pass over the days."""
    from tidecast.plans.prefix import backtest_regression

    splits = windows.window_splits(spark, event_days(spark, d), train=12, test=4, min_test=4, stride=3)
    scores, _ = backtest_regression(daily(spark, d), ["series"], [F.lit(1.0), F.col(POS)], F.col("y"), splits, [1e-3, 1e-3])
    return scores.select("t0", "t1", "t2", rounded("mae").alias("mae"), rounded("rmse").alias("rmse"), rounded("log_score").alias("log_score"), "n")


CHAINS = 4


@query(f"""WITH e AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, value + 0.0 AS v FROM events),
c AS (SELECT series, r % {CHAINS} AS chain, r // {CHAINS} AS draw, v FROM e), n AS (SELECT series, min(k) AS n FROM (SELECT series, chain, count(*) AS k FROM c GROUP BY ALL) GROUP BY 1),
x AS MATERIALIZED (SELECT c.series, chain, draw, v, v - avg(v) OVER (PARTITION BY c.series, chain) AS x, n FROM c JOIN n ON n.series = c.series AND draw < n),
lags AS (SELECT a.series, b.draw - a.draw AS k, sum(a.x * b.x) / (any_value(a.n) * {CHAINS}) AS g FROM x a JOIN x b ON b.series = a.series AND b.chain = a.chain AND b.draw >= a.draw GROUP BY ALL),
z AS (SELECT series, g AS zero FROM lags WHERE k = 0), pr AS (SELECT l.series, l.k, (l.g + m.g) / zero AS pair FROM lags l JOIN lags m ON m.series = l.series AND m.k = l.k + 1 JOIN z ON z.series = l.series WHERE l.k % 2 = 0),
stop AS (SELECT series, min(k) AS k FROM pr WHERE pair < 0 GROUP BY 1), tau AS (SELECT pr.series, -1 + 2 * coalesce(sum(pair) FILTER (pr.k < coalesce(stop.k, 1000000000)), 0) AS tau FROM pr LEFT JOIN stop USING (series) GROUP BY 1),
hv AS (SELECT series, chain, draw < n // 2 AS early, avg(v) AS m, var_samp(v) AS s, any_value(n // 2) AS h FROM x WHERE draw < 2 * (n // 2) GROUP BY ALL), rh AS (SELECT series, sqrt(((any_value(h) - 1) / any_value(h)::DOUBLE * avg(s) + var_samp(m)) / avg(s)) AS rhat FROM hv GROUP BY 1)
SELECT series, round(n * {CHAINS} / greatest(tau, 1e-12), 4) + 0.0 AS ess, round(rhat, 6) + 0.0 AS rhat FROM n JOIN tau USING (series) JOIN rh USING (series)""")
def mixing_diagnostics(spark, d):
    """Effective size and split R-hat of each event type's values, dealt to four chains, as lag products without Python."""
    from tidecast.plans.diagnostics import summary

    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    rows = read(spark, d, "events").select(F.col("event_type").alias("series"), rank.alias("r"), "value")
    drawn = rows.select("series", (F.col("r") % CHAINS).alias("chain"), F.floor(F.col("r") / CHAINS).cast("long").alias("draw"), "value")
    return summary(drawn, ["value"], ["series"]).select("series", rounded("ess", 4).alias("ess"), rounded("rhat").alias("rhat"))


def _u(key: str, at: int) -> str:
    return f"((('0x' || substr(md5({key}), {at}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def _gamma_sql(name: str, source: str, key: str, shape: str, tries: int = 24) -> str:
    """CTE `name` (the source's columns, g): Marsaglia's and Tsang's number from the stream of `key`."""
    a = f"(CASE WHEN {shape} < 1 THEN {shape} + 1 ELSE {shape} END)"
    stream = f"{key} || '|' || i::VARCHAR"
    return f"""{name}_c AS (SELECT s.*, i, {a} - 1.0::DOUBLE / 3 AS d_, {_normal_sql(f"({stream})")} AS z_, {_u(f"({stream} || '|u')", 1)} AS u_ FROM {source} s, range({tries}) r(i)),
{name}_v AS (SELECT *, (1 + z_ / sqrt(9 * d_)) ** 3 AS v_ FROM {name}_c),
{name}_f AS (SELECT * FROM {name}_v WHERE CASE WHEN v_ > 0 THEN ln(u_) < 0.5 * z_ * z_ + d_ - d_ * v_ + d_ * ln(v_) ELSE false END),
{name} AS (SELECT * EXCLUDE (i, d_, z_, u_, v_, rn_), d_ * v_ * CASE WHEN {shape} < 1 THEN {_u(f"({key} || '|boost')", 1)} ** (1 / {shape}) ELSE 1 END AS g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn_ FROM {name}_f) WHERE rn_ = 1)"""


@query(f"""WITH s AS (SELECT c_custkey AS id, 0.2::DOUBLE + c_nationkey / 5.0::DOUBLE AS a, 0.5::DOUBLE + abs(c_acctbal) / 2000 AS b FROM customer),
{_gamma_sql('ga', 's', "('3|gamma|' || id::VARCHAR)", 'a')}, {_gamma_sql('gx', 's', "('3|beta|' || id::VARCHAR || '|a')", 'a')}, {_gamma_sql('gy', 's', "('3|beta|' || id::VARCHAR || '|b')", 'b')}
SELECT ga.id, round(ga.g, 6) + 0.0 AS gamma, round(gx.g / (gx.g + gy.g), 6) + 0.0 AS beta FROM ga JOIN gx USING (id) JOIN gy USING (id)""")
def gamma_beta_draws(spark, d):
    """A gamma and a beta number for each customer, of shapes told by its nation and balance."""
    from tidecast.functions import samplers
    from tidecast.functions.rng import key_of

    a, b = F.lit(0.2) + F.col("c_nationkey") / 5.0, F.lit(0.5) + F.abs("c_acctbal") / 2000
    out = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), a.alias("a"), b.alias("b"))
    return out.select("id", rounded(samplers.gamma(key_of(3, "gamma", F.col("id")), F.col("a"))).alias("gamma"), rounded(samplers.beta(key_of(3, "beta", F.col("id")), F.col("a"), F.col("b"))).alias("beta"))


@query(f"""WITH s AS (SELECT c_custkey AS id, exp(c_nationkey / 3.0::DOUBLE - 1) AS lam FROM customer),
small AS (SELECT id, lam, {_u("('3|poisson|' || id::VARCHAR)", 1)} AS u FROM s WHERE lam <= 10),
terms AS (SELECT id, u, k, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER (PARTITION BY id ORDER BY k) AS cdf FROM small, range(65) g(k)),
si AS (SELECT id, min(k)::DOUBLE AS n FROM terms WHERE u <= cdf GROUP BY 1),
big AS (SELECT id, lam, i, {_u("('3|poisson|' || id::VARCHAR || '|' || i::VARCHAR)", 1)} - 0.5 AS u, {_u("('3|poisson|' || id::VARCHAR || '|' || i::VARCHAR)", 9)} AS v, 0.931 + 2.53 * sqrt(lam) AS b FROM s, range(24) r(i) WHERE lam > 10),
bc AS (SELECT *, -0.059 + 0.02483 * b AS a, 1.1239 + 1.1328 / (b - 3.4) AS inv, 0.9277 - 3.6224 / (b - 2) AS top, 0.5 - abs(u) AS us FROM big),
bn AS (SELECT *, floor((2 * a / us + b) * u + lam + 0.43) AS n FROM bc),
bf AS (SELECT id, i, n FROM bn WHERE (us >= 0.07 AND v <= top) OR CASE WHEN n < 0 OR (us < 0.013 AND v > us) THEN false ELSE ln(v * inv / (a / (us * us) + b)) <= n * ln(lam) - lam - lgamma(n + 1) END)
SELECT id, n FROM si UNION ALL SELECT id, arg_min(n, i) FROM bf GROUP BY id""")
def poisson_draws(spark, d):
    """A Poisson count for each customer, of rates from 0.4 to some thousand."""
    from tidecast.functions import samplers
    from tidecast.functions.rng import key_of

    out = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.exp(F.col("c_nationkey") / 3.0 - 1).alias("lam"))
    return out.select("id", samplers.poisson(key_of(3, "poisson", F.col("id")), F.col("lam")).alias("n"))


@query("""WITH RECURSIVE n AS (SELECT event_type AS series, ts::DATE AS day, count(*)::DOUBLE AS y FROM events GROUP BY ALL), w AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events),
sp AS (SELECT series, unnest(generate_series(min(day), (SELECT max(day) FROM n), INTERVAL 1 DAY))::DATE AS day FROM n GROUP BY series),
o AS MATERIALIZED (SELECT series, day, coalesce(y, 0.0)::DOUBLE AS y, row_number() OVER (PARTITION BY series ORDER BY day) AS k FROM sp LEFT JOIN n USING (series, day) WHERE day + INTERVAL 1 DAY <= (SELECT w FROM w)),
f AS (SELECT DISTINCT series, 0::BIGINT AS k, NULL::DATE AS day, 0.0::DOUBLE AS y, 0.0::DOUBLE AS m, 1000000.0::DOUBLE AS p, 0.0::DOUBLE AS ll FROM o UNION ALL
SELECT f.series, o.k, o.day, o.y, f.m + ((f.p + 4) / (f.p + 4 + 25)) * (o.y - f.m), (f.p + 4) * (1 - (f.p + 4) / (f.p + 4 + 25)), -0.5 * (ln(2 * pi() * (f.p + 29)) + (o.y - f.m) * (o.y - f.m) / (f.p + 29)) FROM f JOIN o ON o.series = f.series AND o.k = f.k + 1)
SELECT series, day, y, round(m, 6) + 0.0 AS level, round(p, 6) + 0.0 AS variance, round(ll, 6) + 0.0 AS loglik FROM f WHERE k > 0""")
def streaming_local_level(spark, d):
    """Daily counts of each event type followed as a stream: the days that the watermark has closed."""
    from tidecast.streaming.level import local_level

    out = local_level(spark, f"{d}/events.parquet", 25.0, 4.0)
    return out.select("series", "day", "y", rounded("level").alias("level"), rounded("variance").alias("variance"), rounded("loglik").alias("loglik"))

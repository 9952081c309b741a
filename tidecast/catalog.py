"""Registered queries of the forecasting operators, each beside its SQL twin."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions import features, rng
from tidecast.names import POS
from tidecast.operators import draws, folds, index, metrics, panel, results, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Daily series of the flagship: 23 days to learn from, 7 ahead, weekly period.
T_OBS, HORIZON, PERIOD = 23, 7, 7


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(series, time, pos, y): events a day of each type, dense."""
    counts = read(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("time")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    full = panel.densify(counts, ["series"], "time", "y", "interval 1 day")
    return full.crossJoin(F.broadcast(full.agg(F.min("time").alias("_t0")))).select("series", "time", F.datediff("time", "_t0").cast("long").alias(POS), "y")


DAILY = """ev AS (SELECT event_type AS series, ts::DATE AS time, count(*)::DOUBLE AS y FROM events GROUP BY ALL),
sp AS (SELECT series, unnest(generate_series((SELECT min(time) FROM ev), (SELECT max(time) FROM ev), INTERVAL 1 DAY))::DATE AS time FROM (SELECT DISTINCT series FROM ev)),
daily AS (SELECT series, time, date_diff('day', (SELECT min(time) FROM ev), time)::BIGINT AS pos, coalesce(y, 0.0)::DOUBLE AS y FROM sp LEFT JOIN ev USING (series, time))"""


@query(f"WITH {DAILY} SELECT series, time, pos, y FROM daily")
def series_daily_by_type(spark, d):
    return daily(spark, d)


MONTHS = """om AS (SELECT n_regionkey AS region, n_nationkey AS nation, (date_part('year', o_orderdate) - 1992) * 12 + date_part('month', o_orderdate) - 1 AS pos, count(*)::DOUBLE AS y
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def nation_months(spark, d):
    """(region, nation, pos, y): orders a month since 1992 of each nation."""
    of = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    pos = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("long")
    return read(spark, d, "orders").join(of, F.col("o_custkey") == F.col("c_custkey")).groupBy("region", "nation", pos.alias(POS)).agg(F.count(F.lit(1)).cast("double").alias("y"))


def ship_days(spark, d):
    return panel.as_series(read(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("q")), "day", "q")


@query("""WITH s AS (SELECT l_shipdate::DATE AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1), n AS (SELECT min(day) AS t0, max(day) AS t1 FROM s)
SELECT (date_diff('day', t0, day) // 7)::BIGINT AS block, round(ln(sum(q)), 6) + 0.0 AS log_total FROM s, n
WHERE date_diff('day', t0, day) // 7 < (date_diff('day', t0, t1) + 1) // 7 GROUP BY 1""")
def od_weekly_blocks(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("q"))
    ends = F.broadcast(rows.agg(F.min("day").alias("t0"), F.max("day").alias("t1")))
    block = F.floor(F.datediff("day", "t0") / 7).cast("long")
    whole = F.floor((F.datediff("t1", "t0") + 1) / 7)
    return rows.crossJoin(ends).withColumn("block", block).filter(F.col("block") < whole).groupBy("block").agg(rounded(F.ln(F.sum("q"))).alias("log_total"))


@query("""WITH w AS (SELECT c_nationkey AS nation, (date_diff('day', (SELECT min(o_orderdate::DATE) FROM orders), o_orderdate::DATE) // 7)::BIGINT AS week, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT nation FROM w GROUP BY nation ORDER BY sum(n) DESC, nation LIMIT 8)
SELECT nation, week, round(ln(1 + n), 6) + 0.0 AS log_orders FROM w JOIN t USING (nation)""")
def weekly_topk_series(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    start = F.broadcast(orders.agg(F.min("day").alias("t0")))
    by = orders.join(read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey")).crossJoin(start)
    weeks = by.groupBy("nation", F.floor(F.datediff("day", "t0") / 7).cast("long").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    top = panel.top_k(weeks.groupBy("nation").agg(F.sum("n").alias("total")), [], [F.desc("total"), F.col("nation")], 8)
    return weeks.join(F.broadcast(top.select("nation")), "nation", "left_semi").select("nation", "week", rounded(F.log1p(F.col("n").cast("double"))).alias("log_orders"))


REGION = """rm AS (SELECT r_name AS region, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def region_months(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_totalprice", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("region", "month").agg(F.sum("o_totalprice").alias("y"))


@query(f"""WITH {REGION}, s AS (SELECT region, unnest(generate_series((SELECT min(month) FROM rm), (SELECT max(month) FROM rm), INTERVAL 1 MONTH))::DATE AS month FROM (SELECT DISTINCT region FROM rm))
SELECT region, month, round(coalesce(y, 0), 2) + 0.0 AS y FROM s LEFT JOIN rm USING (region, month)""")
def panel_region_month_dense(spark, d):
    return panel.densify(region_months(spark, d), ["region"], "month", "y", "interval 1 month").withColumn("y", rounded("y", 2))


FLAGS = ["A", "N", "R"]
PIVOT = "p AS (SELECT l_shipdate::DATE AS day, " + ", ".join(f"coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity END), 0.0)::DOUBLE AS {f}" for f in FLAGS) + " FROM lineitem GROUP BY 1)"


@query(f"WITH {PIVOT} SELECT * FROM p")
def panel_pivot_status(spark, d):
    return panel.pivot(read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag", "l_quantity"), "day", "l_returnflag", FLAGS, "l_quantity")


@query(f"WITH {PIVOT} " + " UNION ALL ".join(f"SELECT day, '{f}' AS input, {f} AS value FROM p" for f in FLAGS))
def panel_unpivot(spark, d):
    return panel.unpivot(panel_pivot_status(spark, d), ["day"], FLAGS)


@query("""WITH h AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT * 2 AS time FROM events), i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM h)
SELECT time, pos FROM i UNION ALL SELECT (SELECT max(time) FROM i) + 2 * k, (SELECT max(pos) FROM i) + k FROM generate_series(1, 24) g(k)""")
def extend_index_numeric(spark, d):
    days = read(spark, d, "events").select((F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 2).cast("long").alias("time")).distinct()
    return index.extend_time_index(days.withColumn(POS, (F.row_number().over(Window.orderBy("time")) - 1).cast("long")), 24)


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS time FROM orders), i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM m)
SELECT time, pos FROM i UNION ALL SELECT ((SELECT max(time) FROM i) + to_months(k::INTEGER))::DATE, (SELECT max(pos) FROM i) + k FROM generate_series(1, 6) g(k)""")
def extend_index_monthly(spark, d):
    months = read(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("time")).distinct()
    return index.extend_time_index(months.withColumn(POS, (F.row_number().over(Window.orderBy("time")) - 1).cast("long")), 6, "month")


@query("""WITH t AS (SELECT DISTINCT ts::DATE AS time FROM events), i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM t)
SELECT time, pos FROM i UNION ALL SELECT (SELECT max(time) FROM i) + (k * k)::INTEGER, (SELECT max(pos) FROM i) + k FROM generate_series(1, 5) g(k)""")
def concat_future_gap(spark, d):
    days = read(spark, d, "events").select(F.col("ts").cast("date").alias("time")).distinct()
    seen = days.withColumn(POS, (F.row_number().over(Window.orderBy("time")) - 1).cast("long"))
    later = days.agg(F.max("time").alias("t")).select("t", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select(F.date_add("t", F.col("k") * F.col("k")).alias("time"), (F.col("k") - 1).cast("long").alias(POS))
    return index.concat_time_index(seen, later)


@query("""WITH t AS (SELECT DISTINCT o_orderdate::DATE AS time FROM orders), i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM t), f AS (SELECT min(time) AS t0 FROM i)
SELECT pos, time, (t0 + pos::INTEGER)::DATE AS covariate_time FROM i, f WHERE time IS DISTINCT FROM (t0 + pos::INTEGER)::DATE""")
def alignment_violations(spark, d):
    days = panel.as_series(read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "n")
    even = days.crossJoin(F.broadcast(days.agg(F.min("time").alias("t0")))).select(POS, F.date_add("t0", F.col(POS).cast("int")).alias("time"))
    return panel.alignment_violations(days, even)


HOURS = "h AS (SELECT DISTINCT date_diff('hour', TIMESTAMP '2024-01-01', ts)::BIGINT AS pos FROM events)"


def event_hours(spark, d):
    return read(spark, d, "events").select(F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600).cast("long").alias(POS))


@query(f"WITH {HOURS} SELECT pos, " + ", ".join([f"round(sin(2 * pi() * {k} * pos / 24), 6) + 0.0 AS sin_{k}" for k in range(1, 5)] + [f"round(cos(2 * pi() * {k} * pos / 24), 6) + 0.0 AS cos_{k}" for k in range(1, 5)]) + " FROM h")
def fourier_design(spark, d):
    names = [f"{f}_{k}" for f in ("sin", "cos") for k in range(1, 5)]
    return event_hours(spark, d).distinct().select(POS, *features.fourier_features(F.col(POS), 24, 4)).select(POS, *(rounded(n).alias(n) for n in names))


@query("""WITH c AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01', ts)::BIGINT AS pos, count(*) AS n FROM events GROUP BY 1), p AS (SELECT pos % 168 AS phase, avg(n) AS value FROM c GROUP BY 1)
SELECT k::BIGINT AS pos, round(value, 6) + 0.0 AS value FROM generate_series(720, 1055) g(k) JOIN p ON k % 168 = phase""")
def periodic_profile(spark, d):
    counts = event_hours(spark, d).groupBy(POS).agg(F.count(F.lit(1)).alias("n"))
    pattern = counts.groupBy(F.pmod(F.col(POS), F.lit(168)).alias(POS)).agg(F.avg("n").alias("value"))
    return features.periodic_repeat(pattern, spark.range(720, 1056).toDF(POS), 168).select(POS, rounded("value").alias("value"))


@query("""WITH u AS (SELECT user_id, ts::DATE AS time, sum(value) AS y FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS pos FROM u),
s AS (SELECT user_id, avg(y) AS scale FROM i WHERE pos < 14 GROUP BY 1) SELECT user_id, pos, round(scale, 6) + 0.0 AS scale, round(y / scale, 6) + 0.0 AS scaled FROM i JOIN s USING (user_id)""")
def scale_by_train_mean(spark, d):
    days = read(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    out = panel.scale_by_train_mean(panel.as_series(days, "day", "v", ["user_id"]), ["user_id"], 14)
    return out.select("user_id", POS, rounded("scale").alias("scale"), rounded("scaled").alias("scaled"))


@query(f"WITH {DAILY}, m AS (SELECT avg(y) AS a, stddev_pop(y) AS s FROM daily WHERE pos < {T_OBS}) SELECT series, pos, round((y - a) / s, 6) + 0.0 AS y_std FROM daily, m")
def standardize_train_only(spark, d):
    return panel.standardize_train_only(daily(spark, d), T_OBS, ["y"]).select("series", POS, rounded("y_std").alias("y_std"))


SLOTS = """c AS (SELECT user_id, ts::DATE AS day, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), ud AS (SELECT DISTINCT user_id, day FROM c),
slots AS (SELECT user_id, day, k AS h, coalesce(n, 0) AS n FROM ud CROSS JOIN generate_series(0, 23) g(k) LEFT JOIN c ON c.user_id = ud.user_id AND c.day = ud.day AND c.h = k)"""


def slot_arrays(spark, d):
    """(user_id, day, slots): counts of each hour, an array of 24 a row."""
    sums = [F.sum((F.hour(F.col("ts")) == h).cast("double")) for h in range(24)]
    return read(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array(*sums).alias("slots"))


@query(f"""WITH {SLOTS.replace("SELECT user_id, day, k", "SELECT ud.user_id, ud.day, k")},
a AS (SELECT user_id, day, sum((h + 1) * (1 - (n > 0)::INTEGER))::DOUBLE AS lost, sum(n) AS total FROM slots GROUP BY ALL)
SELECT floor(lost / 15)::BIGINT AS bin, count(*) AS days, round(avg(total), 6) + 0.0 AS mean_total, round(avg(0.1 + 0.9 * (exp(-3 * lost / 300) - 1) / (exp(-3.0) - 1)), 6) + 0.0 AS factor FROM a WHERE total > 0 GROUP BY 1""")
def availability_curve(spark, d):
    weights = [h + 1.0 for h in range(24)]
    stock = F.transform("slots", lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    total = F.aggregate("slots", F.lit(0.0), lambda a, x: a + x)
    rows = slot_arrays(spark, d).select(features.weighted_availability(stock, weights).alias("lost"), total.alias("total")).filter("total > 0")
    return rows.groupBy(F.floor(F.col("lost") / 15).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("days"), rounded(F.avg("total")).alias("mean_total"), rounded(F.avg(features.saturating_availability(F.col("lost") / 300, 0.1, 3.0))).alias("factor"))


@query("SELECT hour(ts)::BIGINT AS hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) + 0.0 AS share FROM events GROUP BY 1")
def hourly_weights(spark, d):
    # the vector aggregate: each slot of the arrays, exploded and summed before the exchange
    slots = slot_arrays(spark, d).select(F.posexplode("slots").alias("hour", "v")).groupBy("hour").agg(F.sum("v").alias("n"))
    whole = slots.agg(F.sum("n").alias("total"))
    return slots.crossJoin(F.broadcast(whole)).filter("n > 0").select(F.col("hour").cast("long").alias("hour"), F.col("n").cast("long").alias("n"), rounded(F.col("n") / F.col("total"), 9).alias("share"))


@query("""WITH a AS (SELECT user_id, ts::DATE AS day, count(DISTINCT hour(ts)) AS active FROM events GROUP BY ALL)
SELECT active, count(*) AS days, round(count(*) / sum(count(*)) OVER (), 9) + 0.0 AS share FROM a GROUP BY 1""")
def count_histogram_share(spark, d):
    active = slot_arrays(spark, d).select(F.size(F.filter("slots", lambda x: x > 0)).cast("long").alias("active"))
    counts = active.groupBy("active").agg(F.count(F.lit(1)).alias("days"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("days").alias("total")))).select("active", "days", rounded(F.col("days") / F.col("total"), 9).alias("share"))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day FROM lineitem")
def dataset_overview(spark, d):
    # pairs first, combined before the exchange; parts are counted on what is left
    li = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"))
    by_pair = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    by_part = by_pair.groupBy("l_partkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return by_part.agg(F.sum("n").alias("n_rows"), F.count("l_partkey").alias("parts"), F.sum("pairs").alias("pairs"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"))


@query("""WITH t AS (SELECT * FROM orders WHERE o_orderdate::DATE < (SELECT min(o_orderdate::DATE) + 365 FROM orders)),
s AS (SELECT c_nationkey AS nation, count(*) AS n FROM t JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, nation LIMIT 5),
k AS (SELECT c_nationkey AS nation, o_custkey, sum(o_totalprice) AS spent FROM t JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT nation FROM s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY round(spent, 2) DESC, o_custkey) AS rn FROM k)
SELECT r.nation, concat_ws('::', r.nation::VARCHAR, orders.o_custkey::VARCHAR) AS series, count(*) AS orders_all, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders JOIN r ON orders.o_custkey = r.o_custkey WHERE rn <= 4 GROUP BY ALL""")
def train_window_topk_panel(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    train = orders.crossJoin(F.broadcast(orders.agg(F.date_add(F.min("day"), 365).alias("end")))).filter("day < end")
    spent = train.join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey").groupBy("nation", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    stores = panel.top_k(spent.groupBy("nation").agg(F.sum("n").alias("n")), [], [F.desc("n"), F.col("nation")], 5)
    chosen = panel.top_k(spent.join(F.broadcast(stores.select("nation")), "nation"), ["nation"], [F.desc(F.round("spent", 2)), F.col("o_custkey")], 4).select("nation", "o_custkey")
    out = orders.join(F.broadcast(chosen), "o_custkey")
    return out.groupBy("nation", F.concat_ws("::", F.col("nation").cast("string"), F.col("o_custkey").cast("string")).alias("series")).agg(F.count(F.lit(1)).alias("orders_all"), rounded(F.sum("o_totalprice"), 2).alias("total"))


def event_days(spark, d) -> int:
    """Days from the first event to the last."""
    day = F.col("ts").cast("date")
    return read(spark, d, "events").agg((F.datediff(F.max(day), F.min(day)) + 1).alias("n")).first()["n"]


DURATION = "n AS (SELECT date_diff('day', min(ts::DATE), max(ts::DATE)) + 1 AS n FROM events)"


@query(f"WITH {DURATION} SELECT 0::BIGINT AS t0, k::BIGINT AS t1, least(k + 2, n)::BIGINT AS t2 FROM n, unnest(generate_series(6, n - 1, 2)) g(k)")
def backtest_windows_expanding(spark, d):
    return windows.window_splits(spark, event_days(spark, d), min_train=6, test=2, stride=2)


@query(f"WITH {DURATION} SELECT (k - 5)::BIGINT AS t0, k::BIGINT AS t1, least(k + 2, n)::BIGINT AS t2 FROM n, unnest(generate_series(5, n - 1, 2)) g(k)")
def backtest_windows_rolling(spark, d):
    return windows.window_splits(spark, event_days(spark, d), train=5, test=2, stride=2)


NAIVE = f"""naive AS (SELECT series, k::BIGINT AS draw, {T_OBS} + pos - ({T_OBS} - {PERIOD} * k) AS pos, y AS pred FROM daily CROSS JOIN generate_series(1, {T_OBS // PERIOD}) g(k)
WHERE pos < {T_OBS} AND {T_OBS} - {PERIOD} * k >= 0 AND pos - ({T_OBS} - {PERIOD} * k) BETWEEN 0 AND {HORIZON - 1} AND {T_OBS} - {PERIOD} * k + {HORIZON} <= {T_OBS})"""


def ensemble(spark, d):
    """(samples, truth, train) of the seasonal-naive forecast of the daily series."""
    series = daily(spark, d)
    truth = series.filter(F.col(POS).between(T_OBS, T_OBS + HORIZON - 1)).select("series", POS, F.col("y").alias("truth"))
    return features.seasonal_naive(series, ["series"], T_OBS, HORIZON, PERIOD), truth, series.filter(F.col(POS) < T_OBS)


@query(f"WITH {DAILY}, {NAIVE} SELECT series, draw, pos, pred FROM naive")
def seasonal_naive_forecast(spark, d):
    return ensemble(spark, d)[0]


PLACES = f"""{DAILY}, {NAIVE}, t AS (SELECT series, pos, y AS truth FROM daily WHERE pos >= {T_OBS} AND pos < {T_OBS + HORIZON}),
rk AS (SELECT *, row_number() OVER (PARTITION BY series, pos ORDER BY pred) AS i, count(*) OVER (PARTITION BY series, pos) AS n FROM naive),
pl AS (SELECT series, pos, any_value(truth) AS y, median(pred) AS med, avg(pred) AS mean, quantile_cont(pred, 0.05) AS lo, quantile_cont(pred, 0.95) AS hi, quantile_cont(pred, 0.25) AS q,
  avg(abs(pred - truth)) - sum((2 * i - n - 1) * pred) / any_value(n * n) AS crps FROM rk JOIN t USING (series, pos) GROUP BY ALL)"""
METRIC_SQL = {
    "mae": "avg(abs(med - y))",
    "rmse": "sqrt(avg((mean - y) ** 2))",
    "crps": "avg(crps)",
    "coverage": "avg(CASE WHEN lo <= y AND y <= hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "pinball": "avg(greatest(0.25 * (y - q), -0.75 * (y - q)))",
    "interval_score": "avg(hi - lo + 20 * (greatest(lo - y, 0) + greatest(y - hi, 0)))",
}


def _metric(name: str, sql: str):
    def run(spark, d):
        samples, truth, _ = ensemble(spark, d)
        return metrics.evaluate_forecast(samples, truth, ["series", POS], metrics=(name,), quantile=0.25).select(rounded(name).alias(name))

    run.__name__ = f"metric_{name.replace('interval_score', 'interval')}"
    query(f"WITH {PLACES} SELECT round({sql}, 6) + 0.0 AS {name} FROM pl")(run)


for _name, _sql in METRIC_SQL.items():
    _metric(_name, _sql)


@query(f"""WITH {PLACES}, s AS (SELECT abs(y - lag(y, {PERIOD}) OVER (PARTITION BY series ORDER BY pos)) AS g FROM daily WHERE pos < {T_OBS})
SELECT round(avg(abs(med - y)) / (SELECT avg(g) FROM s), 6) + 0.0 AS mase FROM pl""")
def metric_mase(spark, d):
    samples, truth, train = ensemble(spark, d)
    mae = metrics.eval_mae(samples, truth, ["series", POS])
    return mae.crossJoin(F.broadcast(metrics.mase_scale(train, ["series"], PERIOD))).select(rounded(F.col("mae") / F.col("scale")).alias("mase"))


ALL_METRICS = ", ".join(f"round({s}, 6) + 0.0 AS {n}" for n, s in METRIC_SQL.items())


@query(f"WITH {PLACES} SELECT series, {ALL_METRICS} FROM pl GROUP BY series")
def evaluate_all_metrics(spark, d):
    samples, truth, _ = ensemble(spark, d)
    out = metrics.evaluate_forecast(samples, truth, ["series", POS], by=["series"], metrics=tuple(METRIC_SQL), quantile=0.25)
    return out.select("series", *(rounded(m).alias(m) for m in METRIC_SQL))


@query(f"""WITH {DAILY}, w AS (SELECT t1 - 14 AS t0, t1, least(t1 + 4, 30) AS t2 FROM generate_series(14, 26, 4) g(t1)),
n AS (SELECT t0, t1, t2, series, k AS draw, t1 + pos - (t1 - 7 * k) AS pos, y AS pred FROM daily, w, generate_series(1, 2) g(k) WHERE pos >= t0 AND pos < t1 AND pos - (t1 - 7 * k) BETWEEN 0 AND t2 - t1 - 1 AND t1 - 7 * k >= t0),
rk AS (SELECT n.*, daily.y, row_number() OVER (PARTITION BY t1, n.series, n.pos ORDER BY pred) AS i, count(*) OVER (PARTITION BY t1, n.series, n.pos) AS c FROM n JOIN daily ON n.series = daily.series AND n.pos = daily.pos),
pl AS (SELECT t0, t1, t2, series, pos, any_value(y) AS y, median(pred) AS med, avg(abs(pred - y)) - sum((2 * i - c - 1) * pred) / any_value(c * c) AS crps FROM rk GROUP BY ALL)
SELECT t0::BIGINT AS t0, t1::BIGINT AS t1, t2::BIGINT AS t2, round(avg(abs(med - y)), 6) + 0.0 AS mae, round(avg(crps), 6) + 0.0 AS crps FROM pl GROUP BY ALL""")
def backtest_naive_table(spark, d):
    """All windows at once: the few windows are broadcast to the series, and one aggregation scores them all."""
    series = daily(spark, d)
    split = F.broadcast(windows.window_splits(spark, 30, train=14, test=4, min_test=4, stride=4))
    seen = series.crossJoin(split).filter((F.col(POS) >= F.col("t0")) & (F.col(POS) < F.col("t1")))
    drawn = seen.withColumn("draw", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_i", F.col(POS) - (F.col("t1") - 7 * F.col("draw")))
    samples = drawn.filter((F.col("_i") >= 0) & (F.col("_i") < F.col("t2") - F.col("t1")) & (F.col("t1") - 7 * F.col("draw") >= F.col("t0"))).select("t0", "t1", "t2", "series", "draw", (F.col("t1") + F.col("_i")).alias(POS), F.col("y").alias("pred"))
    out = metrics.evaluate_forecast(samples, series.select("series", POS, F.col("y").alias("truth")), ["series", POS], by=["t0", "t1", "t2"], metrics=("mae", "crps"))
    return out.select("t0", "t1", "t2", rounded("mae").alias("mae"), rounded("crps").alias("crps"))


@query(SQL["backtest_naive_table"])
def backtest_seasonal_naive(spark, d):
    """The same windows through backtest() and a forecaster."""
    from tidecast.plans.backtest import backtest
    from tidecast.plans.forecaster import SeasonalNaiveForecaster

    series = daily(spark, d).select("series", POS, "y")
    found = backtest(series, lambda keys: SeasonalNaiveForecaster(keys, 7, num_draws=2), ["series"], metrics=("mae", "crps"), test=4, train=14, min_test=4, stride=4)
    return found.table.select("t0", "t1", "t2", rounded("mae").alias("mae"), rounded("crps").alias("crps"))


@query("""WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS time FROM events),
h AS (SELECT unnest(generate_series((SELECT min(time) FROM t), (SELECT max(time) FROM t), INTERVAL 1 HOUR)) AS time), i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM h)
SELECT time, pos FROM i UNION ALL SELECT (SELECT max(time) FROM i) + to_hours(k::INTEGER), (SELECT max(pos) FROM i) + k FROM generate_series(1, 30) g(k)""")
def extend_index_hourly(spark, d):
    """The hourly labels of all events and 30 steps more, the step found from the data."""
    ts = read(spark, d, "events").select("ts")
    hours = ts.agg(F.min(F.date_trunc("hour", "ts")).alias("lo"), F.max(F.date_trunc("hour", "ts")).alias("hi")).select(F.posexplode(F.expr("sequence(lo, hi, interval 1 hour)")).alias(POS, "time"))
    kind = dict(ts.dtypes)["ts"]
    return index.extend_time_index(hours.select(F.col("time").cast(kind).alias("time"), F.col(POS).cast("long").alias(POS)), 30)


@query(SQL["extend_index_monthly"])
def extend_index_month_inferred(spark, d):
    """extend_index_monthly without a stated freq."""
    months = read(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("time")).distinct()
    return index.extend_time_index(months.withColumn(POS, (F.row_number().over(Window.orderBy("time")) - 1).cast("long")), 6)


@query(f"""WITH {DAILY}, {NAIVE}, t AS (SELECT series, pos, y FROM daily WHERE pos % 3 <> 0 UNION ALL SELECT series, pos, y FROM daily WHERE pos % 5 = 1),
p AS (SELECT DISTINCT series, pos FROM naive), k AS (SELECT series, pos, count(*) AS n FROM t GROUP BY ALL)
SELECT count(*) AS places, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated FROM p LEFT JOIN k USING (series, pos)""")
def evaluate_missing_truth(spark, d):
    """What keeps a forecast from being scored: places whose truth is missing or stated twice."""
    samples, _, _ = ensemble(spark, d)
    truth = daily(spark, d).select("series", POS, F.col("y").alias("truth"))
    given = truth.filter(F.col(POS) % 3 != 0).unionByName(truth.filter(F.col(POS) % 5 == 1))
    return metrics.truth_gaps(samples, given, ["series", POS])


def shards(spark, d):
    """Orders by nation and day, in two parts that follow each other."""
    days = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("time"))
    by = days.join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("origin")), "o_custkey")
    rides = by.groupBy("time", "origin").agg(F.count(F.lit(1)).alias("rides"))
    turn = F.lit("1995-01-01").cast("date")
    return [rides.filter(F.col("time") < turn), rides.filter(F.col("time") >= turn)]


WEEKS = """o AS (SELECT c_nationkey AS origin, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey), e AS (SELECT min(day) AS t0, (max(day) - min(day) + 1) // 7 AS n FROM o),
w AS (SELECT origin, ((day - t0) // 7)::BIGINT AS block, count(*) AS rides FROM o, e WHERE (day - t0) // 7 < n GROUP BY ALL)"""


@query(f"WITH {WEEKS} SELECT block, round(ln(sum(rides)), 6) + 0.0 AS y FROM w GROUP BY 1")
def loader_weekly_total(spark, d):
    from tidecast.sources import loaders

    return loaders.weekly_total(loaders.od_counts(shards(spark, d), hours=24), 7).select("block", rounded("y").alias("y"))


@query(f"WITH {WEEKS}, t AS (SELECT origin FROM w GROUP BY 1 ORDER BY sum(rides) DESC, origin LIMIT 8) SELECT origin, block, round(ln(1 + rides), 6) + 0.0 AS y FROM w JOIN t USING (origin)")
def loader_weekly_by_origin(spark, d):
    from tidecast.sources import loaders

    return loaders.weekly_by_origin(loaders.od_counts(shards(spark, d), hours=24), 8, 7).select("origin", "block", rounded("y").alias("y"))


def posterior_draws(spark, d) -> DataFrame:
    """A posterior told by the customers, a draw for each nation and market segment: chain, draw, intercept, slope,
    level, drift, sigma, obs_sigma.  125 draws at most."""
    g = F.col("c_nationkey") * 5 + F.instr(F.lit("ABFHM"), F.substring("c_mktsegment", 1, 1)) - 1
    held = read(spark, d, "customer").groupBy(g.cast("long").alias("g")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("n"))
    return held.select(
        (F.col("g") % 2).cast("int").alias("chain"), F.floor(F.col("g") / 2).cast("long").alias("draw"), (F.lit(10.0) + F.col("a") / 1999.3).alias("intercept"), (F.lit(0.1) + (F.col("n") % 5) * 0.02).alias("slope"),
        (F.lit(5.0) + F.col("a") / 4999.7).alias("level"), (F.lit(0.05) + (F.col("n") % 3) * 0.01).alias("drift"), F.lit(0.2).alias("sigma"), F.lit(0.1).alias("obs_sigma"),
    )


POST = """post AS MATERIALIZED (SELECT (g % 2)::INTEGER AS chain, (g // 2)::BIGINT AS draw, 10.0::DOUBLE + a / 1999.3::DOUBLE AS intercept, 0.1::DOUBLE + (n % 5) * 0.02::DOUBLE AS slope,
5.0::DOUBLE + a / 4999.7::DOUBLE AS level, 0.05::DOUBLE + (n % 3) * 0.01::DOUBLE AS drift, 0.2::DOUBLE AS sigma, 0.1::DOUBLE AS obs_sigma
FROM (SELECT c_nationkey * 5 + instr('ABFHM', substr(c_mktsegment, 1, 1)) - 1 AS g, avg(c_acctbal) AS a, count(*) AS n FROM customer GROUP BY 1))"""


def _normal_sql(key: str) -> str:
    u = lambda a: f"((('0x' || substr(md5({key}), {a}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"
    return f"(sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(9)}))"


@query(f"""WITH {POST}, r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '3', 'thin', chain::VARCHAR, draw::VARCHAR)), chain, draw) - 1 AS n FROM post)
SELECT 0 AS chain, n AS draw, round(level, 6) + 0.0 AS level FROM r WHERE n < 40""")
def thin_draws(spark, d):
    return draws.thin_draws(posterior_draws(spark, d), 40, 3).select("chain", "draw", rounded("level").alias("level"))


@query(f"SELECT event_id, round({_normal_sql("concat_ws('|', '1', 'eps', event_id::VARCHAR)")}, 9) + 0.0 AS z FROM events")
def rng_normal(spark, d):
    return read(spark, d, "events").select("event_id", rounded(rng.normal(rng.key_of(1, "eps", F.col("event_id"))), 9).alias("z"))


@query(f"""WITH {POST}, g AS (SELECT post.*, k::BIGINT AS pos FROM post, generate_series(40, 44) g(k)),
m AS (SELECT *, level + sum(drift + sigma * {_normal_sql("concat_ws('|', '7', 'level', chain::VARCHAR, draw::VARCHAR, pos::VARCHAR)")}) OVER (PARTITION BY chain, draw ORDER BY pos) AS mu FROM g)
SELECT chain, draw, pos, round(mu, 6) + 0.0 AS mu_future, round(mu + obs_sigma * {_normal_sql("concat_ws('|', '7', 'obs', chain::VARCHAR, draw::VARCHAR, pos::VARCHAR)")}, 6) + 0.0 AS forecast FROM m""")
def random_walk_replay(spark, d):
    out = draws.random_walk_replay(posterior_draws(spark, d), spark.range(40, 45).toDF(POS), [], 7)
    return out.select("chain", "draw", POS, rounded("mu_future").alias("mu_future"), rounded("forecast").alias("forecast"))


@query(f"WITH {DAILY}, {POST} SELECT chain, draw, series, pos, round(intercept + slope * pos, 6) + 0.0 AS mu FROM daily, post WHERE pos < {T_OBS}")
def in_sample_mu_coherent(spark, d):
    steps = daily(spark, d).filter(F.col(POS) < T_OBS).withColumn("x", F.col(POS).cast("double"))
    return draws.linear_predictor(F.broadcast(posterior_draws(spark, d)), steps, {"slope": "x"}).select("chain", "draw", "series", POS, rounded("mu").alias("mu"))


@query(f"""WITH RECURSIVE {POST}, p AS (SELECT chain, draw, level FROM post), f AS (SELECT chain, draw, -1 AS k, level AS x FROM p UNION ALL
SELECT chain, draw, k + 1, 0.8 * x + 0.2 * {_normal_sql("concat_ws('|', '9', 'ar', chain::VARCHAR, draw::VARCHAR, (k + 1)::VARCHAR)")} FROM f WHERE k < 11)
SELECT chain, draw, k::BIGINT AS pos, round(x, 6) + 0.0 AS x FROM f WHERE k >= 0""")
def markov_ar1_forecast(spark, d):
    eps = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: rng.normal(rng.key_of(9, "ar", F.col("chain"), F.col("draw"), k)))
    out = posterior_draws(spark, d).select("chain", "draw", F.posexplode(folds.ar1(eps, F.col("level"), 0.8, 0.2)).alias(POS, "x"))
    return out.select("chain", "draw", F.col(POS).cast("long").alias(POS), rounded("x").alias("x"))


@query(f"""WITH RECURSIVE {DAILY}, o AS MATERIALIZED (SELECT series, pos, y FROM daily), f AS (SELECT DISTINCT series, -1::BIGINT AS pos, 0.0::DOUBLE AS m, 1000000.0::DOUBLE AS p, 0.0::DOUBLE AS ll FROM o UNION ALL
SELECT f.series, o.pos, f.m + ((f.p + 4) / (f.p + 4 + 25)) * (o.y - f.m), (f.p + 4) * (1 - (f.p + 4) / (f.p + 4 + 25)), -0.5 * (ln(6.283185307179586 * (f.p + 29)) + (o.y - f.m) * (o.y - f.m) / (f.p + 29)) FROM f JOIN o ON o.series = f.series AND o.pos = f.pos + 1)
SELECT series, pos, round(m, 6) + 0.0 AS level, round(p, 6) + 0.0 AS variance, round(ll, 6) + 0.0 AS loglik FROM f WHERE pos >= 0""")
def kalman_local_level(spark, d):
    held = folds.paths(daily(spark, d), ["series"])
    out = held.select("series", F.posexplode(folds.kalman_local_level(F.col("path"), 25.0, 4.0)).alias(POS, "s"))
    return out.select("series", F.col(POS).cast("long").alias(POS), rounded("s.m").alias("level"), rounded("s.p").alias("variance"), rounded("s.ll").alias("loglik"))


@query(f"""WITH RECURSIVE {DAILY}, o AS MATERIALIZED (SELECT series, pos, y FROM daily), f AS (SELECT series, -1::BIGINT AS pos, y AS lv, 0.0::DOUBLE AS tr, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0] AS s, 0.0::DOUBLE AS mu FROM o WHERE pos = 0 UNION ALL
SELECT f.series, o.pos, lv + 0.9 * tr + 0.3 * (o.y - (lv + 0.9 * tr + s[1])), 0.9 * tr + 0.05 * (o.y - (lv + 0.9 * tr + s[1])), list_append(s[2:], s[1] + 0.2 * (o.y - (lv + 0.9 * tr + s[1]))), lv + 0.9 * tr + s[1] FROM f JOIN o ON o.series = f.series AND o.pos = f.pos + 1)
SELECT series, pos, round(mu, 6) + 0.0 AS mu FROM f WHERE pos >= 0""")
def holt_winters_damped(spark, d):
    held = folds.paths(daily(spark, d), ["series"])
    out = held.select("series", F.posexplode(folds.holt_winters_damped(F.col("path"), 0.3, 0.05, 0.2, 0.9, 7)).alias(POS, "mu"))
    return out.select("series", F.col(POS).cast("long").alias(POS), rounded("mu").alias("mu"))


@query(f"""WITH {DAILY}, m AS (SELECT series, avg(y) AS mean FROM daily WHERE pos < {T_OBS} GROUP BY 1), l AS (SELECT series, y FROM daily WHERE pos = {T_OBS - 1})
SELECT series, ({T_OBS - 1} + k)::BIGINT AS pos, round(mean + exp(-k / 3.0) * (y - mean), 5) + 0.0 AS mean, round(2.0 * (1 - exp(-2 * k / 3.0)), 5) + 0.0 AS variance FROM m JOIN l USING (series), generate_series(1, {HORIZON}) g(k)""")
def mvn_conditional_ou(spark, d):
    from tidecast.plans import kernels

    series = daily(spark, d).filter(F.col(POS) < T_OBS)
    return kernels.gp_forecast(series, ["series"], HORIZON, lambda gap: 2.0 * math.e ** (-abs(gap) / 3.0), jitter=0.0).select("series", POS, rounded("mean", 5).alias("mean"), rounded("variance", 5).alias("variance"))


LINREG = """x AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), n AS (SELECT count(*) + 0.0001 AS n, sum(x) AS sx, sum(x * x) + 0.0001 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM x)"""


@query(f"""WITH {LINREG} SELECT round((sxx * sy - sx * sxy) / (n * sxx - sx * sx), 4) + 0.0 AS intercept, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 4) + 0.0 AS slope,
round(sqrt(sxx / (n * sxx - sx * sx)), 9) + 0.0 AS intercept_sd, round(sqrt(n / (n * sxx - sx * sx)), 9) + 0.0 AS slope_sd FROM n""")
def bayes_linreg_posterior(spark, d):
    from tidecast.plans.conjugate import linear_posterior

    out = linear_posterior(read(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), prior_precision=1e-4)
    return out.select(rounded("intercept", 4).alias("intercept"), rounded("slope", 4).alias("slope"), rounded("intercept_sd", 9).alias("intercept_sd"), rounded("slope_sd", 9).alias("slope_sd"))


@query(f"""WITH {DAILY}, n AS (SELECT series, count(*) + 0.0001 AS n, sum(pos) AS sx, sum(pos * pos) + 0.0001 AS sxx, sum(y) AS sy, sum(pos * y) AS sxy FROM daily WHERE pos < {T_OBS} GROUP BY 1),
b AS (SELECT series, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM n)
SELECT series, c::BIGINT AS draw, k::BIGINT AS pos, round(a + b * k + 3 * {_normal_sql("concat_ws('|', '5', 'obs', c::VARCHAR, series, k::VARCHAR)")}, 5) + 0.0 AS forecast FROM b, generate_series(0, 19) q(c), generate_series({T_OBS}, {T_OBS + HORIZON - 1}) g(k)""")
def forecast_linreg_trend(spark, d):
    from tidecast.plans.conjugate import linear_posterior

    fit = linear_posterior(daily(spark, d).filter(F.col(POS) < T_OBS), F.col(POS), F.col("y"), ["series"], 1e-4)
    steps = spark.range(T_OBS, T_OBS + HORIZON).toDF(POS).crossJoin(spark.range(20).toDF("draw"))
    z = rng.normal(rng.key_of(5, "obs", F.col("draw"), F.col("series"), F.col(POS)))
    return fit.crossJoin(F.broadcast(steps)).select("series", "draw", POS, rounded(F.col("intercept") + F.col("slope") * F.col(POS) + 3 * z, 5).alias("forecast"))


@query(f"""WITH {DAILY}, {POST}, s AS (SELECT series, pos, y AS x FROM daily WHERE pos >= {T_OBS}), f AS (SELECT series, chain, draw, sum(intercept + slope * x) AS base, sum(intercept + slope * x * 1.2) AS alt FROM post, s GROUP BY ALL)
SELECT series, round(avg(alt / base - 1), 6) + 0.0 AS uplift, round(quantile_cont(alt / base - 1, 0.05), 6) + 0.0 AS lo, round(quantile_cont(alt / base - 1, 0.95), 6) + 0.0 AS hi FROM f GROUP BY series""")
def counterfactual_uplift(spark, d):
    """The same draws over the horizon as it is and with the covariate raised by a fifth: draws pair by key."""
    steps = daily(spark, d).filter(F.col(POS) >= T_OBS).select("series", POS, F.col("y").alias("x"))
    both = draws.linear_predictor(F.broadcast(posterior_draws(spark, d)), steps.withColumn("x2", F.col("x") * 1.2), {"slope": "x"}).withColumn("mu2", F.col("intercept") + F.col("slope") * F.col("x2"))
    ratio = both.groupBy("series", "chain", "draw").agg((F.sum("mu2") / F.sum("mu") - 1).alias("u"))
    return ratio.groupBy("series").agg(rounded(F.avg("u")).alias("uplift"), rounded(F.percentile("u", 0.05)).alias("lo"), rounded(F.percentile("u", 0.95)).alias("hi"))


@query(f"WITH {POST} SELECT (g / 4.0)::DOUBLE AS x, round(quantile_cont(intercept + slope * g / 4.0, 0.1), 6) + 0.0 AS lo, round(median(intercept + slope * g / 4.0), 6) + 0.0 AS mid, round(quantile_cont(intercept + slope * g / 4.0, 0.9), 6) + 0.0 AS hi FROM post, generate_series(0, 40) q(g) GROUP BY 1")
def posterior_quantile_curve(spark, d):
    grid = spark.range(41).select((F.col("id") / 4.0).cast("double").alias("x"))
    mu = draws.linear_predictor(posterior_draws(spark, d), F.broadcast(grid), {"slope": "x"})
    return mu.groupBy("x").agg(*(rounded(F.percentile("mu", q)).alias(n) for n, q in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9))))


@query("""WITH e AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS step, value FROM events),
l AS (SELECT series, step, 40 * exp(-(step + 1) / 25.0) + 3 * CASE WHEN series = 'error' THEN exp(-(step + 1) / 2000.0) ELSE 0 END * 40 + value / 10 AS loss FROM e),
n AS (SELECT series, count(*) AS steps, greatest(count(*) // 10, 10) AS n FROM l GROUP BY 1),
w AS (SELECT series, any_value(steps // 2 + n <= steps - n) AS assessed, median(loss) FILTER (step >= steps - n) AS late, median(loss) FILTER (step >= steps // 2 AND step < steps // 2 + n) AS mid, any_value(n) AS n, any_value(steps) AS steps FROM l JOIN n USING (series) GROUP BY 1),
m AS (SELECT series, median(abs(loss - late)) AS mad, any_value(mid) AS mid, any_value(late) AS late, any_value(w.n) AS n, any_value(assessed) AS assessed FROM l JOIN w USING (series) WHERE step >= steps - n GROUP BY 1)
SELECT series, round(mid - late, 6) + 0.0 AS fall, round(mad, 6) + 0.0 AS mad, CASE WHEN assessed THEN mid - late > greatest(mad, 2 * 1.858 * mad * sqrt(2.0 / n)) ELSE false END AS still_falling, assessed FROM m""")
def elbo_convergence(spark, d):
    """The rule over a history of losses for each event type, which fall fast and, for errors, slowly too."""
    from tidecast.plans.diagnostics import elbo_convergence as check

    step = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("long") - 1
    rows = read(spark, d, "events").select(F.col("event_type").alias("series"), step.alias("step"), "value")
    slow = F.when(F.col("series") == "error", F.exp(-(F.col("step") + 1) / 2000.0)).otherwise(0.0)
    losses = rows.select("series", "step", (40 * F.exp(-(F.col("step") + 1) / 25.0) + 3 * slow * 40 + F.col("value") / 10).alias("loss"))
    return check(losses, by=["series"]).select("series", rounded("fall").alias("fall"), rounded("mad").alias("mad"), "still_falling", "assessed")


@query(f"WITH {DAILY}, {POST} SELECT series, pos, round(avg(exp(slope * ln(1 + y))), 6) + 0.0 AS rate FROM daily, post GROUP BY ALL")
def poisson_glm_mu(spark, d):
    steps = daily(spark, d).select("series", POS, F.log1p("y").alias("x"))
    mu = draws.linear_predictor(F.broadcast(posterior_draws(spark, d)).withColumn("zero", F.lit(0.0)), steps, {"slope": "x"}, "zero")
    return mu.groupBy("series", POS).agg(rounded(F.avg(F.exp("mu"))).alias("rate"))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def streaming_daily_counts(spark, d):
    from tidecast.streaming.counts import daily_counts

    return daily_counts(spark, f"{d}/events.parquet").select("event_type", "day", "n", rounded("total", 4).alias("total"))


@query("""SELECT event_id, (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, day(ts)::INTEGER AS day_of_month, month(ts)::INTEGER AS month,
CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS late FROM events""")
def event_calendar(spark, d):
    at = F.col("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", *features.calendar_parts(at), features.step_flag(at, "2024-01-15").alias("late"))


@query(f"""WITH {DAILY}, s AS (SELECT series, avg(y) AS scale FROM daily WHERE pos < {T_OBS} GROUP BY 1), m AS (SELECT series, pos, y / scale - 1 AS x, scale FROM daily JOIN s USING (series))
SELECT 'raw' AS model, series, pos, round(x, 6) + 0.0 AS x FROM m UNION ALL SELECT 'scaled', series, pos, round(greatest(x * scale, 0), 6) + 0.0 FROM m""")
def back_transformed(spark, d):
    """Scaled values beside the same on the data's own scale, not below 0."""
    scaled = panel.scale_by_train_mean(daily(spark, d), ["series"], T_OBS).withColumn("x", F.col("scaled") - 1)
    raw = scaled.select("series", POS, "x")
    lifted = results.back_transform(raw, scaled.select("series", "scale").distinct(), ["series"], ["x"])
    return results.by_model({"raw": raw, "scaled": lifted}).select("model", "series", POS, rounded("x").alias("x"))


def _own_model(name: str):
    def run(spark, d):
        from tidecast.plans import forecaster as fc
        from tidecast.plans.models import UserModel, time_series
        from tidecast.plans.spec import Prior

        series = daily(spark, d).select("series", POS, "y").withColumn("x", F.sin(F.lit(2 * math.pi / PERIOD) * F.col(POS)))
        wide = Prior("normal", {"mu": 0.0, "sigma": 100.0})
        model = {
            "user_model_forecast": UserModel({"base": wide, "swing": wide}, emit=lambda s, p, t, x: p["base"] + p["swing"] * x["x"], covariates=("x",)),
            "markov_model_forecast": time_series(Prior("normal", {"sigma": 1.0}), Prior("halfnormal", {"sigma": 5.0})),
        }[name]
        covariates = series.select("series", POS, "x")
        made = fc.PathfinderForecaster(model, ["series"]).fit(series.filter(F.col(POS) < T_OBS), covariates if model.covariates else None)
        ahead = made.forecast(covariates=covariates, num_samples=50) if model.covariates else made.forecast(horizon=HORIZON, num_samples=50)
        return ahead.groupBy("series", POS).agg(F.avg("forecast").alias("mean"), F.stddev("forecast").alias("sd"))

    run.__name__ = name
    query(None)(run)


for _name in ("user_model_forecast", "markov_model_forecast"):
    _own_model(_name)


def _fit(method: str):
    def run(spark, d):
        from tidecast.plans import forecaster as fc

        series = daily(spark, d).select("series", POS, "time", "y")
        made = fc.METHODS[method](fc.local_trend_spec(), keys=["series"]).fit(series.filter(F.col(POS) < T_OBS))
        return made.forecast(horizon=HORIZON).groupBy("series", POS).agg(F.avg("forecast").alias("mean"), F.stddev("forecast").alias("sd"))

    run.__name__ = f"{method}_forecast"
    query(None)(run)


for _method in ("advi", "fullrank_advi", "nuts", "pathfinder", "statespace"):
    _fit(_method)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts, dense, split, forecast by the seasonal-naive ensemble and scored by series."""
    return evaluate_all_metrics(spark, d)


from tidecast import catalog_checks, catalog_regression, catalog_states  # noqa: E402, F401  (they register their queries here)

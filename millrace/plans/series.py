"""Rolling statistics, lags, resampling and their SQL, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import timeseries as W
from millrace.plans.registry import Registry

R = Registry()
_P = 4
_BASE = "SELECT user_id, ts, sum(value) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events GROUP BY 1, 2"
_W = f"WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {_P - 1} PRECEDING AND CURRENT ROW)"


def _rolled(t, *ops):
    e = t("events").select("event_id", "user_id", "ts", "value")
    d = W.rolling(e, "value", ["user_id"], "ts", _P, list(ops))
    return d.drop("user_id", "ts", "value")


def _sql(expression, op):
    return f"""SELECT event_id, v AS value_{_P}_user_id_{op} FROM events JOIN (SELECT user_id, ts, CASE WHEN i >= {_P} THEN {expression} END AS v FROM ({_BASE}) {_W}) USING (user_id, ts)"""


def _plain(op, expression, digits=6):
    name = f"value_{_P}_user_id_{op}"

    @R.query(f"w1_{op}", _sql(f"round({expression}, {digits}) + 0.0", op))
    def _(t):
        return _rolled(t, op).withColumn(name, F.round(name, digits) + 0.0)


for _op, _expression in {
    "mean": "avg(x) OVER w",
    "median": "quantile_cont(x, 0.5) OVER w",
    "sum": "sum(x) OVER w",
    "std": "stddev(x) OVER w",
    "max": "max(x) OVER w",
    "min": "min(x) OVER w",
    "quant_90": "quantile_cont(x, 0.9) OVER w",
    "quant_10": "quantile_cont(x, 0.1) OVER w",
    "trend": "regr_slope(x, i) OVER w",
    "kurtosis": "kurtosis(x) OVER w",
    "skewness": "skewness(x) OVER w",
}.items():
    _plain(_op, _expression)


def _list(op, expression, digits=None):
    a = f"SELECT user_id, ts, i, list(x) OVER w AS a FROM ({_BASE}) {_W}"

    @R.query(f"w1_{op}", f"SELECT event_id, v AS value_{_P}_user_id_{op} FROM events JOIN (SELECT user_id, ts, CASE WHEN i >= {_P} THEN {expression} END AS v FROM ({a})) USING (user_id, ts)")
    def _(t):
        return _rolled(t, op)


_list("size", "len(a)")
_list("count_above_zero", "len(list_filter(a, lambda v: v > 0))")
_list("last_max", "CAST(len(a) - list_position(a, list_max(a)) + 1 AS INTEGER)")
_list("last_min", "CAST(len(a) - list_position(a, list_min(a)) + 1 AS INTEGER)")
# Runs: a string of 1 and 0 for each entry; its longest piece between zeros.
_RUN = "list_max(list_transform(string_split(array_to_string(list_transform({0}, lambda v: CASE WHEN {1} THEN '1' ELSE '0' END), ''), '0'), lambda s: CAST(length(s) AS INTEGER)))"
_list("longest_period_above_mean", _RUN.format("a", "v > list_avg(a)"))
_list("longest_period_below_mean", _RUN.format("a", "v < list_avg(a)"))
_STEPS = f"list_transform(range(1, {_P}), lambda k: a[k + 1] - a[k])"
_list("longest_consecutive_increases", _RUN.format(_STEPS, "v > 0"))
_list("longest_consecutive_decreases", _RUN.format(_STEPS, "v < 0"))


@R.query("w1_minmax_std", _sql("stddev(x) OVER w > (max(x) OVER w - min(x) OVER w) / 2", "minmax_std"))
def _(t):
    return _rolled(t, "minmax_std")


@R.query("w1_list", f"SELECT event_id, v AS n FROM events JOIN (SELECT user_id, ts, CASE WHEN i >= {_P} THEN round(list_aggregate(list(x) OVER w, 'sum'), 4) END AS v FROM ({_BASE}) {_W}) USING (user_id, ts)")
def _(t):
    return _rolled(t, "list").select("event_id", F.round(F.aggregate(f"value_{_P}_user_id_list", F.lit(0.0), lambda s, x: s + x), 4).alias("n"))


@R.query("w2_shift", f"SELECT event_id, round(v, 6) AS value_2_user_id_shift FROM events JOIN (SELECT user_id, ts, lag(x, 2) OVER (PARTITION BY user_id ORDER BY ts) AS v FROM ({_BASE})) USING (user_id, ts)")
def _(t):
    d = W.shifted(t("events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], "ts", 2)
    return d.select("event_id", F.round("value_2_user_id_shift", 6).alias("value_2_user_id_shift"))


@R.query("w3_diff", f"SELECT event_id, round(v, 6) AS value_1_user_id_diff FROM events JOIN (SELECT user_id, ts, x - lag(x, 1) OVER (PARTITION BY user_id ORDER BY ts) AS v FROM ({_BASE})) USING (user_id, ts)")
def _(t):
    d = W.shifted(t("events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], "ts", 1, "diff")
    return d.select("event_id", F.round("value_1_user_id_diff", 6).alias("value_1_user_id_diff"))


@R.query("w4_cumulative_ratio", "SELECT event_id, round(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER w / row_number() OVER w, 6) AS ratio FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    d = W.cumulative_ratio(t("events").select("event_id", "user_id", "ts", "value"), F.col("value") > 100, ["user_id"], ["ts", "event_id"])
    return d.select("event_id", F.round("ratio", 6).alias("ratio"))


@R.query("w6_lag_bin", "SELECT event_type, dia, lag(n) OVER (PARTITION BY event_type ORDER BY dia) AS antes FROM (SELECT event_type, CAST(ts AS DATE) dia, count(*) n FROM events GROUP BY 1, 2)")
def _(t):
    n = t("events").groupBy("event_type", F.to_date("ts").alias("dia")).agg(F.count("*").alias("n"))
    return n.select("event_type", "dia", F.lag("n").over(W.Window.partitionBy("event_type").orderBy("dia")).alias("antes"))


@R.query("w7_previous_mean", "SELECT event_type, dia, round(avg(n) OVER (PARTITION BY event_type ORDER BY dia ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS n_prev3_mean FROM (SELECT event_type, CAST(ts AS DATE) dia, count(*) n FROM events GROUP BY 1, 2)")
def _(t):
    n = t("events").groupBy("event_type", F.to_date("ts").alias("dia")).agg(F.count("*").alias("n"))
    return W.previous_mean(n, "n", ["event_type"], "dia").select("event_type", "dia", F.round("n_prev3_mean", 6).alias("n_prev3_mean"))


_BINS = """WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_max(event_type, (ts, event_id)) AS e, avg(value) AS m, stddev(value) AS s FROM events GROUP BY 1),
    a AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 5 MINUTE)) AS ts)"""


@R.query("a7_resample", _BINS + " SELECT ts, round(m, 6) AS value_mean, round(s, 6) AS value_std FROM a LEFT JOIN b USING (ts)")
def _(t):
    d = W.resample(t("events").select("ts", "value"), "ts", "5 minutes", ["value"])
    return d.select("ts", *(F.round(c, 6).alias(c) for c in ("value_mean", "value_std")))


@R.query("a8_lagged_target", _BINS + " SELECT ts, round(v, 6) AS value FROM (SELECT ts, lag(m) OVER (ORDER BY ts) AS v FROM a LEFT JOIN b USING (ts)) WHERE v > 0.1")
def _(t):
    return W.lagged_target(t("events"), "ts", "value", "5 minutes", 0.1).withColumn("value", F.round("value", 6))


queries, oracle_sql = R.queries, R.oracle_sql

"""Queries of trades, metrics, schedules and statistics over the given tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions import scalars
from tideframe.operators import folds, metrics, ranking, schedules, stats
from tideframe.plans.market import query, rounded
from tideframe.sources import tables
from tideframe.sources.tables import DAILY_SQL, TRADES_SQL

T = f"WITH {TRADES_SQL}"
D = f"WITH {DAILY_SQL}"

_METRICS = """count(net_r) AS trades, round(avg(net_r), 8) AS mean_r, round(sum(net_r), 6) AS total_r, round(avg(CAST(net_r > 0 AS DOUBLE)), 8) AS win_rate, round(avg(net_r) FILTER (net_r > 0), 8) AS mean_win,
 round(avg(net_r) FILTER (net_r < 0), 8) AS mean_loss, round(coalesce(sum(net_r) FILTER (net_r > 0), 0) / nullif(abs(sum(net_r) FILTER (net_r < 0)), 0), 6) AS profit_factor, min(net_r) AS worst_r"""


@query("a13_outcome_metrics", f"{T} SELECT {_METRICS} FROM trades")
def outcome_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcome_metrics(tables.trades(spark, d))


@query("a14_metrics_by_group", f"{T} SELECT symbol, side, {_METRICS} FROM trades GROUP BY 1, 2")
def metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcome_metrics(tables.trades(spark, d), ["symbol", "side"])


@query("a35_metrics_by_level", f"""{T} SELECT 'total' AS level, 'all' AS value, {_METRICS} FROM trades UNION ALL SELECT 'symbol', symbol, {_METRICS} FROM trades GROUP BY symbol UNION ALL SELECT 'side', side, {_METRICS} FROM trades GROUP BY side
UNION ALL SELECT 'session', CASE WHEN hour < 8 THEN 'asia' WHEN hour < 16 THEN 'europe' ELSE 'us' END, {_METRICS} FROM trades GROUP BY 2""")
def metrics_by_level(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("session", scalars.session_of(F.col("hour")))
    return metrics.metrics_by_level(t, ["symbol", "side", "session"])


@query("a18_bucket_metrics", f"""{T} SELECT 'confidence' AS dimension, CASE WHEN confidence < 0.3 THEN '0' WHEN confidence < 0.6 THEN '1' ELSE '2' END AS bucket, {_METRICS} FROM trades GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN size < 10 THEN '0' WHEN size < 30 THEN '1' ELSE '2' END, {_METRICS} FROM trades GROUP BY 2""")
def bucket_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.unpivoted_buckets(tables.trades(spark, d), {"confidence": scalars.steps(F.col("confidence"), [0.3, 0.6]), "size": scalars.steps(F.col("size"), [10, 30])})


@query("a19_runner_shares", f"""{T} SELECT threshold, count(*) AS rows, round(avg(CAST(net_r >= threshold AS DOUBLE)), 8) AS reached, round(avg(CAST(net_r >= threshold AND confidence > -1 AS DOUBLE)), 8) AS clean, round(avg(CAST(confidence <= -1 AS DOUBLE)), 8) AS stopped
FROM trades CROSS JOIN (SELECT unnest([CAST(0.2 AS DOUBLE), 0.6, 0.9]) AS threshold) GROUP BY 1""")
def runner_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.runner_shares(tables.trades(spark, d), [0.2, 0.6, 0.9], "net_r", "confidence")


@query("a21_gates", f"""{T}, m AS (SELECT symbol, count(*) AS n, avg(net_r) AS r, avg(CAST(net_r > 0 AS DOUBLE)) AS w FROM trades GROUP BY 1)
SELECT symbol, concat_ws(',', CASE WHEN n < 20000 THEN 'enough_trades' END, CASE WHEN NOT r > 0 THEN 'positive_mean' END, CASE WHEN NOT w >= 0.4 THEN 'win_rate' END) AS failed, n >= 20000 AND r > 0 AND w >= 0.4 AS passed FROM m""")
def gates(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.outcome_metrics(tables.trades(spark, d), ["symbol"])
    x = metrics.gates(m, {"enough_trades": F.col("trades") >= 20000, "positive_mean": F.col("mean_r") > 0, "win_rate": F.col("win_rate") >= 0.4})
    return x.select("symbol", F.array_join("failed", ",").alias("failed"), "passed")


# Every trade, in a total order.
_ORDER = ["decision_t", "id", "exit_t", "net_r", "size", "hour", "notional"]
_W = "PARTITION BY book ORDER BY " + ", ".join(_ORDER) + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_CURVE = f"""{T}, k AS (SELECT *, symbol || side AS book FROM trades),
c AS (SELECT *, 10000 * exp(sum(ln(1 + 0.01 * net_r)) OVER ({_W})) AS equity, row_number() OVER ({_W.split(' ROWS')[0]}) AS n FROM k), dd AS (SELECT *, greatest(10000, max(equity) OVER ({_W})) AS peak FROM c)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("book", F.concat("symbol", "side"))
    return metrics.equity_curve(t, 10000.0, 0.01, ["book"], _ORDER)


@query("w60_compounded_equity", _CURVE + " SELECT book, decision_t, id, round(equity, 3) AS equity, round((peak - equity) / peak, 6) AS drawdown FROM dd")
def compounded_equity(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("book", "decision_t", "id", F.round("equity", 3).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


@query("w61_drawdown_duration", _CURVE + """, n AS (SELECT *, round((peak - equity) / peak, 12) > 0.0000000001 AS below FROM dd),
r AS (SELECT *, CASE WHEN below THEN n - coalesce(max(CASE WHEN NOT below THEN n END) OVER (PARTITION BY book ORDER BY n), 0) ELSE 0 END AS run FROM n)
SELECT book, round(max((peak - equity) / peak), 6) AS max_drawdown, max(run) AS longest_run FROM r GROUP BY book""")
def drawdown_duration(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.longest_drawdown(_curve(spark, d), ["book"], _ORDER)
    return x.select("book", F.round("max_drawdown", 6).alias("max_drawdown"), F.col("longest_run").cast("bigint").alias("longest_run"))


@query("a26_monthly_rollup", f"""{T}, k AS (SELECT symbol || side AS book, strftime(to_timestamp(decision_t) AT TIME ZONE 'UTC', '%Y-%m') AS month, net_r AS r FROM trades),
m AS (SELECT book, month, count(*) AS trades, avg(r) AS mean_r, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, coalesce(sum(r) FILTER (r > 0), 0) / nullif(-sum(r) FILTER (r < 0), 0) AS pf, sum(ln(1 + 0.01 * r)) AS s FROM k GROUP BY 1, 2),
e AS (SELECT *, 10000 * exp(sum(s) OVER (PARTITION BY book ORDER BY month)) AS last FROM m)
SELECT book, month, trades, round(mean_r, 8) AS mean_r, round(win_rate, 6) AS win_rate, round(pf, 9) AS profit_factor, round(last - last / exp(s), 3) AS gain, round(exp(s) - 1, 6) AS month_return FROM e""")
def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.monthly_rollup(_curve(spark, d), ["book"], 10000.0, order=("_n",))
    return x.select("book", "month", "trades", F.round("mean_r", 8).alias("mean_r"), F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 9).alias("profit_factor"), F.round("gain", 3).alias("gain"), F.round("month_return", 6).alias("month_return"))


@query("w62_concurrent_exposure", f"""{T}, e AS (SELECT symbol, decision_t AS t, 1 AS o, 1 AS d, size AS s FROM trades UNION ALL SELECT symbol, exit_t, CASE WHEN exit_t = decision_t THEN 2 ELSE 0 END, -1, -size FROM trades),
g AS (SELECT symbol, t, o, sum(d) AS d, sum(s) AS s FROM e GROUP BY 1, 2, 3), r AS (SELECT symbol, sum(d) OVER w AS open, sum(s) OVER w AS exposure FROM g WINDOW w AS (PARTITION BY symbol ORDER BY t, o))
SELECT symbol, CAST(max(open) AS BIGINT) AS max_open, round(max(exposure), 6) AS max_exposure FROM r GROUP BY 1""")
def concurrent_exposure(spark: SparkSession, d: str) -> DataFrame:
    return metrics.concurrent_exposure(tables.trades(spark, d), ["symbol"])


@query("w55_top_n_per_time", f"""{T}, u AS (SELECT id, min(decision_t) AS decision_t, max(confidence) AS confidence FROM trades GROUP BY id)
SELECT *, CAST(row_number() OVER (PARTITION BY decision_t ORDER BY confidence DESC, id) AS INT) AS rank, row_number() OVER (PARTITION BY decision_t ORDER BY confidence DESC, id) <= 2 AS in_top FROM u""")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    u = tables.trades(spark, d).groupBy("id").agg(F.min("decision_t").alias("decision_t"), F.max("confidence").alias("confidence"))
    return ranking.top_n_per_time(u, 2)


@query("w57_daily_cap", f"""{T}, u AS (SELECT id, min(decision_t) AS decision_t, max(confidence) AS confidence FROM trades GROUP BY id),
r AS (SELECT *, row_number() OVER (PARTITION BY decision_t ORDER BY confidence DESC, id) AS rank FROM u)
SELECT id, decision_t FROM r QUALIFY row_number() OVER (PARTITION BY decision_t // 86400 ORDER BY decision_t, rank, id) <= 3""")
def daily_cap(spark: SparkSession, d: str) -> DataFrame:
    u = tables.trades(spark, d).groupBy("id").agg(F.min("decision_t").alias("decision_t"), F.max("confidence").alias("confidence"))
    return ranking.daily_cap(ranking.top_n_per_time(u, 10), 3).select("id", "decision_t")


def _book(spark: SparkSession, d: str) -> DataFrame:
    """One trade an id, by symbol."""
    return tables.trades(spark, d).groupBy("id").agg(F.min("symbol").alias("symbol"), F.min("decision_t").alias("decision_t"), F.min("exit_t").alias("exit_t"), F.min("net_r").alias("net_r"))


_BOOK = f"{TRADES_SQL}, b AS (SELECT id, min(symbol) AS symbol, min(decision_t) AS s, min(exit_t) AS e, min(net_r) AS r FROM trades GROUP BY id)"


@query("w58_admission_fold", f"""WITH RECURSIVE {_BOOK}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s, id) AS n FROM b),
k AS (SELECT symbol, id, s, r, n, 1 AS taken FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.id, o.s, o.r, o.n, k.taken + 1 FROM k JOIN o ON o.symbol = k.symbol AND o.n = k.n + CASE WHEN k.r < 0 THEN 3 ELSE 1 END WHERE k.taken < 200)
SELECT symbol, id, s AS decision_t, r AS net_r FROM k""")
def admission(spark: SparkSession, d: str) -> DataFrame:
    return ranking.admitted(_book(spark, d), 200, 2).select("symbol", "id", "decision_t", "net_r")


_EXPOSED = f"""{TRADES_SQL}, c AS (SELECT symbol || side || hour AS book, id, decision_t AS t, CASE WHEN id % 401 > 0 THEN exit_t END AS e, net_r AS r, CASE WHEN id % 7 = 0 THEN 'missing_model_estimate' WHEN confidence < 0.1 THEN 'probability_below_threshold' WHEN size / 25 < 0.4 THEN 'expected_r_below_threshold' WHEN notional > 60000 THEN 'stopout_risk_above_limit' END AS why FROM trades),
o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY t, id) AS n FROM c WHERE why IS NULL)"""


def _checks() -> dict:
    return {"missing_model_estimate": F.col("probability").isNull(), "probability_below_threshold": F.col("probability") < 0.1, "expected_r_below_threshold": F.col("expected_r") < 0.4, "stopout_risk_above_limit": F.col("stop_out") > 60000}


def _exposed(spark: SparkSession, d: str) -> DataFrame:
    """Trades as candidates of books with estimates (one in seven has none); one in 401 never leaves."""
    t = tables.trades(spark, d).withColumn("book", F.concat("symbol", "side", F.col("hour").cast("string"))).withColumn("risk", F.lit(0.01))
    known = F.col("id") % 7 > 0
    t = t.withColumn("exit_t", F.when(F.col("id") % 401 > 0, F.col("exit_t")))
    return t.withColumn("probability", F.when(known, F.col("confidence"))).withColumn("expected_r", F.when(known, F.col("size") / 25)).withColumn("stop_out", F.when(known, F.col("notional")))


@query("j28_exposure_release", f"""WITH RECURSIVE {_EXPOSED}, f AS (SELECT book, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, true AS ok, CAST([] AS BIGINT[]) AS open FROM (SELECT DISTINCT book FROM o)
UNION ALL SELECT o.book, o.n, o.id, len(list_filter(f.open, lambda x: x > o.t)) * 0.01 + 0.01 <= 0.03, CASE WHEN len(list_filter(f.open, lambda x: x > o.t)) * 0.01 + 0.01 <= 0.03 THEN list_append(list_filter(f.open, lambda x: x > o.t), coalesce(o.e, 9000000000000)) ELSE list_filter(f.open, lambda x: x > o.t) END FROM f JOIN o ON o.book = f.book AND o.n = f.n + 1)
SELECT book, id, CASE WHEN NOT ok THEN 'symbol_exposure_cap' END AS reason FROM f WHERE n > 0 UNION ALL SELECT book, id, why FROM c WHERE why IS NOT NULL""")
def exposure_release(spark: SparkSession, d: str) -> DataFrame:
    """Reason of each rejection, with open exposure released at exits."""
    return folds.admission(_exposed(spark, d), ["book"], _checks(), max_exposure=0.03)


@query("w58_admission_exposure", f"""WITH RECURSIVE {_EXPOSED}, f AS (SELECT book, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS why, CAST([] AS BIGINT[]) AS open, 0 AS taken, 0 AS wait FROM (SELECT DISTINCT book FROM o)
UNION ALL SELECT book, n, id, why, CASE WHEN why IS NULL THEN list_append(held, coalesce(e, 9000000000000)) ELSE held END, taken + CASE WHEN why IS NULL THEN 1 ELSE 0 END, CASE WHEN why IS NULL THEN CASE WHEN r < 0 THEN 2 ELSE 0 END WHEN why = 'cooldown' THEN wait - 1 ELSE wait END
FROM (SELECT o.book, o.n, o.id, o.e, o.r, f.taken, f.wait, list_filter(f.open, lambda x: x > o.t) AS held, CASE WHEN f.taken >= 60 THEN 'trade_cap' WHEN f.wait > 0 THEN 'cooldown' WHEN len(list_filter(f.open, lambda x: x > o.t)) * 0.01 + 0.01 > 0.02 THEN 'symbol_exposure_cap' END AS why FROM f JOIN o ON o.book = f.book AND o.n = f.n + 1))
SELECT book, id, why AS reason FROM f WHERE n > 0 UNION ALL SELECT book, id, why FROM c WHERE why IS NOT NULL""")
def admission_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Cap of accepted trades, cooldown after a loss and exposure cap at once."""
    return folds.admission(_exposed(spark, d), ["book"], _checks(), max_exposure=0.02, cap=60, cooldown=2)


@query("w59_non_overlap", f"""WITH RECURSIVE {_BOOK}, f AS (SELECT symbol, arg_min(id, (s, id)) AS id, arg_min(e, (s, id)) AS until FROM b GROUP BY symbol UNION ALL SELECT f.symbol, arg_min(b.id, (b.s, b.id)), arg_min(b.e, (b.s, b.id)) FROM f JOIN b ON b.symbol = f.symbol AND b.s >= f.until GROUP BY f.symbol)
SELECT symbol, id FROM f""")
def non_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.non_overlapping(_book(spark, d)).select("symbol", "id")


@query("j22_ledger_merge", """SELECT o_orderkey AS k, coalesce(l.total, o_totalprice) AS total, CASE WHEN l.total IS NULL THEN 'existing' ELSE 'incoming' END AS source FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, round(sum(l_extendedprice), 2), 'incoming' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    """All orders as the existing ledger, totals of all lineitems as what comes in; incoming rows replace existing ones."""
    from tideframe.operators.quality import keep_last

    old = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), F.lit("existing").alias("source"), F.lit(0).alias("p"))
    new = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).select("k", "total", F.lit("incoming").alias("source"), F.lit(1).alias("p"))
    return keep_last(old.unionByName(new), ["k"], ["p"]).drop("p")


# Schedules -----------------------------------------------------------------------------------------------------------


@query("a41_complete_months", D + " SELECT symbol, strftime(day, '%Y-%m') AS month, CAST(min(day(day)) AS INT) AS first_dom, CAST(max(day(day)) AS INT) AS last_dom, count(*) AS days FROM daily GROUP BY 1, 2 HAVING min(day(day)) <= 3 AND max(day(day)) >= 27")
def complete_months(spark: SparkSession, d: str) -> DataFrame:
    return schedules.complete_months(tables.daily_closes(spark, d))


_FIXED = D + """, fixed AS (SELECT symbol, strftime(day, '%Y-%m') AS month, 'day_' || lpad(CAST(target AS VARCHAR), 2, '0') AS schedule, coalesce(min(day) FILTER (day(day) >= target), max(day)) AS day,
  coalesce(arg_min(close, day) FILTER (day(day) >= target), arg_max(close, day)) AS price, 100.0::DOUBLE AS spend FROM daily CROSS JOIN (SELECT unnest([1, 8, 15, 22]) AS target) GROUP BY symbol, 2, target)"""


@query("w69_fixed_days", _FIXED + " SELECT * FROM fixed")
def fixed_days(spark: SparkSession, d: str) -> DataFrame:
    return schedules.fixed_day(tables.daily_closes(spark, d), [1, 8, 15, 22], 100)


_EVALUATED = _FIXED + """, e AS (SELECT symbol, arg_max(close, day) AS lc, avg(close) AS mc, count(*) / sum(1 / close) AS hc, min(close) AS best, max(close) AS worst FROM daily GROUP BY 1), g AS (SELECT symbol, schedule, count(*) AS buys, sum(spend) AS spent, sum(spend / price) AS units FROM fixed GROUP BY 1, 2),
ev AS (SELECT symbol, schedule, buys, spent, units, spent / units AS cb, units * lc AS value, mc, hc, best, worst FROM g JOIN e USING (symbol))"""


@query("a36_campaign_evaluation", _EVALUATED + " SELECT symbol, schedule, buys, round(spent, 4) AS spent, round(units, 6) AS units, round(cb, 4) AS cost_basis, round(value, 4) AS value, round((cb / mc - 1) * 100, 6) AS vs_mean_pct, round((cb / hc - 1) * 100, 6) AS vs_harmonic_pct, best, worst, round((cb - best) / nullif(worst - best, 0), 6) AS position_in_range FROM ev")
def campaign_evaluation(spark: SparkSession, d: str) -> DataFrame:
    daily = tables.daily_closes(spark, d)
    x = schedules.evaluate(schedules.fixed_day(daily, [1, 8, 15, 22], 100), daily)
    return x.select("symbol", "schedule", "buys", F.round("spent", 4).alias("spent"), F.round("units", 6).alias("units"), F.round("cost_basis", 4).alias("cost_basis"), F.round("value", 4).alias("value"), F.round("vs_mean_pct", 6).alias("vs_mean_pct"), F.round("vs_harmonic_pct", 6).alias("vs_harmonic_pct"), "best", "worst", F.round("position_in_range", 6).alias("position_in_range"))


@query("a38_day_of_month_gap", _EVALUATED + " SELECT symbol, schedule, round((cb / avg(cb) OVER (PARTITION BY symbol) - 1) * 100, 6) AS gap_pct FROM ev")
def day_of_month_gap(spark: SparkSession, d: str) -> DataFrame:
    daily = tables.daily_closes(spark, d)
    x = schedules.versus_fixed_days(schedules.evaluate(schedules.fixed_day(daily, [1, 8, 15, 22], 100), daily))
    return rounded(x.select("symbol", "schedule", "gap_pct"))


@query("a40_intramonth_bias", D + """, m AS (SELECT symbol, strftime(day, '%Y-%m') AS month, coalesce(arg_min(close, day) FILTER (day(day) >= 15), arg_max(close, day)) AS c, avg(close) AS m, count(*) AS n FROM daily GROUP BY 1, 2 HAVING count(*) >= 25), g AS (SELECT symbol, (c / m - 1) * 100 AS gap FROM m)
SELECT symbol, count(*) AS months, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS sd_gap, round(avg(CAST(gap > 0 AS DOUBLE)), 6) AS share_above FROM g GROUP BY 1""")
def intramonth_bias(spark: SparkSession, d: str) -> DataFrame:
    return rounded(schedules.intramonth_bias(tables.daily_closes(spark, d), 15))


@query("w67_trailing_percentile", D + """, x AS (SELECT symbol, day, close, list(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS b FROM daily)
SELECT symbol, day, CASE WHEN len(b) = 60 THEN round(len(list_filter(b, lambda v: v < close)) / 59.0, 6) END AS percentile FROM x""")
def trailing_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(schedules.trailing_percentile(tables.daily_closes(spark, d), 60).select("symbol", "day", "percentile"))


@query("w68_ma_distance_weight", D + """, x AS (SELECT symbol, day, close, CASE WHEN count(close) OVER w = 50 THEN avg(close) OVER w END AS ma FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT symbol, day, round(coalesce(CASE WHEN ma IS NOT NULL THEN greatest(0.5, least(2.0, 1 + 2.5 * (1 - close / ma))) END, 1.0), 6) AS weight FROM x""")
def ma_distance_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(schedules.ma_distance_weight(tables.daily_closes(spark, d), 50).select("symbol", "day", "weight"))


@query("w70_weighted_split", D + """, x AS (SELECT symbol, day, close, strftime(day, '%Y-%m') AS month, CASE WHEN count(close) OVER w = 50 THEN avg(close) OVER w END AS ma FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, coalesce(CASE WHEN ma IS NOT NULL THEN greatest(0.5, least(2.0, 1 + 2.5 * (1 - close / ma))) END, 1.0) AS weight, count(*) OVER (PARTITION BY symbol, month) - row_number() OVER (PARTITION BY symbol, month ORDER BY day) + 1 AS left_ FROM x),
p AS (SELECT *, CASE WHEN left_ = 1 THEN 1.0 ELSE least(1.0, weight / left_) END AS part FROM y)
SELECT symbol, month, 'weighted' AS schedule, day, close AS price, round(100 * coalesce(product(1 - part) OVER (PARTITION BY symbol, month ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * part, 6) AS spend FROM p""")
def weighted_split(spark: SparkSession, d: str) -> DataFrame:
    daily = tables.daily_closes(spark, d)
    return rounded(schedules.weighted_split(schedules.ma_distance_weight(daily, 50), 100))


@query("w71_dip_band", D + """, x AS (SELECT symbol, day, close, year(day) * 12 + month(day) AS m, coalesce(close <= (CASE WHEN count(close) OVER b >= 30 THEN max(close) OVER b END) * 0.9, false) AS dip FROM daily WINDOW b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
n AS (SELECT *, min(CASE WHEN dip THEN day END) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM x), p AS (SELECT symbol, m, arg_min(nd, day) AS nd0, min(day) AS a, max(day) AS last FROM n GROUP BY 1, 2),
f AS (SELECT symbol, a, m, last FROM p), q AS (SELECT p.symbol, p.a, (SELECT min(nd) FROM n WHERE n.symbol = p.symbol AND n.day = p.a) AS nd, (SELECT min(f.last) FROM f WHERE f.symbol = p.symbol AND f.m >= p.m + 3) AS late, (SELECT max(f.last) FROM f WHERE f.symbol = p.symbol) AS fin FROM p)
SELECT q.symbol, strftime(least(nd, late, fin), '%Y-%m') AS month, 'dip' AS schedule, least(nd, late, fin) AS day, any_value(d.close) AS price, count(*) * 100.0 AS spend FROM q JOIN daily d ON d.symbol = q.symbol AND d.day = least(nd, late, fin) GROUP BY 1, 2, 3, 4""")
def dip_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(schedules.dip_band(tables.daily_closes(spark, d), 100, 0.1, 60))


# Statistics ----------------------------------------------------------------------------------------------------------


@query("m01_feature_moments", f"{T} SELECT 'size' AS feature, count(size) AS n, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS deviation FROM trades UNION ALL SELECT 'confidence', count(confidence), round(avg(confidence), 6), round(stddev_pop(confidence), 6) FROM trades")
def feature_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.moments(tables.trades(spark, d), ["size", "confidence"]))


@query("m03_ridge_scores")
def ridge_scores(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("won", (F.col("net_r") > 0).cast("double"))
    w = stats.fit_ridge(t, ["size", "confidence", "hour", "notional"], "won", 1.0)
    return t.select("symbol", "id", F.round(stats.linear_score(w), 8).alias("score"), F.round(stats.probability(w), 8).alias("probability"))


@query("m04_single_feature_threshold", f"{T} SELECT round((avg(size) FILTER (net_r > 0) + avg(size) FILTER (NOT net_r > 0)) / 2, 6) AS threshold, CASE WHEN avg(size) FILTER (net_r > 0) >= avg(size) FILTER (NOT net_r > 0) THEN 1 ELSE -1 END AS direction FROM trades")
def single_feature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.single_feature_threshold(tables.trades(spark, d).withColumn("won", (F.col("net_r") > 0).cast("int")), "size", "won"))


@query("m06_threshold_sweep", f"""{T}, g AS (SELECT threshold, count(net_r) AS trades, round(avg(net_r), 8) AS mean_r FROM trades JOIN (SELECT unnest([CAST(0.0 AS DOUBLE), 0.2, 0.4, 0.6, 0.8]) AS threshold) ON threshold <= confidence GROUP BY 1)
SELECT threshold, trades, mean_r, row_number() OVER (ORDER BY trades >= 1000 DESC, mean_r DESC, trades DESC, threshold DESC) = 1 AS chosen FROM g""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return stats.threshold_sweep(tables.trades(spark, d), "confidence", "net_r", [0.0, 0.2, 0.4, 0.6, 0.8], 1000)


@query("m11_roc_auc", f"""{T}, x AS (SELECT symbol, CAST(net_r > 0 AS INT) AS y, rank() OVER (PARTITION BY symbol ORDER BY size) + (count(*) OVER (PARTITION BY symbol, size) - 1) / 2.0 AS r FROM trades)
SELECT symbol, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc, count(*) AS rows FROM x GROUP BY 1""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return stats.roc_auc(tables.trades(spark, d).withColumn("y", (F.col("net_r") > 0).cast("int")), "size", "y", ["symbol"])


@query("a39_rank_stability", f"""{T}, x AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY size) + (count(*) OVER (PARTITION BY symbol, size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY notional) + (count(*) OVER (PARTITION BY symbol, notional) - 1) / 2.0 AS b FROM trades)
SELECT symbol, round(corr(a, b), 6) AS spearman, count(*) AS rows FROM x GROUP BY 1""")
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.spearman(tables.trades(spark, d), "size", "notional", ["symbol"]))


def _resampled(keys: str, source: str, seed: str, block: int = 30, iterations: int = 500) -> str:
    """SQL of block_bootstrap(): v(keys, o, r) -> b(keys, n, mean, low, high, naive_t)."""
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys.split(", "))
    return f"""v AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY o) - 1 AS i FROM ({source})),
n AS (SELECT {keys}, count(*) AS n, CAST(ceil(count(*) / {block}.0) AS BIGINT) AS b, avg(r) AS mean, stddev_samp(r) AS d, min(r) AS lo, max(r) AS hi FROM v GROUP BY ALL),
k AS (SELECT {keys}, id // b AS it, id % b AS j, ('0x' || substr(md5(id || ':' || {seed}), 1, 8))::BIGINT % (n - {block - 1}) AS s, n, b FROM (SELECT *, unnest(range(0, {iterations} * b)) AS id FROM n WHERE n > {block})),
c AS (SELECT {keys}, i + 1 AS i, sum(r) OVER (PARTITION BY {keys} ORDER BY i) AS p FROM v UNION ALL SELECT {keys}, 0, 0 FROM n),
m AS (SELECT {", ".join("k." + c for c in keys.split(", "))}, k.it, sum(z.p - a.p) / max(n) AS m FROM k JOIN c a ON {on("a", "k")} AND a.i = s JOIN c z ON {on("z", "k")} AND z.i = s + CASE WHEN j = b - 1 THEN n - (b - 1) * {block} ELSE {block} END GROUP BY ALL),
q AS (SELECT {keys}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL),
b AS (SELECT {", ".join("n." + c for c in keys.split(", "))}, n, mean, coalesce(low, lo) AS low, coalesce(high, hi) AS high, CASE WHEN n >= 2 THEN CASE WHEN d > 0 THEN mean / (d / sqrt(n)) ELSE 0 END END AS naive_t FROM n LEFT JOIN q ON {on("q", "n")})"""


@query("m12_block_bootstrap", f"""{T}, {_resampled("g", "SELECT 0 AS g, decision_t AS o, avg(net_r) AS r FROM trades GROUP BY 2", "7")}
SELECT n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(naive_t, 6) AS naive_t FROM b""")
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    daily = tables.trades(spark, d).groupBy("decision_t").agg(F.avg("net_r").alias("r"))
    return rounded(stats.block_bootstrap(daily, "r", "decision_t", 30, 500, 7))


@query("m12_grouped_bootstrap", f"""{T}, {_resampled("symbol, hour", "SELECT symbol, hour, decision_t AS o, avg(net_r) AS r FROM trades GROUP BY 1, 2, 3", "7", iterations=100)}
SELECT symbol, hour, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(naive_t, 6) AS naive_t FROM b""")
def grouped_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of all symbols and hours in one job."""
    daily = tables.trades(spark, d).groupBy("symbol", "hour", "decision_t").agg(F.avg("net_r").alias("r"))
    return rounded(stats.block_bootstrap(daily, "r", "decision_t", 30, 100, 7, by=["symbol", "hour"]))


@query("m13_difference_interval", f"""{T}, {_resampled("symbol, early", "SELECT symbol, hour < 12 AS early, decision_t AS o, avg(net_r) AS r FROM trades GROUP BY 1, 2, 3", "CASE WHEN early THEN 11 ELSE 12 END", iterations=200)}
SELECT x.symbol, x.n + y.n AS n, round(x.mean - y.mean, 6) AS difference, round(x.mean - y.mean - sqrt(pow((x.high - x.low) / 2, 2) + pow((y.high - y.low) / 2, 2)), 6) AS low, round(x.mean - y.mean + sqrt(pow((x.high - x.low) / 2, 2) + pow((y.high - y.low) / 2, 2)), 6) AS high FROM b x JOIN b y ON x.symbol = y.symbol AND x.early AND NOT y.early""")
def difference_interval(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("hour") < 12
    daily = tables.trades(spark, d).groupBy("symbol", early.alias("early"), "decision_t").agg(F.avg("net_r").alias("r"))
    return rounded(stats.difference_interval(daily, ["symbol"], F.col("early"), "r", "decision_t", 30, 200, 11))


_FORWARD = f"""{T}, lim AS (SELECT min(decision_t) AS lo, max(decision_t) AS hi FROM trades),
s AS (SELECT *, CAST(least(5, floor((decision_t - lo) * 6.0 / (hi - lo))) AS INT) AS fold, greatest(0, floor((exit_t + 604800 - lo) * 6.0 / (hi - lo)) + 1) AS since, CAST(net_r > 0 AS INT) AS y FROM trades, lim),
tr AS (SELECT k.fold, s.* EXCLUDE (fold) FROM s JOIN (SELECT CAST(unnest(range(6)) AS INT) AS fold) k ON s.since <= k.fold),
m AS (SELECT fold, count(*) AS n, max(decision_t) AS train_end, sum(y) AS p, avg(y) AS ym, avg(size) AS a1, avg(confidence) AS a2, stddev_pop(size) AS s1, stddev_pop(confidence) AS s2, covar_pop(size, confidence) AS c12, covar_pop(size, y) AS b1, covar_pop(confidence, y) AS b2 FROM tr GROUP BY 1 HAVING count(*) >= 400 AND sum(y) BETWEEN 1 AND count(*) - 1),
z AS (SELECT *, n + 1.0 AS d, n * c12 / (s1 * s2) AS o, n * b1 / s1 AS r1, n * b2 / s2 AS r2 FROM m), w AS (SELECT *, (d * r1 - o * r2) / (d * d - o * o) / s1 AS w1, (d * r2 - o * r1) / (d * d - o * o) / s2 AS w2 FROM z),
f AS (SELECT *, ym - w1 * a1 - w2 * a2 AS w0 FROM w),
te AS (SELECT s.*, round(1 / (1 + exp(-(w0 + w1 * size + w2 * confidence))), 12) AS p FROM s JOIN f USING (fold)), ts AS (SELECT tr.*, round(1 / (1 + exp(-(w0 + w1 * size + w2 * confidence))), 12) AS p FROM tr JOIN f USING (fold)),
cut AS (SELECT fold, quantile_cont(p, 0.5) AS threshold FROM ts GROUP BY 1)"""


def _auc_sql(rows: str) -> str:
    return f"SELECT fold, count(*) AS n, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY fold, round(p, 12)) - 1) / 2.0 AS r FROM {rows}) GROUP BY 1"


def _forward(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tables.trades(spark, d).withColumn("y", (F.col("net_r") > 0).cast("int"))
    return stats.walk_forward(t, ["size", "confidence"], "y", "decision_t", "exit_t")


@query("m09_walk_forward", _FORWARD + " SELECT id, te.fold, round(p, 9) AS probability, p >= threshold - 1e-12 AS selected FROM te JOIN cut USING (fold)")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of every trade by a model of trades that were over a week before its fold."""
    return _forward(spark, d)[0].select("id", "fold", F.round("probability", 9).alias("probability"), "selected")


@query("m09_fold_report", _FORWARD + f""", a AS ({_auc_sql("te")}), b AS ({_auc_sql("ts")}) SELECT fold, b.n AS train_size, a.n AS test_size, train_end, round(threshold, 9) AS threshold, round(a.auc, 6) AS auc, round(b.auc, 6) AS train_auc FROM a JOIN b USING (fold) JOIN cut USING (fold) JOIN m USING (fold)""")
def fold_report(spark: SparkSession, d: str) -> DataFrame:
    x = _forward(spark, d)[1]
    return x.select("fold", "train_size", "test_size", "train_end", F.round("threshold", 9).alias("threshold"), F.round("auc", 6).alias("auc"), F.round("train_auc", 6).alias("train_auc"))


@query("m09_purged_folds", f"""{T}, f AS (SELECT * FROM (VALUES (0, 852076800, 883612800), (1, 883612800, 915148800)) AS v(fold, lo, hi))
SELECT fold, CASE WHEN decision_t >= lo AND decision_t < hi THEN 'test' WHEN exit_t < lo - 864000 THEN 'train' END AS part, count(*) AS rows, round(avg(net_r), 8) AS mean_r FROM trades CROSS JOIN f WHERE (decision_t >= lo AND decision_t < hi) OR exit_t < lo - 864000 GROUP BY 1, 2""")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    x = stats.purged_folds(tables.trades(spark, d), "decision_t", "exit_t", [(852076800, 883612800), (883612800, 915148800)], 864000)
    return x.groupBy("fold", "part").agg(F.count("*").alias("rows"), F.round(F.avg("net_r"), 8).alias("mean_r"))


@query("m15_quantiles", f"{T} SELECT symbol, quantile_disc(notional, 0.95) AS nearest, round(quantile_cont(notional, 0.95), 6) AS linear FROM trades GROUP BY 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d)
    return t.groupBy("symbol").agg(F.expr("percentile_disc(0.95) within group (order by notional)").alias("nearest"), F.round(F.percentile("notional", F.lit(0.95)), 6).alias("linear"))


@query("o05_argmax_with_ties", f"{T} SELECT symbol, arg_max(hour, r * 1000000 + hour) AS best_hour FROM (SELECT symbol, hour, round(avg(net_r), 4) AS r FROM trades GROUP BY 1, 2) GROUP BY 1")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    g = tables.trades(spark, d).groupBy("symbol", "hour").agg(F.round(F.avg("net_r"), 4).alias("r"))
    return g.groupBy("symbol").agg(F.max_by("hour", F.col("r") * 1000000 + F.col("hour")).alias("best_hour"))


@query("o06_latest_slice", f"{T} SELECT symbol, id, decision_t FROM trades WHERE decision_t = (SELECT max(decision_t) FROM trades)")
def latest_slice(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d)
    return t.where(F.col("decision_t") == t.agg(F.max("decision_t")).scalar()).select("symbol", "id", "decision_t")

"""Queries of pricing, performance and monitoring over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators import metrics, schedules
from tideframe.operators import performance as pf
from tideframe.plans.market import CANDLES, query, rounded
from tideframe.plans.outcomes import _CURVE, _ORDER, _curve
from tideframe.sources import tables
from tideframe.sources.tables import DAILY_SQL, TRADES_SQL

T = f"WITH {TRADES_SQL}"
D = f"WITH {DAILY_SQL}"
_PF = "CASE WHEN coalesce(sum(CASE WHEN {r} < 0 THEN {r} END), 0) = 0 THEN NULL ELSE coalesce(sum(CASE WHEN {r} > 0 THEN {r} END), 0) / abs(sum(CASE WHEN {r} < 0 THEN {r} END)) END"


def pf_sql(r: str) -> str:
    return _PF.replace("{r}", r)


_PRICED = f"""{T}, x AS (SELECT id, symbol, side, decision_t, net_r AS gross_r, 0.005 + 0.001 * (hour % 5) AS stop_share, (exit_t - decision_t) / 3600.0 AS hours_held FROM trades),
n AS (SELECT *, least(0.01 / stop_share, 1.5) AS notional_share FROM x), p AS (SELECT *, notional_share * 0.0022 AS cost, notional_share * 0.00001 * hours_held * CASE WHEN side = 'long' THEN 1 ELSE -1 END AS funding FROM n),
q AS (SELECT *, gross_r - (cost + funding) / (notional_share * stop_share) AS r FROM p)"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).select("id", "symbol", "side", "decision_t", F.col("net_r").alias("gross_r"), (0.005 + 0.001 * (F.col("hour") % 5)).alias("stop_share"), ((F.col("exit_t") - F.col("decision_t")) / 3600).alias("hours_held"))
    return pf.priced(t, 0.01, 1.5, 0.0006, 0.0005, 0.00001)


@query("w63_trade_pricing", _PRICED + " SELECT id, round(notional_share, 6) AS notional_share, round(cost, 8) AS cost, round(funding, 8) AS funding, round(r, 6) AS net_r FROM q")
def trade_pricing(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("id", F.round("notional_share", 6).alias("notional_share"), F.round("cost", 8).alias("cost"), F.round("funding", 8).alias("funding"), F.round("net_r", 6).alias("net_r"))


@query("a33_study_breakdown", _PRICED + f""", g AS (SELECT 'symbol' AS level, symbol AS value, * EXCLUDE (symbol) FROM q UNION ALL SELECT 'side', side, * EXCLUDE (symbol) FROM q UNION ALL SELECT 'quarter', year(make_timestamp(decision_t * 1000000)) || '-Q' || quarter(make_timestamp(decision_t * 1000000)), * EXCLUDE (symbol) FROM q)
SELECT level, value, count(*) AS rows, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS win_rate, round(avg(gross_r), 6) AS mean_before, round(avg(r), 6) AS mean_after, round({pf_sql('r')}, 6) AS profit_factor FROM g GROUP BY 1, 2""")
def study_breakdown(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.functions.scalars import calendar_keys

    x = _priced(spark, d)
    return rounded(pf.study_breakdown(x, {"symbol": F.col("symbol"), "side": F.col("side"), "quarter": calendar_keys(F.timestamp_seconds("decision_t"))["quarter"]}, "gross_r", "net_r"))


@query("a44_cost_sensitivity", _PRICED + """ SELECT symbol, 'before' AS costs, count(*) AS rows, round(avg(gross_r), 6) AS mean_r, round(avg(CAST(gross_r > 0 AS DOUBLE)), 6) AS win_rate FROM q GROUP BY 1 UNION ALL SELECT symbol, 'after', count(*), round(avg(r), 6), round(avg(CAST(r > 0 AS DOUBLE)), 6) FROM q GROUP BY 1""")
def cost_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.cost_sensitivity(_priced(spark, d), {"before": F.lit(0.0), "after": F.col("gross_r") - F.col("net_r")}, ["symbol"], "gross_r"))


_DAILY_EQUITY = _CURVE + """, l AS (SELECT book, decision_t // 86400 AS day, arg_max(equity, n) AS q FROM c GROUP BY 1, 2), g AS (SELECT book, unnest(generate_series(min(day), max(day))) AS day FROM l GROUP BY 1),
e AS (SELECT g.book, g.day, last_value(q IGNORE NULLS) OVER (PARTITION BY g.book ORDER BY g.day) AS equity FROM g LEFT JOIN l ON l.book = g.book AND l.day = g.day)"""


@query("a29_risk_adjusted", _DAILY_EQUITY + """, r AS (SELECT book, day, equity / lag(equity) OVER (PARTITION BY book ORDER BY day) - 1 AS r, equity FROM e), m AS (SELECT book, avg(r) AS m, stddev_pop(r) AS s, stddev_pop(r) FILTER (round(r, 12) < 0) AS dn, max(day) - min(day) AS span, arg_max(equity, day) / arg_min(equity, day) AS growth FROM r GROUP BY 1),
w AS (SELECT book, max((peak - equity) / peak) AS dd FROM dd GROUP BY 1), h AS (SELECT book, sum(exit_t - decision_t) / (greatest(max(exit_t) - min(decision_t), 86400) * count(DISTINCT hour)) AS x, sum(0.0002 * size) AS c FROM k GROUP BY 1)
SELECT book, round(coalesce(m / nullif(s, 0) * sqrt(365), 0), 6) AS sharpe, round(coalesce(m / nullif(dn, 0) * sqrt(365), 0), 6) AS sortino, round(pow(growth, 365.0 / span) - 1, 6) AS annual_return, round(dd, 6) AS max_drawdown, round(x, 6) AS exposure, round(c, 6) AS cost_drag FROM m JOIN w USING (book) JOIN h USING (book)""")
def risk_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Books as scenarios, hours of the day as pairs, costs by size."""
    curve = _curve(spark, d)
    daily = pf.daily_equity(curve, ["book"], "decision_t", F.col("_n"))
    worst = curve.groupBy("book").agg(F.max("drawdown").alias("max_drawdown"))
    t = tables.trades(spark, d).withColumn("book", F.concat("symbol", "side"))
    load = metrics.trade_load(t, ["book"], "hour", "decision_t", "exit_t", 0.0002 * F.col("size"))
    return rounded(metrics.risk_adjusted(daily, ["book"]).join(worst, "book").join(load, "book"))


@query("a28_monthly_returns", _DAILY_EQUITY + """ SELECT book, strftime(make_timestamp(day * 86400000000), '%Y-%m') AS month, round(arg_max(equity, day) / arg_min(equity, day) - 1, 6) AS month_return FROM e GROUP BY 1, 2""")
def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    daily = pf.daily_equity(_curve(spark, d), ["book"], "decision_t", F.col("_n"))
    month = F.date_format(F.timestamp_seconds(F.col("day") * 86400), "yyyy-MM")
    g = daily.groupBy("book", month.alias("month")).agg((F.max_by("equity", "day") / F.min_by("equity", "day") - 1).alias("month_return"))
    return rounded(g)


_MONTHS = _CURVE + """, m AS (SELECT book, strftime(make_timestamp(decision_t * 1000000), '%Y-%m') AS month, exp(sum(ln(1 + 0.01 * net_r))) - 1 AS r FROM k GROUP BY 1, 2)"""


def _months(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("book", F.concat("symbol", "side"))
    month = F.date_format(F.timestamp_seconds("decision_t"), "yyyy-MM")
    return t.groupBy("book", month.alias("month")).agg((F.exp(F.sum(F.ln(1 + 0.01 * F.col("net_r")))) - 1).alias("r"))


@query("a27_monthly_target", _MONTHS + """ SELECT book, count(*) AS months, round(CASE WHEN min(r) <= -1 THEN -1 ELSE pow(exp(sum(ln(1 + r))), 1.0 / count(*)) - 1 END, 6) AS geometric_mean, round(avg(r), 6) AS mean_month, round(avg(CAST(r >= 0.005 AS DOUBLE)), 6) AS target_rate, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS positive_rate FROM m GROUP BY 1""")
def monthly_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.monthly_target(_months(spark, d), ["book"], "r", 0.005))


@query("o07_best_worst_month", _MONTHS + """, z AS (SELECT book, month, round(r, 6) AS r FROM m) SELECT book, arg_min(month, (-r, month)) AS best, max(r) AS best_value, arg_min(month, (r, month)) AS worst, min(r) AS worst_value FROM z GROUP BY 1""")
def best_worst_month(spark: SparkSession, d: str) -> DataFrame:
    return pf.best_and_worst(_months(spark, d).withColumn("r", F.round("r", 6)), ["book"], "month", "r")


@query("a30_buy_and_hold", D + """, b AS (SELECT symbol, arg_min(close, day) AS b FROM daily GROUP BY 1) SELECT day, round(avg(close / b.b), 6) AS index FROM daily JOIN b USING (symbol) GROUP BY 1 HAVING count(*) = 5""")
def buy_and_hold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.buy_and_hold(tables.daily_closes(spark, d), "symbol", "day", "close", 5))


@query("a31_basket_index", D + """, b AS (SELECT symbol, arg_min(close, day) AS b FROM daily GROUP BY 1) SELECT day, round(avg(close / b.b), 6) AS index, count(*) AS symbols FROM daily JOIN b USING (symbol) GROUP BY 1""")
def basket_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.basket_index(tables.daily_closes(spark, d), "symbol", "day", "close"))


@query("a32_slice_report", f"""{T}, s AS (SELECT 'all' AS slice, count(*) AS rows, avg(net_r) AS m FROM trades UNION ALL SELECT 'confident', count(*), avg(net_r) FROM trades WHERE confidence >= 0.6 UNION ALL SELECT 'small', count(*), avg(net_r) FROM trades WHERE size < 10 UNION ALL SELECT 'late', count(*), avg(net_r) FROM trades WHERE hour >= 20)
SELECT slice, rows, round(m, 6) AS mean_r, slice = (SELECT arg_max(slice, (m, slice)) FROM s WHERE rows >= 10) AS best, rows >= 30 AND m > (SELECT m FROM s WHERE slice = 'all') AS useful FROM s""")
def slice_report(spark: SparkSession, d: str) -> DataFrame:
    cuts = {"all": F.lit(True), "confident": F.col("confidence") >= 0.6, "small": F.col("size") < 10, "late": F.col("hour") >= 20}
    return rounded(pf.slices(tables.trades(spark, d), cuts, "net_r", 10))


@query("a34_mean_over_runs", f"""{T} SELECT symbol, round(avg(m), 6) AS mean_r, round(avg(CASE WHEN f IS NOT NULL THEN f END), 6) AS profit_factor FROM (SELECT symbol, hour, avg(net_r) AS m, {pf_sql('net_r')} AS f FROM trades GROUP BY 1, 2) GROUP BY 1""")
def mean_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """Hours as runs; a run without losses has no finite profit factor."""
    runs = tables.trades(spark, d).groupBy("symbol", "hour").agg(F.avg("net_r").alias("mean_r"), metrics.profit_factor(F.col("net_r")).alias("profit_factor"))
    return rounded(pf.mean_over_runs(runs, ["symbol"], ["mean_r", "profit_factor"]))


@query("a15_swing_metrics", f"""{T}, x AS (SELECT *, hour < 20 AS done, CASE WHEN net_r > 0 THEN 'target' ELSE 'time' END AS why FROM trades), c AS (SELECT symbol, array_to_string(list_sort(list(why || '=' || n)), ',') AS reasons FROM (SELECT symbol, why, count(*) AS n FROM x WHERE done GROUP BY 1, 2) GROUP BY 1)
SELECT x.symbol, count(*) FILTER (done) AS closed, count(*) FILTER (NOT done) AS open, round(avg(net_r) FILTER (done), 6) AS mean_r, round(median(net_r) FILTER (done), 6) AS median_r, round(avg(CAST(net_r > 0 AS DOUBLE)) FILTER (done), 6) AS win_rate,
round(sum(net_r) FILTER (done AND net_r > 0) / abs(sum(net_r) FILTER (done AND net_r < 0)), 6) AS profit_factor, round(avg((exit_t - decision_t) / 3600.0) FILTER (done), 6) AS mean_hours, any_value(c.reasons) AS reasons FROM x JOIN c USING (symbol) GROUP BY 1""")
def swing_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("hours", (F.col("exit_t") - F.col("decision_t")) / 3600).withColumn("why", F.when(F.col("net_r") > 0, "target").otherwise("time"))
    return rounded(pf.swing_metrics(t, ["symbol"], "net_r", "hours", "why", F.col("hour") < 20))


@query("a16_position_breadth", f"""{T}, p AS (SELECT side, symbol || '-' || hour AS g, avg(net_r) AS m FROM trades GROUP BY 1, 2) SELECT side, count(*) AS groups, round(avg(CAST(m > 0 AS DOUBLE)), 6) AS positive_share FROM p GROUP BY 1""")
def position_breadth(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("g", F.concat_ws("-", "symbol", "hour"))
    return rounded(pf.positive_breadth(t, ["side"], "g", "net_r"))


@query("a20_concentration", f"""{T}, g AS (SELECT hour, count(*) AS n, sum(CASE WHEN net_r > 0 THEN net_r ELSE 0 END) AS g FROM trades GROUP BY 1) SELECT count(*) AS groups, round(max(n) / sum(n), 6) AS row_share, round(max(g) / sum(g), 6) AS gain_share FROM g""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.concentration(tables.trades(spark, d), "hour", "net_r"))


_RULES = "(VALUES ('confident'), ('not_late'), ('both')) r(rule)"


@query("a17_rule_report", f"""{T}, x AS (SELECT symbol, rule, net_r, CASE rule WHEN 'confident' THEN confidence >= 0.4 WHEN 'not_late' THEN hour < 20 ELSE confidence >= 0.4 AND hour < 20 END AS keep FROM trades CROSS JOIN {_RULES})
SELECT symbol, rule, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS skipped, round(avg(net_r) FILTER (keep), 6) AS mean_kept, round(avg(net_r) FILTER (NOT keep), 6) AS mean_skipped FROM x GROUP BY 1, 2""")
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("confidence") >= 0.4, F.col("hour") < 20
    return rounded(pf.rule_report(tables.trades(spark, d), {"confident": a, "not_late": b, "both": a & b}, ["symbol"], "net_r"))


@query("a43_abstention_sensitivity", f"""{T}, x AS (SELECT CASE WHEN hour < 8 THEN 'asia' WHEN hour < 16 THEN 'europe' ELSE 'us' END AS session, rule, net_r, CASE rule WHEN 'baseline' THEN true WHEN 'confident' THEN confidence >= 0.4 ELSE size < 30 END AS keep FROM trades CROSS JOIN (VALUES ('baseline'), ('confident'), ('small')) r(rule))
SELECT session, rule, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS skipped, round(avg(net_r) FILTER (keep), 6) AS mean_kept, round(avg(net_r) FILTER (NOT keep), 6) AS mean_skipped FROM x GROUP BY 1, 2""")
def abstention_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.functions.scalars import session_of

    t = tables.trades(spark, d).withColumn("session", session_of(F.col("hour")))
    return rounded(pf.rule_report(t, {"baseline": F.lit(True), "confident": F.col("confidence") >= 0.4, "small": F.col("size") < 30}, ["session"], "net_r"))


@query("a22_monitoring", f"""{T} SELECT symbol, count(*) FILTER (hour < 20) AS closed, count(*) FILTER (hour >= 20) AS open, round(avg(net_r) FILTER (hour < 20), 6) AS mean_r, max(decision_t) // 86400 - min(decision_t) // 86400 + 1 AS days, count(*) FILTER (hour < 20 AND confidence >= 0.5) AS reached, count(*) FILTER (hour < 20 AND confidence >= 0.5 AND net_r < 0) AS reached_then_lost FROM trades GROUP BY 1""")
def monitoring(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.monitoring(tables.trades(spark, d), ["symbol"], "net_r", "confidence", "decision_t", F.col("hour") < 20, 0.5))


@query("a23_policy_metrics", f"""{T}, x AS (SELECT unnest(['hold', 'half', 'flip']) AS policy, unnest([net_r, net_r / 2, -net_r]) AS outcome FROM trades) SELECT policy, count(outcome) AS rows, round(avg(outcome), 6) AS mean_r, count(*) FILTER (outcome > 0) AS positive FROM x GROUP BY 1""")
def policy_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("net_r")
    t = tables.trades(spark, d).select(F.create_map(F.lit("hold"), r, F.lit("half"), r / 2, F.lit("flip"), -r).alias("outcomes"))
    return rounded(pf.policy_metrics(t, "outcomes"))


@query("a24_skip_outcomes", f"""{T}, x AS (SELECT 'low_confidence' AS reason, net_r FROM trades WHERE confidence < 0.4 UNION ALL SELECT 'late', net_r FROM trades WHERE hour >= 20)
SELECT reason, count(net_r) AS rows, round(avg(net_r), 6) AS mean_r, round(median(net_r), 6) AS median_r, round(avg(CAST(net_r > 0 AS DOUBLE)), 6) AS win_rate, round(coalesce({pf_sql('net_r')}, 0), 6) AS profit_factor FROM x GROUP BY 1""")
def skip_outcomes(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.operators.setups import reasons

    t = tables.trades(spark, d).select("net_r", reasons({"low_confidence": F.col("confidence") < 0.4, "late": F.col("hour") >= 20}).alias("reasons"))
    return rounded(pf.reason_outcomes(t, "reasons", "net_r"))


@query("a25_stream_evidence", f"""{T}, s AS (SELECT symbol || side AS stream, count(DISTINCT decision_t // 86400) AS days, max(decision_t) AS last_t, count(*) AS trades, bool_or(hour = 3) AS flagged FROM trades GROUP BY 1)
SELECT max(days) AS days, max(last_t) AS last_t, CAST(sum(trades) AS BIGINT) AS trades, bool_or(flagged) AS flagged, concat_ws(',', CASE WHEN max(days) < 3000 THEN 'enough_days' END, CASE WHEN sum(trades) < 100 THEN 'enough_trades' END) AS failed FROM s""")
def stream_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("stream", F.concat("symbol", "side"))
    s = t.groupBy("stream").agg(F.count_distinct(F.expr("decision_t div 86400")).alias("days"), F.max("decision_t").alias("last_t"), F.count("*").alias("trades"), F.bool_or(F.col("hour") == 3).alias("flagged"))
    x = s.agg(F.max("days").alias("days"), F.max("last_t").alias("last_t"), F.sum("trades").alias("trades"), F.bool_or("flagged").alias("flagged"))
    return metrics.gates(x, {"enough_days": F.col("days") >= 3000, "enough_trades": F.col("trades") >= 100}).select("days", "last_t", "trades", "flagged", F.array_join("failed", ",").alias("failed"))


@query("a45_screen_decisions", f"""{T}, s AS (SELECT 'h' || hour AS scenario, count(*) AS rows, round(avg(net_r), 8) AS m FROM trades GROUP BY 1), b AS (SELECT m AS base FROM s WHERE scenario = 'h0'), x AS (SELECT scenario, rows, m, m - base AS gain, rows >= 10 AND m >= -0.5 AND m - base >= 0 AS passed FROM s, b)
SELECT scenario, rows, round(m, 6) AS mean_r, round(gain, 6) AS gain, passed, coalesce(scenario = (SELECT arg_max(scenario, (m, scenario)) FROM x WHERE passed), false) AS best FROM x""")
def screen_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = tables.trades(spark, d).groupBy(F.concat(F.lit("h"), "hour").alias("scenario")).agg(F.count("*").alias("rows"), F.round(F.avg("net_r"), 8).alias("mean_r"))
    return rounded(pf.screen_decisions(s, "h0", 10, -0.5, 0.0))


@query("a42_interval_coverage", CANDLES + """ SELECT symbol, min(t) AS first_t, max(t) AS last_t, count(DISTINCT t) AS rows, count(DISTINCT t) = (max(t) - min(t)) // 3600 + 1 AS complete FROM candles GROUP BY 1""")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pf.interval_coverage(tables.candles(spark, d), ["symbol"], "t", 3600)


# Campaigns -----------------------------------------------------------------------------------------------------------

_WEEKLY = D + """, m AS (SELECT *, strftime(day, '%Y-%m') AS month FROM daily), a AS (SELECT symbol, month, unnest([1, 8, 15, 22]) AS anchor FROM m GROUP BY symbol, month),
w AS (SELECT a.symbol, a.month, a.anchor, coalesce(min(CASE WHEN day(m.day) >= anchor THEN m.day END), max(m.day)) AS day FROM a JOIN m ON m.symbol = a.symbol AND m.month = a.month GROUP BY 1, 2, 3)"""


@query("w69_weekly_split", _WEEKLY + " SELECT w.symbol, w.month, 'weekly' AS schedule, w.day, any_value(d.close) AS price, count(*) * 25.0 AS spend FROM w JOIN daily d ON d.symbol = w.symbol AND d.day = w.day GROUP BY 1, 2, 3, 4")
def weekly_split(spark: SparkSession, d: str) -> DataFrame:
    return schedules.weekly_split(tables.daily_closes(spark, d), 100)


@query("w69_daily_split", D + " SELECT symbol, strftime(day, '%Y-%m') AS month, 'daily' AS schedule, day, close AS price, round(100.0 / count(*) OVER (PARTITION BY symbol, strftime(day, '%Y-%m')), 6) AS spend FROM daily")
def daily_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(schedules.daily_split(tables.daily_closes(spark, d), 100))


_CAMPAIGNS = D + """, x AS (SELECT *, year(day) * 12 + month(day) - 1 AS m FROM daily), s AS (SELECT symbol, min(m) AS a, max(m) AS z FROM x GROUP BY 1), st AS (SELECT symbol, unnest(generate_series(a, z - 11)) AS start FROM s), c AS (SELECT x.symbol, x.day, x.close, st.start FROM x JOIN st ON st.symbol = x.symbol AND x.m BETWEEN st.start AND st.start + 11)"""


@query("w72_rolling_campaigns", _CAMPAIGNS + " SELECT symbol, start, count(*) AS days, min(day) AS first_day, max(day) AS last_day, round(sum(close), 2) AS total_close FROM c GROUP BY 1, 2")
def rolling_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Every start month with its twelve months."""
    c = schedules.rolling_campaigns(tables.daily_closes(spark, d), 12)
    return c.groupBy("symbol", F.col("start").cast("bigint").alias("start")).agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.sum("close"), 2).alias("total_close"))


@query("a37_paired_summary", _CAMPAIGNS + """, b AS (SELECT symbol, start, strftime(day, '%Y-%m') AS month, 'day_' || lpad(CAST(a AS VARCHAR), 2, '0') AS schedule, coalesce(arg_min(close, CASE WHEN day(day) >= a THEN day END), arg_max(close, day)) AS price FROM c CROSS JOIN (SELECT unnest([1, 10, 20]) AS a) GROUP BY 1, 2, 3, 4),
e AS (SELECT symbol, start, schedule, count(*) / sum(1 / price) AS cb FROM b GROUP BY 1, 2, 3), g AS (SELECT schedule, (cb / avg(cb) OVER (PARTITION BY symbol, start) - 1) * 100 AS gap FROM e)
SELECT schedule, count(*) AS campaigns, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.05), 6) AS p5, round(quantile_cont(gap, 0.95), 6) AS p95 FROM g GROUP BY 1""")
def paired_summary(spark: SparkSession, d: str) -> DataFrame:
    c = schedules.rolling_campaigns(tables.daily_closes(spark, d), 12).withColumn("pair", F.col("symbol")).withColumn("symbol", F.concat_ws("@", "symbol", "start"))
    x = schedules.evaluate(schedules.fixed_day(c, [1, 10, 20], 100), c)
    return rounded(schedules.paired_summary(x, ["symbol"]))

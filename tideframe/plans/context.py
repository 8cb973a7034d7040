"""Queries of as-of contexts, panels and joins over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions import scalars
from tideframe.operators import asof as aj
from tideframe.operators import bars, features, panels, quality, ranking
from tideframe.plans.market import CANDLES, S, query, rounded
from tideframe.sources import tables
from tideframe.sources.tables import DAILY_SQL, FUNDING_SQL, TICKS_SQL, TRADES_SQL

H4, DAY = 4 * 3600, 86400
T = f"WITH {TRADES_SQL}"
K = f"WITH {TICKS_SQL}"


def z_sql(x: str, n: int, least: int, by: str = "symbol", order: str = "t") -> str:
    over = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN ({x} - avg({x}) {over}) / nullif(stddev_pop({x}) {over}, 0) END"


def least_sql(f: str, x: str, n: int, least: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {f}({x}) {over} END"


# As-of contexts ------------------------------------------------------------------------------------------------------

_H4 = CANDLES + f""", g AS (SELECT symbol, ((close_t - 1) // {H4} + 1) * {H4} AS e, arg_max(close, candles.close_t) AS close FROM candles GROUP BY 1, 2),
h AS (SELECT symbol, e AS known, close AS htf_close, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY e), 0) - 1 AS htf_return_1 FROM g)"""


def _h4(spark: SparkSession, d: str) -> DataFrame:
    g = bars.regroup(tables.candles(spark, d), H4, closed_only=False)
    r = features.returns(features.Series(order="close_t"), lags=(1,))["return_1"]
    return g.select("symbol", F.col("close_t").alias("known"), F.col("close").alias("htf_close"), r.alias("htf_return_1"))


@query("j06_asof_two_back", _H4 + " SELECT c.symbol, c.t, h.htf_close, round(h.htf_return_1, 6) AS htf_return_1 FROM candles c ASOF LEFT JOIN h ON c.symbol = h.symbol AND c.t >= h.known")
def asof_two_back(spark: SparkSession, d: str) -> DataFrame:
    """The latest longer bar that is known, and its change against the one before."""
    out = aj.asof(tables.candles(spark, d).select("symbol", "t"), _h4(spark, d), "t", "known", ["symbol"], ["htf_close", "htf_return_1"])
    return rounded(out.select("symbol", "t", "htf_close", "htf_return_1"))


_LEFT = CANDLES + f", {FUNDING_SQL}"


@query("j08_asof_lagged_change", CANDLES + """, l AS (SELECT symbol, t, t - 14400 AS before FROM candles), n AS (SELECT l.*, c.quote_volume AS now, c.close_t AS nt FROM l ASOF LEFT JOIN candles c ON l.symbol = c.symbol AND l.t >= c.close_t),
b AS (SELECT n.*, c.quote_volume AS earlier, c.close_t AS bt FROM n ASOF LEFT JOIN candles c ON n.symbol = c.symbol AND n.before >= c.close_t)
SELECT symbol, t, round(CASE WHEN t - nt <= 7200 AND before - bt <= 7200 AND earlier > 0 THEN now / earlier - 1 END, 6) AS change FROM b""")
def asof_lagged_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of a level against four hours before, both as of then and at most two hours old."""
    c = tables.candles(spark, d)
    right = c.select("symbol", F.col("close_t").alias("at"), "quote_volume")
    left = c.select("symbol", "t", (F.col("t") - 14400).alias("before"))
    now = aj.asof(left, right, "t", "at", ["symbol"], ["quote_volume"], max_age=7200, prefix="now_")
    both = aj.asof(now, right, "before", "at", ["symbol"], ["quote_volume"], max_age=7200, prefix="then_")
    return rounded(both.select("symbol", "t", panels.asof_change(F.col("now_quote_volume"), F.col("then_quote_volume")).alias("change")))


@query("j09_asof_known_at", _LEFT + """, p AS (SELECT symbol, funding_t, rate, funding_t + 300 AS known_at FROM funding) SELECT c.symbol, c.t, p.rate, p.funding_t FROM candles c ASOF LEFT JOIN p ON c.symbol = p.symbol AND c.t >= p.known_at""")
def asof_known_at(spark: SparkSession, d: str) -> DataFrame:
    p = panels.known_at(tables.funding(spark, d).select("symbol", "funding_t", "rate"), "funding_t", 300, ["symbol"])
    out = aj.asof(tables.candles(spark, d).select("symbol", "t"), p, "t", "known_at", ["symbol"], ["rate", "funding_t"])
    return out.select("symbol", "t", "rate", "funding_t")


_DAYS = CANDLES + """, dd AS (SELECT symbol, t // 86400 * 86400 + 86400 AS known, arg_max(close, candles.t) AS day_close, max(high) AS day_high FROM candles GROUP BY 1, 2)"""


def _days(spark: SparkSession, d: str) -> DataFrame:
    return tables.candles(spark, d).groupBy("symbol", F.expr("t div 86400 * 86400 + 86400").alias("known")).agg(F.max_by("close", "t").alias("day_close"), F.max("high").alias("day_high"))


@query("j10_asof_daily_context", _DAYS + " SELECT c.symbol, c.t, dd.day_close, dd.day_high FROM candles c ASOF LEFT JOIN dd ON c.symbol = dd.symbol AND c.close_t >= dd.known")
def asof_daily_context(spark: SparkSession, d: str) -> DataFrame:
    """Daily columns, seen from the day's close on only."""
    out = aj.asof(tables.candles(spark, d).select("symbol", "t", "close_t"), _days(spark, d), "close_t", "known", ["symbol"], ["day_close", "day_high"])
    return out.select("symbol", "t", "day_close", "day_high")


@query("j11_asof_reference_context", _DAYS + " SELECT c.symbol, c.t, v.day_close AS ref_close FROM candles c ASOF LEFT JOIN (SELECT * FROM dd WHERE symbol = 'view') v ON c.close_t >= v.known")
def asof_reference_context(spark: SparkSession, d: str) -> DataFrame:
    """One reference's daily columns for all symbols."""
    ref = _days(spark, d).where("symbol = 'view'").select("known", "day_close")
    left = tables.candles(spark, d).select("symbol", "t", "close_t")
    out = aj.asof_for_all(left, ref, "close_t", "known", ["day_close"], DAY)
    return out.select("symbol", "t", F.col("day_close").alias("ref_close"))


@query("w22_multi_timeframe", CANDLES + f""", g AS (SELECT symbol, ((close_t - 1) // {H4} + 1) * {H4} AS known, max(high) AS high, min(low) AS low, arg_max(close, candles.close_t) AS close FROM candles GROUP BY 1, 2),
m AS (SELECT *, lag(close) OVER o AS prev, CASE WHEN count(*) OVER w = 6 THEN avg(close) OVER w END AS ma, CASE WHEN count(*) OVER w = 6 THEN max(high) OVER w END AS hi, CASE WHEN count(*) OVER w = 6 THEN min(low) OVER w END AS lo, CASE WHEN count(*) OVER w = 6 THEN (high - low) / nullif(avg(high - low) OVER w, 0) END AS x FROM g WINDOW o AS (PARTITION BY symbol ORDER BY known), w AS (PARTITION BY symbol ORDER BY known ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, ma / nullif(lag(ma) OVER (PARTITION BY symbol ORDER BY known), 0) - 1 AS slope FROM m)
SELECT c.symbol, c.t, round(k.close / nullif(k.prev, 0) - 1, 6) AS h4_return_1, CAST(k.close >= ma AS INT) AS h4_trend_above_ma_6, CAST(sign(slope) AS INT) AS h4_ma_slope_sign_6, round((k.close - lo) / nullif(hi - lo, 0), 6) AS h4_range_position_6, CASE WHEN x < 0.75 THEN 0 WHEN x < 1.5 THEN 1 WHEN x < 2.5 THEN 2 WHEN x >= 2.5 THEN 3 END AS h4_volatility_bucket_6 FROM candles c ASOF LEFT JOIN k ON c.symbol = k.symbol AND c.t >= k.known""")
def multi_timeframe(spark: SparkSession, d: str) -> DataFrame:
    """Features of four-hour bars as known at each hourly bar."""
    h = bars.regroup(tables.candles(spark, d), H4, closed_only=False)
    x = features.timeframe_features(h, 6, "h4", features.Series(order="close_t")).withColumnRenamed("close_t", "known")
    names = [c for c in x.columns if c.startswith("h4_")]
    out = aj.asof(tables.candles(spark, d).select("symbol", "t"), x, "t", "known", ["symbol"], names)
    return rounded(out.select("symbol", "t", *(F.col(c).cast("int").alias(c) if c.split("_")[1] in ("trend", "ma", "volatility") else F.col(c) for c in names)))


@query("a10_timeframe_breadth", _H4 + """ SELECT known AS t, count(*) AS symbols, round(avg(CAST(htf_return_1 > 0 AS DOUBLE)), 6) AS positive_share, round(avg(htf_return_1), 6) AS mean_return FROM h GROUP BY 1""")
def timeframe_breadth(spark: SparkSession, d: str) -> DataFrame:
    g = _h4(spark, d).groupBy(F.col("known").alias("t")).agg(F.count("*").alias("symbols"), F.avg((F.col("htf_return_1") > 0).cast("double")).alias("positive_share"), F.avg("htf_return_1").alias("mean_return"))
    return rounded(g)


@query("a09_risk_on", CANDLES + """, r AS (SELECT symbol, t, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS ret FROM candles),
g AS (SELECT t, avg(CAST(ret > 0 AS DOUBLE)) AS a, max(CASE WHEN symbol = 'view' THEN CAST(ret > 0 AS DOUBLE) END) AS b, max(CASE WHEN symbol = 'click' THEN CAST(ret > 0 AS DOUBLE) END) AS c FROM r GROUP BY 1)
SELECT t, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0), 6) AS risk_on FROM g""")
def risk_on(spark: SparkSession, d: str) -> DataFrame:
    """Mean of those that are there: share of rising symbols, and whether each of two references rises."""
    c = tables.candles(spark, d)
    x = c.select("symbol", "t", (features.returns(S, lags=(1,))["return_1"] > 0).cast("double").alias("up"))
    g = x.groupBy("t").agg(F.avg("up").alias("a"), F.max(F.when(F.col("symbol") == "view", F.col("up"))).alias("b"), F.max(F.when(F.col("symbol") == "click", F.col("up"))).alias("c"))
    return rounded(g.select("t", scalars.mean_of_present(F.col("a"), F.col("b"), F.col("c")).alias("risk_on")))


# Panels --------------------------------------------------------------------------------------------------------------


@query("w34_funding_panel", f"{K}, {FUNDING_SQL}, f AS (SELECT symbol, funding_t AS t, rate FROM funding) SELECT symbol, t, rate AS funding_rate, round({least_sql('avg', 'rate', 9, 3)}, 8) AS funding_mean, round({least_sql('sum', 'rate', 21, 7)}, 8) AS funding_sum, round({z_sql('rate', 90, 22)}, 6) AS funding_z FROM f")
def funding_panel(spark: SparkSession, d: str) -> DataFrame:
    f = tables.funding(spark, d).select("symbol", F.col("funding_t").alias("t"), "rate")
    x = f.select("symbol", "t", *(c.alias(k) for k, c in panels.funding_features(S).items()))
    return x.select("symbol", "t", "funding_rate", F.round("funding_mean", 8).alias("funding_mean"), F.round("funding_sum", 8).alias("funding_sum"), F.round("funding_z", 6).alias("funding_z"))


@query("w21_funding_window", CANDLES + f""", {FUNDING_SQL}, f AS (SELECT symbol, funding_t AS t, available_t, rate FROM funding), x AS (SELECT symbol, t AS due, available_t, rate, {least_sql('avg', 'rate', 9, 9)} AS m, {z_sql('rate', 9, 9)} AS z FROM f)
SELECT c.symbol, c.t, rate AS funding_rate, round(m, 8) AS funding_mean, round(z, 6) AS funding_z, round(abs(z), 6) AS funding_z_size, CAST(rate > 0 AS INT) AS funding_positive, abs(rate) AS funding_size, round((c.t - due) / 3600.0, 6) AS hours_since_funding, round(greatest(8 - (c.t - due) / 3600.0, 0), 6) AS hours_to_funding FROM candles c ASOF LEFT JOIN x ON c.symbol = x.symbol AND c.t >= x.available_t""")
def funding_window(spark: SparkSession, d: str) -> DataFrame:
    x = panels.funding_window(tables.candles(spark, d).select("symbol", "t"), tables.funding(spark, d), 9)
    return x.select("symbol", "t", *(F.round(c, 8 if c == "funding_mean" else 6).alias(c) if k == "double" else F.col(c) for c, k in x.dtypes if c not in ("symbol", "t")))


@query("w35_metrics_panel", CANDLES + f""", m AS (SELECT symbol, t, ln(quote_volume) AS oi, taker_buy / nullif(quote_volume - taker_buy, 0) AS ls FROM candles WHERE quote_volume > 0)
SELECT symbol, t, round(oi - lag(oi, 4) OVER w, 6) AS oi_diff_4, round(oi - lag(oi, 24) OVER w, 6) AS oi_diff_24, round({z_sql('oi', 96, 24)}, 6) AS oi_z, round(ls, 6) AS long_short, round({z_sql('ls', 48, 12)}, 6) AS long_short_z FROM m WINDOW w AS (PARTITION BY symbol ORDER BY t)""")
def metrics_panel(spark: SparkSession, d: str) -> DataFrame:
    m = tables.candles(spark, d).where("quote_volume > 0").withColumn("ls", scalars.ratio(F.col("taker_buy"), F.col("quote_volume") - F.col("taker_buy")))
    x = features.in_chunks(m, S, 100)
    x = x.select("symbol", "t", "_own", "_row", "_chunk", *(c.alias(k) for k, c in panels.metrics_features(features.CHUNKED, "quote_volume", "ls", (4, 24), 96, 48).items()))
    return rounded(features.own_rows(x).drop("_row"))


_DEPTHS = f"{K}, lv AS (SELECT symbol, t // 3600 * 3600 AS t, k % 11 - 5 AS pct, price AS notional FROM ticks)"


@query("w36_depth_panel", _DEPTHS + f""", p AS (SELECT symbol, t, coalesce(sum(notional) FILTER (pct < 0 AND pct >= -1), 0) AS b1, coalesce(sum(notional) FILTER (pct > 0 AND pct <= 1), 0) AS a1, coalesce(sum(notional) FILTER (pct < 0), 0) AS b5, coalesce(sum(notional) FILTER (pct > 0), 0) AS a5 FROM lv GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN b5 + a5 > 0 THEN ln(b5 + a5) END AS ld FROM p)
SELECT symbol, t, round((b1 - a1) / nullif(b1 + a1, 0), 6) AS imbalance_near, round((b5 - a5) / nullif(b5 + a5, 0), 6) AS imbalance_far, round((b1 + a1) / nullif(b5 + a5, 0), 6) AS concentration, round({z_sql('ld', 48, 12)}, 6) AS depth_z FROM l""")
def depth_panel(spark: SparkSession, d: str) -> DataFrame:
    lv = tables.ticks(spark, d).select("symbol", F.expr("t div 3600 * 3600").alias("t"), (F.col("k") % 11 - 5).alias("pct"), F.col("price").alias("notional"))
    part = lambda lo, hi: F.coalesce(F.sum(F.when(F.col("pct").between(lo, hi), F.col("notional"))), F.lit(0.0))
    p = lv.groupBy("symbol", "t").agg(part(-1, -1).alias("bid_1"), part(1, 1).alias("ask_1"), part(-5, -1).alias("bid_5"), part(1, 5).alias("ask_5"))
    return rounded(p.select("symbol", "t", *(c.alias(k) for k, c in panels.depth_features(S, 48).items())))


@query("w37_liquidation_proxy", CANDLES + """, m AS (SELECT symbol, t, greatest(-(ln(quote_volume) - lag(ln(quote_volume)) OVER w), 0) AS drop, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM candles WHERE quote_volume > 0 WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, round(drop * greatest(-r, 0), 6) AS long_liquidation, round(drop * greatest(r, 0), 6) AS short_liquidation FROM m WHERE r IS NOT NULL""")
def liquidation_proxy(spark: SparkSession, d: str) -> DataFrame:
    m = tables.candles(spark, d).where("quote_volume > 0")
    m = m.select("symbol", "t", "quote_volume", features.returns(S, lags=(1,))["return_1"].alias("r"))
    return rounded(m.select("symbol", "t", "r", *(c.alias(k) for k, c in panels.liquidation_proxy(S, "quote_volume", "r").items())).where("r is not null").drop("r"))


@query("w39_ratio_lift", CANDLES + """, r AS (SELECT symbol, t, taker_buy / nullif(quote_volume, 0) AS x FROM candles) SELECT symbol, t, round(x - avg(x) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 6) AS lift FROM r""")
def ratio_lift(spark: SparkSession, d: str) -> DataFrame:
    x = scalars.ratio(F.col("taker_buy"), F.col("quote_volume"))
    return rounded(tables.candles(spark, d).select("symbol", "t", panels.ratio_lift(S, x).alias("lift")))


@query("a05_panel_mean", f"""{K}, lv AS (SELECT symbol, t, k % 5 AS band, arg_max(price, us) AS v FROM ticks GROUP BY 1, 2, 3)
SELECT symbol, ((t - 1) // 1800 + 1) * 1800 AS interval_end, """ + ", ".join(f"round(avg(v) FILTER (band = {b}), 6) AS level_{b}" for b in (1, 2, 3)) + " FROM lv WHERE band IN (1, 2, 3) GROUP BY 1, 2")
def panel_mean(spark: SparkSession, d: str) -> DataFrame:
    lv = tables.ticks(spark, d).select("symbol", "t", (F.col("k") % 5).alias("band"), "price", "us")
    return rounded(panels.panel_mean(lv, "symbol", "t", "band", "price", [1, 2, 3], 1800, "us"))


@query("a07_liquidation_rollup", f"""{K} SELECT symbol, t // 14400 * 14400 AS snapshot, count(*) AS events, round(sum(price * qty), 4) AS notional, round(sum(CASE WHEN is_buyer THEN price * qty ELSE 0 END), 4) AS long_notional, round(sum(CASE WHEN is_buyer THEN 0 ELSE price * qty END), 4) AS short_notional,
round(coalesce((sum(CASE WHEN is_buyer THEN price * qty ELSE 0 END) - sum(CASE WHEN is_buyer THEN 0 ELSE price * qty END)) / nullif(sum(price * qty), 0), 0), 6) AS imbalance FROM ticks GROUP BY 1, 2""")
def liquidation_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = tables.ticks(spark, d).select("symbol", F.expr("t div 14400 * 14400").alias("snapshot"), F.when(F.col("is_buyer"), "long").otherwise("short").alias("side"), (F.col("price") * F.col("qty")).alias("notional"))
    x = panels.liquidation_rollup(e, ["symbol", "snapshot"])
    return x.select("symbol", "snapshot", "events", *(F.round(c, 4).alias(c) for c in ("notional", "long_notional", "short_notional")), F.round("imbalance", 6).alias("imbalance"))


@query("j18_zero_filled", f"""{K}, f AS (SELECT symbol, t // 14400 AS snapshot, count(*) AS events FROM ticks WHERE k > 90 GROUP BY 1, 2), s AS (SELECT DISTINCT t // 14400 AS snapshot FROM ticks), y AS (SELECT DISTINCT symbol FROM ticks)
SELECT y.symbol, s.snapshot, coalesce(f.events, 0) AS events FROM y CROSS JOIN s LEFT JOIN f ON f.symbol = y.symbol AND f.snapshot = s.snapshot""")
def zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """A row for each symbol of a snapshot, also without events: symbols are a configured list."""
    t = tables.ticks(spark, d).withColumn("snapshot", F.expr("t div 14400"))
    symbols = F.explode(F.array(*(F.lit(s) for s in ("click", "error", "purchase", "signup", "view"))))
    dimension = t.select("snapshot").distinct().select(symbols.alias("symbol"), "snapshot")
    facts = t.where("k > 90").groupBy("symbol", "snapshot").agg(F.count("*").alias("events"))
    return panels.zero_filled(dimension, facts, ["symbol", "snapshot"], ["events"])


@query("j17_family_merge", f"""{K}, a AS (SELECT symbol, t // 3600 AS h, arg_max(price, us) AS open_interest FROM ticks WHERE k % 3 = 0 GROUP BY 1, 2), b AS (SELECT symbol, t // 3600 AS h, arg_max(qty, us) AS long_short FROM ticks WHERE k % 3 = 1 GROUP BY 1, 2), c AS (SELECT symbol, t // 3600 AS h, arg_max(k, us) AS depth FROM ticks WHERE k % 3 = 2 GROUP BY 1, 2)
SELECT coalesce(a.symbol, b.symbol, c.symbol) AS symbol, coalesce(a.h, b.h, c.h) AS h, open_interest, long_short, depth FROM a FULL JOIN b ON a.symbol = b.symbol AND a.h = b.h FULL JOIN c ON c.symbol = coalesce(a.symbol, b.symbol) AND c.h = coalesce(a.h, b.h)""")
def family_merge(spark: SparkSession, d: str) -> DataFrame:
    t = tables.ticks(spark, d).withColumn("h", F.expr("t div 3600"))
    part = lambda n, c, to: t.where(f"k % 3 = {n}").select("symbol", "h", "us", F.col(c).alias(to))
    return panels.merge_families({"a": part(0, "price", "open_interest"), "b": part(1, "qty", "long_short"), "c": part(2, "k", "depth")}, ["symbol", "h"], "us")


@query("a12_trade_flow", f"""{K}, x AS (SELECT symbol, t // 86400 AS day, price * qty AS n, is_buyer AS b FROM ticks), l AS (SELECT symbol, day, quantile_disc(n, 0.95) AS lim FROM x GROUP BY 1, 2)
SELECT x.symbol, x.day, count(*) AS trades, round(sum(n), 4) AS notional, round(sum(CASE WHEN b THEN n ELSE 0 END), 4) AS bought, round(sum(n) - sum(CASE WHEN b THEN n ELSE 0 END), 4) AS sold, round(sum(CASE WHEN b THEN n ELSE 0 END) / nullif(sum(n), 0), 6) AS buy_ratio,
round((2 * sum(CASE WHEN b THEN n ELSE 0 END) - sum(n)) / nullif(sum(n), 0), 6) AS imbalance, max(lim) AS large_from, count(*) FILTER (n >= lim) AS large_trades, round(sum(CASE WHEN b AND n >= lim THEN n ELSE 0 END) / nullif(sum(n) FILTER (n >= lim), 0), 6) AS large_buy_ratio, max(n) AS largest
FROM x JOIN l USING (symbol, day) GROUP BY 1, 2""")
def trade_flow(spark: SparkSession, d: str) -> DataFrame:
    t = tables.ticks(spark, d).withColumn("day", F.expr("t div 86400"))
    x = panels.trade_flow(t, ["symbol", "day"], F.col("price") * F.col("qty"), F.col("is_buyer"))
    return x.select("symbol", "day", "trades", *(F.round(c, 4).alias(c) for c in ("notional", "bought", "sold")), F.round("buy_ratio", 6).alias("buy_ratio"), F.round("imbalance", 6).alias("imbalance"), "large_from", "large_trades", F.round("large_buy_ratio", 6).alias("large_buy_ratio"), "largest")


# Joins ---------------------------------------------------------------------------------------------------------------


@query("j02_label_semi", CANDLES + """, w AS (SELECT symbol, t, lead(close, 3) OVER (PARTITION BY symbol ORDER BY t) AS later, close FROM candles) SELECT symbol, t, round(later / close - 1, 6) AS forward_return_3 FROM w WHERE t % 14400 = 0""")
def label_semi(spark: SparkSession, d: str) -> DataFrame:
    """Labels of requested keys only; the future window still sees all rows."""
    from tideframe.operators.labels import forward_returns

    c = tables.candles(spark, d)
    keys = c.where("t % 14400 = 0").select("symbol", "t")
    return rounded(forward_returns(c, (3,)).join(keys, ["symbol", "t"], "left_semi").select("symbol", "t", "forward_return_3"))


@query("j03_flagged_left_join", f"{T} SELECT id, decision_t, o_totalprice AS feature, o_orderkey IS NOT NULL AS matched FROM trades LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = id // 10")
def flagged_left_join(spark: SparkSession, d: str) -> DataFrame:
    right = tables.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("feature"))
    x = tables.trades(spark, d).select("id", "decision_t", F.expr("id div 10").alias("k"))
    return aj.flagged_left(x, right, ["k"], "matched").select("id", "decision_t", "feature", "matched")


@query("j04_external_join", f"""{T}, r AS (SELECT o_orderkey AS k, o_totalprice AS feature FROM orders) SELECT id, feature FROM trades LEFT JOIN r ON k = id // 10""")
def external_join(spark: SparkSession, d: str) -> DataFrame:
    """Features of another source: repeated right keys are an error, as are missing ones where they are required."""
    right = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("feature"))
    x = tables.trades(spark, d).select("id", F.expr("id div 10").alias("k"))
    return aj.unique_left(x, right, ["k"]).select("id", "feature")


@query("j13_reference_join", CANDLES + """ SELECT c.symbol, c.t, r.close AS ref_close, round(c.close - r.close, 6) AS difference FROM candles c LEFT JOIN (SELECT t, close FROM candles WHERE symbol = 'view') r ON r.t = c.t""")
def reference_join(spark: SparkSession, d: str) -> DataFrame:
    c = tables.candles(spark, d)
    ref = F.max(F.when(F.col("symbol") == "view", F.col("close"))).over(Window.partitionBy("t"))
    return rounded(c.select("symbol", "t", ref.alias("ref_close"), (F.col("close") - ref).alias("difference")))


@query("j14_return_pairs", CANDLES + """, r AS (SELECT symbol, t, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS own FROM candles) SELECT a.symbol, a.t, round(a.own, 6) AS own, round(b.own, 6) AS ref FROM r a JOIN r b ON a.t = b.t AND b.symbol = 'view' WHERE a.own IS NOT NULL AND b.own IS NOT NULL""")
def return_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = tables.candles(spark, d).select("symbol", "t", features.returns(S, lags=(1,))["return_1"].alias("own"))
    ref = F.max(F.when(F.col("symbol") == "view", F.col("own"))).over(Window.partitionBy("t"))
    return rounded(r.withColumn("ref", ref).where("own is not null and ref is not null"))


@query("j23_previous_snapshot", f"""{K}, s AS (SELECT k, symbol, t // 86400 AS day, sum(price) AS notional FROM ticks GROUP BY 1, 2, 3) SELECT k, symbol, day, round(notional - coalesce(lag(notional) OVER (PARTITION BY k, symbol ORDER BY day), 0), 4) AS delta FROM s""")
def previous_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = tables.ticks(spark, d).groupBy("k", "symbol", F.expr("t div 86400").alias("day")).agg(F.sum("price").alias("notional"))
    return panels.change_since_snapshot(s, ["k", "symbol"], "day", "notional").select("k", "symbol", "day", F.round("delta", 4).alias("delta"))


@query("j24_entry_price", CANDLES + """, e AS (SELECT event_type AS symbol, event_id AS id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) // 3600 * 3600 AS close_t FROM events) SELECT e.symbol, e.id, c.close AS entry_price FROM e LEFT JOIN candles c ON c.symbol = e.symbol AND c.close_t = e.close_t""")
def entry_price(spark: SparkSession, d: str) -> DataFrame:
    e = tables.ticks(spark, d).select("symbol", "id", F.expr("t div 3600 * 3600").alias("close_t"))
    return e.join(tables.candles(spark, d).select("symbol", "close_t", F.col("close").alias("entry_price")), ["symbol", "close_t"], "left").select("symbol", "id", "entry_price")


@query("j25_accepted_back", f"""{T}, a AS (SELECT DISTINCT decision_t, symbol FROM trades WHERE confidence >= 0.6) SELECT id, net_r FROM trades t WHERE EXISTS (SELECT 1 FROM a WHERE a.decision_t = t.decision_t AND a.symbol = t.symbol)""")
def accepted_back(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d)
    accepted = t.where("confidence >= 0.6").select("decision_t", "symbol").distinct()
    return t.join(accepted, ["decision_t", "symbol"], "left_semi").select("id", "net_r")


@query("j27_scenario_cross", f"""{T} SELECT s.scenario, symbol, count(*) AS trades, round(sum(net_r * s.risk), 4) AS total FROM trades CROSS JOIN (VALUES ('low', 0.5), ('mid', 1.0), ('high', 2.0)) s(scenario, risk) WHERE confidence >= s.risk * 0.2 GROUP BY 1, 2""")
def scenario_cross(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of a configuration as conditional sums, one pass and no copies of rows."""
    t = tables.trades(spark, d)
    scenarios = {"low": 0.5, "mid": 1.0, "high": 2.0}
    parts = []
    for k, risk in scenarios.items():
        ok = F.col("confidence") >= risk * 0.2
        parts += [F.count_if(ok).alias(f"n_{k}"), F.sum(F.when(ok, F.col("net_r") * risk)).alias(f"s_{k}")]
    g = t.groupBy("symbol").agg(*parts)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.col(f"n_{k}").alias("trades"), F.round(f"s_{k}", 4).alias("total")) for k in scenarios)))
    return g.select("symbol", rows.alias("s")).select("s.scenario", "symbol", "s.trades", "s.total").where("trades > 0")


@query("u01_union_frames", "SELECT o_orderkey AS id, o_totalprice AS price, NULL AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def union_frames(spark: SparkSession, d: str) -> DataFrame:
    a = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_distinct_keys", f"{T} SELECT DISTINCT symbol, decision_t FROM trades")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.trades(spark, d).select("symbol", "decision_t").distinct()


@query("u04_key_intersection", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    x = tables.read(spark, d, "lineitem")
    k = F.col("l_partkey").alias("k")
    return x.where("l_returnflag = 'R'").select(k).intersect(x.where("l_returnflag = 'A'").select(k))


# Sources -------------------------------------------------------------------------------------------------------------


@query("s12_daily_closes", f"WITH {DAILY_SQL} SELECT * FROM daily")
def daily_closes(spark: SparkSession, d: str) -> DataFrame:
    return tables.daily_closes(spark, d)


@query("s13_funding_rows", f"{K}, {FUNDING_SQL} SELECT * FROM funding")
def funding_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.funding(spark, d)


@query("s26_trade_ticks", f"{K} SELECT symbol, id, us, price, qty, NOT is_buyer AS aggressive_buy FROM ticks")
def trade_ticks(spark: SparkSession, d: str) -> DataFrame:
    return tables.ticks(spark, d).select("symbol", "id", "us", "price", "qty", (~F.col("is_buyer")).alias("aggressive_buy"))


@query("s14_funding_rules", f"""{K}, {FUNDING_SQL}, g AS (SELECT *, funding_t - lag(funding_t) OVER (PARTITION BY symbol ORDER BY funding_t) AS gap FROM funding)
SELECT symbol, funding_t, concat_ws(',', CASE WHEN abs(rate) > 0.45 THEN 'rate_limit' END, CASE WHEN available_t < funding_t THEN 'available_early' END) AS broken, coalesce(gap > 29100, false) AS gap_before FROM g""")
def funding_rules(spark: SparkSession, d: str) -> DataFrame:
    f = tables.funding(spark, d)
    gap = F.col("funding_t") - F.lag("funding_t").over(Window.partitionBy("symbol").orderBy("funding_t"))
    x = quality.violations(f, {"rate_limit": F.abs("rate") <= 0.45, "available_early": F.col("available_t") >= F.col("funding_t")})
    return x.select("symbol", "funding_t", F.array_join("violations", ",").alias("broken"), F.coalesce(gap > 29100, F.lit(False)).alias("gap_before"))


@query("s16_metrics_rules", CANDLES + """ SELECT symbol, t, concat_ws(',', CASE WHEN NOT quote_volume >= 0 THEN 'negative' END, CASE WHEN volume < 2 THEN 'thin' END) AS broken, coalesce(t - lag(t) OVER (PARTITION BY symbol ORDER BY t) > 7200, false) AS gap_before FROM candles""")
def metrics_rules(spark: SparkSession, d: str) -> DataFrame:
    c = tables.candles(spark, d)
    gap = F.col("t") - F.lag("t").over(S.w)
    x = quality.violations(c, {"negative": F.col("quote_volume") >= 0, "thin": F.col("volume") >= 2})
    return x.select("symbol", "t", F.array_join("violations", ",").alias("broken"), F.coalesce(gap > 7200, F.lit(False)).alias("gap_before"))


@query("s18_depth_rows", f"{K}, x AS (SELECT symbol, id, k % 11 - 5 AS pct, price FROM ticks) SELECT symbol, id, CASE WHEN pct < 0 THEN 'bid' ELSE 'ask' END AS side, CAST(abs(pct) AS INT) AS distance, price AS notional FROM x WHERE pct <> 0")
def depth_rows(spark: SparkSession, d: str) -> DataFrame:
    x = tables.ticks(spark, d).select("symbol", "id", (F.col("k") % 11 - 5).alias("pct"), F.col("price").alias("notional"))
    return bars.depth_rows(x, "pct").select("symbol", "id", "side", "distance", "notional")


@query("s19_depth_rules", _DEPTHS + """, n AS (SELECT symbol, t, count(*) AS rows, count(DISTINCT pct) AS bands, list_sort(list(DISTINCT pct)) = [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5] AS whole FROM lv GROUP BY 1, 2) SELECT symbol, t, rows, bands, whole, rows > bands AS repeated FROM n""")
def depth_rules(spark: SparkSession, d: str) -> DataFrame:
    lv = tables.ticks(spark, d).select("symbol", F.expr("t div 3600 * 3600").alias("t"), (F.col("k") % 11 - 5).alias("pct"))
    return bars.band_check(lv, ["symbol", "t"], "pct", [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5])


@query("s22_order_book_levels", f"""{K}, m AS (SELECT symbol, t // 3600 * 3600 AS t, list(price ORDER BY us, id) FILTER (is_buyer) AS b, list(price ORDER BY us, id) FILTER (NOT is_buyer) AS a FROM ticks GROUP BY 1, 2),
l AS (SELECT symbol, t, 'bid' AS side, unnest(b) AS price, generate_subscripts(b, 1) - 1 AS ordinal FROM m UNION ALL SELECT symbol, t, 'ask', unnest(a), generate_subscripts(a, 1) - 1 FROM m) SELECT symbol, t, side, CAST(ordinal AS INT) AS ordinal, price, round(price * 2, 6) AS notional FROM l""")
def order_book_levels(spark: SparkSession, d: str) -> DataFrame:
    t = tables.ticks(spark, d)
    side = lambda buy: F.transform(F.sort_array(F.collect_list(F.when(F.col("is_buyer") == buy, F.struct("us", "id", "price")))), lambda x: F.array(x["price"].cast("string"), F.lit("2")))
    books = t.groupBy("symbol", F.expr("t div 3600 * 3600").alias("t")).agg(F.to_json(F.struct(side(True).alias("bids"), side(False).alias("asks"))).alias("payload"))
    return bars.book_levels(books, "payload", ["symbol", "t"]).select("symbol", "t", "side", F.col("ordinal").cast("int").alias("ordinal"), "price", F.round("notional", 6).alias("notional"))


@query("s23_liquidation_events", """SELECT event_id AS id, CASE WHEN k IS NULL THEN 'malformed' WHEN k % 2 = 0 THEN 'long_liquidation' ELSE 'short_liquidation' END AS direction, round(value * k, 4) AS notional FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def liquidation_events(spark: SparkSession, d: str) -> DataFrame:
    """JSON messages, in an envelope or not, as force-order rows; those that can't be read are kept as malformed."""
    e = tables.read(spark, d, "events")
    order = F.struct(F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "SELL").otherwise("BUY").alias("S"), F.col("value").alias("ap"), F.get_json_object("props", "$.k").cast("int").alias("z"))
    body = F.to_json(F.struct(order.alias("o")))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"data":'), body, F.lit("}"))).otherwise(body)
    return bars.liquidation_events(e.select(F.col("event_id").alias("id"), text.alias("message")), "message").select("id", "direction", F.round("notional", 4).alias("notional"))


@query("s24_wallet_positions", """SELECT c_custkey AS wallet, n AS position, CASE WHEN s >= 0 THEN 'long' ELSE 'short' END AS side, round(abs(s), 2) AS notional FROM (SELECT c_custkey, 0 AS n, c_acctbal AS s FROM customer UNION ALL SELECT c_custkey, 1, 1000 - c_acctbal FROM customer)""")
def wallet_positions(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "customer")
    position = lambda s: F.struct(F.struct(s.alias("szi")).alias("position"))
    state = F.to_json(F.struct(F.array(position(F.col("c_acctbal")), position(1000 - F.col("c_acctbal"))).alias("assetPositions")))
    return bars.wallet_positions(c.select(F.col("c_custkey").alias("wallet"), state.alias("state")), "state").select("wallet", F.col("position").cast("int").alias("position"), "side", F.round("notional", 2).alias("notional"))


@query("s25_wallet_fills", """SELECT l_orderkey AS wallet, l_linenumber AS trade, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, round(abs(l_extendedprice * l_quantity), 2) AS notional, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS repeated FROM lineitem""")
def wallet_fills(spark: SparkSession, d: str) -> DataFrame:
    x = tables.read(spark, d, "lineitem")
    fill = F.to_json(F.struct(F.col("l_extendedprice").alias("px"), F.col("l_quantity").alias("sz"), F.when(F.col("l_linestatus") == "O", "B").otherwise("A").alias("side"), F.col("l_linenumber").alias("tid")))
    out = bars.wallet_fills(x.select(F.col("l_orderkey").alias("wallet"), fill.alias("fill")), "fill")
    return out.select("wallet", "trade", "side", F.round("notional", 2).alias("notional"), "repeated")


@query("s28_pruned_scan", "SELECT event_id, value FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """Columns and filters reach the Parquet scan."""
    e = tables.read(spark, d, "events")
    return e.where(F.col("event_type").isin("click", "view") & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))).select("event_id", "value")


@query("s29_panel_known_at", f"{K}, {FUNDING_SQL} SELECT symbol, funding_t, rate, funding_t + 60 AS known_at FROM funding")
def panel_known_at(spark: SparkSession, d: str) -> DataFrame:
    f = tables.funding(spark, d).select("symbol", "funding_t", "rate")
    return panels.known_at(f.unionByName(f), "funding_t", 60, ["symbol"])

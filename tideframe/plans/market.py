"""Queries of bars, features, labels and joins over the given tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions import scalars
from tideframe.operators import asof as aj
from tideframe.operators import bars, features, labels, predicates, quality, ranking, scenarios
from tideframe.plans.registry import ORACLE_SQL, QUERIES
from tideframe.sources import tables
from tideframe.sources.tables import DAILY_SQL, FUNDING_SQL, TICKS_SQL, TRADES_SQL, candles_sql
from tideframe.streaming import streams

S = features.Series()
H4 = 4 * 3600


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


CANDLES = "WITH " + candles_sql()


# Sources and quality -------------------------------------------------------------------------------------------------


@query("a01_hour_bars", CANDLES + " SELECT * FROM candles")
def hour_bars(spark: SparkSession, d: str) -> DataFrame:
    return tables.candles(spark, d)


@query("s04_candle_rules", CANDLES + """
SELECT symbol, t, CASE WHEN (high - low) / greatest(open, 1.0) <= 1.0 THEN '' ELSE 'range_within_limit' END AS broken FROM candles""")
def candle_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(tables.candles(spark, d), quality.candle_rules()).select("symbol", "t", F.array_join("violations", ",").alias("broken"))


@query("s05_duplicate_keys", f"WITH {TRADES_SQL} SELECT symbol, decision_t, side, count(*) AS copies FROM trades GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(tables.trades(spark, d), ["symbol", "decision_t", "side"])


@query("s06_out_of_order", f"""WITH {TRADES_SQL}, u AS (SELECT id, symbol, min(exit_t) AS exit_t FROM trades GROUP BY 1, 2),
x AS (SELECT id, symbol, exit_t, max(exit_t) OVER (PARTITION BY symbol, exit_t // 2592000 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before FROM u)
SELECT id, symbol, latest_before FROM x WHERE exit_t < latest_before""")
def out_of_order(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).groupBy("id", "symbol").agg(F.min("exit_t").alias("exit_t")).withColumn("month", F.expr("exit_t div 2592000"))
    return quality.out_of_order(t, ["symbol", "month"], "id", "exit_t").select("id", "symbol", "latest_before")


@query("s07_gap_check", CANDLES + """, x AS (SELECT symbol, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS previous, t AS next FROM candles)
SELECT symbol, previous, next, next - previous AS distance FROM x WHERE next - previous > 3600""")
def gap_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.gaps(tables.candles(spark, d), ["symbol"], "t", tables.HOUR)


@query("s09_manifest", f"WITH {TICKS_SQL} SELECT count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM ticks")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return quality.manifest(tables.ticks(spark, d), "t").drop("digest")


@query("s17_null_report", """SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS nulls, count(*) AS rows, CAST(count(*) FILTER (text IS NULL) AS DOUBLE) / count(*) AS share FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), count(*), CAST(count(*) FILTER (lang IS NULL) AS DOUBLE) / count(*) FROM documents""")
def null_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_report(tables.read(spark, d, "documents"), ["text", "lang"])


@query("s20_coverage", f"""WITH {DAILY_SQL}, span AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS day), k AS (SELECT DISTINCT symbol FROM daily UNION ALL SELECT '0-NONE'),
x AS (SELECT s.symbol, span.day, d.day IS NOT NULL AS there FROM k s CROSS JOIN span LEFT JOIN daily d ON d.symbol = s.symbol AND d.day = span.day)
SELECT symbol, count(*) AS expected, count(*) FILTER (there) AS present, count(*) FILTER (NOT there) AS missing, round(CAST(count(*) FILTER (there) AS DOUBLE) / count(*), 8) AS share FROM x GROUP BY 1""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A configured list of keys, one of which has no row at all."""
    x = tables.daily_closes(spark, d).withColumn("n", F.unix_date("day"))
    return quality.coverage(x, "symbol", "n", 9131, 11687, ["0-NONE", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("u03_keep_last", f"WITH {TICKS_SQL} SELECT symbol, t // 60 AS minute, arg_max(price, us) AS price FROM ticks GROUP BY 1, 2")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    x = tables.ticks(spark, d).select("symbol", F.expr("t div 60").alias("minute"), "us", "price")
    return quality.keep_last(x, ["symbol", "minute"], ["us"]).drop("us")


@query("u05_missing_set", """WITH x AS (SELECT DISTINCT l_partkey AS p FROM lineitem) SELECT p_partkey FROM part LEFT JOIN x ON p = p_partkey WHERE p IS NULL""")
def missing_set(spark: SparkSession, d: str) -> DataFrame:
    used = tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return tables.read(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("f03_timeframes", """SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 900 WHEN 'click' THEN 14400 WHEN 'error' THEN 86400 END AS BIGINT) AS seconds FROM events""")
def timeframes(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    text = F.when(F.col("event_type") == "view", "15m").when(F.col("event_type") == "click", "4h").when(F.col("event_type") == "error", "1d").otherwise("x")
    return e.select("event_id", scalars.timeframe_seconds(text).alias("seconds"))


@query("f16_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Bars ----------------------------------------------------------------------------------------------------------------


@query("a02_closed_bars", CANDLES + """, g AS (SELECT symbol, ((close_t - 1) // 14400 + 1) * 14400 AS e, * EXCLUDE (symbol) FROM candles)
SELECT symbol, e - 14400 AS t, e AS close_t, arg_min(open, g.close_t) AS open, max(high) AS high, min(low) AS low, arg_max(close, g.close_t) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars
FROM g GROUP BY symbol, e HAVING max(g.close_t) = e""")
def closed_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.regroup(tables.candles(spark, d), H4)


@query("a03_epoch_bars", CANDLES + """, g AS (SELECT symbol, ((close_t - 1) // 14400 + 1) * 14400 AS e, * EXCLUDE (symbol) FROM candles)
SELECT symbol, e - 14400 AS t, e AS close_t, arg_min(open, g.close_t) AS open, max(high) AS high, min(low) AS low, arg_max(close, g.close_t) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars
FROM g GROUP BY symbol, e""")
def epoch_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.regroup(tables.candles(spark, d), H4, closed_only=False)


_DEPTH = f"WITH {TICKS_SQL}, lv AS (SELECT symbol, t // 3600 * 3600 AS t, k % 11 - 5 AS pct, price AS notional FROM ticks)"


@query("a04_depth_pivot", _DEPTH + """, s AS (SELECT symbol, t, """ + ", ".join(f"round(sum(CASE WHEN pct {op} 0 AND abs(pct) <= {b} THEN notional ELSE 0 END), 6) AS {side}_notional_{b}pct" for b in (1, 2, 5) for side, op in (("bid", "<"), ("ask", ">"))) + """, count(*) AS bands FROM lv GROUP BY 1, 2)
SELECT *, """ + ", ".join(f"round((bid_notional_{b}pct - ask_notional_{b}pct) / nullif(bid_notional_{b}pct + ask_notional_{b}pct, 0), 8) AS imbalance_{b}pct" for b in (1, 2, 5)) + " FROM s")
def depth_pivot(spark: SparkSession, d: str) -> DataFrame:
    lv = tables.ticks(spark, d).select("symbol", F.expr("t div 3600 * 3600").alias("t"), (F.col("k") % 11 - 5).alias("pct"), F.col("price").alias("notional"))
    return bars.depth_pivot(lv, ["symbol", "t"])


@query("a06_book_summary", f"""WITH {TICKS_SQL}, lv AS (SELECT symbol, t // 3600 * 3600 AS t, CASE WHEN is_buyer THEN 'bid' ELSE 'ask' END AS side, round(CASE WHEN is_buyer THEN 1000 - price ELSE 1000 + price END, 2) AS price, qty, us FROM ticks),
m AS (SELECT symbol, t, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM lv GROUP BY 1, 2),
x AS (SELECT lv.*, price * qty AS notional, abs(price - mid) / mid * 10000 AS bps, mid FROM lv JOIN m USING (symbol, t)),
g AS (SELECT symbol, t, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, sum(notional) FILTER (side = 'bid') AS bn, sum(notional) FILTER (side = 'ask') AS an, max(notional) FILTER (side = 'bid') AS lb, max(notional) FILTER (side = 'ask') AS la FROM x GROUP BY 1, 2)
SELECT symbol, t, best_bid, best_ask, round(bn, 6) AS bid_notional, round(an, 6) AS ask_notional, round(lb, 6) AS largest_bid, round(la, 6) AS largest_ask, round((best_bid + best_ask) / 2, 6) AS mid, round((best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000, 6) AS spread_bps, round((bn - an) / (bn + an), 6) AS notional_imbalance
FROM g WHERE best_bid < best_ask""")
def book_summary(spark: SparkSession, d: str) -> DataFrame:
    t = tables.ticks(spark, d)
    price = F.round(F.when(F.col("is_buyer"), 1000 - F.col("price")).otherwise(1000 + F.col("price")), 2).cast("string")
    level = F.array(price, F.col("qty").cast("string"))
    books = t.groupBy("symbol", F.expr("t div 3600 * 3600").alias("t")).agg(F.to_json(F.struct(F.collect_list(F.when(F.col("is_buyer"), level)).alias("bids"), F.collect_list(F.when(~F.col("is_buyer"), level)).alias("asks"))).alias("payload"))
    lv = bars.book_levels(books, "payload", ["symbol", "t"])
    return rounded(bars.book_summary(lv, ["symbol", "t"]).drop("largest_bid_bps", "largest_ask_bps"))


# Features ------------------------------------------------------------------------------------------------------------

N = 20


def _full(expr: str, arg: str, n: int = N, skip: int = 0) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1 + skip} PRECEDING AND {'CURRENT ROW' if not skip else f'{skip} PRECEDING'})"
    return f"CASE WHEN count({arg}) {over} = {n} THEN {expr.format(over=over)} END"


def _lags(x: str, weights: list[float]) -> str:
    return " + ".join(f"lag({x}, {i}) OVER w * {k!r}" for i, k in enumerate(weights))


_CORE = CANDLES + f""", a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS return_1, close / nullif(lag(close, 2) OVER w, 0) - 1 AS return_2,
  {_full('avg(close) {over}', 'close')} AS ma, {_full('avg(close) {over}', 'close', N, 1)} AS ma0, {_full('min(low) {over}', 'low')} AS lo, {_full('max(high) {over}', 'high')} AS hi,
  max(high) OVER (w ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW) AS ph, min(low) OVER (w ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW) AS pl,
  {_full('avg(volume) {over}', 'volume')} AS mv, {_full('stddev_pop(volume) {over}', 'volume')} AS sv, {_full('avg(high - low) {over}', 'high')} AS mr, {_full('stddev_pop(high - low) {over}', 'high')} AS sr, {_full('stddev_pop(close) {over}', 'close')} AS sc,
  taker_buy / nullif(quote_volume, 0) AS taker_ratio, close - lag(close) OVER w AS ch, row_number() OVER w AS n,
  coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr0,
  {_lags('close', features.ema_weights(N))} AS ema, ({_lags('close', features.ema_weights(10))}) - ({_lags('close', features.ema_weights(N))}) AS macd
  FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE tr0 END AS tr, {_full('stddev_pop(return_1) {over}', 'return_1', N - 1)} AS rv,
  CASE WHEN count(ch) OVER f = {N - 1} THEN sum(greatest(ch, 0)) OVER f END AS gain, CASE WHEN count(ch) OVER f = {N - 1} THEN sum(greatest(-ch, 0)) OVER f END AS loss,
  ({_lags('macd', features.ema_weights(6))}) AS macd_signal, {_full('avg(taker_ratio) {over}', 'taker_ratio')} AS tm, {_full('stddev_pop(taker_ratio) {over}', 'taker_ratio')} AS ts,
  n - coalesce(max(CASE WHEN NOT close >= open THEN n END) OVER u, 0) AS bull_run, n - coalesce(max(CASE WHEN NOT close < open THEN n END) OVER u, 0) AS bear_run
  FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 2} PRECEDING AND CURRENT ROW), u AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, {_full('avg(tr) {over}', 'tr')} AS atr FROM b),
core AS (SELECT symbol, t, close, return_1, return_2, ma, ma / nullif(ma0, 0) - 1 AS ma_slope, CASE WHEN close >= ma THEN 1 WHEN close < ma THEN 0 END AS above_ma, close / nullif(ph, 0) - 1 AS from_high, close / nullif(pl, 0) - 1 AS from_low,
  (close - lo) / nullif(hi - lo, 0) AS range_position, volume / nullif(mv, 0) AS relative_volume, (volume - mv) / nullif(sv, 0) AS volume_z, (high - low) / nullif(mr, 0) AS volatility_expansion,
  rv AS realized_volatility, ema, macd, macd_signal, macd - macd_signal AS macd_histogram, CASE WHEN gain IS NULL THEN NULL WHEN gain = 0 AND loss = 0 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi,
  tr AS true_range, atr, atr / nullif(close, 0) AS atr_share, (close - (ma - 2 * sc)) / nullif(4 * sc, 0) AS bollinger_position, 4 * sc / nullif(ma, 0) AS bollinger_width,
  (close - low) / nullif(high - low, 0) AS close_location, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick, 2 * taker_ratio - 1 AS taker_imbalance, tm AS taker_mean, (taker_ratio - tm) / nullif(ts, 0) AS taker_z, taker_ratio,
  bull_run, bear_run, (high - low - mr) / nullif(sr, 0) AS range_z FROM c)"""

_DOUBLES = "return_1 return_2 ma ma_slope from_high from_low range_position relative_volume volume_z volatility_expansion realized_volatility ema macd macd_signal macd_histogram rsi true_range atr atr_share bollinger_position bollinger_width close_location upper_wick taker_imbalance taker_mean taker_z range_z".split()


@query("w01_core_features", _CORE + " SELECT symbol, t, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in _DOUBLES) + ", above_ma, CAST(bull_run AS INT) AS bull_run, CAST(bear_run AS INT) AS bear_run FROM core")
def core_features(spark: SparkSession, d: str) -> DataFrame:
    x = features.chunked_core_features(tables.candles(spark, d), N)
    # The shift keeps means of prices with two decimals off rounding ties.
    return x.select("symbol", "t", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in _DOUBLES), "above_ma", F.col("bull_run").cast("int").alias("bull_run"), F.col("bear_run").cast("int").alias("bear_run"))


@query("w20_correlation_beta", _CORE + f""", r AS (SELECT symbol, t, return_1, max(CASE WHEN symbol = 'view' THEN return_1 END) OVER (PARTITION BY t) AS ref FROM core),
p AS (SELECT *, CASE WHEN return_1 IS NOT NULL AND ref IS NOT NULL THEN return_1 END AS x, CASE WHEN return_1 IS NOT NULL AND ref IS NOT NULL THEN ref END AS y FROM r),
q AS (SELECT *, count(x) OVER f AS n, covar_pop(x, y) OVER f AS cov, var_pop(x) OVER f AS vx, var_pop(y) OVER f AS vy FROM p WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))
SELECT symbol, t, round(ref, 6) AS ref_return, round(return_1 - ref, 6) AS relative_return, CASE WHEN n >= 2 AND vx > 0 AND vy > 0 THEN round(cov / sqrt(vx * vy), 5) END AS correlation, CASE WHEN n >= 2 AND vy > 0 THEN round(cov / vy, 5) END AS beta FROM q""")
def correlation_beta(spark: SparkSession, d: str) -> DataFrame:
    x = tables.candles(spark, d).select("*", *(c.alias(k) for k, c in features.returns(S, lags=(1,)).items()))
    x = features.reference_features(x, "view", N)
    return x.select("symbol", "t", F.round("ref_return", 6).alias("ref_return"), F.round("relative_return", 6).alias("relative_return"), F.round("correlation", 5).alias("correlation"), F.round("beta", 5).alias("beta"))


@query("a08_market_breadth", _CORE + """, g AS (SELECT t, avg(CAST(return_1 > 0 AS DOUBLE)) AS p, avg(return_1) AS m, avg(CAST(above_ma = 1 AS DOUBLE)) AS a, avg(taker_ratio) AS k, count(*) AS symbols FROM core GROUP BY t)
SELECT t, round(p, 6) AS positive_share, round(m, 6) AS mean_return, round(a, 6) AS above_ma_share, round(k, 6) AS mean_taker, symbols, round((coalesce(p, 0) + coalesce(a, 0)) / nullif(CAST(p IS NOT NULL AS INT) + CAST(a IS NOT NULL AS INT), 0), 6) AS risk_on FROM g""")
def market_breadth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.breadth(features.chunked_core_features(tables.candles(spark, d), N)))


@query("a11_market_median", CANDLES + " SELECT t, round(median(close), 6) AS close, round(median(quote_volume), 6) AS quote_volume FROM candles GROUP BY t")
def market_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tables.candles(spark, d).groupBy("t").agg(F.median("close").alias("close"), F.median("quote_volume").alias("quote_volume")))


def _recursive(alpha: float, x: str, src: str, name: str) -> str:
    return f"""{name} AS (SELECT symbol, n, {x} AS y FROM {src} WHERE n = 1 UNION ALL SELECT r.symbol, s.n, {1 - alpha!r} * r.y + {alpha!r} * s.{x} FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.n = r.n + 1)"""


@query("w23_recursive_ema", "WITH RECURSIVE " + candles_sql() + ", s AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM candles), " + _recursive(2 / 13, "close", "s", "e") + " SELECT e.symbol, s.t, CASE WHEN e.n >= 12 THEN round(y, 6) END AS ema FROM e JOIN s USING (symbol, n)")
def recursive_ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.ema(tables.candles(spark, d), "close", 12, "ema").select("symbol", "t", "ema"))


@query("w24_wilder_smoothing", "WITH RECURSIVE " + candles_sql() + ", s AS (SELECT symbol, t, high - low AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM candles), " + _recursive(1 / 14, "x", "s", "e") + " SELECT e.symbol, s.t, CASE WHEN e.n >= 14 THEN round(y, 6) END AS smooth FROM e JOIN s USING (symbol, n)")
def wilder_smoothing(spark: SparkSession, d: str) -> DataFrame:
    x = tables.candles(spark, d).withColumn("x", F.col("high") - F.col("low"))
    return rounded(features.wilder(x, "x", 14, "smooth").select("symbol", "t", "smooth"))


@query("w31_donchian", CANDLES + f", x AS (SELECT symbol, t, close, {_full('max(high) {over}', 'high', N, 1)} AS h, {_full('min(low) {over}', 'low', N, 1)} AS l FROM candles) SELECT symbol, t, h AS donchian_high, l AS donchian_low, round((close - l) / nullif(h - l, 0), 6) AS donchian_position FROM x")
def donchian(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tables.candles(spark, d).select("symbol", "t", *(c.alias(k) for k, c in features.donchian(S, N).items())))


@query("w38_lagged_zscore", CANDLES + """, x AS (SELECT symbol, t, volume, count(volume) OVER f AS n, avg(volume) OVER f AS m, stddev_pop(volume) OVER f AS s FROM candles WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT symbol, t, CASE WHEN n = 24 THEN round((volume - m) / nullif(s, 0), 6) END AS z FROM x""")
def lagged_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tables.candles(spark, d).select("symbol", "t", features.zscore(S, F.col("volume").cast("double"), 24, skip=1).alias("z")))


# Joins ---------------------------------------------------------------------------------------------------------------


@query("j05_asof_funding", CANDLES + ", " + FUNDING_SQL + """
SELECT c.symbol, c.t, c.close, f.rate, f.available_t FROM candles c ASOF LEFT JOIN funding f ON c.symbol = f.symbol AND c.t >= f.available_t""")
def asof_funding(spark: SparkSession, d: str) -> DataFrame:
    c = tables.candles(spark, d).select("symbol", "t", "close")
    return aj.asof(c, tables.funding(spark, d), "t", "available_t", ["symbol"], ["rate"])


@query("j07_asof_max_age", CANDLES + ", " + FUNDING_SQL + """
SELECT c.symbol, c.t, CASE WHEN c.t - f.available_t <= 7200 THEN f.rate END AS rate, CASE WHEN c.t - f.available_t <= 7200 THEN f.available_t END AS available_t FROM candles c ASOF LEFT JOIN funding f ON c.symbol = f.symbol AND c.t >= f.available_t""")
def asof_max_age(spark: SparkSession, d: str) -> DataFrame:
    return aj.asof(tables.candles(spark, d).select("symbol", "t"), tables.funding(spark, d), "t", "available_t", ["symbol"], ["rate"], max_age=7200)


@query("j12_asof_derived_timeframe", CANDLES + """, g AS (SELECT symbol, ((close_t - 1) // 14400 + 1) * 14400 AS e, * EXCLUDE (symbol) FROM candles),
b AS (SELECT symbol, e AS close_t, arg_max(close, g.close_t) AS close FROM g GROUP BY symbol, e HAVING max(g.close_t) = e),
r AS (SELECT *, round(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY close_t), 0) - 1, 6) AS ret FROM b)
SELECT c.symbol, c.close_t AS at_t, r.ret AS h4_ret, r.close_t AS h4_close_t FROM candles c ASOF LEFT JOIN r ON c.symbol = r.symbol AND c.close_t >= r.close_t""")
def asof_derived(spark: SparkSession, d: str) -> DataFrame:
    c = tables.candles(spark, d)
    b = bars.regroup(c, H4)
    r = b.select("symbol", "close_t", F.round(features.returns(features.Series(order="close_t"), lags=(1,))["return_1"], 6).alias("ret"))
    return aj.asof(c.select("symbol", F.col("close_t").alias("at_t")), r, "at_t", "close_t", ["symbol"], ["ret"], prefix="h4_")


@query("j15_range_join_lookback", f"""WITH {TICKS_SQL}, c AS (SELECT id, symbol, t FROM ticks WHERE true)
SELECT c.id, count(*) AS trades, round(sum(x.price), 6) AS notional, round(coalesce(sum(x.price) FILTER (x.is_buyer), 0) / sum(x.price), 6) AS buy_ratio FROM c JOIN ticks x ON x.symbol = c.symbol AND x.t BETWEEN c.t - 21600 AND c.t GROUP BY c.id""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    t = tables.ticks(spark, d)
    c = t.select("symbol", "id", (F.col("t") - 21600).alias("from_t"), F.col("t").alias("to_t"))
    sums = {"trades": F.lit(1), "notional": F.col("price"), "bought": F.when(F.col("is_buyer"), F.col("price"))}
    x = aj.interval_sums(c, t, "from_t", "to_t", "t", ["symbol"], "id", sums, 21600)
    return x.select("id", F.round("trades").cast("bigint").alias("trades"), F.round("notional", 6).alias("notional"), F.round(F.col("bought") / F.col("notional"), 6).alias("buy_ratio"))


_LABELS = CANDLES + """, f AS (SELECT *, list(high) OVER w AS hs, list(low) OVER w AS ls, list(close) OVER w AS cs FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
g AS (SELECT symbol, t, close, coalesce(len(hs), 0) = 6 AS whole, list_max(hs) AS mh, list_min(ls) AS ml, nullif(list_position([x >= close * 1.4 FOR x IN hs], true), 0) AS bt, nullif(list_position([x <= close * 0.8 FOR x IN ls], true), 0) AS bs, cs[-1] AS last FROM f),
h AS (SELECT *, CASE WHEN bt IS NULL AND bs IS NULL THEN NULL WHEN bs IS NULL THEN true WHEN bt IS NULL THEN false ELSE bt < bs END AS hit FROM g),
labels AS (SELECT symbol, t, CASE WHEN whole THEN round((mh - close) / (close * 0.2), 8) END AS mfe_r, CASE WHEN whole THEN round((ml - close) / (close * 0.2), 8) END AS mae_r, CASE WHEN whole THEN CAST(bt AS INT) END AS bars_to_target, CASE WHEN whole THEN CAST(bs AS INT) END AS bars_to_stop,
  CASE WHEN whole THEN hit END AS target_before_stop, CASE WHEN whole THEN round(last / close - 1, 8) END AS forward_return, CASE WHEN whole THEN round(CASE WHEN hit THEN 2.0 WHEN NOT hit THEN -1.0 ELSE (last / close - 1) / 0.2 END - 0.05, 8) END AS realized_r, CASE WHEN NOT whole THEN 'insufficient_window' END AS reason FROM h)"""


def _barriers(spark: SparkSession, d: str) -> DataFrame:
    return labels.barrier_labels(tables.candles(spark, d), 6, 0.2, 0.4, 0.01)


@query("w49_barrier_labels", _LABELS + " SELECT * FROM labels")
def barrier_labels(spark: SparkSession, d: str) -> DataFrame:
    x = _barriers(spark, d).select("symbol", "t", "mfe_r", "mae_r", "bars_to_target", "bars_to_stop", "target_before_stop", "forward_return", "realized_r", "reason")
    return rounded(x, 8)


@query("w52_trailing_exit", CANDLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n, count(*) OVER (PARTITION BY symbol) AS total, CASE WHEN t // 3600 % 2 = 0 THEN 1 ELSE -1 END AS sg FROM candles),
f AS (SELECT symbol, t, n, close, sg, 0 AS k, CAST(-1 AS DOUBLE) AS stop, CAST(NULL AS INT) AS even, CAST(NULL AS INT) AS ended FROM b WHERE n + 12 <= total
UNION ALL SELECT symbol, t, n, close, sg, k + 1, CASE WHEN worst <= stop THEN stop ELSE raised END, CASE WHEN worst > stop AND even IS NULL AND best >= 1 THEN k + 1 ELSE even END, CASE WHEN worst <= stop OR raised <> stop AND worst <= raised THEN k + 1 END
FROM (SELECT *, greatest(stop, CASE WHEN best >= 1 THEN 0.1 ELSE stop END, CASE WHEN best >= 0.8 THEN best - 0.8 ELSE stop END) AS raised FROM (SELECT f.*, CASE WHEN f.sg = 1 THEN (b.high - f.close) / (f.close * 0.2) ELSE (f.close - b.low) / (f.close * 0.2) END AS best, CASE WHEN f.sg = 1 THEN (b.low - f.close) / (f.close * 0.2) ELSE (f.close - b.high) / (f.close * 0.2) END AS worst
FROM f JOIN b ON b.symbol = f.symbol AND b.n = f.n + f.k + 1 WHERE f.ended IS NULL AND f.k < 12))),
g AS (SELECT symbol, n, arg_max(stop, k) AS stop, arg_max(even, k) FILTER (even IS NOT NULL) AS even, max(ended) AS ended FROM f GROUP BY 1, 2)
SELECT b.symbol, b.t, round(CASE WHEN g.n IS NOT NULL THEN CASE WHEN ended IS NOT NULL THEN stop ELSE b.sg * (l.close - b.close) / (b.close * 0.2) END - 0.01 END, 6) AS exit_r, ended AS exit_bars, even AS breakeven_bars, CASE WHEN g.n IS NULL THEN NULL WHEN ended IS NOT NULL THEN 'dynamic_stop' ELSE 'horizon_exit' END AS exit_reason
FROM b LEFT JOIN g ON g.symbol = b.symbol AND g.n = b.n LEFT JOIN b l ON l.symbol = b.symbol AND l.n = b.n + 12""")
def trailing_exit(spark: SparkSession, d: str) -> DataFrame:
    """Longs and shorts by turns, resolved on the bars' own highs and lows."""
    side = F.when(F.expr("t div 3600") % 2 == 0, "long").otherwise("short")
    x = labels.trailing_exit(tables.candles(spark, d), 12, 0.2, 1.0, 0.1, 0.8, cost=0.002, side=side)
    return rounded(x.select("symbol", "t", "exit_r", "exit_bars", "breakeven_bars", "exit_reason"))


@query("w53_triple_barrier_path", f"""WITH {candles_sql(600, 'bars')}, e AS (SELECT symbol, id, t, CASE WHEN is_buyer THEN 'long' ELSE 'short' END AS side, price AS entry, CASE WHEN is_buyer THEN round(price * 0.5, 4) ELSE round(price * 1.5, 4) END AS stop, CASE WHEN is_buyer THEN round(price * 2, 4) ELSE round(price * 0.3, 4) END AS target FROM ticks),
x AS (SELECT e.*, b.t AS pt, b.high, b.low, b.close, CASE WHEN side = 'long' THEN b.low <= stop ELSE b.high >= stop END AS s, CASE WHEN side = 'long' THEN b.high >= target ELSE b.low <= target END AS g FROM e JOIN bars b ON b.symbol = e.symbol AND b.t BETWEEN e.t AND e.t + 43200),
h AS (SELECT *, min(CASE WHEN s THEN pt END) OVER w AS st, min(CASE WHEN g THEN pt END) OVER w AS gt, max(pt) OVER w AS lt, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY symbol, id, t, side, entry)),
k AS (SELECT *, CASE WHEN st IS NULL AND gt IS NULL THEN 'timeout' WHEN gt IS NULL OR st <= gt THEN 'stop' ELSE 'target' END AS barrier FROM h WHERE n >= 2),
z AS (SELECT symbol, id, t, side, entry, stop, target, barrier, max(n) AS path_rows, max(pt) AS exit_t, max(high) AS mh, min(low) AS ml, arg_max(close, pt) AS last FROM k WHERE pt <= coalesce(least(st, gt), lt) GROUP BY ALL)
SELECT symbol, id, path_rows, barrier, exit_t, round((exit_t - t) / 3600.0, 6) AS hours_held, round(CASE side WHEN 'long' THEN 1 ELSE -1 END * (CASE barrier WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE last END - entry) / nullif(abs(entry - stop), 0), 6) AS gross_r,
 round(CASE side WHEN 'long' THEN 1 ELSE -1 END * (CASE WHEN barrier = 'target' THEN target WHEN side = 'long' THEN mh ELSE ml END - entry) / nullif(abs(entry - stop), 0), 6) AS mfe_r, round(CASE side WHEN 'long' THEN 1 ELSE -1 END * (CASE WHEN barrier = 'stop' THEN stop WHEN side = 'long' THEN ml ELSE mh END - entry) / nullif(abs(entry - stop), 0), 6) AS mae_r FROM z""")
def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    """All ticks as entries, resolved on the highs and lows of ten-minute bars."""
    buy, price = F.col("is_buyer"), F.col("price")
    e = tables.ticks(spark, d).select("symbol", "id", "t", F.when(buy, "long").otherwise("short").alias("side"), price.alias("entry"), F.round(price * F.when(buy, 0.5).otherwise(1.5), 4).alias("stop"), F.round(price * F.when(buy, 2.0).otherwise(0.3), 4).alias("target"))
    x = labels.first_touch(e, tables.candles(spark, d, 600), 43200, 43200)
    return rounded(x.select("symbol", "id", "path_rows", "barrier", "exit_t", "hours_held", "gross_r", "mfe_r", "mae_r"))


@query("j01_feature_label_join", _CORE + ", " + _LABELS.split(", ", 1)[1].split("FROM ticks GROUP BY 1, 2, 3)", 1)[1].lstrip(", ") + " SELECT core.symbol, core.t, round(volatility_expansion, 6) AS volatility_expansion, target_before_stop, realized_r FROM core JOIN labels USING (symbol, t) WHERE target_before_stop IS NOT NULL")
def feature_label_join(spark: SparkSession, d: str) -> DataFrame:
    x = features.chunked_core_features(tables.candles(spark, d), N).select("symbol", "t", "volatility_expansion")
    y = _barriers(spark, d).where("target_before_stop is not null").select("symbol", "t", "target_before_stop", F.round("realized_r", 4).alias("realized_r"))
    return rounded(x.join(y, ["symbol", "t"]))


@query("p08_filter_funnel", CANDLES + """ SELECT 0 AS step, 'volume >= 2' AS condition, count(*) FILTER (volume >= 2) AS alone, count(*) FILTER (volume IS NULL) AS missing, count(*) AS before, count(*) FILTER (volume >= 2) AS after, CAST(min(volume) AS DOUBLE) AS smallest, CAST(max(volume) AS DOUBLE) AS largest, count(*) FILTER (NOT volume >= 2) AS rejected FROM candles
UNION ALL SELECT 1, 'close < 20.0', count(*) FILTER (close < 20), 0, count(*) FILTER (volume >= 2), count(*) FILTER (volume >= 2 AND close < 20), min(close), max(close), count(*) FILTER (volume >= 2 AND NOT close < 20) FROM candles""")
def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return predicates.funnel(tables.candles(spark, d), [predicates.Condition("volume", ">=", 2), predicates.Condition("close", "<", 20.0)])


@query("p04_filter_groups", CANDLES + " SELECT symbol, t FROM candles WHERE NOT ((close > 50 AND volume > 1) OR low < 1)")
def filter_groups(spark: SparkSession, d: str) -> DataFrame:
    c = predicates.Condition
    return tables.candles(spark, d).where(~predicates.any_group([[c("close", ">", 50), c("volume", ">", 1)], [c("low", "<", 1)]])).select("symbol", "t")


@query("p05_fail_closed", _CORE + " SELECT symbol, t, CASE WHEN rsi IS NULL THEN 'rsi' ELSE '' END AS missing, rsi IS NULL OR (rsi > 60 AND from_high > -0.5) AS blocked FROM (SELECT symbol, t, round(rsi, 6) AS rsi, from_high FROM core)")
def fail_closed(spark: SparkSession, d: str) -> DataFrame:
    c = predicates.Condition
    x = features.chunked_core_features(tables.candles(spark, d), N).select("symbol", "t", F.round("rsi", 6).alias("rsi"), "from_high")
    return predicates.abstain(x, [[c("rsi", ">", 60), c("from_high", ">", -0.5)]]).select("symbol", "t", F.array_join("missing", ",").alias("missing"), "blocked")


@query("p11_time_split", f"WITH {TRADES_SQL} SELECT split, count(*) AS rows, min(decision_t) AS first_t, max(decision_t) AS last_t FROM (SELECT *, CASE WHEN decision_t <= 915148800 THEN 'train' WHEN decision_t <= 946684800 THEN 'validation' WHEN decision_t <= 978307200 THEN 'test' END AS split FROM trades) GROUP BY split")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    x = predicates.time_split(tables.trades(spark, d), "decision_t", 915148800, 946684800, 978307200)
    return x.groupBy("split").agg(F.count("*").alias("rows"), F.min("decision_t").alias("first_t"), F.max("decision_t").alias("last_t"))


_WINDOWS = CANDLES + """, x AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM candles))
SELECT CAST(i // 50 AS INT) AS fold, t AS train_start, lead(t, 99) OVER o AS train_end, lead(t, 100) OVER o AS validation_start, lead(t, 149) OVER o AS validation_end, lead(t, 150) OVER o AS test_start, lead(t, 199) OVER o AS test_end FROM x WINDOW o AS (ORDER BY i) QUALIFY i % 50 = 0 AND lead(t, 199) OVER o IS NOT NULL"""


@query("p12_walk_forward", _WINDOWS)
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return predicates.walk_forward(tables.candles(spark, d), "t", 100, 50, 50, 50)


@query("x07_sql_windows", _WINDOWS)
def sql_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows by SQL alone, from a registered view and table function."""
    scenarios.register_sql(spark, {"tideframe_candles": tables.candles(spark, d)})
    return spark.sql("SELECT * FROM walk_forward_windows(TABLE(SELECT DISTINCT t FROM tideframe_candles) WITH SINGLE PARTITION ORDER BY (t), 100, 50, 50, 50, false)")


@query("x06_scenario_runs", f"""WITH {TRADES_SQL}, s AS (SELECT * FROM (VALUES ('base', 0.3), ('strict', 0.6)) v(scenario, low)) SELECT scenario, 'completed' AS run_status, CAST(NULL AS VARCHAR) AS error, symbol, count(*) AS trades, round(avg(net_r), 8) AS mean_r FROM trades JOIN s ON confidence >= low GROUP BY scenario, symbol
UNION ALL SELECT 'typo', 'failed', 'AnalysisException', NULL, NULL, NULL UNION ALL SELECT 'broken', 'failed', 'ArithmeticException', NULL, NULL, NULL""")
def scenario_runs(spark: SparkSession, d: str) -> DataFrame:
    """Four scenarios over all trades: one can't be planned, one fails in its tasks, the others complete."""

    def run(spark: SparkSession, config: dict) -> DataFrame:
        t = tables.trades(spark, d).where(F.col(config["column"]) >= config["least"])
        return t.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.avg(F.expr(config["value"])), 8).alias("mean_r"))

    base = {"column": "confidence", "least": 0.3, "value": "net_r"}
    matrix = {"base": {}, "strict": {"least": 0.6}, "typo": {"column": "confidense"}, "broken": {"value": "1 / (id - id)"}}
    folder = f"{streams.shared_folder(spark)}/scenarios-{uuid.uuid4().hex}"
    rows, report = scenarios.run_scenarios(spark, base, matrix, run, folder, "symbol string, trades long, mean_r double")
    return report.select("scenario", "run_status", "error").join(rows, "scenario", "left")


@query("p13_time_folds", CANDLES + ", e AS (SELECT min(t) AS lo, max(t) AS hi FROM candles) SELECT symbol, t, CAST(least(floor((t - lo) * 6.0 / (hi - lo)), 5) AS INT) AS fold FROM candles CROSS JOIN e")
def time_folds(spark: SparkSession, d: str) -> DataFrame:
    return predicates.time_folds(tables.candles(spark, d).select("symbol", "t"), "t", 6)


# Ranks over bars -----------------------------------------------------------------------------------------------------


@query("w48_relative_strength", CANDLES + """, x AS (SELECT symbol, t, close / nullif(lag(close, 12) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS strength FROM candles)
SELECT symbol, t, round(strength, 6) AS strength, CAST(row_number() OVER (PARTITION BY t ORDER BY strength DESC, symbol) AS INT) AS strength_rank, count(*) OVER (PARTITION BY t) AS strength_of FROM x WHERE strength IS NOT NULL""")
def relative_strength(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.relative_strength(tables.candles(spark, d), 12).select("symbol", "t", "strength", "strength_rank", "strength_of"))


@query("w64_cross_sectional_rank", CANDLES + """ SELECT symbol, t, round(2 * (rank() OVER (PARTITION BY t ORDER BY volume) + (count(volume) OVER (PARTITION BY t, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY t) - 1, 6) AS r FROM candles""")
def cross_sectional_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.cross_sectional_rank(tables.candles(spark, d), "volume", "r").select("symbol", "t", "r"))


@query("w65_relative_label", CANDLES + """, x AS (SELECT symbol, t, count(volume) OVER (PARTITION BY t) AS n, 2 * (rank() OVER (PARTITION BY t ORDER BY close) + (count(close) OVER (PARTITION BY t, close) - 1) / 2.0) / count(close) OVER (PARTITION BY t) - 1 AS r FROM candles) SELECT symbol, t, CASE WHEN n >= 3 THEN r > 0 END AS upper FROM x""")
def relative_label(spark: SparkSession, d: str) -> DataFrame:
    return ranking.relative_label(tables.candles(spark, d), "close", "upper", 3).select("symbol", "t", "upper")


@query("w66_long_short_book", CANDLES + """, x AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS a, row_number() OVER (PARTITION BY t ORDER BY close, symbol) AS b, count(*) OVER (PARTITION BY t) AS n FROM candles)
SELECT symbol, t, CASE WHEN a <= 1 THEN 'long' ELSE 'short' END AS leg FROM x WHERE n >= 2 AND (a <= 1 OR b <= 1)""")
def long_short_book(spark: SparkSession, d: str) -> DataFrame:
    return ranking.long_short_book(tables.candles(spark, d), "close", 1).select("symbol", "t", "leg")

"""A query for each indicator of the core set and of the recursive one, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators import bars, features, labels
from tideframe.plans.market import _CORE, CANDLES, H4, N, query, rounded
from tideframe.sources import tables
from tideframe.sources.tables import candles_sql

C = features.CHUNKED

#: Query and the columns of the core set that it shows.
CORE_FAMILIES = {
    "w02_moving_average_slope": ["ma", "ma_slope", "above_ma"],
    "w03_rolling_extremes": ["from_high", "from_low"],
    "w04_range_position": ["range_position"],
    "w05_rolling_zscore": ["range_z"],
    "w06_relative_volume": ["relative_volume", "volume_z"],
    "w07_volatility_expansion": ["volatility_expansion"],
    "w08_realized_volatility": ["realized_volatility"],
    "w09_windowed_ema": ["ema"],
    "w10_windowed_macd": ["macd", "macd_signal", "macd_histogram"],
    "w11_windowed_rsi": ["rsi"],
    "w14_true_range_atr": ["true_range", "atr", "atr_share"],
    "w15_bollinger": ["bollinger_position", "bollinger_width"],
    "w18_consecutive_bars": ["bull_run", "bear_run"],
    "w19_taker_flow": ["taker_imbalance", "taker_mean", "taker_z"],
    "w29_sma": ["ma"],
    "w32_trailing_zscore": ["volume_z"],
}
_WHOLE = ("above_ma", "bull_run", "bear_run")


#: Means of true ranges over closes meet rounding ties at fewer digits.
_DIGITS = {"atr": 9, "atr_share": 9}


def _shown(x: DataFrame, columns: list[str]) -> DataFrame:
    return x.select("symbol", "t", *(F.col(c).cast("int").alias(c) if c in _WHOLE else F.round(c, _DIGITS.get(c, 5)).alias(c) for c in columns))


def _family(columns: list[str]):
    """Only what the columns need is computed: the optimizer prunes the rest of the set."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(features.chunked_core_features(tables.candles(spark, d), N), columns)

    return run


for _name, _columns in CORE_FAMILIES.items():
    query(_name, _CORE + " SELECT symbol, t, " + ", ".join(f"CAST({c} AS INT) AS {c}" if c in _WHOLE else f"round({c}, {_DIGITS.get(c, 5)}) AS {c}" for c in _columns) + " FROM core")(_family(_columns))


@query("w16_windowed_dmi", CANDLES + f""", a AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn, lag(close) OVER w AS pc FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN up IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a),
d AS (SELECT symbol, t, CASE WHEN count(close) OVER f = {N} THEN sum(p) OVER k / nullif(sum(tr) OVER k, 0) * 100 END AS plus_di, CASE WHEN count(close) OVER f = {N} THEN sum(m) OVER k / nullif(sum(tr) OVER k, 0) * 100 END AS minus_di FROM b
 WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW), k AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 2} PRECEDING AND CURRENT ROW))
SELECT symbol, t, round(plus_di, 5) AS plus_di, round(minus_di, 5) AS minus_di, round(abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) * 100, 5) AS adx_proxy FROM d""")
def windowed_dmi(spark: SparkSession, d: str) -> DataFrame:
    return _shown(features.chunked_core_features(tables.candles(spark, d), N), ["plus_di", "minus_di", "adx_proxy"])


@query("w17_candle_shape", CANDLES + """ SELECT symbol, t, round((close - low) / nullif(high - low, 0), 6) AS close_location, round(abs(close - open) / nullif(high - low, 0), 6) AS body_ratio, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_wick, round((close - open) / nullif(high - low, 0), 6) AS body_pressure FROM candles""")
def candle_shape(spark: SparkSession, d: str) -> DataFrame:
    shape = features.candle_shape()
    return tables.candles(spark, d).select("symbol", "t", *(F.round(shape[c], 6).alias(c) for c in ("close_location", "body_ratio", "upper_wick", "lower_wick", "body_pressure")))


# Recursive indicators of four-hour bars ------------------------------------------------------------------------------


def _from(alpha: float, x: str, src: str, name: str, first: int) -> str:
    """y = (1 - alpha) y_before + alpha x from row `first` on."""
    return f"{name} AS (SELECT symbol, n, {x} AS y FROM {src} WHERE n = {first} UNION ALL SELECT r.symbol, s.n, {1 - alpha!r} * r.y + {alpha!r} * s.{x} FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.n = r.n + 1)"


_BASE = "WITH RECURSIVE " + candles_sql() + f""", g AS (SELECT symbol, ((close_t - 1) // {H4} + 1) * {H4} - {H4} AS t, arg_min(open, candles.close_t) AS open, max(high) AS high, min(low) AS low, arg_max(close, candles.close_t) AS close FROM candles GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM g WINDOW w AS (PARTITION BY symbol ORDER BY t)),
s AS (SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM q)"""


def _wilder(spark: SparkSession, d: str) -> DataFrame:
    b = bars.regroup(tables.candles(spark, d), H4, closed_only=False)
    return features.wilder_indicators(b)


def _of(columns: list[str], digits: int = 5):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _wilder(spark, d).select("symbol", "t", *(F.round(c, digits).alias(c) for c in columns))

    return run


query("w25_wilder_rsi", _BASE + ", " + _from(1 / 14, "gain", "s", "a", 2) + ", " + _from(1 / 14, "loss", "s", "b", 2) + """ SELECT s.symbol, s.t, CASE WHEN s.n >= 15 THEN round(CASE WHEN b.y = 0 THEN 100 ELSE 100 - 100 / (1 + a.y / b.y) END, 5) END AS wilder_rsi FROM s LEFT JOIN a USING (symbol, n) LEFT JOIN b USING (symbol, n)""")(_of(["wilder_rsi"]))
query("w26_wilder_atr", _BASE + ", " + _from(1 / 20, "tr", "s", "a", 1) + " SELECT s.symbol, s.t, CASE WHEN s.n >= 20 THEN round(a.y, 5) END AS wilder_atr FROM s JOIN a USING (symbol, n)")(_of(["wilder_atr"]))
query("w27_wilder_adx", _BASE + ", " + ", ".join((_from(1 / 14, "tr", "s", "a", 1), _from(1 / 14, "p", "s", "b", 1), _from(1 / 14, "m", "s", "c", 1))) + """,
x AS (SELECT s.symbol, s.n, s.t, CASE WHEN s.n >= 14 THEN b.y / nullif(a.y, 0) * 100 END AS pd, CASE WHEN s.n >= 14 THEN c.y / nullif(a.y, 0) * 100 END AS md FROM s JOIN a USING (symbol, n) LEFT JOIN b USING (symbol, n) LEFT JOIN c USING (symbol, n)),
dx AS (SELECT *, coalesce(abs(pd - md) / nullif(pd + md, 0) * 100, 0) AS v FROM x), """ + _from(1 / 14, "v", "dx", "e", 1) + """ SELECT dx.symbol, dx.t, round(pd, 5) AS wilder_plus_di, round(md, 5) AS wilder_minus_di, CASE WHEN dx.n >= 14 THEN round(e.y, 5) END AS wilder_adx FROM dx JOIN e USING (symbol, n)""")(_of(["wilder_plus_di", "wilder_minus_di", "wilder_adx"]))
query("w28_macd", _BASE + ", " + _from(2 / 13, "close", "s", "a", 1) + ", " + _from(2 / 27, "close", "s", "b", 1) + """,
x AS (SELECT s.symbol, s.n, s.t, CASE WHEN s.n >= 26 THEN a.y - b.y END AS line FROM s JOIN a USING (symbol, n) JOIN b USING (symbol, n)), """ + _from(2 / 10, "line", "x", "e", 26) + """ SELECT x.symbol, x.t, round(line, 5) AS macd_line, CASE WHEN x.n >= 34 THEN round(e.y, 5) END AS macd_line_signal FROM x LEFT JOIN e USING (symbol, n)""")(_of(["macd_line", "macd_line_signal"]))
query("w30_keltner", _BASE + ", " + _from(2 / 21, "close", "s", "a", 1) + ", " + _from(1 / 20, "tr", "s", "b", 1) + """ SELECT s.symbol, s.t, CASE WHEN s.n >= 20 THEN round((close - (a.y - b.y)) / nullif(2 * b.y, 0), 5) END AS keltner_position FROM s JOIN a USING (symbol, n) JOIN b USING (symbol, n)""")(_of(["keltner_position"]))


_STUDY = CANDLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, q AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t)),
s AS (SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM q), """ + ", ".join([
    _from(1 / 14, "gain", "s", "rg", 2), _from(1 / 14, "loss", "s", "rl", 2), _from(1 / 20, "tr", "s", "ra", 1), _from(1 / 14, "tr", "s", "rt", 1), _from(1 / 14, "p", "s", "rp", 1), _from(1 / 14, "m", "s", "rm", 1),
    *(_from(2 / (k + 1), "close", "s", f"e{k}", 1) for k in (8, 12, 18, 20, 26, 50, 200)),
]) + """, x AS (SELECT s.*, CASE WHEN n >= 14 THEN coalesce(abs(rp.y - rm.y) / nullif(rp.y + rm.y, 0) * 100, 0) ELSE 0 END AS dx, CASE WHEN n >= 26 THEN e12.y - e26.y END AS line, CASE WHEN n >= 20 THEN ra.y END AS atr,
CASE WHEN n >= 15 THEN CASE WHEN rl.y = 0 THEN 100 ELSE 100 - 100 / (1 + rg.y / rl.y) END END AS rsi, CASE WHEN n >= 8 THEN e8.y END AS m8, CASE WHEN n >= 18 THEN e18.y END AS m18, CASE WHEN n >= 20 THEN e20.y END AS m20, CASE WHEN n >= 50 THEN e50.y END AS m50, CASE WHEN n >= 200 THEN e200.y END AS m200
FROM s LEFT JOIN rg USING (symbol, n) LEFT JOIN rl USING (symbol, n) JOIN ra USING (symbol, n) JOIN rp USING (symbol, n) JOIN rm USING (symbol, n) JOIN e8 USING (symbol, n) JOIN e12 USING (symbol, n) JOIN e18 USING (symbol, n) JOIN e20 USING (symbol, n) JOIN e26 USING (symbol, n) JOIN e50 USING (symbol, n) JOIN e200 USING (symbol, n)), """ + _from(1 / 14, "dx", "x", "rx", 1) + ", " + _from(2 / 10, "line", "x", "sg", 26) + """,
y AS (SELECT x.*, CASE WHEN x.n >= 14 THEN rx.y END AS adx, CASE WHEN x.n >= 34 THEN sg.y END AS sig, close / nullif(pc, 0) - 1 AS r1 FROM x JOIN rx USING (symbol, n) LEFT JOIN sg USING (symbol, n)),
z AS (SELECT *, close / nullif(lag(close, 6) OVER w, 0) - 1 AS r6, close / nullif(lag(close, 30) OVER w, 0) - 1 AS r30, CASE WHEN n >= 20 THEN avg(close) OVER f20 END AS ma, CASE WHEN n >= 20 THEN stddev_pop(close) OVER f20 END AS sd, CASE WHEN n >= 21 THEN max(high) OVER d20 END AS dh, CASE WHEN n >= 21 THEN min(low) OVER d20 END AS dl, CASE WHEN n >= 31 THEN stddev_pop(r1) OVER f30 END AS rv, quote_volume / nullif(trades, 0) AS sz, m50 / lag(m50, 5) OVER w - 1 AS slope, atr / nullif(close, 0) AS ap
FROM y WINDOW w AS (PARTITION BY symbol ORDER BY t), f20 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), d20 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f30 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, CASE WHEN count(rv) OVER f = 60 THEN (rv - avg(rv) OVER f) / nullif(stddev_pop(rv) OVER f, 0) END AS vv, CASE WHEN count(ap) OVER f = 60 THEN (ap - avg(ap) OVER f) / nullif(stddev_pop(ap) OVER f, 0) END AS az, CASE WHEN count(quote_volume) OVER f = 60 THEN (quote_volume - avg(quote_volume) OVER f) / nullif(stddev_pop(quote_volume) OVER f, 0) END AS vz, CASE WHEN count(sz) OVER f = 60 THEN (sz - avg(sz) OVER f) / nullif(stddev_pop(sz) OVER f, 0) END AS tz FROM z WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
"""
#: SQL of each column of the study frame.
_STUDY_COLUMNS = {
    "atr_pct": "ap", "atr_pct_z": "az", "rsi": "rsi", "adx": "adx", "ema_short_rel": "m8 / close - 1", "ema_long_rel": "m50 / close - 1", "ema_stack": "CAST(sign(m8 - m18) + sign(m50 - m200) AS DOUBLE)", "ema_long_slope": "slope",
    "macd_hist_norm": "(line - sig) / nullif(atr, 0)", "macd_above_signal": "CAST(coalesce(line > sig, false) AS DOUBLE)", "boll_position": "(close - (ma - 2 * sd)) / nullif(4 * sd, 0)", "boll_width": "nullif(4 * sd, 0) / nullif(ma, 0)", "keltner_position": "(close - (m20 - atr)) / nullif(2 * atr, 0)",
    "donchian_position": "(close - dl) / nullif(dh - dl, 0)", "donchian_span_atr": "nullif(dh - dl, 0) / nullif(atr, 0)", "return_1": "r1", "return_6": "r6", "return_30": "r30", "realized_vol": "rv", "vol_of_vol": "vv", "taker_buy_share": "taker_buy / nullif(quote_volume, 0)", "volume_z": "vz", "trade_size_z": "tz",
    "body_fraction": "abs(close - open) / nullif(high - low, 0)", "upper_wick": "(high - greatest(open, close)) / nullif(high - low, 0)", "lower_wick": "(least(open, close) - low) / nullif(high - low, 0)",
}


@query("w33_base_indicator_frame", _STUDY + "SELECT symbol, t, " + ", ".join(f"round({v}, 5) AS {k}" for k, v in _STUDY_COLUMNS.items()) + " FROM o")
def base_indicator_frame(spark: SparkSession, d: str) -> DataFrame:
    """The price features of hourly bars."""
    return rounded(features.study_frame(tables.candles(spark, d)).select("symbol", "t", *_STUDY_COLUMNS), 5)


@query("w33_study_features")
def study_features(spark: SparkSession, d: str) -> DataFrame:
    """All 39 price features: hourly bars with the context of six-hour bars, of their own and of a reference series."""
    c = tables.candles(spark, d)
    coarse = tables.candles(spark, d, 6 * 3600)
    return rounded(features.study_features(c, coarse, "view").drop("open", "high", "low", "close", "volume", "quote_volume", "taker_buy", "trades", "donchian_high", "donchian_low", "atr"), 6)


# Labels --------------------------------------------------------------------------------------------------------------

_TOUCH = CANDLES + """, n AS (SELECT symbol, t, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM candles),
h AS (SELECT a.symbol, a.t, any_value(a.close) AS entry, count(b.n) AS k, min(CASE WHEN b.high >= a.close * 1.4 THEN b.n - a.n END) AS tt, min(CASE WHEN b.low <= a.close * 0.8 THEN b.n - a.n END) AS ts, arg_max(b.close, b.n) AS last FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.n BETWEEN a.n + 1 AND a.n + 6 GROUP BY 1, 2)"""


def _touched(spark: SparkSession, d: str) -> DataFrame:
    return labels.barrier_labels(tables.candles(spark, d), 6, 0.2, 0.4, 0.01)


@query("w50_first_touch_times", _TOUCH + " SELECT symbol, t, CASE WHEN k = 6 THEN CAST(tt AS INT) END AS bars_to_target, CASE WHEN k = 6 THEN CAST(ts AS INT) END AS bars_to_stop FROM h")
def first_touch_times(spark: SparkSession, d: str) -> DataFrame:
    return _touched(spark, d).select("symbol", "t", "bars_to_target", "bars_to_stop")


@query("w51_barrier_outcome", _TOUCH + " SELECT symbol, t, CASE WHEN k = 6 THEN round(CASE WHEN tt IS NULL AND ts IS NULL THEN (last / entry - 1) / 0.2 WHEN ts IS NULL OR tt < ts THEN 2.0 ELSE -1.0 END - 0.05, 8) END AS realized_r FROM h")
def barrier_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _touched(spark, d).select("symbol", "t", F.round("realized_r", 8).alias("realized_r"))


@query("w54_open_trades", _TOUCH + " SELECT symbol, t, CASE WHEN tt IS NULL AND ts IS NULL THEN CASE WHEN k < 6 THEN 'open' ELSE 'horizon' END WHEN ts IS NULL OR tt < ts THEN 'target' ELSE 'stop' END AS state FROM h")
def open_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades resolved by what is known so far: a touch decides also before the horizon is there."""
    return labels.resolved(tables.candles(spark, d), 6, 0.2, 0.4).select("symbol", "t", "state")


_RESOLVED = f"""WITH RECURSIVE {candles_sql(600, 'bars')}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close_t) AS n FROM bars),
e AS (SELECT symbol, id, t, CASE WHEN is_buyer THEN 1 ELSE -1 END AS g, price AS entry, price * (1 - 0.3 * CASE WHEN is_buyer THEN 1 ELSE -1 END) AS sp, price * (1 + 0.6 * CASE WHEN is_buyer THEN 1 ELSE -1 END) AS tp FROM ticks),
x AS (SELECT e.*, b.close_t, b.high, b.low, b.close, row_number() OVER (PARTITION BY e.symbol, e.id ORDER BY b.close_t) AS k FROM e JOIN bars b ON b.symbol = e.symbol AND b.close_t > e.t AND b.close_t <= e.t + 172800 QUALIFY k <= 8),
u AS (SELECT *, CASE WHEN g = 1 THEN (high - entry) / (entry * 0.3) ELSE (entry - low) / (entry * 0.3) END AS best, CASE WHEN g = 1 THEN (low - entry) / (entry * 0.3) ELSE (entry - high) / (entry * 0.3) END AS worst, CASE WHEN g = 1 THEN low <= sp ELSE high >= sp END AS s, CASE WHEN g = 1 THEN high >= tp ELSE low <= tp END AS h FROM x),
a AS (SELECT symbol, id, any_value(g) AS g, any_value(entry) AS entry, any_value(sp) AS sp, any_value(tp) AS tp, max(k) AS rows, min(k) FILTER (s) AS ks, min(k) FILTER (h) AS kh, max(best) AS mfe, min(worst) AS mae, arg_max(close, k) AS last FROM u GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN kh IS NOT NULL AND (ks IS NULL OR kh < ks) THEN 'target' WHEN ks IS NOT NULL THEN 'stop' WHEN rows = 8 THEN 'horizon_exit' END AS why FROM a),
z AS (SELECT *, CASE why WHEN 'target' THEN tp WHEN 'stop' THEN sp WHEN 'horizon_exit' THEN last END AS px, CASE why WHEN 'target' THEN kh WHEN 'stop' THEN ks WHEN 'horizon_exit' THEN 8 END AS held FROM c)"""


@query("w54_trade_resolution", _RESOLVED + """ SELECT e.symbol, e.id, CASE WHEN why IS NULL THEN 'open' ELSE 'closed' END AS status, why AS exit_reason, CAST(held AS INT) AS bars_held, x.close_t AS exit_t, round(px, 6) AS exit_price, round(CASE WHEN z.g = 1 THEN px / z.entry - 1 ELSE z.entry / px - 1 END / 0.3, 6) AS gross_r, round(CASE WHEN z.g = 1 THEN px / z.entry - 1 ELSE z.entry / px - 1 END / 0.3 - 0.002 / 0.3, 6) AS net_r,
CASE WHEN why IS NOT NULL THEN round(mfe, 6) END AS mfe_r, CASE WHEN why IS NOT NULL THEN round(mae, 6) END AS mae_r, CASE WHEN why IS NOT NULL THEN CAST(mfe >= 0.5 AS INT) + CAST(mfe >= 1 AS INT) + CAST(mfe >= 1.5 AS INT) + CAST(mfe >= 2 AS INT) END AS milestones
FROM e LEFT JOIN z ON z.symbol = e.symbol AND z.id = e.id LEFT JOIN x ON x.symbol = e.symbol AND x.id = e.id AND x.k = z.held""")
def trade_resolution(spark: SparkSession, d: str) -> DataFrame:
    """All ticks as open trades, resolved on the eight ten-minute bars that close next."""
    x = _resolved(spark, d)
    return rounded(x.select("symbol", "id", "status", "exit_reason", "bars_held", "exit_t", "exit_price", "gross_r", "net_r", "mfe_r", "mae_r", F.size(F.filter("reached", lambda f: f)).alias("milestones")))


@query("w54_exit_policies", _RESOLVED + """, p AS (SELECT * FROM (VALUES ('breakeven_after_1r', 0.0, 1e12), ('breakeven_lock_0_1r_after_1r', 0.1, 1e12), ('breakeven_lock_0_1r_trail_1_5r_after_1r', 0.1, CAST(1.5 AS DOUBLE))) v(policy, lock_r, trail)),
f AS (SELECT z.symbol, z.id, policy, lock_r, trail, CAST(0 AS BIGINT) AS k, CAST(-1 AS DOUBLE) AS stop, CAST(NULL AS BIGINT) AS even, CAST(NULL AS BIGINT) AS ended FROM z, p WHERE why IS NOT NULL
UNION ALL SELECT symbol, id, policy, lock_r, trail, k + 1, CASE WHEN worst <= stop THEN stop ELSE raised END, CASE WHEN worst > stop AND even IS NULL AND best >= 1 THEN k + 1 ELSE even END, CASE WHEN worst <= stop OR raised <> stop AND worst <= raised THEN k + 1 END
FROM (SELECT f.*, u.best, u.worst, greatest(f.stop, CASE WHEN u.best >= 1 THEN lock_r ELSE f.stop END, CASE WHEN u.best >= trail THEN u.best - trail ELSE f.stop END) AS raised FROM f JOIN u ON u.symbol = f.symbol AND u.id = f.id AND u.k = f.k + 1 WHERE f.ended IS NULL)),
q AS (SELECT symbol, id, policy, arg_max(stop, k) AS stop, max(even) AS even, max(ended) AS ended, max(k) AS seen FROM f GROUP BY 1, 2, 3),
w AS (SELECT q.*, z.g, z.entry, CASE WHEN ended IS NOT NULL THEN z.entry + z.g * stop * (z.entry * 0.3) ELSE z.last END AS px FROM q JOIN z ON z.symbol = q.symbol AND z.id = q.id)
SELECT symbol, id, policy, CASE WHEN ended IS NOT NULL THEN 'dynamic_stop' ELSE 'horizon_exit' END AS exit_reason, CAST(seen AS INT) AS bars_held, CAST(even AS INT) AS breakeven_bars, round(CASE WHEN g = 1 THEN px / entry - 1 ELSE entry / px - 1 END / 0.3 - 0.002 / 0.3, 6) AS net_r FROM w""")
def exit_policies(spark: SparkSession, d: str) -> DataFrame:
    """What each closed trade would have brought with other exits."""
    # explode_outer: explode infers a filter on the map, so that the optimizer works out all folds again below it.
    x = _resolved(spark, d).where("status = 'closed'").select("symbol", "id", F.explode_outer("policies").alias("policy", "_p"))
    return rounded(x.select("symbol", "id", "policy", "_p.exit_reason", "_p.bars_held", "_p.breakeven_bars", "_p.net_r"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.functions.scalars import stop_and_target

    side = F.when(F.col("is_buyer"), "long").otherwise("short")
    e = tables.ticks(spark, d).select("symbol", "id", "t", side.alias("side"), F.col("price").alias("entry"))
    stop, target = stop_and_target(F.col("entry"), F.col("side"), 0.3, 0.6)
    e = e.withColumn("stop_price", stop).withColumn("target_price", target)
    return labels.resolve_trades(e, tables.candles(spark, d, 600), 8, 0.3, 0.002)


@query("j16_forward_path", f"""WITH {candles_sql(600, 'bars')}, e AS (SELECT symbol, id, t FROM ticks) SELECT e.symbol, e.id, count(*) AS path_rows, max(b.high) AS highest, min(b.low) AS lowest FROM e JOIN bars b ON b.symbol = e.symbol AND b.t BETWEEN e.t AND e.t + 14400 GROUP BY 1, 2 HAVING count(*) >= 2""")
def forward_path(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.operators.asof import interval_join

    e = tables.ticks(spark, d).select("symbol", "id", F.col("t").alias("from_t"), (F.col("t") + 14400).alias("to_t"))
    b = tables.candles(spark, d, 600).select("symbol", "t", "high", "low")
    x = interval_join(e, b, "from_t", "to_t", "t", ["symbol"], 14400)
    return x.groupBy("symbol", "id").agg(F.count("*").alias("path_rows"), F.max("high").alias("highest"), F.min("low").alias("lowest")).where("path_rows >= 2")

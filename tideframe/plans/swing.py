"""Queries of swing features, exits, models and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.operators import features, folds, models, swing
from tideframe.operators.performance import basket_index
from tideframe.operators.scan import ema_weights
from tideframe.plans.market import CANDLES, S, query, rounded
from tideframe.sources import tables
from tideframe.sources.tables import TRADES_SQL

T = f"WITH {TRADES_SQL}"
C = features.CHUNKED
B = CANDLES + """, b AS (SELECT *, row_number() OVER w - 1 AS n, lag(close) OVER w AS prev, close - lag(close) OVER w AS ch FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


def frame(n: int, skip: int = 0, by: str = "symbol") -> str:
    return f"(PARTITION BY {by} ORDER BY t ROWS BETWEEN {n - 1 + skip} PRECEDING AND {'CURRENT ROW' if not skip else f'{skip} PRECEDING'})"


def _bars(spark: SparkSession, d: str, halo: int) -> DataFrame:
    return features.in_chunks(tables.candles(spark, d), S, halo)


def _out(x: DataFrame) -> DataFrame:
    return rounded(features.own_rows(x).drop("_row"))


@query("w40_drawdown_bounce", B + f""", f AS (SELECT symbol, t, n, close, count(*) OVER k = 21 AS full_, max(high) OVER k AS hi, min(low) OVER k AS lo, list(low) OVER k AS lows FROM b WINDOW k AS {frame(21)})
SELECT symbol, t, CASE WHEN full_ THEN round(close / nullif(hi, 0) - 1, 6) END AS drawdown, CASE WHEN full_ THEN round(close / nullif(lo, 0) - 1, 6) END AS bounce, CASE WHEN full_ THEN list_position(list_reverse(lows), lo) - 1 END AS low_age FROM f""")
def drawdown_bounce(spark: SparkSession, d: str) -> DataFrame:
    x = _bars(spark, d, 40)
    return _out(x.select("symbol", "t", "_own", "_row", "_chunk", *(c.alias(k) for k, c in swing.drawdown_bounce_age(C, 20, F.col("_row")).items())))


@query("w41_lookback_returns", B + """, f AS (SELECT symbol, t, close / nullif(lag(close, 24) OVER w, 0) - 1 AS a, close / nullif(lag(close, 6) OVER w, 0) - 1 AS r, CAST(close > prev AS INT) AS rose FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, round(a, 6) AS trend_return, round(r, 6) AS recent_return, rose, CAST(sum(rose) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS rose_6 FROM f""")
def lookback_returns(spark: SparkSession, d: str) -> DataFrame:
    x = _bars(spark, d, 30)
    x = x.select("symbol", "t", "_own", "_row", "_chunk", *(c.alias(k) for k, c in swing.lookback_returns(C, 24, 6).items()))
    return _out(x.withColumn("rose_6", F.sum("rose").over(C.frame(6))))


@query("w42_breakout", B + f""", f AS (SELECT symbol, t, close, volume, count(*) OVER k AS c, max(high) OVER k AS hi, min(low) OVER k AS lo, avg(volume) OVER k AS v FROM b WINDOW k AS {frame(12, 1)})
SELECT symbol, t, coalesce(c = 12 AND close >= hi * 0.9 AND (hi - lo) / nullif(lo, 0) <= 50, false) AS breakout, CASE WHEN c = 12 THEN round(volume / nullif(v, 0), 6) END AS volume_ratio FROM f""")
def breakout(spark: SparkSession, d: str) -> DataFrame:
    x = _bars(spark, d, 20)
    return _out(x.select("symbol", "t", "_own", "_row", "_chunk", *(c.alias(k) for k, c in swing.breakout(C, 12, -0.1, 50.0).items())))


_RSI = f"CASE WHEN count(ch) OVER r = 14 THEN CASE WHEN sum(greatest(-ch, 0)) OVER r = 0 THEN 100 ELSE 100 - 100 / (1 + (sum(greatest(ch, 0)) OVER r / 14) / nullif(sum(greatest(-ch, 0)) OVER r / 14, 0)) END END AS rsi"
_EMA = "(" + " + ".join(f"{k!r} * lag(close, {i}) OVER w" for i, k in enumerate(ema_weights(9, seed="mean"))) + ") AS ema"
_FADE = B + f""", i AS (SELECT *, {_RSI}, {_EMA} FROM b WINDOW r AS {frame(14)}, w AS (PARTITION BY symbol ORDER BY t)),
j AS (SELECT *, rsi - lag(rsi) OVER w AS rsi_change, coalesce(close < prev, false) OR coalesce(rsi < lag(rsi) OVER w, false) OR coalesce((high - greatest(open, close)) / nullif(high - low, 0) >= 0.35, false) OR coalesce(close < ema, false) AS fading FROM i WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


def _faded(spark: SparkSession, d: str) -> DataFrame:
    x = _bars(spark, d, 60).withColumn("_ch", F.col("close") - C.back("close"))
    x = x.select("*", *(c.alias(k) for k, c in swing.swing_rsi(C, 14, "_ch").items()), swing.swing_ema(C, 9).alias("ema"))
    return x.withColumn("rsi_change", F.col("rsi") - C.back("rsi")).withColumn("fading", swing.fading(C, "rsi", "ema"))


@query("w12_swing_rsi", _FADE + " SELECT symbol, t, round(rsi, 6) AS rsi, round(rsi_change, 6) AS rsi_change FROM j")
def swing_rsi(spark: SparkSession, d: str) -> DataFrame:
    return _out(_faded(spark, d).select("symbol", "t", "rsi", "rsi_change", "_own", "_row", "_chunk"))


@query("w13_swing_ema", _FADE + " SELECT symbol, t, round(ema, 6) AS ema FROM j")
def swing_ema(spark: SparkSession, d: str) -> DataFrame:
    return _out(_faded(spark, d).select("symbol", "t", "ema", "_own", "_row", "_chunk"))


@query("w45_rebound_fading", _FADE + " SELECT symbol, t, fading FROM j")
def rebound_fading(spark: SparkSession, d: str) -> DataFrame:
    return _out(_faded(spark, d).select("symbol", "t", "fading", "_own", "_row", "_chunk"))


@query("w43_entry_screen", _FADE + """ SELECT symbol, t, concat_ws(',', CASE WHEN NOT coalesce(rsi < 50, false) THEN 'oversold' END, CASE WHEN NOT volume >= 2 THEN 'liquid' END, CASE WHEN NOT coalesce(taker_buy / nullif(quote_volume, 0) >= 0.3, false) THEN 'bought' END) AS failed FROM j""")
def entry_screen(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.functions.scalars import ratio

    x = features.own_rows(_faded(spark, d))
    s = swing.entry_screen({"oversold": F.col("rsi") < 50, "liquid": F.col("volume") >= 2, "bought": ratio(F.col("taker_buy"), F.col("quote_volume")) >= 0.3})
    return x.select("symbol", "t", F.array_join(s["failed"], ",").alias("failed"))


@query("w44_lookahead_reach", B + """ SELECT symbol, t, coalesce(max(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 FOLLOWING AND 12 FOLLOWING) >= close * 1.5, false) AS reached FROM b""")
def lookahead_reach(spark: SparkSession, d: str) -> DataFrame:
    return tables.candles(spark, d).select("symbol", "t", swing.lookahead_reach(S, 2, 12, 0.5).alias("reached"))


_ENTRIES = _FADE + """, e AS (SELECT symbol, n AS entry_n, close AS entry FROM j WHERE rsi < 50)"""
_MOVES = "round(coalesce(greatest(0, max(high) FILTER (n > entry_n) / any_value(entry) - 1), 0), 6) AS best, round(coalesce(least(0, min(low) FILTER (n > entry_n) / any_value(entry) - 1), 0), 6) AS worst"


@query("w46_swing_exit", _ENTRIES + f""", x AS (SELECT e.*, j.n, j.high, j.low, j.close, j.n - entry_n >= 2 AND j.close / entry - 1 >= 0.2 AND j.fading AS hit FROM e JOIN j ON j.symbol = e.symbol AND j.n BETWEEN e.entry_n AND e.entry_n + 24),
h AS (SELECT *, min(CASE WHEN hit THEN n END) OVER (PARTITION BY symbol, entry_n) AS hn FROM x), k AS (SELECT * FROM h WHERE hn IS NULL OR n <= hn)
SELECT symbol, entry_n, max(n) AS exit_n, CASE WHEN max(hn) IS NOT NULL THEN 'profit_fade' ELSE 'time_stop' END AS reason, round(arg_max(close, n) / any_value(entry) - 1, 6) AS return_share, {_MOVES} FROM k GROUP BY symbol, entry_n""")
def swing_exit(spark: SparkSession, d: str) -> DataFrame:
    x = features.own_rows(_faded(spark, d))
    entries = x.where("rsi < 50").select("symbol", F.col("_row").alias("entry_n"), F.col("close").alias("entry"))
    return rounded(swing.swing_exit(entries, x, "_row", 0.2, 2, 24).select("symbol", "entry_n", "exit_n", "reason", "return_share", "best", "worst"))


@query("w46_profit_exit", _ENTRIES + f""", x AS (SELECT e.*, j.n, j.high, j.low, j.close, CASE WHEN j.n - entry_n >= 2 AND j.close / entry - 1 >= 0.6 AND j.fading THEN 'profit_fade' WHEN j.n - entry_n >= 24 AND j.close / entry - 1 >= 0.05 AND j.fading THEN 'profitable_time_fade' END AS hit FROM e JOIN j ON j.symbol = e.symbol AND j.n >= e.entry_n),
h AS (SELECT *, min(CASE WHEN hit IS NOT NULL THEN n END) OVER (PARTITION BY symbol, entry_n) AS hn FROM x), k AS (SELECT * FROM h WHERE hn IS NULL OR n <= hn)
SELECT symbol, entry_n, max(n) AS exit_n, coalesce(arg_max(hit, n) FILTER (n = hn), 'open_unrealized') AS reason, CASE WHEN max(hn) IS NULL THEN 'open' ELSE 'closed' END AS status, round(arg_max(close, n) / any_value(entry) - 1, 6) AS return_share, {_MOVES} FROM k GROUP BY symbol, entry_n""")
def profit_exit(spark: SparkSession, d: str) -> DataFrame:
    """The same entries, sold with a profit only."""
    x = features.own_rows(_faded(spark, d)).withColumn("enters", F.coalesce(F.col("rsi") < 50, F.lit(False)))
    out = folds.profit_exits(x, 0.6, 0.05, 2, 24, number="_row")
    return rounded(out.select("symbol", "entry_n", "exit_n", "reason", "status", "return_share", "best", "worst"))


@query("w47_market_guard", CANDLES + """, d AS (SELECT symbol, t // 86400 AS day, arg_max(close, candles.t) AS close FROM candles GROUP BY 1, 2), s AS (SELECT symbol, arg_min(close, day) AS b FROM d GROUP BY 1), i AS (SELECT day, avg(close / nullif(b, 0)) AS v FROM d JOIN s USING (symbol) GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS n FROM i), u AS (SELECT a.n, avg(CAST(x.close > y.close AS DOUBLE)) AS rising FROM n a JOIN n p ON p.n = a.n - 3 JOIN d x ON x.day = a.day JOIN d y ON y.day = p.day AND y.symbol = x.symbol GROUP BY 1),
g AS (SELECT n.*, CASE WHEN n.n >= 10 THEN v / nullif(min(v) OVER (ORDER BY n.n ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 0) - 1 END AS bounce, v / nullif(lag(v, 3) OVER (ORDER BY n.n), 0) - 1 AS r, rising, v / nullif(lag(v, 7) OVER (ORDER BY n.n), 0) - 1 AS tr FROM n LEFT JOIN u ON u.n = n.n)
SELECT day, round(bounce, 6) AS bounce, round(r, 6) AS recent_return, round(rising, 6) AS rising, round(tr, 6) AS trend_return, coalesce(n >= 10 AND bounce >= 0.1 AND r >= 0 AND rising >= 0.4 AND tr >= -0.5, false) AS open FROM g""")
def market_guard(spark: SparkSession, d: str) -> DataFrame:
    """Over days, one row a day: the index is a small table."""
    days = tables.candles(spark, d).groupBy("symbol", F.expr("t div 86400").alias("day")).agg(F.max_by("close", "t").alias("close"))
    closes = days.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("closes"))
    index = basket_index(days, "symbol", "day", "close").select("day", "index").join(closes, "day")
    return rounded(swing.market_guard(index, "day", "index", 10, 0.1, 3, 0.0, 0.4, 7, -0.5, "closes").drop("index", "closes"))


# Models --------------------------------------------------------------------------------------------------------------


@query("m02_standardised", f"""{T}, m AS (SELECT avg(CASE WHEN hour > 3 THEN size END) AS m FROM trades), x AS (SELECT id, exit_t, coalesce(CASE WHEN hour > 3 THEN size END, m) AS v FROM trades, m), s AS (SELECT avg(v) AS a, stddev_pop(v) AS s FROM x) SELECT id, exit_t, round((v - a) / s, 6) AS z FROM x, s""")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("v", F.when(F.col("hour") > 3, F.col("size")))
    return rounded(models.standardise(t, ["v"]).select("id", "exit_t", F.col("v").alias("z")))


_VARIANTS = f"""{T}, v AS (SELECT variant, decision_t >= 878000000 AS oos, net_r * CASE variant WHEN 'risk_controlled' THEN 0.5 ELSE 1 END AS r FROM trades CROSS JOIN (VALUES ('no_trade'), ('rule_only'), ('confident'), ('risk_controlled')) x(variant)
WHERE CASE variant WHEN 'no_trade' THEN false WHEN 'rule_only' THEN true WHEN 'confident' THEN confidence >= 0.5 ELSE hour < 20 END)"""


@query("m07_variant_matrix", _VARIANTS + """ SELECT x.variant, p.part, count(v.r) AS trades, round(avg(v.r), 6) AS mean_r FROM (VALUES ('no_trade'), ('rule_only'), ('confident'), ('risk_controlled')) x(variant) CROSS JOIN (VALUES ('all'), ('oos')) p(part) LEFT JOIN v ON v.variant = x.variant AND (p.part = 'all' OR v.oos) GROUP BY 1, 2""")
def variant_matrix(spark: SparkSession, d: str) -> DataFrame:
    ok = {"no_trade": F.lit(False), "rule_only": F.lit(True), "confident": F.col("confidence") >= 0.5, "risk_controlled": F.col("hour") < 20}
    r = {k: F.col("net_r") * (0.5 if k == "risk_controlled" else 1.0) for k in ok}
    return rounded(models.variant_matrix(tables.trades(spark, d), ok, r, {"all": F.lit(True), "oos": F.col("decision_t") >= 878000000}))


_IMPORTANCE = f"""{T}, m AS (SELECT avg(size) AS a1, stddev_pop(size) AS s1, avg(confidence) AS a2, stddev_pop(confidence) AS s2, avg(hour) AS a3, stddev_pop(hour) AS s3, corr(size, net_r) AS c1, corr(confidence, net_r) AS c2, corr(hour, net_r) AS c3 FROM trades)"""


@query("m08_feature_importance", _IMPORTANCE + """ SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY round(importance, 6) DESC, feature) AS INT) AS rank FROM (SELECT 'size' AS feature, abs(c1) AS importance FROM m UNION ALL SELECT 'confidence', abs(c2) FROM m UNION ALL SELECT 'hour', abs(c3) FROM m)""")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    return models.importance(tables.trades(spark, d), ["size", "confidence", "hour"], "net_r")


@query("o04_top_importance", _IMPORTANCE + """ SELECT feature, round(importance, 6) AS importance FROM (SELECT 'size' AS feature, abs(c1) AS importance FROM m UNION ALL SELECT 'confidence', abs(c2) FROM m UNION ALL SELECT 'hour', abs(c3) FROM m) ORDER BY round(importance, 6) DESC, feature LIMIT 2""")
def top_importance(spark: SparkSession, d: str) -> DataFrame:
    """The most important features; the limit is the feature."""
    return models.importance(tables.trades(spark, d), ["size", "confidence", "hour"], "net_r").where("rank <= 2").drop("rank")


@query("m05_score_probability", f"""{T} SELECT id, exit_t, CASE WHEN hour <= 3 THEN NULL ELSE round(0.02 * size - 0.5 * confidence + 0.1, 6) END AS expected_r, CASE WHEN hour <= 3 THEN NULL ELSE round(1 / (1 + exp(-(0.02 * size - 0.5 * confidence + 0.1))), 6) END AS probability, CASE WHEN hour <= 3 THEN 'size' ELSE '' END AS missing FROM trades""")
def score_probability(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("size", F.when(F.col("hour") > 3, F.col("size")))
    return rounded(models.scored(t, {"size": 0.02, "confidence": -0.5, "intercept": 0.1}).select("id", "exit_t", "expected_r", "probability", F.array_join("missing", ",").alias("missing")))


@query("m14_random_benchmarks", f"""{T}, x AS (SELECT DISTINCT id, net_r FROM trades), s AS (SELECT id, net_r, seed, md5(id || ':' || seed) AS h FROM x CROSS JOIN (SELECT unnest(range(20)) AS seed)) SELECT seed, count(*) AS entries, round(avg(net_r), 6) AS mean_r FROM s WHERE h < '1' GROUP BY 1""")
def random_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    """Random entries of 20 seeds: each takes a sixteenth of all rows by hash, so that no sort is needed."""
    t = tables.trades(spark, d).select("id", "net_r").distinct()
    return rounded(models.random_entries(t, "id", "net_r", 20, "1"))


@query("m16_leaderboard", f"""{T}, g AS (SELECT symbol || side AS model, max(decision_t) AS created_at, count(*) AS trades, round(avg(net_r), 6) AS mean_r FROM trades GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY created_at, model) AS INT) AS place FROM g""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """One row a model: a small table in order of creation."""
    g = tables.trades(spark, d).groupBy(F.concat("symbol", "side").alias("model")).agg(F.max("decision_t").alias("created_at"), F.count("*").alias("trades"), F.round(F.avg("net_r"), 6).alias("mean_r"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("created_at", "model")))


@query("m17_model_artifacts", f"""{T}, g AS (SELECT symbol AS model, round(avg(net_r), 6) AS weight FROM trades GROUP BY 1) SELECT model, weight, sha256('{{"model":"' || model || '","weight":' || weight || '}}') AS digest, model <> 'N' AS intact FROM g""")
def model_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients with their digest; one row was changed after it was signed and is told."""
    g = tables.trades(spark, d).groupBy(F.col("symbol").alias("model")).agg(F.round(F.avg("net_r"), 6).alias("weight"))
    signed = models.sign(g, ["model", "weight"])
    changed = signed.withColumn("weight", F.when(F.col("model") == "N", F.col("weight") + 1).otherwise(F.col("weight")))
    told = models.checked(changed, ["model", "weight"], "intact")
    return told.select("model", F.when(F.col("model") == "N", F.round(F.col("weight") - 1, 6)).otherwise(F.col("weight")).alias("weight"), "digest", "intact")


@query("m10_boosted_filter")
def boosted_filter(spark: SparkSession, d: str) -> DataFrame:
    """A small boosted filter of trades, trained before a time and scored after it."""
    t = tables.trades(spark, d).withColumn("label", (F.col("net_r") > 0).cast("double"))
    return rounded(models.boosted(t.where("decision_t < 878000000"), t.where("decision_t >= 878000000"), ["size", "confidence", "hour"], "label", 3, 5).select("id", "exit_t", "probability"))

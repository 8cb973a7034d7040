"""Queries of setups, candidates, signals and ledgers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions import scalars
from tideframe.operators import features, labels, predicates, quality, ranking, setups
from tideframe.plans.market import CANDLES, S, query, rounded
from tideframe.sources import tables
from tideframe.sources.tables import TICKS_SQL, TRADES_SQL

T = f"WITH {TRADES_SQL}"
N = 20

# Features of the rules, as SQL.
_FEATURES = CANDLES + f""", b AS (SELECT *, row_number() OVER w - 1 AS n, lag(close) OVER w AS prev, close - lag(close) OVER w AS ch FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t)),
r AS (SELECT *, coalesce(greatest(high - low, abs(high - prev), abs(low - prev)), high - low) AS tr FROM b),
f AS (SELECT symbol, t, n, open, high, low, close, close / nullif(prev, 0) - 1 AS return_1,
 CASE WHEN count(*) OVER p = {N} THEN max(high) OVER p END AS donchian_high, CASE WHEN count(*) OVER p = {N} THEN min(low) OVER p END AS donchian_low,
 CASE WHEN count(*) OVER q = {N} THEN avg(tr) OVER q END AS atr, CASE WHEN count(*) OVER q = {N} THEN avg(close) OVER q END AS ma,
 (CASE WHEN count(*) OVER q = {N} THEN avg(close) OVER q END) / (CASE WHEN count(*) OVER p = {N} THEN avg(close) OVER p END) - 1 AS ma_slope,
 CASE WHEN count(*) OVER q = {N} THEN (close - min(low) OVER q) / nullif(max(high) OVER q - min(low) OVER q, 0) END AS range_position,
 CASE WHEN count(ch) OVER k = {N - 1} THEN sum(greatest(ch, 0)) OVER k END AS gain, CASE WHEN count(ch) OVER k = {N - 1} THEN sum(greatest(-ch, 0)) OVER k END AS loss
 FROM r WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW),
 k AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 2} PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN gain IS NULL THEN NULL WHEN gain = 0 AND loss = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi FROM f)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    bars = features.in_chunks(tables.candles(spark, d), S, 3 * N)
    x = features.core_features(bars, N, features.CHUNKED)
    x = x.select("*", *(c.alias(k) for k, c in features.donchian(features.CHUNKED, N).items()))
    return features.own_rows(x).withColumnRenamed("_row", "n")


@query("p14_rule_setups", _FEATURES + """, u AS (SELECT symbol, t, close, atr, 'breakout' AS family, 'long' AS side FROM x WHERE close > donchian_high UNION ALL SELECT symbol, t, close, atr, 'breakout', 'short' FROM x WHERE close < donchian_low
UNION ALL SELECT symbol, t, close, atr, 'reversion', 'long' FROM x WHERE rsi < 45 UNION ALL SELECT symbol, t, close, atr, 'reversion', 'short' FROM x WHERE rsi > 55)
SELECT symbol, t, family, side, round(CASE side WHEN 'long' THEN close - 1.5 * atr ELSE close + 1.5 * atr END, 6) AS stop, round(CASE side WHEN 'long' THEN close + 3 * atr ELSE close - 3 * atr END, 6) AS target FROM u WHERE atr > 0""")
def rule_setups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(setups.rule_setups(_features(spark, d), 1.5, 3.0, 45, 55).select("symbol", "t", "family", "side", "stop", "target"))


@query("p15_all_bar_setups", _FEATURES + """ SELECT symbol, t, side, round(CASE side WHEN 'long' THEN close - 1.5 * atr ELSE close + 1.5 * atr END, 6) AS stop, round(CASE side WHEN 'long' THEN close + 3 * atr ELSE close - 3 * atr END, 6) AS target
FROM x CROSS JOIN (SELECT unnest(['long', 'short']) AS side) WHERE atr > 0 AND n % 3 = 0""")
def all_bar_setups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(setups.all_bar_setups(_features(spark, d), "n", 3).select("symbol", "t", "side", "stop", "target"))


@query("p16_trend_pullback", _FEATURES + """ SELECT symbol, t, round(1 - range_position, 6) AS score FROM x WHERE close > ma AND ma_slope > 0 AND return_1 <= 0.5 AND range_position <= 0.8""")
def trend_pullback(spark: SparkSession, d: str) -> DataFrame:
    return rounded(setups.trend_pullback(_features(spark, d), 0.5, 0.8).select("symbol", "t", "score"))


@query("j26_setup_context", _FEATURES + """ SELECT symbol, t, 'long' AS side, round(range_position, 6) AS range_position, round(rsi, 6) AS rsi FROM x WHERE close > donchian_high AND atr > 0
UNION ALL SELECT symbol, t, 'short', round(range_position, 6), round(rsi, 6) FROM x WHERE close < donchian_low AND atr > 0""")
def setup_context(spark: SparkSession, d: str) -> DataFrame:
    """Setups with the whole feature row of their bar: features are carried through, no join."""
    x = setups.rule_setups(_features(spark, d)).where("family = 'breakout'")
    return rounded(x.select("symbol", "t", "side", "range_position", "rsi"))


@query("p01_symbol_filter", f"{T} SELECT id, symbol FROM trades WHERE upper(symbol) IN ('A', 'R')")
def symbol_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.trades(spark, d).where(predicates.symbols_in("symbol", ["a", "r"])).where(predicates.symbols_in("symbol", [])).select("id", "symbol")


@query("p02_predicate_list", f"{T} SELECT id FROM trades WHERE net_r > 0.2 AND confidence <= 0.6 AND side <> 'short' AND hour >= 6 AND hour < 20 AND size != 10")
def predicate_list(spark: SparkSession, d: str) -> DataFrame:
    c = predicates.Condition
    return tables.trades(spark, d).where(predicates.all_of([c("net_r", ">", 0.2), c("confidence", "<=", 0.6), c("side", "!=", "short"), c("hour", ">=", 6), c("hour", "<", 20), c("size", "!=", 10.0)])).select("id")


@query("p03_candidate_rows", f"""{T} SELECT symbol, decision_t, min(id) AS id FROM trades WHERE net_r IS NOT NULL AND confidence >= 0.3 AND symbol IN ('A', 'N') GROUP BY 1, 2""")
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).where(predicates.symbols_in("symbol", ["A", "N"]))
    return predicates.candidates(t, "net_r", [predicates.Condition("confidence", ">=", 0.3)], ["symbol", "decision_t"], ["id"]).select("symbol", "decision_t", "id")


@query("p06_session_bucket", "SELECT event_id, CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'europe' ELSE 'us' END AS session FROM events WHERE hour(ts) >= 8")
def session_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("event_id", scalars.session_of(F.hour("ts")).alias("session"))
    return e.where(predicates.symbols_in("session", ["europe", "us"]))


@query("p07_scenario_gate", f"""{T}, r AS (SELECT id, symbol, net_r, confidence, CAST(row_number() OVER (PARTITION BY decision_t ORDER BY confidence DESC, id, net_r, exit_t) AS INT) AS rank FROM trades)
SELECT 'strict' AS scenario, id, rank FROM r WHERE rank <= 2 AND net_r >= 0.2 AND confidence >= 0.5 UNION ALL SELECT 'symbols', id, rank FROM r WHERE symbol IN ('A') UNION ALL SELECT 'all', id, rank FROM r""")
def scenario_gate(spark: SparkSession, d: str) -> DataFrame:
    # Ties that the SQL leaves open go by what else a row has, so that ranks don't depend on the order of rows.
    w = Window.partitionBy("decision_t").orderBy(F.desc("confidence"), "id", "net_r", "exit_t", F.desc("symbol"), "side", "size", "hour", "notional")
    t = tables.trades(spark, d).select("id", "symbol", F.col("net_r").alias("expected_r"), F.col("confidence").alias("probability"), F.row_number().over(w).alias("rank"))
    scenarios = {"strict": {"max_rank": 2, "min_expected_r": 0.2, "min_probability": 0.5}, "symbols": {"symbols": ["A"]}, "all": {}}
    passed = F.array_compact(F.array(*(F.when(setups.scenario_gate(t, s), F.lit(k)) for k, s in scenarios.items())))
    return t.select(F.explode(passed).alias("scenario"), "id", "rank")


@query("p09_warmup_exclusion", _FEATURES + " SELECT symbol, t FROM x WHERE return_1 IS NOT NULL AND ma IS NOT NULL AND atr IS NOT NULL AND range_position IS NOT NULL")
def warmup_exclusion(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d).withColumn("never", F.lit(None).cast("double"))
    return setups.usable_rows(x, "return_1", ["ma", "atr", "range_position", "never"]).select("symbol", "t")


@query("p10_numeric_features", "SELECT unnest(['c_acctbal', 'c_nationkey']) AS feature, (SELECT count(*) FROM customer) AS rows")
def numeric_features(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "customer")
    names = setups.numeric_features(c, ["c_custkey"])
    return c.agg(F.count("*").alias("rows")).select(F.explode(F.array(*map(F.lit, names))).alias("feature"), "rows")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    x = labels.barrier_labels(tables.candles(spark, d), 12, 0.5, 1.0, 0.01)
    return x.select("symbol", "t", "target_before_stop", F.col("realized_r"), "mae_r")


# R of the fixed barriers: 2 at the target, -1 at the stop, else the move; less costs.
_LABELS = CANDLES + """, j AS (SELECT c.symbol, c.t, c.close, row_number() OVER (PARTITION BY c.symbol ORDER BY c.t) AS n FROM candles c), p AS (SELECT j.*, o.high, o.low, o.close AS fc, row_number() OVER (PARTITION BY o.symbol ORDER BY o.t) AS rn FROM j JOIN candles o USING (symbol, t)),
h AS (SELECT a.symbol, a.t, a.close, count(*) AS k, min(CASE WHEN b.high >= a.close * 2 THEN b.n - a.n END) AS tt, min(CASE WHEN b.low <= a.close * 0.5 THEN b.n - a.n END) AS ts, min(b.low) AS worst, arg_max(b.close, b.n) AS last
 FROM p a JOIN p b ON a.symbol = b.symbol AND b.n BETWEEN a.n + 1 AND a.n + 12 GROUP BY 1, 2, 3),
l AS (SELECT symbol, t, CASE WHEN tt IS NULL AND ts IS NULL THEN NULL WHEN ts IS NULL THEN true WHEN tt IS NULL THEN false ELSE tt < ts END AS first, (worst - close) / nullif(close - close * 0.5, 0) AS mae, (last / nullif(close, 0) - 1) AS fwd FROM h WHERE k = 12),
y AS (SELECT symbol, t, first, mae, CASE WHEN first THEN 2 WHEN NOT first THEN -1 ELSE fwd / 0.5 END - 0.02 AS r FROM l)"""


@query("p17_training_target", _LABELS + " SELECT symbol, t, CASE WHEN r IS NULL THEN NULL ELSE CAST(coalesce(first, false) AS INT) END AS target_first, CASE WHEN r IS NULL THEN NULL ELSE CAST(r >= 0.3 AS INT) END AS min_r, CASE WHEN r IS NULL THEN NULL ELSE CAST(coalesce(first AND r >= 0.3 AND mae >= -0.9, false) AS INT) END AS clean FROM y")
def training_target(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).where("mae_r is not null")
    return x.select("symbol", "t", *(setups.training_target(m, 0.3, -0.9).alias(m) for m in ("target_first", "min_r", "clean")))


@query("p18_reason_codes", f"""{T} SELECT id, concat_ws(',', CASE WHEN net_r < 0 THEN 'expected_r_below_threshold' END, CASE WHEN confidence < 0.4 THEN 'probability_below_threshold' END, CASE WHEN hour < 6 THEN 'session_closed' END) AS reasons,
concat_ws(',', CASE WHEN size > 45 THEN 'size_limit' END) AS hard_blocks FROM trades""")
def reason_codes(spark: SparkSession, d: str) -> DataFrame:
    why = setups.reasons({"expected_r_below_threshold": F.col("net_r") < 0, "probability_below_threshold": F.col("confidence") < 0.4, "session_closed": F.col("hour") < 6})
    hard = setups.reasons({"size_limit": F.col("size") > 45})
    return tables.trades(spark, d).select("id", F.array_join(why, ",").alias("reasons"), F.array_join(hard, ",").alias("hard_blocks"))


_ESTIMATES = "e AS (SELECT p_partkey, round(p_size / 50.0, 2) AS probability, round((p_size - 20) / 30.0, 4) AS expected_r, round((50 - p_size) / 60.0, 4) AS stop_out FROM part WHERE p_partkey % 3 > 0)"
_CANDIDATES = "c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey FROM lineitem)"


def _estimated(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("p_size") / 50.0, 2).alias("probability"), F.round((F.col("p_size") - 20) / 30.0, 4).alias("expected_r"), F.round((50 - F.col("p_size")) / 60.0, 4).alias("stop_out"))
    return tables.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey").join(e, "l_partkey", "left")


@query("p19_rejection_reason", f"WITH {_ESTIMATES}, {_CANDIDATES} SELECT id, CASE WHEN probability IS NULL THEN 'missing_estimate' WHEN probability < 0.3 THEN 'probability' WHEN expected_r < 0 THEN 'expected_r' WHEN stop_out > 0.4 THEN 'stop_out_risk' END AS reason FROM c LEFT JOIN e ON p_partkey = l_partkey")
def rejection_reason(spark: SparkSession, d: str) -> DataFrame:
    checks = {"missing_estimate": F.col("probability").isNull(), "probability": F.col("probability") < 0.3, "expected_r": F.col("expected_r") < 0, "stop_out_risk": F.col("stop_out") > 0.4}
    return _estimated(spark, d).select("id", setups.first_failing(checks).alias("reason"))


@query("j19_estimate_anti", f"WITH {_ESTIMATES}, {_CANDIDATES} SELECT id, 'missing_estimate' AS reason FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE p_partkey = l_partkey)")
def estimate_anti(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("l_partkey"))
    c = tables.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey")
    return c.join(e, "l_partkey", "left_anti").select("id", F.lit("missing_estimate").alias("reason"))


@query("p20_categorical_flags", f"{T} SELECT id, CAST(symbol = 'A' AS INT) AS symbol_A, CAST(symbol = 'N' AS INT) AS symbol_N, CAST(hour < 8 AS INT) AS session_asia, CAST(hour >= 8 AND hour < 16 AS INT) AS session_europe, CAST(hour >= 16 AS INT) AS session_us FROM trades")
def categorical_flags(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).withColumn("session", scalars.session_of(F.col("hour")))
    return t.select("id", *setups.flags("symbol", ["A", "N"], "symbol"), *setups.flags("session", ["asia", "europe", "us"], "session"))


@query("p21_calendar_features", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events")
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))


@query("p22_data_contract", "SELECT unnest(['close', 'high', 'low', 'open', 'volume']) AS feature, 'signal_time' AS availability, (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_type, epoch_us(ts) // 3600000000)) AS rows")
def data_contract(spark: SparkSession, d: str) -> DataFrame:
    """Columns that may feed features by their availability class; after-the-fact ones may not."""
    classes = {c: "signal_time" for c in ("open", "high", "low", "close", "volume")} | {"outcome": "after_exit"}
    bars = quality.with_availability(tables.candles(spark, d).withColumn("outcome", F.lit(0.0)), classes)
    usable = quality.feature_columns(bars)
    return bars.agg(F.count("*").alias("rows")).select(F.explode(F.array(*map(F.lit, usable))).alias("feature"), F.lit("signal_time").alias("availability"), "rows")


_SCORED = f"{T}, s AS (SELECT id, symbol, decision_t, net_r AS expected_r, confidence AS probability, decision_t + hour * 60 AS now FROM trades)"
_SIGNALS = _SCORED + """, g AS (SELECT *, concat_ws(',', CASE WHEN expected_r < 0.2 THEN 'expected_r_below_threshold' END, CASE WHEN probability < 0.3 THEN 'probability_below_threshold' END, CASE WHEN now - decision_t > 1200 THEN 'stale' END) AS reasons, now - decision_t AS freshness_s,
symbol || ':' || decision_t || ':' || id AS request_id FROM s)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d).select("id", "symbol", "decision_t", F.col("net_r").alias("expected_r"), F.col("confidence").alias("probability"), (F.col("decision_t") + F.col("hour") * 60).alias("now"))
    return setups.signals(t, "now", 0.2, 0.3, 1200)


@query("p24_signal_rows", _SIGNALS + " SELECT id, request_id, freshness_s, reasons, CASE WHEN reasons = '' THEN 'take' ELSE 'skip' END AS action FROM g")
def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("id", "request_id", "freshness_s", F.array_join("reason_codes", ",").alias("reasons"), "action")


@query("j20_skipped_signals", _SIGNALS + " SELECT id, expected_r FROM g WHERE contains(reasons, 'expected_r_below_threshold')")
def skipped_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).where((F.col("action") == "skip") & F.array_contains("reason_codes", "expected_r_below_threshold")).select("id", "expected_r")


_OUTCOMES = "o AS (SELECT o_orderkey, round(o_totalprice / 100000 - 2, 8) AS realized_r, CASE o_orderstatus WHEN 'F' THEN 'target' WHEN 'P' THEN 'stop' END AS exit_reason FROM orders WHERE o_orderstatus <> 'O')"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders").where("o_orderstatus <> 'O'")
    return o.select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") / 100000 - 2, 8).alias("realized_r"), F.when(F.col("o_orderstatus") == "F", "target").when(F.col("o_orderstatus") == "P", "stop").alias("exit_reason"))


@query("p25_ledger_rows", _SIGNALS + f", {_OUTCOMES} SELECT id, CASE WHEN realized_r IS NULL THEN 'open' ELSE 'closed' END AS status, CASE WHEN realized_r IS NOT NULL THEN coalesce(exit_reason, 'label') END AS exit_reason, realized_r FROM g LEFT JOIN o ON o_orderkey = id // 10 WHERE reasons = ''")
def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d).withColumn("k", F.expr("id div 10"))
    return setups.ledger(s, _outcomes(spark, d), ["k"]).select("id", "status", "exit_reason", "realized_r")


@query("p26_trade_rows", _SCORED + f", {_OUTCOMES} SELECT id, realized_r, CASE WHEN expected_r IS NOT NULL THEN least(1.0, greatest(0.01, expected_r)) END AS confidence FROM s LEFT JOIN o ON o_orderkey = id // 10 WHERE expected_r >= 0.2")
def trade_rows(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d).where("expected_r >= 0.2").withColumn("k", F.expr("id div 10"))
    return setups.trade_rows(s, _outcomes(spark, d), ["k"]).select("id", "realized_r", "confidence")


@query("j21_short_legs", CANDLES + """, r AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS rank, count(*) OVER (PARTITION BY t) AS size FROM candles)
SELECT symbol, t, 'long' AS side FROM r WHERE rank <= 1 UNION ALL SELECT symbol, t, 'short' FROM r WHERE rank > size - 1""")
def short_legs(spark: SparkSession, d: str) -> DataFrame:
    c = tables.candles(spark, d)
    at = Window.partitionBy("t")
    ranked = c.select("symbol", "t", F.lit("long").alias("side"), F.row_number().over(at.orderBy(F.desc("close"), "symbol")).alias("rank"), F.count("*").over(at).alias("size"))
    return setups.short_legs(ranked, c.select("symbol", "t", F.lit("short").alias("side")), 1)


@query("o08_group_sample")
def group_sample(spark: SparkSession, d: str) -> DataFrame:
    return setups.per_group_sample(tables.trades(spark, d).select("symbol", "id", "decision_t", "exit_t"), ["symbol"], 100, 7, "id", "decision_t", "exit_t")


@query("o02_rank_tie_sort", f"""{T} SELECT id, CAST(row_number() OVER (PARTITION BY decision_t ORDER BY net_r DESC, symbol DESC, id DESC, exit_t DESC) AS INT) AS rank FROM trades""")
def rank_tie_sort(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("decision_t").orderBy(F.desc("net_r"), F.desc("symbol"), F.desc("id"), F.desc("exit_t"))
    return tables.trades(spark, d).select("id", F.row_number().over(w).alias("rank"))


@query("o03_max_candidates", f"{T} SELECT symbol, decision_t, id FROM trades WHERE net_r > 0 ORDER BY symbol, decision_t, id LIMIT 500")
def max_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the first candidates in order, as TakeOrderedAndProject."""
    return tables.trades(spark, d).where("net_r > 0").select("symbol", "decision_t", "id").orderBy("symbol", "decision_t", "id").limit(500)


@query("w56_score_and_rank", f"""{T}, s AS (SELECT id, decision_t, symbol, round(0.4 * net_r + 0.1, 4) AS expected_r, confidence AS probability FROM trades),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY decision_t ORDER BY expected_r DESC, symbol DESC, id) AS INT) AS rank FROM s)
SELECT id, rank, expected_r, rank <= 3 AS in_top, expected_r >= 0.2 AS over, rank <= 3 AND expected_r >= 0.2 AS take FROM r""")
def score_and_rank(spark: SparkSession, d: str) -> DataFrame:
    s = tables.trades(spark, d).select("id", "decision_t", "symbol", F.round(0.4 * F.col("net_r") + 0.1, 4).alias("expected_r"), "confidence")
    w = Window.partitionBy("decision_t").orderBy(F.desc("expected_r"), F.desc("symbol"), "id")
    x = s.withColumn("rank", F.row_number().over(w))
    return x.select("id", "rank", "expected_r", (F.col("rank") <= 3).alias("in_top"), (F.col("expected_r") >= 0.2).alias("over"), ((F.col("rank") <= 3) & (F.col("expected_r") >= 0.2)).alias("take"))

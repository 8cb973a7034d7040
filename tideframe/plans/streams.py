"""Streaming queries, run once over the given tables; SQL where a batch query gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.plans.market import query
from tideframe.sources import tables
from tideframe.sources.tables import TICKS_SQL, candles_sql
from tideframe.streaming import streams as s


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return s.tick_stream(s.landed(spark, f"{d}/events.parquet"))


@query("t01_stream_bars", f"""WITH {TICKS_SQL}, b AS (SELECT symbol, t // 3600 * 3600 AS t, arg_min(price, us * 1000 + id % 1000) AS open, max(price) AS high, min(price) AS low, arg_max(price, us * 1000 + id % 1000) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2)
SELECT * FROM b WHERE t + 3600 <= (SELECT max(us) / 1000000 - 600 FROM ticks)""")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    return s.run_once(s.stream_bars(_ticks(spark, d)))


@query("t02_stream_dedup", "SELECT DISTINCT event_type AS symbol, user_id AS user FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    x = s.run_once(s.stream_dedup(_ticks(spark, d), ["symbol", "user"], late="365 days"))
    return x.select("symbol", "user")


@query("t03_stream_flow_windows", f"""WITH {TICKS_SQL}, b AS (SELECT symbol, t // 900 * 900 AS t, count(*) AS ticks, round(sum(CASE WHEN is_buyer THEN price ELSE 0 END), 6) AS buy, round(sum(CASE WHEN NOT is_buyer THEN price ELSE 0 END), 6) AS sell FROM ticks GROUP BY 1, 2)
SELECT *, round((buy - sell) / nullif(buy + sell, 0), 8) AS imbalance FROM b WHERE t + 900 <= (SELECT max(us) / 1000000 - 600 FROM ticks)""")
def stream_flow(spark: SparkSession, d: str) -> DataFrame:
    return s.run_once(s.stream_flow_windows(_ticks(spark, d)))


@query("t04_stream_union", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN value END AS view_price, CASE WHEN event_type = 'click' THEN value END AS click_price FROM events WHERE event_type IN ('view', 'click')")
def stream_union(spark: SparkSession, d: str) -> DataFrame:
    view = _ticks(spark, d).where("symbol = 'view'").select("id", F.col("price").alias("view_price"))
    click = _ticks(spark, d).where("symbol = 'click'").select("id", F.col("price").alias("click_price"))
    return s.run_once(s.stream_union(view, click))


@query("t06_stream_context", f"""WITH {TICKS_SQL}, p AS (SELECT symbol, t // 28800 AS bucket, round(avg(price), 6) AS rate FROM ticks GROUP BY 1, 2)
SELECT k.id, p.rate FROM ticks k LEFT JOIN p ON p.symbol = k.symbol AND p.bucket = k.t // 28800 - 1""")
def stream_context(spark: SparkSession, d: str) -> DataFrame:
    panel = tables.ticks(spark, d).groupBy("symbol", F.expr("t div 28800").alias("bucket")).agg(F.round(F.avg("price"), 6).alias("rate"))
    return s.run_once(s.stream_context(_ticks(spark, d), panel, ["symbol"], 28800).select("id", "rate"))


@query("t06_stream_asof", f"""WITH {TICKS_SQL}, v AS (SELECT * FROM ticks WHERE symbol = 'view'), x AS (SELECT v.id, v.us, arg_max(c.price, (c.us, c.price)) AS context, max(c.us) AS known FROM v JOIN ticks c ON c.symbol = 'click' AND c.us <= v.us AND c.us >= v.us - 14400000000 GROUP BY 1, 2)
SELECT id, context, (us - known) // 1000000 AS age_s FROM x WHERE us < (SELECT least(max(us) FILTER (symbol = 'view'), max(us) FILTER (symbol = 'click')) FROM ticks) - 600000000 - 14400000000""")
def stream_asof(spark: SparkSession, d: str) -> DataFrame:
    """The latest click known at each view, both as streams."""
    ticks = _ticks(spark, d).where("symbol IN ('view', 'click')")
    views = ticks.where("symbol = 'view'").select(F.lit("x").alias("k"), "id", "at")
    clicks = _ticks(spark, d).where("symbol = 'click'").select(F.lit("x").alias("k"), F.col("at").alias("known"), F.col("price").alias("context"))
    with s.rocksdb_state(spark):
        x = s.run_once(s.stream_asof(views, clicks, ["k"], "at", "known", ["context"], "id", "4 HOURS"))
    return x.select("id", "context", F.expr("(unix_micros(at) - unix_micros(known)) div 1000000").alias("age_s"))


@query("t08_stream_open_trades", f"""WITH {candles_sql(600, 'bars')}, e AS (SELECT symbol, id, us, CASE WHEN is_buyer THEN 1 ELSE -1 END AS g, price FROM ticks),
x AS (SELECT e.*, b.close_t, b.close, CASE WHEN g = 1 THEN b.low <= price * 0.5 ELSE b.high >= price * 1.5 END AS s, CASE WHEN g = 1 THEN b.high >= price * 2 ELSE b.low <= price * 0.25 END AS w, row_number() OVER (PARTITION BY e.symbol, e.id ORDER BY b.close_t) AS k FROM e JOIN bars b ON b.symbol = e.symbol AND b.close_t * 1000000 > us AND b.close_t * 1000000 <= us + 14400000000),
h AS (SELECT symbol, id, any_value(us) AS us, any_value(g) AS g, any_value(price) AS price, min(k) FILTER (s OR w) AS k, max(k) AS last FROM x GROUP BY 1, 2)
SELECT h.symbol, h.id, CASE WHEN h.k IS NULL THEN 'horizon_exit' WHEN x.s THEN 'stop' ELSE 'target' END AS reason, x.close_t * 1000 AS exit_ms, round(CASE WHEN h.k IS NULL THEN x.close WHEN x.s THEN CASE WHEN h.g = 1 THEN h.price * 0.5 ELSE h.price * 1.5 END ELSE CASE WHEN h.g = 1 THEN h.price * 2 ELSE h.price * 0.25 END END, 6) AS exit_price, coalesce(h.k, h.last) AS bars
FROM h JOIN x ON x.symbol = h.symbol AND x.id = h.id AND x.k = coalesce(h.k, h.last) WHERE h.k IS NOT NULL OR h.us // 1000 + 14400000 <= (SELECT least((SELECT max(us) // 1000 FROM ticks), (SELECT max(close_t) * 1000 FROM bars)) - 600000)""")
def stream_open_trades(spark: SparkSession, d: str) -> DataFrame:
    """Every tick as a trade, closed by ten-minute bars that land as files."""
    buy, price = F.col("user") % 2 == 0, F.col("price")
    trades = _ticks(spark, d).select("symbol", "id", "at", F.when(buy, "long").otherwise("short").alias("side"), (price * F.when(buy, 0.5).otherwise(1.5)).alias("stop_price"), (price * F.when(buy, 2.0).otherwise(0.25)).alias("target_price"))
    path = f"{s.shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    tables.candles(spark, d, 600).select("symbol", F.timestamp_seconds("close_t").alias("closed_at"), "high", "low", "close").write.parquet(path)
    with s.rocksdb_state(spark):
        x = s.run_once(s.stream_open_trades(trades, s.landed(spark, path), "4 HOURS"))
    return x.withColumn("exit_price", F.round("exit_price", 6))


@query("t09_stream_alerts", f"""WITH {TICKS_SQL}, x AS (SELECT symbol, id, price, round(price - lag(price) OVER (PARTITION BY symbol ORDER BY us, id), 6) AS change FROM ticks)
SELECT *, concat_ws(',', CASE WHEN price >= 200 THEN 'large' END, CASE WHEN abs(change) >= 250 THEN 'jump' END) AS reasons FROM x WHERE price >= 200 OR abs(change) >= 250""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    return s.stream_alerts(_ticks(spark, d), 200, 250)


@query("t10_stream_gaps", f"""WITH {TICKS_SQL}, x AS (SELECT symbol, us, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS before FROM ticks) SELECT symbol, round(before / 1000000.0, 3) AS since, round(us / 1000000.0, 3) AS until FROM x WHERE us - before > 7200000000""")
def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    return s.run_once(s.stream_gaps(_ticks(spark, d), 7200)).select("symbol", F.round("since", 3).alias("since"), F.round("until", 3).alias("until"))

"""Market-style views over the given tables, with their SQL.

events become candles (symbol := event_type, one bar an hour), a funding panel (8 hours) and trade ticks; orders become
daily closes; lineitem becomes trades with a result in R. Times are whole seconds since 1970 (bigint) in these views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, t (seconds), us (microseconds), id, price, qty, is_buyer, k: one row an event."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        seconds(F.col("ts")).alias("t"),
        micros(F.col("ts")).alias("us"),
        F.col("event_id").alias("id"),
        F.col("value").alias("price"),
        (F.col("user_id") % 7 + 1).cast("double").alias("qty"),
        (F.col("user_id") % 2 == 0).alias("is_buyer"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, epoch_us(ts) AS us, event_id AS id, value AS price,
         CAST(user_id % 7 + 1 AS DOUBLE) AS qty, user_id % 2 = 0 AS is_buyer, CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""


def candles(spark: SparkSession, sf_dir: str, seconds_per_bar: int = HOUR) -> DataFrame:
    """symbol, t (bar start), close_t, open, high, low, close, volume, quote_volume, taker_buy, trades."""
    from tideframe.operators.bars import resample

    return resample(ticks(spark, sf_dir), seconds_per_bar)


def candles_sql(seconds_per_bar: int = HOUR, name: str = "candles") -> str:
    n = seconds_per_bar
    return f"""{TICKS_SQL}, {name} AS (
  SELECT symbol, t // {n} * {n} AS t, t // {n} * {n} + {n} AS close_t, arg_min(price, us * 1000 + id % 1000) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, us * 1000 + id % 1000) AS close, count(*) AS volume, round(sum(price), 6) AS quote_volume,
         round(coalesce(sum(price) FILTER (is_buyer), 0), 6) AS taker_buy, count(*) AS trades
  FROM ticks GROUP BY 1, 2, 3)"""


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, funding_t, available_t, rate: mean signup value of 8 hours, known 5 minutes later, for all symbols."""
    e = ticks(spark, sf_dir).where("symbol = 'signup'")
    panel = e.groupBy(F.expr(f"(t div {8 * HOUR} + 1) * {8 * HOUR}").alias("funding_t")).agg(F.round(F.avg("price") / 1000 - 0.05, 6).alias("rate"))
    symbols = F.explode(F.array(*(F.lit(s) for s in ("click", "error", "purchase", "signup", "view"))))
    return panel.select(symbols.alias("symbol"), "funding_t", (F.col("funding_t") + 300).alias("available_t"), "rate")


FUNDING_SQL = """funding AS (
  SELECT s.symbol, funding_t, funding_t + 300 AS available_t, rate
  FROM (SELECT (t // 28800 + 1) * 28800 AS funding_t, round(avg(price) / 1000 - 0.05, 6) AS rate FROM ticks WHERE symbol = 'signup' GROUP BY 1) f
  CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS symbol) s)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, id, decision_t, exit_t, side, gross_r, net_r, confidence, session_hour: one row a lineitem."""
    x = read(spark, sf_dir, "lineitem")
    t = seconds(F.col("l_shipdate"))
    return x.select(
        F.col("l_returnflag").alias("symbol"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        t.alias("decision_t"),
        (t + F.col("l_linenumber") * 86400).alias("exit_t"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
        F.round((F.col("l_discount") - 0.05) * 20, 4).alias("net_r"),
        F.round(F.col("l_tax") * 10, 4).alias("confidence"),
        F.col("l_quantity").alias("size"),
        (F.col("l_partkey") % 24).cast("int").alias("hour"),
        F.col("l_extendedprice").alias("notional"),
    )


TRADES_SQL = """trades AS (
  SELECT l_returnflag AS symbol, l_orderkey * 10 + l_linenumber AS id, CAST(epoch(l_shipdate) AS BIGINT) AS decision_t,
         CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 86400 AS exit_t, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side,
         round((l_discount - 0.05) * 20, 4) AS net_r, round(l_tax * 10, 4) AS confidence, l_quantity AS size,
         CAST(l_partkey % 24 AS INT) AS hour, l_extendedprice AS notional
  FROM lineitem)"""


def daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, close: mean order price of a priority and day."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") + 1e-6, 2).alias("close"))


DAILY_SQL = """daily AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) + 1e-6, 2) AS close FROM orders GROUP BY 1, 2)"""

"""Queries of the scalar column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions import scalars
from tideframe.plans.market import CANDLES, query, rounded
from tideframe.sources import tables
from tideframe.sources.tables import TICKS_SQL, TRADES_SQL

T = f"WITH {TRADES_SQL}"
K = f"WITH {TICKS_SQL}"


@query("f01_trim_case", """SELECT c_custkey, lower(nullif(trim(seg), '')) AS segment, upper(nullif(trim(seg), '')) AS upper_segment, nullif(trim(seg), '') AS kept
FROM (SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN '   ' ELSE '  ' || c_mktsegment || ' ' END AS seg FROM customer)""")
def trim_case(spark: SparkSession, d: str) -> DataFrame:
    seg = F.when(F.col("c_nationkey") % 4 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return tables.read(spark, d, "customer").select("c_custkey", scalars.clean_text(seg, "lower").alias("segment"), scalars.clean_text(seg, "upper").alias("upper_segment"), scalars.clean_text(seg).alias("kept"))


_SYMBOL = "replace(upper(p_brand), '#', '') || CASE p_partkey % 4 WHEN 0 THEN 'USDT' WHEN 1 THEN 'BTC' WHEN 2 THEN 'ETH' ELSE 'XYZ' END"


@query("f02_quote_suffix", f"""SELECT p_partkey, regexp_replace(s, 'USDT$', '') AS base, CASE WHEN s LIKE '%USDT' THEN 'USDT' WHEN s LIKE '%BTC' THEN 'BTC' WHEN s LIKE '%ETH' THEN 'ETH' END AS quote
FROM (SELECT p_partkey, {_SYMBOL} AS s FROM part)""")
def quote_suffix(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    s = F.concat(F.regexp_replace(F.upper("p_brand"), "#", ""), F.when(n == 0, "USDT").when(n == 1, "BTC").when(n == 2, "ETH").otherwise("XYZ"))
    return tables.read(spark, d, "part").select("p_partkey", scalars.base_asset(s).alias("base"), scalars.quote_asset(s).alias("quote"))


@query("f04_rfc3339", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN s WHEN 1 THEN s - 7200 END AS seconds, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS text
FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)""")
def rfc3339(spark: SparkSession, d: str) -> DataFrame:
    """Texts with Z, with an offset, and naive ones, which are rejected."""
    at = F.timestamp_seconds(tables.seconds(F.col("ts")))
    text = scalars.rfc3339_text(at)
    n = F.col("event_id") % 3
    given = F.when(n == 0, text).when(n == 1, F.regexp_replace(text, "Z$", "+02:00")).otherwise(F.regexp_replace(text, "Z$", ""))
    return tables.read(spark, d, "events").select("event_id", F.unix_seconds(scalars.rfc3339(given)).alias("seconds"), text.alias("text"))


@query("f05_epochs", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS from_us, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS from_ms FROM events")
def epochs(spark: SparkSession, d: str) -> DataFrame:
    us = tables.micros(F.col("ts"))
    return tables.read(spark, d, "events").select("event_id", F.unix_seconds(scalars.from_epoch(us)).alias("from_us"), F.unix_seconds(scalars.from_epoch(F.floor(us / 1000))).alias("from_ms"))


@query("f06_calendar_keys", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders""")
def calendar_keys(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return tables.read(spark, d, "orders").select("o_orderkey", *(c.alias(k) for k, c in scalars.calendar_keys(at).items()))


@query("f07_time_differences", f"{T} SELECT id, (exit_t - decision_t) / 3600.0 AS hours, (exit_t - decision_t) / 60.0 AS minutes, CAST(exit_t - decision_t AS DOUBLE) AS seconds FROM trades")
def time_differences(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.timestamp_seconds("exit_t"), F.timestamp_seconds("decision_t")
    return tables.trades(spark, d).select("id", *(scalars.time_between(a, b, u).alias(u) for u in ("hours", "minutes", "seconds")))


@query("f08_safe_ratios", """SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio, round(l_tax / nullif(l_discount, 0) - 1, 6) AS change, round(l_tax - l_discount, 6) AS diff, round(coalesce(l_tax / nullif(l_discount, 0), 0), 6) AS ratio_or_0 FROM lineitem""")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    return rounded(tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.ratio(a, b).alias("ratio"), scalars.change(a, b).alias("change"), (a - b).alias("diff"), F.coalesce(scalars.ratio(a, b), F.lit(0.0)).alias("ratio_or_0")))


@query("f09_sign_bucket_clip", f"{T} SELECT id, CAST(sign(net_r) AS INT) AS sign, CAST(net_r > 0 AS INT) AS flag, CASE WHEN confidence < 0.3 THEN 0 WHEN confidence < 0.6 THEN 1 ELSE 2 END AS bucket, greatest(-0.5, least(0.5, net_r)) AS clipped FROM trades")
def sign_bucket_clip(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("net_r")
    return tables.trades(spark, d).select("id", scalars.sign(r).alias("sign"), scalars.flag(r > 0).alias("flag"), scalars.steps(F.col("confidence"), [0.3, 0.6]).alias("bucket"), scalars.clip(r, -0.5, 0.5).alias("clipped"))


@query("f10_imbalance_bps", CANDLES + """ SELECT symbol, t, round((taker_buy - (quote_volume - taker_buy)) / nullif(quote_volume, 0), 6) AS imbalance, round((close - open) / nullif(open, 0) * 10000, 4) AS move_bps FROM candles""")
def imbalance_bps(spark: SparkSession, d: str) -> DataFrame:
    from tideframe.operators.bars import imbalance

    c = tables.candles(spark, d)
    return c.select("symbol", "t", F.round(imbalance(F.col("taker_buy"), F.col("quote_volume") - F.col("taker_buy")), 6).alias("imbalance"), F.round(scalars.bps(F.col("close"), F.col("open")), 4).alias("move_bps"))


@query("f11_stop_target_prices", f"""{T}, p AS (SELECT id, side, notional AS e, CASE WHEN side = 'long' THEN notional * 0.98 ELSE notional * 1.02 END AS s, CASE WHEN side = 'long' THEN notional * 1.03 ELSE notional * 0.97 END AS g,
CASE WHEN side = 'long' THEN notional - 1.5 * size ELSE notional + 1.5 * size END AS a, CASE WHEN side = 'long' THEN notional + 3 * size ELSE notional - 3 * size END AS ag FROM trades)
SELECT id, round(s, 4) AS stop, round(g, 4) AS target, round(a, 4) AS atr_stop, round(ag, 4) AS atr_target, round(CASE WHEN side = 'long' THEN greatest(s, a) ELSE least(s, a) END, 4) AS protective_stop, round(CASE WHEN side = 'long' THEN g - e ELSE e - g END / abs(e - s), 6) AS target_r FROM p""")
def stop_target_prices(spark: SparkSession, d: str) -> DataFrame:
    t = tables.trades(spark, d)
    e, side = F.col("notional"), F.col("side")
    stop, target = scalars.stop_and_target(e, side, 0.02, 0.03)
    atr_stop, atr_target = scalars.atr_stop_and_target(e, side, F.col("size"), 1.5, 3.0)
    out = t.select("id", stop.alias("stop"), target.alias("target"), atr_stop.alias("atr_stop"), atr_target.alias("atr_target"), scalars.more_protective(side, stop, atr_stop).alias("protective_stop"), scalars.in_r(target, e, side, F.abs(e - stop)).alias("target_r"))
    return out.select("id", *(F.round(c, 4).alias(c) for c in ("stop", "target", "atr_stop", "atr_target", "protective_stop")), F.round("target_r", 6).alias("target_r"))


@query("f12_sigmoid_score", f"{T} SELECT id, round(1 / (1 + exp(-(0.4 * net_r - 0.3 * confidence + 0.1))), 8) AS probability, round(1 / (1 + exp(-((net_r - 0.2) * 10))), 8) AS margin FROM trades")
def sigmoid_score(spark: SparkSession, d: str) -> DataFrame:
    score = 0.4 * F.col("net_r") - 0.3 * F.col("confidence") + 0.1
    return tables.trades(spark, d).select("id", F.round(scalars.sigmoid(score), 8).alias("probability"), F.round(scalars.sigmoid((F.col("net_r") - 0.2) * 10), 8).alias("margin"))


@query("f13_finite_means", """SELECT l_returnflag AS symbol, round(avg(CASE WHEN l_discount > 0 AND l_tax > 0 THEN l_tax / l_discount END), 8) AS mean_ratio, count(CASE WHEN l_discount > 0 AND l_tax > 0 THEN 1 END) AS finite_rows FROM lineitem GROUP BY 1""")
def finite_means(spark: SparkSession, d: str) -> DataFrame:
    """NaN where the tax is 0, infinite where the discount is."""
    x = F.when(F.col("l_tax") == 0, float("nan")).when(F.col("l_discount") == 0, float("inf")).otherwise(scalars.ratio(F.col("l_tax"), F.col("l_discount")))
    v = scalars.finite(x)
    return tables.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(F.round(F.avg(v), 8).alias("mean_ratio"), F.count(v).alias("finite_rows"))


@query("f14_array_ops", f"""{K}, g AS (SELECT symbol, t // 86400 AS day, list_sort(list(DISTINCT k)) AS ks FROM ticks GROUP BY 1, 2)
SELECT symbol, day, len(ks) AS n, list_contains(ks, 7) AS has_7, array_to_string(list_filter(ks, lambda x: x >= 90), ',') AS large FROM g""")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    g = tables.ticks(spark, d).groupBy("symbol", F.expr("t div 86400").alias("day")).agg(F.sort_array(F.collect_set("k")).alias("ks"))
    return g.select("symbol", "day", F.size("ks").cast("bigint").alias("n"), F.array_contains("ks", 7).alias("has_7"), F.array_join(F.filter("ks", lambda x: x >= 90), ",").alias("large"))


@query("f15_map_ops", """SELECT l_suppkey, l_returnflag AS outcome, count(*) AS times FROM lineitem GROUP BY 1, 2""")
def map_ops(spark: SparkSession, d: str) -> DataFrame:
    """Outcome counters as a map per key, and back to rows."""
    counted = tables.read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").count()
    maps = counted.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "count"))).alias("counters"))
    return maps.select("l_suppkey", F.explode("counters").alias("outcome", "times"))


@query("f17_content_hash", """SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS digest FROM orders""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "orders").select("o_orderkey", scalars.content_hash(F.col("o_orderkey"), F.col("o_orderstatus")).alias("digest"))


@query("f18_wallet_address", """SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM customer""")
def wallet_address(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("c_name", 256)
    n = F.col("c_custkey") % 3
    address = F.when(n == 0, F.concat(F.lit("0x"), F.substring(h, 1, 40))).when(n == 1, F.concat(F.lit("0x"), F.substring(h, 1, 39), F.lit("g")))
    return tables.read(spark, d, "customer").select("c_custkey", scalars.wallet_ok(address).alias("ok"))


@query("f19_prefix_lookup", CANDLES + """ SELECT symbol, t, round(close / nullif(lag(close, 2) OVER w, 0) - 1, 8) AS value FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t)""")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last column return or return_N, found in the schema."""
    from tideframe.operators.features import Series, returns

    x = tables.candles(spark, d)
    x = x.select("*", *(c.alias(k) for k, c in returns(Series(), lags=(1, 2)).items()))
    return x.select("symbol", "t", F.round(scalars.last_with_prefix(x, "return"), 8).alias("value"))


@query("f20_payload_rules", """SELECT event_id, CASE WHEN k IS NULL THEN 'k_missing' WHEN age > 50 THEN 'stale' ELSE '' END AS violations, CASE WHEN k IS NULL OR age > 50 THEN 'skip' ELSE 'ok' END AS action
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) AS age FROM events)""")
def payload_rules(spark: SparkSession, d: str) -> DataFrame:
    """A table of JSON payloads against its contract: required fields, age at most 50, no sizing fields."""
    from tideframe.operators.quality import payload_violations

    e = tables.read(spark, d, "events").select("event_id", F.col("props").alias("payload"))
    x = payload_violations(e, "payload", required=["k"], forbidden=["size", "leverage"], age="k", max_age=50)
    return x.select("event_id", F.array_join("violations", ",").alias("violations"), "action")

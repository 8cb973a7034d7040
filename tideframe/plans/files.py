"""Queries of file scans, over files that Spark writes from the given tables first, and of streams by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.operators import features, quality
from tideframe.plans.market import CANDLES, S, query, rounded
from tideframe.sources import files, tables
from tideframe.sources.tables import DAILY_SQL, FUNDING_SQL, TICKS_SQL, TRADES_SQL
from tideframe.streaming import streams

K = f"WITH {TICKS_SQL}"
T = f"WITH {TRADES_SQL}"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{streams.shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


@query("s01_candle_csv", CANDLES + " SELECT 'SPOT' AS market, symbol || 'USDT' AS symbol, t, CAST(open AS DOUBLE) AS open, CAST(close AS DOUBLE) AS close FROM candles")
def candle_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "candles")
    c = tables.candles(spark, d)
    c.select(F.concat("symbol", F.lit("USDT")).alias("symbol"), F.lit("spot").alias("market"), *(c[x].cast("string").alias(x) for x in ("t", "open", "high", "low", "close", "volume"))).write.option("header", True).csv(path)
    rows = files.candle_csv(spark, path, ["symbol", "market", "t", "open", "high", "low", "close", "volume"])
    return rows.select(F.upper("market").alias("market"), "symbol", F.col("t").cast("long").alias("t"), F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"))


@query("s03_normalize_candles", CANDLES + " SELECT lower(symbol) AS venue, upper(symbol) || 'USDT' AS symbol, t AS seconds, round(close, 6) AS close, CASE WHEN volume % 2 = 0 THEN volume END AS trades FROM candles")
def normalize_candles(spark: SparkSession, d: str) -> DataFrame:
    """Text with blanks and mixed case to typed columns; blank optional values become null."""
    c = tables.candles(spark, d)
    at = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = c.select(F.concat(F.lit(" "), F.upper("symbol")).alias("venue"), F.lit("Spot ").alias("market_type"), F.concat(F.lower("symbol"), F.lit("usdt ")).alias("symbol"), F.lit("usdt").alias("quote_asset"), F.col("symbol").alias("base_asset"), F.lit("1H").alias("timeframe"), at.alias("open_time"), at.alias("close_time"), at.alias("source_available_at"), *(F.concat(F.lit(" "), c[x].cast("string")).alias(x) for x in ("open", "high", "low", "close", "volume", "quote_volume")), F.when(F.col("volume") % 2 == 0, F.col("volume").cast("string")).otherwise(" ").alias("number_of_trades"))
    x = quality.normalize_candles(raw)
    return x.select("venue", "symbol", F.unix_seconds("open_time").alias("seconds"), F.round(F.col("close").cast("double"), 6).alias("close"), F.col("number_of_trades").cast("long").alias("trades"))


@query("s02_leakage_guard", CANDLES + " SELECT count(*) AS rows, 2 AS rejected FROM candles")
def leakage_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a column that knows the future are rejected before any job."""
    c = tables.candles(spark, d)
    rejected = 0
    for leak in ("no_trade_reason", "forward_return_3"):
        try:
            quality.require_columns(c.withColumn(leak, F.lit(0)), ["t"])
        except ValueError:
            rejected += 1
    return quality.require_columns(c, ["t", "close"]).agg(F.count("*").alias("rows"), F.lit(rejected).alias("rejected"))


@query("s08_clean_sink", CANDLES + " SELECT symbol, t, close FROM candles")
def clean_sink(spark: SparkSession, d: str) -> DataFrame:
    """Written in a Hive layout, sorted within files, and read back."""
    path = _folder(spark, "clean")
    quality.write_clean(tables.candles(spark, d).select("symbol", "t", "close"), path, ["symbol"], ["t"])
    return spark.read.parquet(path).select("symbol", "t", "close")


@query("o01_canonical_sort", CANDLES + " SELECT symbol, t, CAST(row_number() OVER (PARTITION BY symbol ORDER BY t) AS BIGINT) AS place FROM candles")
def canonical_sort(spark: SparkSession, d: str) -> DataFrame:
    """Files sorted by series and time: a row's place in its file is its place in the series."""
    path = _folder(spark, "sorted")
    quality.write_clean(tables.candles(spark, d).select("symbol", "t", "close"), path, ["symbol"], ["t"])
    x = spark.read.parquet(path)
    return x.select("symbol", "t", (F.col("_metadata.row_index") + 1).alias("place"))


@query("s10_minute_archive", f"{K}, b AS (SELECT symbol, t // 60 * 60 AS open_time, arg_max(price, (us, id)) AS close FROM ticks GROUP BY 1, 2) SELECT symbol AS pair, open_time, close FROM b WHERE open_time >= 1704153600 AND open_time < 1708000000")
def minute_archive(spark: SparkSession, d: str) -> DataFrame:
    """An archive with a header line in each file and repeated open times, of which the last line stays."""
    path = _folder(spark, "minutes")
    t = tables.ticks(spark, d)
    body = t.select("symbol", "us", "id", F.concat_ws(",", F.expr("t div 60 * 60").cast("string"), *(F.col("price").cast("string") for _ in range(4)), F.lit("1")).alias("value"))
    head = t.select("symbol").distinct().select("symbol", F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("id"), F.lit("open_time,open,high,low,close,volume").alias("value"))
    body.unionByName(head).repartition("symbol").sortWithinPartitions("symbol", F.asc_nulls_first("us"), "id").select(F.col("symbol").alias("pair"), "value").write.partitionBy("pair").text(path)
    return files.minute_archive(spark, f"{path}/pair=*/*", 1704153600, 1708000000).select("pair", "open_time", "close")


@query("s11_kline_archive", CANDLES + " SELECT t * 1000000 AS open_us, close_t * 1000000 AS close_us, open, close, CASE WHEN symbol = 'view' THEN quote_volume ELSE 0 END AS quote_volume FROM candles WHERE t >= 1704153600 AND t < 1706000000")
def kline_archive(spark: SparkSession, d: str) -> DataFrame:
    """Lines in milliseconds and microseconds, some without their optional fields, and a header among them."""
    path = _folder(spark, "klines")
    c = tables.candles(spark, d)
    fine = F.col("symbol") == "click"
    unit = F.when(fine, 1_000_000).otherwise(1000)
    close = F.when(fine, F.col("close_t") * 1_000_000 - 1).otherwise(F.col("close_t") * 1000)
    line = F.concat_ws(",", (F.col("t") * unit).cast("string"), *(c[x].cast("string") for x in ("open", "high", "low", "close", "volume")), close.cast("string"), F.when(F.col("symbol") == "view", F.concat_ws(",", c["quote_volume"].cast("string"), c["trades"].cast("string"))))
    c.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("open_time,open,high,low,close").alias("value"))).write.text(path)
    x = files.kline_lines(spark, path, 1704153600, 1706000000)
    # Milliseconds have lost the bar's last one; both kinds end on the bar's end here.
    return x.select("open_us", F.expr("close_us div 1000000 * 1000000").alias("close_us"), "open", "close", "quote_volume")


@query("s15_metrics_csv", CANDLES + " SELECT symbol, t, CASE WHEN volume % 2 = 0 THEN quote_volume END AS open_interest FROM candles")
def metrics_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "metrics")
    c = tables.candles(spark, d)
    c.select("symbol", "t", F.when(F.col("volume") % 2 == 0, c["quote_volume"].cast("string")).otherwise("  ").alias("open_interest")).write.option("header", True).csv(path)
    x = files.metrics_csv(spark, path, ["open_interest"])
    return x.select("symbol", F.col("t").cast("long").alias("t"), "open_interest")


@query("s12_daily_close_files", f"WITH {DAILY_SQL} SELECT upper(symbol) AS symbol, day, close FROM daily")
def daily_close_files(spark: SparkSession, d: str) -> DataFrame:
    """Daily kline files by symbol and month: milliseconds and microseconds by turns, some with a header line."""
    path = _folder(spark, "days")
    c = tables.daily_closes(spark, d).withColumn("month", F.date_format("day", "yyyy-MM"))
    unit = F.when(F.month("day") % 2 == 0, 1_000).otherwise(1_000_000)
    open_ = F.unix_timestamp(F.col("day").cast("timestamp")) * unit
    line = F.concat_ws(",", open_.cast("string"), F.lit("1"), F.lit("1"), F.lit("1"), F.col("close").cast("decimal(20,2)").cast("string"), F.lit("0"))
    rows = c.select(F.upper("symbol").alias("symbol"), "month", line.alias("value"))
    heads = rows.where("month LIKE '%-03'").select("symbol", "month").distinct().withColumn("value", F.lit("open_time,open,high,low,close,volume"))
    rows.unionByName(heads).repartition("symbol", "month").write.partitionBy("symbol", "month").text(path)
    return files.daily_closes(spark, path, 10**14)  # days before 2001


@query("s13_funding_pages", f"{K}, {FUNDING_SQL} SELECT upper(symbol) || 'USDT' AS symbol, CASE WHEN abs(rate) > 0.45 THEN NULL ELSE funding_t END AS funding_t, round(CAST(rate AS DOUBLE), 6) AS rate, CASE WHEN funding_t % 57600 = 0 THEN 101.5 END AS mark_price, CASE WHEN abs(rate) > 0.45 THEN 'missing fundingTime' END AS reason FROM funding")
def funding_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a day's rows a symbol as JSON; a row without its time keeps its reason."""
    path = _folder(spark, "funding")
    f = tables.funding(spark, d)
    ms = F.when(F.abs("rate") <= 0.45, F.col("funding_t") * 1000)
    row = F.struct(F.concat(F.col("symbol"), F.lit("usdt ")).alias("symbol"), ms.alias("fundingTime"), F.col("rate").cast("decimal(20,6)").cast("string").alias("fundingRate"), F.when(F.col("funding_t") % 57600 == 0, "101.5").otherwise("").alias("markPrice"))
    f.groupBy("symbol", F.expr("funding_t div 86400")).agg(F.to_json(F.collect_list(row)).alias("value")).select("value").write.text(path)
    x = files.funding_pages(spark, path, "exchange", "futures")
    return x.select("symbol", "funding_t", F.round(F.col("rate").cast("double"), 6).alias("rate"), F.col("mark_price").cast("double").alias("mark_price"), "reason")


@query("s26_trade_files", f"{K} SELECT upper(symbol) AS symbol, id, CASE WHEN id % 2 = 0 THEN us ELSE us // 1000 * 1000 END AS us, round(CAST(price AS DOUBLE), 6) AS price, round(CAST(qty AS DOUBLE), 6) AS qty, NOT is_buyer AS aggressive_buy FROM ticks")
def trade_files(spark: SparkSession, d: str) -> DataFrame:
    """Trade lines without header, in milliseconds and microseconds, with a line of names that goes."""
    path = _folder(spark, "trades")
    t = tables.ticks(spark, d)
    at = F.when(F.col("id") % 2 == 0, F.col("us")).otherwise(F.expr("us div 1000"))
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("id", "price", "qty", "id", "id")), at.cast("string"), F.col("is_buyer").cast("string"), F.lit("True"))
    rows = t.select(F.upper("symbol").alias("symbol"), line.alias("value"))
    heads = rows.select("symbol").distinct().withColumn("value", F.lit("agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker,is_best_match"))
    rows.unionByName(heads).write.partitionBy("symbol").text(path)
    x = files.aggregate_trades(spark, path)
    return x.select("symbol", "id", "us", F.round("price", 6).alias("price"), F.round("qty", 6).alias("qty"), "aggressive_buy")


_KINDS = """(VALUES ('open_interest'), ('open_interest_hist'), ('global_long_short'), ('top_long_short_position'), ('top_long_short_account'), ('book')) k(kind)"""


@query("s21_crowding_tables", CANDLES + f""", m AS (SELECT kind, symbol, t, close, volume, CASE WHEN kind = 'book' THEN 'unknown kind' WHEN volume % 5 = 1 AND kind = 'open_interest' THEN 'malformed openInterest' WHEN volume % 5 = 2 AND kind LIKE 'top%' THEN 'missing longShortRatio' WHEN volume % 5 = 3 AND kind = 'open_interest_hist' THEN 'malformed CMCCirculatingSupply' END AS reason FROM candles, {_KINDS})
SELECT CASE WHEN reason IS NULL THEN kind ELSE 'rejected' END AS "table", CASE WHEN reason IS NULL THEN upper(symbol) || 'USDT' END AS symbol, CASE WHEN reason IS NULL THEN t END AS event_t, CASE WHEN reason IS NULL THEN CASE kind WHEN 'open_interest' THEN NULL ELSE '5m' END END AS period,
CASE WHEN reason IS NULL THEN round(close, 4) END AS first, CASE WHEN reason IS NULL AND kind <> 'open_interest' THEN round(close / 2, 4) END AS second, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'open_interest_hist' THEN CASE WHEN volume % 5 = 4 THEN 7.5 END WHEN kind <> 'open_interest' THEN round(close / 4, 4) END END AS third, reason FROM m
UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, 'malformed line' FROM candles WHERE volume % 5 = 0""")
def crowding_tables(spark: SparkSession, d: str) -> DataFrame:
    """Five kinds of messages and one unknown kind in one file set; what doesn't fit is listed with its reason."""
    path, to = _folder(spark, "messages"), _folder(spark, "crowding")
    c = tables.candles(spark, d).select("symbol", "t", "volume", *(F.round(F.col("close") / n, 4).cast("decimal(20,4)").cast("string").alias(f"v{n}") for n in (1, 2, 4)))
    wrong = lambda k: F.col("volume") % 5 == k
    head = [F.concat(F.col("symbol"), F.lit("usdt")).alias("symbol")]
    at, time = (F.col("t") * 1000).alias("timestamp"), (F.col("t") * 1000).cast("string").alias("time")
    ratio = lambda broken: [F.when(~broken, F.col("v1")).alias("longShortRatio"), F.col("v2").alias("longAccount"), F.col("v4").alias("shortAccount")]
    rows = {
        "open_interest": [*head, time, F.when(wrong(1), "n/a").otherwise(F.col("v1")).alias("openInterest")],
        "open_interest_hist": [*head, at, F.col("v1").alias("sumOpenInterest"), F.col("v2").alias("sumOpenInterestValue"), F.when(wrong(3), "many").when(wrong(4), "7.5").otherwise("").alias("CMCCirculatingSupply")],
        "global_long_short": [*head, at, *ratio(F.lit(False))],
        "top_long_short_position": [*head, at, *ratio(wrong(2))],
        "top_long_short_account": [*head, at, *ratio(wrong(2))],
        "book": [*head, at],
    }
    lines = F.array(*(F.to_json(F.struct(F.lit(k).alias("kind"), F.lit(None if k == "open_interest" else "5m").cast("string").alias("period"), (F.col("t") * 1000 + 500).alias("available_ms"), F.struct(*r).alias("row"))) for k, r in rows.items()), F.when(wrong(0), "{broken"))
    c.select(F.explode(F.array_compact(lines)).alias("value")).write.text(path)
    found, rejected = files.routed_messages(spark, path, to)
    out = []
    for kind, x in found.items():
        numbers = [F.col(c).cast("double") for c in x.columns if c not in ("symbol", "event_time", "period", "source_available_at")]
        numbers += [F.lit(None).cast("double")] * (3 - len(numbers))
        out.append(x.select(F.lit(kind).alias("table"), "symbol", F.unix_seconds("event_time").alias("event_t"), "period", *(v.alias(n) for v, n in zip(numbers, ("first", "second", "third")))))
    return streams.stream_union(*out, rejected.select(F.lit("rejected").alias("table"), "reason"))


@query("s27_snapshots", f"{K} SELECT 'book_' || symbol AS snapshot, id, price, 1700000000 + length(symbol) AS created_at FROM ticks WHERE symbol <> 'error'")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One folder a symbol, with a manifest each; one manifest can't be read, and its rows are left out."""
    base = _folder(spark, "snapshots")
    t = tables.ticks(spark, d)
    for symbol in ("click", "error", "purchase", "signup", "view"):  # a few configured folders
        t.where(F.col("symbol") == symbol).select("id", "price").write.parquet(f"{base}/book_{symbol}/rows")
        text = "{broken" if symbol == "error" else f'{{"created_at": {1700000000 + len(symbol)}}}'
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{base}/book_{symbol}/manifest.json")
    x = files.snapshots(spark, base, "book")
    return x.select("snapshot", "id", "price", "created_at")


@query("s30_ledger_sink", """SELECT o_orderkey AS k, o_totalprice AS total FROM orders""")
def ledger_sink(spark: SparkSession, d: str) -> DataFrame:
    """A ledger kept as JSON, read back typed."""
    path = _folder(spark, "ledger")
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    o.write.mode("overwrite").json(path)
    return spark.read.schema("k long, total double").json(path)


@query("s31_keyed_cache", CANDLES + " SELECT symbol, t, round(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1, 6) AS return_1, 1 AS builds FROM candles")
def keyed_cache(spark: SparkSession, d: str) -> DataFrame:
    """Built once, read twice."""
    folder, built = _folder(spark, "cache"), []

    def build() -> DataFrame:
        built.append(1)
        c = tables.candles(spark, d)
        return rounded(c.select("symbol", "t", features.returns(S, lags=(1,))["return_1"].alias("return_1")))

    config = {"feature": "return_1", "source": d}
    files.materialize(build, folder, config)
    return files.materialize(build, folder, config).withColumn("builds", F.lit(len(built)))


@query("s32_config_matrix", f"""{T}, s AS (SELECT * FROM (VALUES ('base', 0.3, 10), ('strict', 0.6, 10), ('wide', 0.3, 40)) v(scenario, low, high)) SELECT scenario, count(*) AS trades FROM trades, s WHERE confidence >= low AND size <= high GROUP BY 1""")
def config_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of a configuration and its overrides, applied to all trades."""
    base = {"filter": {"confidence": 0.3, "size": 10}}
    s = files.scenarios(spark, base, {"base": {}, "strict": {"filter": {"confidence": 0.6}}, "wide": {"filter": {"size": 40}}})
    limits = s.select("scenario", F.from_json("config", "filter struct<confidence:double,size:double>")["filter"].alias("f"))
    x = tables.trades(spark, d).join(F.broadcast(limits), (F.col("confidence") >= F.col("f.confidence")) & (F.col("size") <= F.col("f.size")))
    return x.groupBy("scenario").agg(F.count("*").alias("trades"))


@query("s33_feature_dictionary", CANDLES + """, r AS (SELECT close / nullif(lag(close, 1) OVER w, 0) - 1 AS r1, close / nullif(lag(close, 2) OVER w, 0) - 1 AS r2 FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT 'return_1' AS name, 'returns' AS "group", 1 AS lookback, 'signal_time' AS availability, count(r1) AS rows, 'v1' AS version FROM r UNION ALL SELECT 'return_2', 'returns', 2, 'signal_time', count(r2), 'v1' FROM r""")
def feature_dictionary(spark: SparkSession, d: str) -> DataFrame:
    c = tables.candles(spark, d)
    x = c.select(*(v.alias(k) for k, v in features.returns(S, lags=(1, 2)).items()))
    return files.dictionary(x, {"return_1": ("returns", 1), "return_2": ("returns", 2)}, "v1")


@query("p23_snapshot_projection", f"""{K} SELECT symbol, t // 3600 AS snapshot, max(price) AS book_spread, NULL AS crowding_ratio FROM ticks WHERE symbol IN ('view', 'click') GROUP BY 1, 2""")
def snapshot_projection(spark: SparkSession, d: str) -> DataFrame:
    """Features of one family under their names, for the symbols allowed; the other families' columns are null."""
    t = tables.ticks(spark, d).where(F.col("symbol").isin("view", "click"))
    book = t.groupBy("symbol", F.expr("t div 3600").alias("snapshot")).agg(F.max("price").alias("book_spread"))
    empty = spark.createDataFrame([], "symbol string, snapshot long, crowding_ratio int")
    return book.unionByName(empty, allowMissingColumns=True)


@query("t05_stream_rolling", CANDLES + " SELECT symbol, t, round(avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ma FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 1")
def stream_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Features of each symbol's newest bar, worked out for each batch over a bounded history."""
    path = _folder(spark, "bars")
    tables.candles(spark, d).write.parquet(path)
    newest = Window.partitionBy("symbol").orderBy(F.desc("t"))

    def history(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(newest)).where("_k <= 5").drop("_k")

    def newest_features(rows: DataFrame) -> DataFrame:
        return rows.groupBy("symbol").agg(F.max("t").alias("t"), F.round(F.avg("close"), 6).alias("ma"))

    return streams.newest_by_batch(streams.landed(spark, path, 1), newest_features, history, _folder(spark, "newest"))


@query("t07_stream_take", f"""{T}, r AS (SELECT id, decision_t, net_r, confidence, row_number() OVER (PARTITION BY decision_t // 86400 ORDER BY decision_t, confidence DESC, id, net_r) AS k FROM trades WHERE net_r >= 0.2) SELECT id, decision_t FROM r WHERE k <= 3""")
def stream_take(spark: SparkSession, d: str) -> DataFrame:
    """Signals that arrive in batches: scored, gated, and at most three taken a day over the merged ledger."""
    path = _folder(spark, "signals")
    tables.trades(spark, d).select("id", "decision_t", "net_r", "confidence").write.parquet(path)

    def take(merged: DataFrame) -> DataFrame:  # a day's best three are among those of before and the new rows
        w = Window.partitionBy(F.expr("decision_t div 86400")).orderBy("decision_t", F.desc("confidence"), "id", "net_r")
        return merged.where("net_r >= 0.2").withColumn("_k", F.row_number().over(w)).where("_k <= 3").drop("_k")

    return streams.newest_by_batch(streams.landed(spark, path, 1), take, take, _folder(spark, "taken")).select("id", "decision_t")

"""Bars, pivots and order-book summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(ticks: DataFrame, seconds: int, by: str = "symbol") -> DataFrame:
    """Left-labelled bars of a tick table (t, us, id, price, is_buyer); bars without a tick don't exist."""
    order = F.col("us") * 1000 + F.col("id") % 1000
    start = F.expr(f"t div {seconds} * {seconds}")
    return (
        ticks.groupBy(by, start.alias("t"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count("*").alias("volume"),
            F.round(F.sum("price"), 6).alias("quote_volume"),
            F.round(F.coalesce(F.sum(F.when(F.col("is_buyer"), F.col("price"))), F.lit(0.0)), 6).alias("taker_buy"),
        )
        .select(by, "t", (F.col("t") + seconds).alias("close_t"), "open", "high", "low", "close", "volume", "quote_volume", "taker_buy", F.col("volume").alias("trades"))
    )


def regroup(bars: DataFrame, seconds: int, closed_only: bool = True, by: str = "symbol") -> DataFrame:
    """Longer bars from bars. A bar belongs to the bucket that its close falls into or ends.

    closed_only drops a bucket whose last bar doesn't reach the bucket's end. Gaps never merge buckets.
    """
    end = F.expr(f"((close_t - 1) div {seconds} + 1) * {seconds}")
    out = bars.groupBy(by, end.alias("bucket_end")).agg(
        F.min_by("open", "close_t").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_t").alias("close"),
        F.sum("volume").alias("volume"),
        F.max("close_t").alias("last_close_t"),
        F.count("*").alias("bars"),
    )
    return (out.where("last_close_t = bucket_end") if closed_only else out).select(by, (F.col("bucket_end") - seconds).alias("t"), F.col("bucket_end").alias("close_t"), "open", "high", "low", "close", "volume", "bars")


def imbalance(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def depth_pivot(levels: DataFrame, key: list[str], pct: str = "pct", notional: str = "notional", bands: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """Rows of signed percentage bands to cumulative bid and ask notionals, imbalance, total and band count."""
    sums = []
    for b in bands:
        for side, sign in (("bid", -1), ("ask", 1)):
            near = (F.col(pct) * sign > 0) & (F.abs(pct) <= b)
            sums.append(F.round(F.sum(F.when(near, F.col(notional)).otherwise(0.0)), 6).alias(f"{side}_notional_{b}pct"))
    out = levels.groupBy(*key).agg(*sums, F.count("*").alias("bands"))
    return out.select("*", *(F.round(imbalance(F.col(f"bid_notional_{b}pct"), F.col(f"ask_notional_{b}pct")), 8).alias(f"imbalance_{b}pct") for b in bands))


def book_levels(books: DataFrame, payload: str = "payload", key: list[str] | None = None) -> DataFrame:
    """One row a level of a JSON book {bids: [[price, qty]], asks: ...}: side, ordinal, price, qty, notional, bps from mid."""
    key = key or ["id"]
    side = "array<array<string>>"
    parsed = books.select(*key, F.from_json(payload, f"bids {side}, asks {side}").alias("b")).select(*key, F.col("b.bids").alias("bids"), F.col("b.asks").alias("asks"))
    best = lambda c, f: f(F.transform(c, lambda x: x[0].cast("double")))
    mid = (best("bids", F.array_max) + best("asks", F.array_min)) / 2
    both = parsed.withColumn("mid", mid)
    rows = []
    for name, c in (("bid", "bids"), ("ask", "asks")):
        rows.append(both.select(*key, "mid", F.lit(name).alias("side"), F.posexplode(c).alias("ordinal", "level")))
    x = rows[0].unionByName(rows[1])
    price, qty = F.col("level")[0].cast("double"), F.col("level")[1].cast("double")
    return x.select(*key, "side", "ordinal", price.alias("price"), qty.alias("qty"), (price * qty).alias("notional"), (F.abs(price - F.col("mid")) / F.col("mid") * 10000).alias("bps"))


def book_summary(levels: DataFrame, key: list[str]) -> DataFrame:
    """Best prices, mid, spread, totals, imbalance and the largest level of each side. Empty and crossed books go."""
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    out = levels.groupBy(*key).agg(
        F.max(side("bid", "price")).alias("best_bid"),
        F.min(side("ask", "price")).alias("best_ask"),
        F.sum(side("bid", "notional")).alias("bid_notional"),
        F.sum(side("ask", "notional")).alias("ask_notional"),
        F.max(side("bid", "notional")).alias("largest_bid"),
        F.max(side("ask", "notional")).alias("largest_ask"),
        F.max_by(side("bid", "bps"), side("bid", "notional")).alias("largest_bid_bps"),
        F.max_by(side("ask", "bps"), side("ask", "notional")).alias("largest_ask_bps"),
    )
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    return out.where("best_bid < best_ask").select("*", mid.alias("mid"), ((F.col("best_ask") - F.col("best_bid")) / mid * 10000).alias("spread_bps"), imbalance(F.col("bid_notional"), F.col("ask_notional")).alias("notional_imbalance"))


def depth_rows(rows: DataFrame, pct: str) -> DataFrame:
    """Signed percentage bands as side and distance; band 0 belongs to no side and goes."""
    p = F.col(pct)
    return rows.where(p != 0).select("*", F.when(p < 0, "bid").otherwise("ask").alias("side"), F.abs(p).cast("int").alias("distance"))


def band_check(levels: DataFrame, key: list[str], pct: str, expected: list[int]) -> DataFrame:
    """Per key: rows, distinct bands, whether they are exactly the expected ones, and whether one is repeated."""
    bands = F.sort_array(F.collect_set(F.col(pct).cast("int")))
    g = levels.groupBy(*key).agg(F.count("*").alias("rows"), bands.alias("_b"))
    return g.select(*key, "rows", F.size("_b").cast("bigint").alias("bands"), (F.col("_b") == F.array(*map(F.lit, sorted(expected)))).alias("whole"), (F.col("rows") > F.size("_b")).alias("repeated"))


def liquidation_events(messages: DataFrame, message: str) -> DataFrame:
    """Force orders {o: {S, ap, z}}, in an envelope {data: ...} or not, with direction and notional.

    A sold position was long. Messages that can't be read have the direction malformed and no notional.
    """
    order = "o struct<S:string,ap:double,z:double>"
    x = messages.withColumn("_j", F.from_json(message, f"{order}, data struct<{order.replace(' ', ':', 1)}>"))
    x = x.withColumn("_o", F.coalesce("_j.o", "_j.data.o"))
    sold = F.when(F.col("_o.S") == "SELL", "long_liquidation").when(F.col("_o.S") == "BUY", "short_liquidation")
    notional = F.col("_o.ap") * F.col("_o.z")
    return x.select("*", F.when(notional.isNull(), "malformed").otherwise(F.coalesce(sold, F.lit("malformed"))).alias("direction"), notional.alias("notional")).drop("_j", "_o")


def wallet_positions(states: DataFrame, state: str) -> DataFrame:
    """One row a position of {assetPositions: [{position: {szi}}]}: its number, side by sign, and size without sign."""
    x = states.withColumn("_s", F.from_json(state, "assetPositions array<struct<position:struct<szi:double>>>"))
    x = x.select(*(c for c in states.columns if c != state), F.posexplode("_s.assetPositions").alias("position", "_p"))
    size = F.col("_p.position.szi")
    return x.select("*", F.when(size >= 0, "long").otherwise("short").alias("side"), F.abs(size).alias("notional")).drop("_p")


def wallet_fills(fills: DataFrame, fill: str, wallet: str = "wallet") -> DataFrame:
    """Fills {px, sz, side, tid} as rows; repeated tells of a (wallet, trade) that is there more than once."""
    x = fills.withColumn("_f", F.from_json(fill, "px double, sz double, side string, tid int"))
    x = x.select(*(c for c in fills.columns if c != fill), F.col("_f.tid").alias("trade"), F.when(F.col("_f.side") == "B", "buy").otherwise("sell").alias("side"), F.abs(F.col("_f.px") * F.col("_f.sz")).alias("notional"))
    times = x.groupBy(wallet, "trade").agg(F.count("*").alias("_n"))
    return x.join(times, [wallet, "trade"]).withColumn("repeated", F.col("_n") > 1).drop("_n")

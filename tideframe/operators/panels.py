"""Features of alternative data: funding, futures metrics, book depth, crowding, liquidations, trade flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import ratio
from tideframe.operators.asof import asof
from tideframe.operators.features import Series, zscore


def known_at(panel: DataFrame, event_time: str, lag: int, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last row of each key and event time, with known_at = event time + lag."""
    by = [*key, event_time]
    rest = [c for c in panel.columns if c not in by]
    one = panel.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("_r")).select(*by, "_r.*")
    return one.withColumn("known_at", F.col(event_time) + lag)


def at_least(s: Series, c: Column, n: int, least: int, f) -> Column:
    """f(c) over the last n rows, null until `least` of them have a value."""
    frame = s.frame(n)
    return F.when(F.count(c).over(frame) >= least, f(c).over(frame))


def funding_features(s: Series, rate: str = "rate", short: int = 9, long: int = 21, z: int = 90) -> dict[str, Column]:
    r = F.col(rate)
    return {"funding_rate": r, "funding_mean": at_least(s, r, short, short // 3, F.avg), "funding_sum": at_least(s, r, long, long // 3, F.sum), "funding_z": zscore(s, r, z, min_rows=max(10, z // 4))}


def metrics_features(s: Series, open_interest: str, long_short: str, lags: Sequence[int], z_oi: int, z_ls: int) -> dict[str, Column]:
    """Differences and z of log open interest, level and z of the long-short ratio; z scores need a quarter of their frame."""
    log_oi = F.when(F.col(open_interest) > 0, F.ln(open_interest))
    ls = F.col(long_short)
    out = {f"oi_diff_{n}": log_oi - F.lag(log_oi, n).over(s.w) for n in lags}
    return {**out, "oi_z": zscore(s, log_oi, z_oi, min_rows=max(10, z_oi // 4)), "long_short": ls, "long_short_z": zscore(s, ls, z_ls, min_rows=max(10, z_ls // 4))}


def depth_features(s: Series, z: int, near: int = 1, far: int = 5) -> dict[str, Column]:
    """Imbalance near and far, how much of the far depth lies near, and z of log depth."""
    bid, ask = (lambda n, side=side: F.col(f"{side}_{n}") for side in ("bid", "ask"))
    imbalance = lambda n: ratio(bid(n) - ask(n), bid(n) + ask(n))
    total = bid(far) + ask(far)
    log_depth = F.when(total > 0, F.ln(total))
    return {"imbalance_near": imbalance(near), "imbalance_far": imbalance(far), "concentration": ratio(bid(near) + ask(near), total), "depth_z": zscore(s, log_depth, z, min_rows=max(10, z // 4))}


def liquidation_proxy(s: Series, open_interest: str, ret: str) -> dict[str, Column]:
    """Falling open interest times the move against each side: longs hurt by falls, shorts by rises."""
    drop = F.greatest(-(F.ln(open_interest) - F.lag(F.ln(open_interest), 1).over(s.w)), F.lit(0.0))
    return {"long_liquidation": drop * F.greatest(-F.col(ret), F.lit(0.0)), "short_liquidation": drop * F.greatest(F.col(ret), F.lit(0.0))}


def ratio_lift(s: Series, c: Column, n: int = 12) -> Column:
    """c less the mean of up to n earlier values."""
    return c - F.avg(c).over(s.w.rowsBetween(-n, -1))


def panel_mean(levels: DataFrame, key: str, time: str, column: str, value: str, names: Sequence[object], width: int, order: str) -> DataFrame:
    """Levels pivoted (the last of a time wins), then means over intervals of `width` that are closed and labelled right.

    Intervals without any value have no row.
    """
    last = levels.groupBy(key, time).pivot(column, list(names)).agg(F.max_by(value, order))
    end = F.expr(f"(({time} - 1) div {width} + 1) * {width}")
    named = [c for c in last.columns if c not in (key, time)]
    out = last.groupBy(key, end.alias("interval_end")).agg(*(F.avg(F.col(f"`{c}`")).alias(f"level_{c}") for c in named))
    return out.where(F.coalesce(*(F.col(f"`level_{c}`") for c in named)).isNotNull())


def asof_change(joined_now: Column, joined_before: Column) -> Column:
    """Change against an earlier as-of value, null unless that is positive."""
    return F.when(joined_before > 0, joined_now / joined_before - 1)


def merge_families(sources: Mapping[str, DataFrame], key: Sequence[str], order: str) -> DataFrame:
    """Sources with columns of their own, as one row a key: the last value of each column that is not null wins."""
    tagged = None
    for name, df in sources.items():
        x = df.withColumn("_source", F.lit(name))
        tagged = x if tagged is None else tagged.unionByName(x, allowMissingColumns=True)
    values = [c for c in tagged.columns if c not in (*key, order, "_source")]
    return tagged.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, "_source"))).alias(c) for c in values))


def zero_filled(dimension: DataFrame, facts: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each row of the dimension, with zeros where there are no facts."""
    return dimension.join(facts, list(key), "left").select(*dimension.columns, *(F.coalesce(c, F.lit(0).cast(facts.schema[c].dataType)).alias(c) for c in values))


def liquidation_rollup(events: DataFrame, key: Sequence[str], side: str = "side", notional: str = "notional") -> DataFrame:
    """count, total, long and short notional, and imbalance (0 where nothing was liquidated)."""
    n = F.col(notional)
    sums = {"long_notional": F.sum(F.when(F.col(side) == "long", n).otherwise(0.0)), "short_notional": F.sum(F.when(F.col(side) == "short", n).otherwise(0.0))}
    g = events.groupBy(*key).agg(F.count("*").alias("events"), F.sum(n).alias("notional"), *(c.alias(k) for k, c in sums.items()))
    return g.withColumn("imbalance", F.coalesce(ratio(F.col("long_notional") - F.col("short_notional"), F.col("notional")), F.lit(0.0)))


def trade_flow(trades: DataFrame, key: Sequence[str], notional: Column, buy: Column) -> DataFrame:
    """Per key: trades, notional, bought and sold, buy ratio, imbalance, and the same of large trades.

    A trade is large from the 95th percentile of its key by nearest rank on.
    """
    x = trades.select(*key, notional.alias("n"), buy.alias("b"))
    # The percentile is an aggregate of counted values, so that no key is sorted in one task.
    limit = x.groupBy(*key).agg(F.percentile_disc("n", 0.95).alias("limit")) if hasattr(F, "percentile_disc") else x.groupBy(*key).agg(F.expr("percentile_disc(0.95) within group (order by n)").alias("limit"))
    y = x.join(limit, list(key))
    large = F.col("n") >= F.col("limit")
    bought = F.sum(F.when(F.col("b"), F.col("n")).otherwise(0.0))
    g = y.groupBy(*key).agg(F.count("*").alias("trades"), F.sum("n").alias("notional"), bought.alias("bought"), F.max("limit").alias("large_from"), F.count_if(large).alias("large_trades"), F.sum(F.when(large, F.col("n"))).alias("_l"), F.sum(F.when(large & F.col("b"), F.col("n")).otherwise(0.0)).alias("_lb"), F.max("n").alias("largest"))
    return g.select(*key, "trades", "notional", "bought", (F.col("notional") - F.col("bought")).alias("sold"), ratio(F.col("bought"), F.col("notional")).alias("buy_ratio"), ratio(2 * F.col("bought") - F.col("notional"), F.col("notional")).alias("imbalance"), "large_from", "large_trades", ratio(F.col("_lb"), F.col("_l")).alias("large_buy_ratio"), "largest")


def change_since_snapshot(snapshots: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Each snapshot's value less the key's previous one (all of it where there is none)."""
    w = Window.partitionBy(*key).orderBy(order)
    return snapshots.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)))


def funding_window(bars: DataFrame, funding: DataFrame, n: int, time: str = "t", interval_h: float = 8.0) -> DataFrame:
    """bars with the latest funding row known by then: its rate, sign and size, mean, z-score and size of that over the
    last n funding rows (null before), hours since it was due and hours to the next one (at least 0).

    funding: symbol, funding_t, available_t, rate. Without a funding row all are null.
    """
    f = Series(order="funding_t")
    r = F.col("rate")
    z = zscore(f, r, n)
    x = funding.select("symbol", "available_t", F.col("funding_t").alias("_due"), r.alias("funding_rate"), f.full(r, n, F.avg).alias("funding_mean"), z.alias("funding_z"))
    out = asof(bars, x, time, "available_t", ["symbol"], ["funding_rate", "funding_mean", "funding_z", "_due"]).drop("available_t")
    since = (F.col(time) - F.col("_due")) / 3600.0
    return out.select(*bars.columns, "funding_rate", "funding_mean", "funding_z", F.abs("funding_z").alias("funding_z_size"), (F.col("funding_rate") > 0).cast("int").alias("funding_positive"), F.abs("funding_rate").alias("funding_size"), since.alias("hours_since_funding"), F.greatest(interval_h - since, F.lit(0.0)).alias("hours_to_funding"))

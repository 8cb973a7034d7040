"""Swing trading of drawdowns: entry screens, exits, market guards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import change, ratio
from tideframe.operators.asof import interval_join
from tideframe.operators.features import Series
from tideframe.operators.scan import ema_weights, weighted_lags


def drawdown_bounce_age(s: Series, lookback: int, number: Column) -> dict[str, Column]:
    """Close against the highest high and lowest low of lookback + 1 rows, and rows since the last lowest low."""
    frame = s.frame(lookback + 1)
    full = F.count("close").over(frame) == lookback + 1
    low_at = F.max_by(number, F.struct(-F.col("low"), number)).over(frame)
    return {"drawdown": F.when(full, change(F.col("close"), F.max("high").over(frame))), "bounce": F.when(full, change(F.col("close"), F.min("low").over(frame))), "low_age": F.when(full, number - low_at)}


def lookback_returns(s: Series, trend: int, recent: int) -> dict[str, Column]:
    """Returns over two lookbacks, and how many of the last `recent` closes rose."""
    c = F.col("close")
    rose = (c > s.back("close")).cast("int")
    return {"trend_return": change(c, s.back("close", trend)), "recent_return": change(c, s.back("close", recent)), "rose": rose}


def breakout(s: Series, n: int, margin: float, max_range: float) -> dict[str, Column]:
    """Close over the n earlier highs by a margin, after a narrow range (false before n bars are there), and volume against
    its earlier mean."""
    before = s.w.rowsBetween(-n, -1)
    full = F.count("close").over(before) == n
    high, low = F.max("high").over(before), F.min("low").over(before)
    return {"breakout": F.coalesce(full & (F.col("close") >= high * (1 + margin)) & (ratio(high - low, low) <= max_range), F.lit(False)), "volume_ratio": F.when(full, ratio(F.col("volume"), F.avg("volume").over(before)))}


def swing_rsi(s: Series, n: int, changes: str) -> dict[str, Column]:
    """Relative strength over n changes: null before they are all there, 100 without losses; and its change."""
    frame = s.frame(n)
    x = F.col(changes)
    gain, loss = (F.sum(F.greatest(v, F.lit(0.0))).over(frame) / n for v in (x, -x))
    return {"rsi": F.when(F.count(x).over(frame) == n, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))))}


def swing_ema(s: Series, n: int, column: str = "close") -> Column:
    """Exponential mean over a frame of n values, seeded with the frame's mean."""
    return weighted_lags(column, ema_weights(n, seed="mean"), s.w)


def fading(s: Series, rsi: str, ema: str, wick: float = 0.35) -> Column:
    """A rebound that loses force: a lower close, a lower RSI, a long upper wick, or a close below its mean."""
    upper = ratio(F.col("high") - F.greatest("open", "close"), F.col("high") - F.col("low"))
    signs = (F.col("close") < s.back("close"), F.col(rsi) < s.back(rsi), upper >= wick, F.col("close") < F.col(ema))
    out = F.lit(False)
    for x in signs:
        out = out | F.coalesce(x, F.lit(False))
    return out


def entry_screen(conditions: Mapping[str, Column]) -> dict[str, Column]:
    """Whether all conditions of an entry hold, and the names of those that don't; a null one doesn't."""
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()}
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in ok.items())))
    return {"failed": failed, "enter": F.size(failed) == 0}


def lookahead_reach(s: Series, min_hold: int, n: int, target: float) -> Column:
    """Whether a high of the rows min_hold to n ahead reaches the target; looks ahead on purpose, for research only."""
    frame = s.w.rowsBetween(min_hold, n)
    return F.coalesce(F.max("high").over(frame) >= F.col("close") * (1 + target), F.lit(False))


def swing_exit(entries: DataFrame, bars: DataFrame, number: str, target: float, min_hold: int, max_hold: int) -> DataFrame:
    """Entries (symbol, entry_n, entry) out at the first bar that is min_hold or more rows on, at the target and fading
    (profit_fade); else at max_hold or, where the series ends before, its last bar (time_stop).

    Gives exit_n, exit, reason, return_share, and the largest move for and against the entry up to the exit (at least and
    at most 0). bars: symbol, number, high, low, close, fading. An entry at the last bar leaves there. Exits that wait for
    a profit without a horizon are folds.profit_exits().
    """
    e = entries.withColumn("_until", F.col("entry_n") + max_hold).withColumn("_from", F.col("entry_n"))
    b = bars.select("symbol", F.col(number).alias("bar_n"), "high", "low", "close", "fading")
    x = interval_join(e, b, "_from", "_until", "bar_n", ["symbol"], max_hold)
    path = x.groupBy("symbol", "entry_n", "entry").agg(F.sort_array(F.collect_list(F.struct("bar_n", "high", "low", "close", "fading"))).alias("path"))
    hit = lambda p: (p["bar_n"] - F.col("entry_n") >= max(min_hold, 1)) & (p["close"] / F.col("entry") - 1 >= target) & p["fading"]
    at = F.nullif(F.array_position(F.transform("path", hit), True), F.lit(0))
    y = path.withColumn("_at", at).withColumn("reason", F.when(at.isNotNull(), "profit_fade").otherwise("time_stop"))
    y = y.withColumn("_held", F.slice("path", F.lit(1), F.coalesce("_at", F.size("path")).cast("int")))
    end, entry = F.element_at("_held", -1), F.col("entry")
    after = F.filter("_held", lambda p: p["bar_n"] > F.col("entry_n"))
    best = F.greatest(F.lit(0.0), change(F.array_max(F.transform(after, lambda p: p["high"])), entry))
    worst = F.least(F.lit(0.0), change(F.array_min(F.transform(after, lambda p: p["low"])), entry))
    return y.select("symbol", "entry_n", "entry", end["bar_n"].alias("exit_n"), end["close"].alias("exit"), "reason", change(end["close"], entry).alias("return_share"), best.alias("best"), worst.alias("worst"))


def market_guard(index: DataFrame, time: str, value: str, lookback: int | None = None, min_bounce: float | None = None, recent: int | None = None, min_recent: float | None = None, min_rising: float | None = None, trend: int | None = None, min_trend: float | None = None, closes: str | None = None) -> DataFrame:
    """Per time of an index with one row a time: bounce, recent_return, rising, trend_return and whether the guard is open.

    bounce: from the lowest of the last lookback + 1 values; returns over recent and trend rows; rising: share of the
    symbols in the map `closes` (name -> close), there and recent rows back, that rose. A part without a lookback
    is left out; one whose lookback isn't full yet keeps the guard shut, whatever its limit; rising without a common
    symbol does, too.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(time)
    c, row = F.col(value), F.row_number().over(w) - 1
    none = F.lit(None).cast("double")
    full = lambda n, x: F.when(row >= n, x)
    x = index.withColumn("bounce", none if lookback is None else full(lookback, change(c, F.min(c).over(w.rowsBetween(-lookback, 0)))))
    x = x.withColumn("recent_return", none if recent is None else full(recent, change(c, F.lag(c, recent).over(w))))
    rising = none
    if recent is not None and closes is not None:
        before = F.lag(closes, recent).over(w)
        shared = F.array_intersect(F.map_keys(closes), F.map_keys(before))
        up = F.size(F.filter(shared, lambda k: F.element_at(F.col(closes), k) > F.element_at(F.col("_before"), k)))
        x = x.withColumn("_before", before).withColumn("_shared", shared)
        rising = F.when(F.size("_shared") > 0, up / F.size("_shared"))
    x = x.withColumn("rising", rising)
    x = x.withColumn("trend_return", none if trend is None else full(trend, change(c, F.lag(c, trend).over(w))))
    ok = F.lit(True)
    for n in (lookback, recent, trend):
        if n is not None:
            ok = ok & (row >= n)
    for column, n, least in (("bounce", lookback, min_bounce), ("recent_return", recent, min_recent), ("rising", recent, min_rising), ("trend_return", trend, min_trend)):
        if n is not None and least is not None:
            ok = ok & F.coalesce(F.col(column) >= least, F.lit(False))
    return x.withColumn("open", ok).drop("_before", "_shared")

"""Trade outcome metrics, equity curves and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import ratio
from tideframe.operators.chunks import SPAN


def profit_factor(r: Column, on_no_loss: float | None = float("inf")) -> Column:
    gain, loss = F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))
    return F.when(loss.isNull() | (loss == 0), F.when(gain > 0, F.lit(on_no_loss))).otherwise(F.coalesce(gain, F.lit(0.0)) / loss)


def outcome_columns(r: str = "net_r") -> list[Column]:
    c = F.col(r)
    return [
        F.count(c).alias("trades"),
        F.round(F.avg(c), 8).alias("mean_r"),
        F.round(F.sum(c), 6).alias("total_r"),
        F.round(F.avg((c > 0).cast("double")), 8).alias("win_rate"),
        F.round(F.avg(F.when(c > 0, c)), 8).alias("mean_win"),
        F.round(F.avg(F.when(c < 0, c)), 8).alias("mean_loss"),
        F.round(profit_factor(c, None), 6).alias("profit_factor"),
        F.min(c).alias("worst_r"),
    ]


def outcome_metrics(trades: DataFrame, by: Sequence[str] = (), r: str = "net_r") -> DataFrame:
    """Count, mean and total R, win rate, mean win and loss, profit factor (null without losses), worst trade."""
    return (trades.groupBy(*by) if by else trades).agg(*outcome_columns(r))


def metrics_by_level(trades: DataFrame, levels: Sequence[str], r: str = "net_r") -> DataFrame:
    """The same metrics in total and by each level, in one pass."""
    sets = [[], *([F.col(x)] for x in levels)]
    out = trades.groupingSets(sets, *(F.col(x) for x in levels)).agg(*outcome_columns(r), *(F.grouping(x).alias(f"_g_{x}") for x in levels))
    level = F.lit("total")
    value = F.lit("all")
    for x in levels:
        level = F.when(F.col(f"_g_{x}") == 0, F.lit(x)).otherwise(level)
        value = F.when(F.col(f"_g_{x}") == 0, F.col(x).cast("string")).otherwise(value)
    return out.select(level.alias("level"), value.alias("value"), *(c for c in out.columns if c not in levels and not c.startswith("_g_")))


def unpivoted_buckets(df: DataFrame, buckets: dict[str, Column], r: str = "net_r") -> DataFrame:
    """Metrics by each of several bucket labels."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("bucket")) for k, c in buckets.items()))).alias("b")
    return df.select("*", pairs).groupBy(F.col("b.dimension").alias("dimension"), F.col("b.bucket").alias("bucket")).agg(*outcome_columns(r))


def runner_shares(df: DataFrame, thresholds: Sequence[float], mfe: str = "mfe_r", mae: str = "mae_r") -> DataFrame:
    """Per threshold: share that reached it, share that did without touching the stop, share that touched the stop."""
    x = df.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    share = lambda c: F.round(F.avg(c.cast("double")), 8)
    up = F.col(mfe) >= F.col("threshold")
    return x.groupBy("threshold").agg(F.count("*").alias("rows"), share(up).alias("reached"), share(up & (F.col(mae) > -1)).alias("clean"), share(F.col(mae) <= -1).alias("stopped"))


def equity_curve(trades: DataFrame, initial: float, risk: float, by: Sequence[str], order: Sequence[str], r: str = "net_r", weight: str | None = None, span: int = SPAN) -> DataFrame:
    """Compounded equity in order: initial * product(1 + risk * weight * r); with peak, drawdown and _n (place in its book).

    The first column of order is a number; books are cut into chunks of `span` of its units, and what a chunk passes on
    is one row, so a long book is not one task. A trade may not lose all (1 + risk * weight * r > 0).
    """
    x = trades.withColumn("_step", F.ln(1 + risk * (F.col(weight) if weight else F.lit(1.0)) * F.col(r))).withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(span)))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_l", F.sum("_step").over(inside)).withColumn("_top", F.max("_l").over(inside)).withColumn("_k", F.count("*").over(inside))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(*by, "_chunk").agg(F.sum("_step").alias("_e"), F.max("_l").alias("_m"), F.count("*").alias("_c"))
    ends = ends.withColumn("_b", F.coalesce(F.sum("_e").over(earlier), F.lit(0.0)))
    ends = ends.select(*by, "_chunk", "_b", F.max(F.col("_b") + F.col("_m")).over(earlier).alias("_p"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    x = x.join(ends, [*by, "_chunk"])
    equity, peak = initial * F.exp(F.col("_b") + F.col("_l")), initial * F.exp(F.greatest(F.lit(0.0), F.col("_b") + F.col("_top"), F.coalesce("_p", F.lit(0.0))))
    x = x.select(*trades.columns, (F.col("_o") + F.col("_k")).alias("_n"), equity.alias("equity"), peak.alias("peak"))
    return x.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def longest_drawdown(curve: DataFrame, by: Sequence[str], order: Sequence[str], span: int = SPAN) -> DataFrame:
    """Largest drawdown and the longest run of rows below the peak, per key, of an equity_curve().

    A run is as long as the gap between two rows at the peak, or between the last of them and the end; gaps within a
    chunk and those across chunks are found apart.
    """
    at_peak = F.round("drawdown", 12) <= 0
    x = curve.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(span)))
    peaks = x.where(at_peak).withColumn("_gap", F.col("_n") - F.lag("_n").over(Window.partitionBy(*by, "_chunk").orderBy("_n")) - 1)
    per = x.groupBy(*by, "_chunk").agg(F.max("_n").alias("_end"), F.max("drawdown").alias("_d"), F.max_by("equity", "_n").alias("_q"))
    per = per.join(peaks.groupBy(*by, "_chunk").agg(F.max("_gap").alias("_g"), F.min("_n").alias("_f"), F.max("_n").alias("_z")), [*by, "_chunk"], "left")
    before = F.coalesce(F.max("_z").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_across", F.col("_f") - before - 1)
    g = per.groupBy(*by).agg(F.max("_d").alias("_d"), F.max(F.greatest("_g", "_across")).alias("_r"), F.max("_end").alias("_end"), F.max("_z").alias("_z"), F.max_by("_q", "_end").alias("_q"))
    longest = F.greatest(F.coalesce("_r", F.lit(0)), F.col("_end") - F.coalesce("_z", F.lit(0)))
    return g.select(*by, F.round("_d", 8).alias("max_drawdown"), longest.alias("longest_run"), F.round("_q", 6).alias("final_equity"))


def concurrent_exposure(trades: DataFrame, by: Sequence[str], start: str = "decision_t", end: str = "exit_t", size: str = "size") -> DataFrame:
    """Most trades open at once and most size, per key; at one time exits go before entries, but not before their own."""
    own = F.col(start) == F.col(end)
    events = trades.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("o"), F.lit(1).alias("d"), F.col(size).alias("s")), F.struct(F.col(end).alias("t"), F.when(own, 2).otherwise(0).alias("o"), F.lit(-1).alias("d"), (-F.col(size)).alias("s")))).alias("e")).select(*by, "e.*")
    summed = events.groupBy(*by, "t", "o").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    w = Window.partitionBy(*by).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select(*by, F.sum("d").over(w).alias("open"), F.sum("s").over(w).alias("exposure")).groupBy(*by).agg(F.max("open").alias("max_open"), F.round(F.max("exposure"), 6).alias("max_exposure"))


def monthly_rollup(curve: DataFrame, by: Sequence[str], initial: float, time: str = "decision_t", order: Sequence[str] = ("decision_t", "id"), r: str = "net_r") -> DataFrame:
    """Equity before a month's first trade and after its last, return and gain between them, trades, mean R, win rate and
    profit factor of each month with trades, from an equity_curve(); order is total within a key."""
    month = F.date_format(F.timestamp_seconds(time), "yyyy-MM")
    o, c = F.struct(*order), F.col(r)
    months = curve.groupBy(*by, month.alias("month")).agg(F.max_by("equity", o).alias("last_equity"), F.count("*").alias("trades"), F.avg(c).alias("mean_r"), F.avg((c > 0).cast("double")).alias("win_rate"), ratio(F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)), -F.sum(F.when(c < 0, c))).alias("profit_factor"))
    # One row a month: a small table.
    x = months.withColumn("first_equity", F.coalesce(F.lag("last_equity").over(Window.partitionBy(*by).orderBy("month")), F.lit(initial)))
    return x.withColumn("gain", F.col("last_equity") - F.col("first_equity")).withColumn("month_return", ratio(F.col("last_equity"), F.col("first_equity")) - 1)


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """passed (all checks) and failed (names of those that don't hold; a null check fails)."""
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in ok.items())))
    return df.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def risk_adjusted(curve: DataFrame, by: Sequence[str], day: str = "day", equity: str = "equity", per_year: int = 365) -> DataFrame:
    """Sharpe and Sortino ratios of daily returns of a daily equity table (number of the day), and the annual return.

    Both divide the mean return by a population deviation: of all returns, or of the negative ones only. With fewer than
    two returns, without a negative one (beyond the noise of running sums) or with a deviation of 0, a ratio is 0.
    """
    w = Window.partitionBy(*by).orderBy(day)
    x = curve.withColumn("_r", ratio(F.col(equity), F.lag(equity).over(w)) - 1)
    r = F.col("_r")
    g = x.groupBy(*by).agg(F.avg(r).alias("_m"), F.count(r).alias("_n"), F.stddev_pop(r).alias("_s"), F.stddev_pop(F.when(F.round(r, 12) < 0, r)).alias("_d"), (F.max(day) - F.min(day)).alias("_span"), ratio(F.max_by(equity, day), F.min_by(equity, day)).alias("_g"))
    scaled = lambda d: F.when((F.col("_n") >= 2) & (F.col(d) > 0), F.col("_m") / F.col(d) * F.sqrt(F.lit(float(per_year)))).otherwise(0.0)
    return g.select(*by, scaled("_s").alias("sharpe"), scaled("_d").alias("sortino"), (F.pow(F.col("_g"), F.lit(float(per_year)) / F.greatest(F.col("_span"), F.lit(1))) - 1).alias("annual_return"))


def trade_load(trades: DataFrame, by: Sequence[str], pair: str, start: str, end: str, cost: Column) -> DataFrame:
    """Share of the time in the market of each pair (hours held by hours spanned and pairs), and the sum of costs."""
    x = trades.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("_held"), (F.max(end) - F.min(start)).alias("_span"), F.count_distinct(pair).alias("_pairs"), F.sum(cost).alias("cost_drag"))
    return x.select(*by, (F.col("_held") / (F.greatest(F.col("_span"), F.lit(86400)) * F.greatest(F.col("_pairs"), F.lit(1)))).alias("exposure"), "cost_drag")


def monthly_target(months: DataFrame, by: Sequence[str], r: str, target: float) -> DataFrame:
    """Geometric and arithmetic mean month, shares of months at the target and above zero; -1 where all was lost."""
    c = F.col(r)
    geometric = F.when(F.min(c) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.when(c > -1, F.ln(1 + c))) / F.count(c)) - 1)
    return months.groupBy(*by).agg(F.count(c).alias("months"), geometric.alias("geometric_mean"), F.avg(c).alias("mean_month"), F.avg((c >= target).cast("double")).alias("target_rate"), F.avg((c > 0).cast("double")).alias("positive_rate"))

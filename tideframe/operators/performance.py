"""Trade pricing, performance of equity and holdings, policy and monitoring reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import finite, ratio
from tideframe.operators.metrics import profit_factor


def priced(trades: DataFrame, risk: float, leverage_cap: float, fee: float, slippage: float, funding_per_hour: float, stop: str = "stop_share", gross: str = "gross_r", side: str = "side", hours: str = "hours_held") -> DataFrame:
    """Notional from the risk and the stop's distance (shares of equity), round-trip costs, funding and net R.

    Longs pay funding for the hours held, shorts receive it. R is what the stop would lose.
    """
    notional = F.least(ratio(F.lit(risk), F.col(stop)), F.lit(leverage_cap))
    costs = notional * (2 * (fee + slippage))
    funding = notional * funding_per_hour * F.col(hours) * F.when(F.col(side) == "long", 1.0).otherwise(-1.0)
    x = trades.withColumn("notional_share", notional).withColumn("cost", costs).withColumn("funding", funding)
    return x.withColumn("net_r", F.col(gross) - ratio(F.col("cost") + F.col("funding"), F.col("notional_share") * F.col(stop)))


def daily_equity(curve: DataFrame, by: Sequence[str], time: str, order: Column, equity: str = "equity") -> DataFrame:
    """Last equity of each day between a key's first and last one; days without a trade keep the one before."""
    day = F.floor(F.col(time) / 86400)
    last = curve.groupBy(*by, day.alias("day")).agg(F.max_by(equity, order).alias("_q"))
    span = last.groupBy(*by).agg(F.sequence(F.min("day"), F.max("day")).alias("days"))
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return span.select(*by, F.explode("days").alias("day")).join(last, [*by, "day"], "left").select(*by, "day", F.last("_q", ignorenulls=True).over(w).alias("equity"))


def buy_and_hold(closes: DataFrame, symbol: str, time: str, close: str, symbols: int) -> DataFrame:
    """Equal-weight holding: mean of closes over their first one, at times when all symbols are there."""
    base = closes.groupBy(symbol).agg(F.min_by(close, time).alias("_b"))
    x = closes.join(base, symbol).withColumn("_n", ratio(F.col(close), F.col("_b")))
    return x.groupBy(time).agg(F.avg("_n").alias("index"), F.count("_n").alias("_c")).where(F.col("_c") == symbols).drop("_c")


def basket_index(closes: DataFrame, symbol: str, time: str, close: str) -> DataFrame:
    """Mean of closes over their first one, over the symbols of each time, and how many these are."""
    base = closes.groupBy(symbol).agg(F.min_by(close, time).alias("_b"))
    x = closes.join(base, symbol)
    return x.groupBy(time).agg(F.avg(ratio(F.col(close), F.col("_b"))).alias("index"), F.count("*").alias("symbols"))


def slices(df: DataFrame, conditions: Mapping[str, Column], r: str, least: int, whole: str = "all", useful_rows: int = 30) -> DataFrame:
    """Per named slice, in one pass: rows and mean; best marks the best mean with enough rows; useful one with useful_rows or
    more and a better mean than the slice `whole`."""
    aggs = [c for k, cond in conditions.items() for c in (F.count_if(cond).alias(f"n_{k}"), F.avg(F.when(cond, F.col(r))).alias(f"m_{k}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(f"n_{k}").alias("rows"), F.col(f"m_{k}").alias("mean_r")) for k in conditions)))
    x = df.agg(*aggs).select(rows.alias("s")).select("s.*")  # one row a slice
    best = x.where(F.col("rows") >= least).agg(F.max_by("slice", F.struct("mean_r", "slice")).alias("_best"))
    all_ = x.agg(F.max(F.when(F.col("slice") == whole, F.col("mean_r"))).alias("_all"))
    x = x.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(all_)).withColumn("best", F.coalesce(F.col("slice") == F.col("_best"), F.lit(False)))
    return x.withColumn("useful", F.coalesce((F.col("rows") >= useful_rows) & (F.col("mean_r") > F.col("_all")), F.lit(False))).drop("_best", "_all")


def study_breakdown(trades: DataFrame, levels: Mapping[str, Column], before: str, after: str) -> DataFrame:
    """Per level and value: rows, win rate, means before and after costs and the profit factor, in one pass."""
    keyed = trades.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), c.cast("string").alias("value")) for k, c in levels.items()))).alias("_g"))
    a = F.col(after)
    return keyed.groupBy("_g.level", "_g.value").agg(F.count("*").alias("rows"), F.avg((a > 0).cast("double")).alias("win_rate"), F.avg(before).alias("mean_before"), F.avg(a).alias("mean_after"), profit_factor(a, None).alias("profit_factor"))


def mean_over_runs(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over the runs where it is finite."""
    return runs.groupBy(*by).agg(*(F.avg(finite(F.col(c))).alias(c) for c in metrics))


def swing_metrics(trades: DataFrame, by: Sequence[str], r: str, hours: str, reason: str, exited: Column) -> DataFrame:
    """Closed and open trades, mean, median, win rate and profit factor of closed ones, mean holding, and reasons counted."""
    x = trades.withColumn("_r", F.when(exited, F.col(r)))
    counts = x.where(exited).groupBy(*by, reason).count().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", reason, "count"))), ",").alias("reasons"))
    c = F.col("_r")
    g = x.groupBy(*by).agg(F.count(c).alias("closed"), F.count_if(~exited).alias("open"), F.avg(c).alias("mean_r"), F.median(c).alias("median_r"), F.avg((c > 0).cast("double")).alias("win_rate"), profit_factor(c, None).alias("profit_factor"), F.avg(F.when(exited, F.col(hours))).alias("mean_hours"))
    return g.join(counts, list(by), "left")


def positive_breadth(trades: DataFrame, by: Sequence[str], group: str, r: str) -> DataFrame:
    """Groups of each key, and the share of them with a positive mean."""
    per = trades.groupBy(*by, group).agg(F.avg(r).alias("_m"))
    return per.groupBy(*by).agg(F.count("*").alias("groups"), F.avg((F.col("_m") > 0).cast("double")).alias("positive_share"))


def concentration(trades: DataFrame, group: str, r: str) -> DataFrame:
    """Largest group's share of all rows and of all gains."""
    g = trades.groupBy(group).agg(F.count("*").alias("_n"), F.sum(F.when(F.col(r) > 0, F.col(r)).otherwise(0.0)).alias("_g"))
    return g.agg(F.count("*").alias("groups"), (F.max("_n") / F.sum("_n")).alias("row_share"), (F.max("_g") / F.sum("_g")).alias("gain_share"))


def rule_report(trades: DataFrame, rules: Mapping[str, Column], by: Sequence[str], r: str) -> DataFrame:
    """Per rule and key, in one pass: rows the rule keeps and skips, and the mean of each part. A null rule skips."""
    keep = {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    aggs = [c for k, ok in keep.items() for c in (F.count_if(ok).alias(f"k_{k}"), F.count_if(~ok).alias(f"s_{k}"), F.avg(F.when(ok, F.col(r))).alias(f"mk_{k}"), F.avg(F.when(~ok, F.col(r))).alias(f"ms_{k}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"k_{k}").alias("kept"), F.col(f"s_{k}").alias("skipped"), F.col(f"mk_{k}").alias("mean_kept"), F.col(f"ms_{k}").alias("mean_skipped")) for k in rules)))
    return trades.groupBy(*by).agg(*aggs).select(*by, rows.alias("_r")).select(*by, "_r.*")


def policy_metrics(rows: DataFrame, outcomes: str) -> DataFrame:
    """A map policy -> outcome in each row: mean, rows and positive ones of each policy."""
    x = rows.select(F.explode(outcomes).alias("policy", "outcome"))
    o = F.col("outcome")
    return x.groupBy("policy").agg(F.count(o).alias("rows"), F.avg(o).alias("mean_r"), F.count_if(o > 0).alias("positive"))


def reason_outcomes(rows: DataFrame, reasons: str, r: str) -> DataFrame:
    """Outcomes of skipped rows by each of their reasons; the profit factor is 0 without a loss."""
    x = rows.select(F.explode(reasons).alias("reason"), r)
    c = F.col(r)
    return x.groupBy("reason").agg(F.count(c).alias("rows"), F.avg(c).alias("mean_r"), F.median(c).alias("median_r"), F.avg((c > 0).cast("double")).alias("win_rate"), F.coalesce(profit_factor(c, 0.0), F.lit(0.0)).alias("profit_factor"))


def monitoring(trades: DataFrame, by: Sequence[str], r: str, best: str, time: str, exited: Column, reached: float) -> DataFrame:
    """Closed and open counts, mean R, days spanned, how many reached so many R and how many of those lost."""
    got = exited & (F.col(best) >= reached)
    return trades.groupBy(*by).agg(F.count_if(exited).alias("closed"), F.count_if(~exited).alias("open"), F.avg(F.when(exited, F.col(r))).alias("mean_r"), (F.floor(F.max(time) / 86400) - F.floor(F.min(time) / 86400) + 1).alias("days"), F.count_if(got).alias("reached"), F.count_if(got & (F.col(r) < 0)).alias("reached_then_lost"))


def cost_sensitivity(trades: DataFrame, costs: Mapping[str, Column], by: Sequence[str], gross: str) -> DataFrame:
    """Per cost table, in one pass: rows, mean and win rate of gross R less those costs."""
    net = {k: F.col(gross) - c for k, c in costs.items()}
    aggs = [c for k, x in net.items() for c in (F.count(x).alias(f"n_{k}"), F.avg(x).alias(f"m_{k}"), F.avg((x > 0).cast("double")).alias(f"w_{k}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("costs"), F.col(f"n_{k}").alias("rows"), F.col(f"m_{k}").alias("mean_r"), F.col(f"w_{k}").alias("win_rate")) for k in costs)))
    return trades.groupBy(*by).agg(*aggs).select(*by, rows.alias("_r")).select(*by, "_r.*")


def screen_decisions(per_scenario: DataFrame, baseline: str, min_rows: int, min_mean: float, min_gain: float) -> DataFrame:
    """scenario, rows, mean_r: pass or fail, gain over the baseline scenario, and which passing one is best."""
    base = per_scenario.where(F.col("scenario") == baseline).select(F.col("mean_r").alias("_base"))
    x = per_scenario.crossJoin(F.broadcast(base)).withColumn("gain", F.col("mean_r") - F.col("_base"))
    x = x.withColumn("passed", (F.col("rows") >= min_rows) & (F.col("mean_r") >= min_mean) & (F.col("gain") >= min_gain))
    best = x.agg(F.max_by("scenario", F.when(F.col("passed"), F.struct("mean_r", "scenario"))).alias("_best"))
    return x.crossJoin(F.broadcast(best)).withColumn("best", F.coalesce(F.col("scenario") == F.col("_best"), F.lit(False))).drop("_base", "_best")


def interval_coverage(series: DataFrame, by: Sequence[str], time: str, step: int) -> DataFrame:
    """First and last time, rows, and whether every step between them has one."""
    g = series.groupBy(*by).agg(F.min(time).alias("first_t"), F.max(time).alias("last_t"), F.count_distinct(time).alias("rows"))
    return g.withColumn("complete", F.col("rows") == F.expr(f"(last_t - first_t) div {step} + 1"))


def best_and_worst(df: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """Names of the largest and smallest value; the first name of equal ones."""
    a, b = F.struct(-F.col(value), F.col(name)), F.struct(F.col(value), F.col(name))
    return df.groupBy(*by).agg(F.min_by(name, a).alias("best"), F.max(value).alias("best_value"), F.min_by(name, b).alias("worst"), F.min(value).alias("worst_value"))

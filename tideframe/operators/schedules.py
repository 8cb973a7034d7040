"""Purchase schedules over daily closes, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import clip, ratio


def months(daily: DataFrame) -> DataFrame:
    """Daily closes with month (yyyy-MM) and day of month."""
    return daily.select("*", F.date_format("day", "yyyy-MM").alias("month"), F.dayofmonth("day").alias("dom"))


def complete_months(daily: DataFrame, first: int = 3, last: int = 27) -> DataFrame:
    """Months whose first day is at most `first` and whose last is at least `last`."""
    return months(daily).groupBy("symbol", "month").agg(F.min("dom").alias("first_dom"), F.max("dom").alias("last_dom"), F.count("*").alias("days")).where((F.col("first_dom") <= first) & (F.col("last_dom") >= last))


def fixed_day(daily: DataFrame, days: list[int], monthly: float) -> DataFrame:
    """One purchase a month and schedule: on the first bar on or after the day, else on the month's last bar."""
    x = months(daily).select("*", F.explode(F.array(*map(F.lit, days))).alias("target"))
    late = F.col("dom") >= F.col("target")
    g = x.groupBy("symbol", "month", "target").agg(F.min_by("day", F.when(late, F.col("day"))).alias("_a"), F.min_by("close", F.when(late, F.col("day"))).alias("_ac"), F.max("day").alias("_l"), F.max_by("close", "day").alias("_lc"))
    return g.select("symbol", "month", F.format_string("day_%02d", F.col("target")).alias("schedule"), F.coalesce("_a", "_l").alias("day"), F.coalesce("_ac", "_lc").alias("price"), F.lit(float(monthly)).alias("spend"))


def daily_split(daily: DataFrame, monthly: float) -> DataFrame:
    """The month's money spread evenly over its bars."""
    w = Window.partitionBy("symbol", "month")
    return months(daily).select("symbol", "month", F.lit("daily").alias("schedule"), "day", F.col("close").alias("price"), (monthly / F.count("*").over(w)).alias("spend"))


def trailing_percentile(daily: DataFrame, window: int) -> DataFrame:
    """Share of the window's other closes below the current one (the window includes it), and the weight 2 - 1.5 p.

    Before the window is full the percentile is null and the weight 1.
    """
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-(window - 1), 0)
    x = daily.withColumn("_in", F.collect_list("close").over(w))
    p = F.when(F.size("_in") == window, F.size(F.filter("_in", lambda v: v < F.col("close"))) / (window - 1))
    return x.withColumn("percentile", p).withColumn("weight", F.coalesce(2 - 1.5 * F.col("percentile"), F.lit(1.0))).drop("_in")


def ma_distance_weight(daily: DataFrame, window: int, slope: float = 2.5) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-(window - 1), 0)
    ma = F.when(F.count("close").over(w) == window, F.avg("close").over(w))
    return daily.withColumn("weight", F.coalesce(clip(1 + slope * (1 - ratio(F.col("close"), ma)), 0.5, 2.0), F.lit(1.0)))


def weighted_split(weighted: DataFrame, monthly: float) -> DataFrame:
    """Spend min(1, weight / days left) of what is left each day; the last day takes the rest."""
    w = Window.partitionBy("symbol", "month").orderBy("day")
    x = months(weighted).withColumn("_left", F.count("*").over(Window.partitionBy("symbol", "month")) - F.row_number().over(w) + 1)
    part = F.when(F.col("_left") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") / F.col("_left")))
    x = x.withColumn("_part", part)
    kept = F.coalesce(F.product(1 - F.col("_part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return x.select("symbol", "month", F.lit("weighted").alias("schedule"), "day", F.col("close").alias("price"), (monthly * kept * F.col("_part")).alias("spend"))


def weekly_split(daily: DataFrame, monthly: float, anchors: tuple[int, ...] = (1, 8, 15, 22)) -> DataFrame:
    """The month's money in equal parts, each on the first bar on or after its anchor day, else on the month's last bar."""
    x = fixed_day(daily, list(anchors), monthly / len(anchors))
    g = x.groupBy("symbol", "month", "day").agg(F.first("price").alias("price"), F.sum("spend").alias("spend"))
    return g.select("symbol", "month", F.lit("weekly").alias("schedule"), "day", "price", "spend")


def dip_band(daily: DataFrame, monthly: float, drawdown: float, lookback: int, max_wait_months: int = 3, min_rows: int = 30) -> DataFrame:
    """Hold each month's money until a close is at most (1 - drawdown) of the lookback's high, its own bar included.

    Money arrives on a month's first bar. Each parcel is spent on its first dip, or on the last bar of the first month
    that is max_wait_months later, or on the series' last bar, whichever comes first. There is no dip before the
    lookback has min_rows bars.
    """
    back = Window.partitionBy("symbol").orderBy("day").rowsBetween(-(lookback - 1), 0)
    ahead = Window.partitionBy("symbol").orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    high = F.when(F.count("close").over(back) >= min_rows, F.max("close").over(back))
    x = months(daily).withColumn("_dip", F.coalesce(F.col("close") <= high * (1 - drawdown), F.lit(False)))
    x = x.withColumn("_next", F.min(F.when(F.col("_dip"), F.col("day"))).over(ahead)).withColumn("_m", F.year("day") * 12 + F.month("day"))
    parcels = x.groupBy("symbol", "_m").agg(F.min_by("_next", "day").alias("_next"), F.max("day").alias("_last"))
    late = Window.partitionBy("symbol").orderBy("_m").rangeBetween(max_wait_months, Window.unboundedFollowing)
    whole = Window.partitionBy("symbol")
    spent = parcels.select("symbol", F.least("_next", F.min("_last").over(late), F.max("_last").over(whole)).alias("day"))
    g = spent.groupBy("symbol", "day").agg((F.count("*") * F.lit(float(monthly))).alias("spend"))
    return g.join(months(daily), ["symbol", "day"]).select("symbol", "month", F.lit("dip").alias("schedule"), "day", F.col("close").alias("price"), "spend")


def evaluate(buys: DataFrame, daily: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per key and schedule: spent, units, cost basis against the mean, harmonic mean and range of closes, and worth at the end."""
    c = F.col("close")
    end = daily.groupBy(*by).agg(F.max_by("close", "day").alias("last_close"), F.avg(c).alias("mean_close"), (F.count("*") / F.sum(1 / c)).alias("harmonic_close"), F.min(c).alias("best"), F.max(c).alias("worst"))
    g = buys.groupBy(*by, "schedule").agg(F.count("*").alias("buys"), F.sum("spend").alias("spent"), F.sum(F.col("spend") / F.col("price")).alias("units"))
    x = g.join(end, list(by)).withColumn("cost_basis", F.col("spent") / F.col("units"))
    basis = F.col("cost_basis")
    return x.select(
        *by, "schedule", "buys", "spent", "units", "cost_basis", (F.col("units") * F.col("last_close")).alias("value"),
        ((basis / F.col("mean_close") - 1) * 100).alias("vs_mean_pct"), ((basis / F.col("harmonic_close") - 1) * 100).alias("vs_harmonic_pct"),
        "best", "worst", ratio(basis - F.col("best"), F.col("worst") - F.col("best")).alias("position_in_range"),
    )


def rolling_campaigns(daily: DataFrame, length: int, step: int = 1) -> DataFrame:
    """Daily closes of every campaign: each start month (month number) with all of its `length` months of data.

    A bar is in at most `length` campaigns.
    """
    x = daily.withColumn("_m", F.year("day") * 12 + F.month("day") - 1)
    span = x.groupBy("symbol").agg(F.min("_m").alias("_a"), F.max("_m").alias("_z"))
    starts = F.explode(F.sequence(F.greatest(F.col("_a"), F.col("_m") - (length - 1)), F.least(F.col("_m"), F.col("_z") - (length - 1))))
    y = x.join(span, "symbol").where(F.greatest(F.col("_a"), F.col("_m") - (length - 1)) <= F.least(F.col("_m"), F.col("_z") - (length - 1)))
    return y.select(*daily.columns, starts.alias("start")).where((F.col("start") % step) == 0)


def paired_summary(results: DataFrame, by: list[str], base: str = "day_", value: str = "cost_basis") -> DataFrame:
    """Per schedule: mean gap in percent to the campaign's mean over schedules named base..., and its 5th and 95th percentile."""
    ref = F.avg(F.when(F.col("schedule").startswith(base), F.col(value))).over(Window.partitionBy(*by))
    gap = results.withColumn("gap", (F.col(value) / ref - 1) * 100)
    q = F.percentile("gap", F.array(F.lit(0.05), F.lit(0.95)))
    return gap.groupBy("schedule").agg(F.count("*").alias("campaigns"), F.avg("gap").alias("mean_gap"), q.alias("_q")).select("schedule", "campaigns", "mean_gap", F.col("_q")[0].alias("p5"), F.col("_q")[1].alias("p95"))


def versus_fixed_days(results: DataFrame, value: str = "cost_basis") -> DataFrame:
    """Percentage gap of each schedule to the mean of the symbol's fixed days."""
    base = F.avg(F.when(F.col("schedule").startswith("day_"), F.col(value))).over(Window.partitionBy("symbol"))
    return results.withColumn("gap_pct", (F.col(value) / base - 1) * 100)


def intramonth_bias(daily: DataFrame, dom: int, min_days: int = 25) -> DataFrame:
    """How the close on or after a day of month compares with the month's mean."""
    x = months(daily)
    late = F.when(F.col("dom") >= dom, F.col("day"))
    g = x.groupBy("symbol", "month").agg(F.coalesce(F.min_by("close", late), F.max_by("close", "day")).alias("_c"), F.avg("close").alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= min_days)
    gap = (F.col("_c") / F.col("_m") - 1) * 100
    return g.groupBy("symbol").agg(F.count("*").alias("months"), F.round(F.avg(gap), 8).alias("mean_gap"), F.round(F.stddev_pop(gap), 8).alias("sd_gap"), F.round(F.avg((gap > 0).cast("double")), 8).alias("share_above"))

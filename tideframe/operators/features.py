"""Point-in-time features of a bar series. All columns of a set share one window order, hence one sort.

Rolling columns are null until their frame is full unless said otherwise; deviations are those of the population; a
zero divisor gives null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tideframe.functions.scalars import change, flag, ratio, sign, steps
from tideframe.operators import chunks
from tideframe.operators.asof import asof, asof_for_all
from tideframe.operators.scan import ema_weights, recurrence, weighted_lags


@dataclass(frozen=True)
class Series:
    """Window specs of a series key and its order."""

    by: tuple[str, ...] = ("symbol",)
    order: str = "t"

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.order)

    def frame(self, n: int, skip: int = 0) -> WindowSpec:
        """The n rows that end `skip` rows back."""
        return self.w.rowsBetween(-(n - 1) - skip, -skip)

    def full(self, c: Column, n: int, f, skip: int = 0) -> Column:
        """f(c) over the frame, null until it has n values."""
        frame = self.frame(n, skip)
        return F.when(F.count(c).over(frame) == n, f(c).over(frame))

    def back(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)


def returns(s: Series, close: str = "close", lags: tuple[int, ...] = (1, 2)) -> dict[str, Column]:
    return {f"return_{n}": change(F.col(close), s.back(close, n)) for n in lags}


def moving_average(s: Series, n: int, close: str = "close") -> dict[str, Column]:
    c = F.col(close)
    ma, before = s.full(c, n, F.avg), s.full(c, n, F.avg, 1)
    slope = change(ma, before)
    return {"ma": ma, "ma_slope": slope, "ma_slope_sign": sign(slope), "above_ma": flag(c >= ma)}


def rolling_extremes(s: Series, n: int) -> dict[str, Column]:
    """Distance from the frame's high and low; short frames count."""
    c = F.col("close")
    return {"from_high": change(c, F.max("high").over(s.frame(n))), "from_low": change(c, F.min("low").over(s.frame(n)))}


def range_position(s: Series, n: int) -> dict[str, Column]:
    low, high = s.full(F.col("low"), n, F.min), s.full(F.col("high"), n, F.max)
    return {"range_position": ratio(F.col("close") - low, high - low)}


def zscore(s: Series, c: Column, n: int, skip: int = 0, min_rows: int | None = None) -> Column:
    """(c - mean) / deviation of the n rows that end `skip` rows back."""
    frame = s.frame(n, skip)
    enough = F.count(c).over(frame) >= (min_rows or n)
    return F.when(enough, ratio(c - F.avg(c).over(frame), F.stddev_pop(c).over(frame)))


def relative_volume(s: Series, n: int) -> dict[str, Column]:
    v = F.col("volume").cast("double")
    return {"relative_volume": ratio(v, s.full(v, n, F.avg)), "volume_z": zscore(s, v, n)}


def volatility_expansion(s: Series, n: int) -> dict[str, Column]:
    span = F.col("high") - F.col("low")
    x = ratio(span, s.full(span, n, F.avg))
    return {"volatility_expansion": x, "volatility_bucket": steps(x, [0.75, 1.5, 2.5])}


def timeframe_features(bars: DataFrame, n: int, prefix: str, s: Series = Series()) -> DataFrame:
    """Return, trend flag, sign of the mean's slope, range position and volatility bucket of derived bars over n of them."""
    c = {**returns(s, lags=(1,)), **moving_average(s, n), **range_position(s, n), **volatility_expansion(s, n)}
    names = {"return_1": "return_1", "above_ma": f"trend_above_ma_{n}", "ma_slope_sign": f"ma_slope_sign_{n}", "range_position": f"range_position_{n}", "volatility_bucket": f"volatility_bucket_{n}"}
    return bars.select("*", *(c[k].alias(f"{prefix}_{v}") for k, v in names.items()))


def realized_volatility(s: Series, n: int, ret: str) -> dict[str, Column]:
    """Deviation of the n - 1 returns within the frame."""
    return {"realized_volatility": s.full(F.col(ret), n - 1, F.stddev_pop)}


def windowed_ema(s: Series, n: int, name: str = "ema", seed: str = "first", span: int | None = None) -> dict[str, Column]:
    return {name: weighted_lags("close", ema_weights(n, span, seed), s.w)}


def windowed_macd_line(s: Series, n: int) -> dict[str, Column]:
    """Fast less slow, each an exponential mean over its own frame."""
    fast = max(2, n // 2)
    return {"macd": weighted_lags("close", ema_weights(fast), s.w) - weighted_lags("close", ema_weights(n), s.w)}


def windowed_macd_signal(s: Series, n: int) -> dict[str, Column]:
    k = max(2, n // 3)
    signal = weighted_lags("macd", ema_weights(k), s.w)
    return {"macd_signal": signal, "macd_histogram": F.col("macd") - signal}


def windowed_rsi(s: Series, n: int) -> dict[str, Column]:
    """Mean gain against mean loss of n - 1 changes (column _change): 50 without changes, 100 without losses."""
    frame = s.frame(n - 1)
    gain, loss = (F.sum(F.greatest(x, F.lit(0.0))).over(frame) / (n - 1) for x in (F.col("_change"), -F.col("_change")))
    full = F.count("_change").over(frame) == n - 1
    return {"rsi": F.when(~full, None).when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))}


def true_range(s: Series) -> Column:
    prev = s.back("close")
    h, low = F.col("high"), F.col("low")
    return F.coalesce(F.greatest(h - low, F.abs(h - prev), F.abs(low - prev)), h - low)


def atr(s: Series, n: int) -> dict[str, Column]:
    """Mean of true ranges (column true_range), and as a share of the close."""
    a = s.full(F.col("true_range"), n, F.avg)
    return {"atr": a, "atr_share": ratio(a, F.col("close"))}


def bollinger(s: Series, n: int) -> dict[str, Column]:
    c = F.col("close")
    mean, dev = s.full(c, n, F.avg), s.full(c, n, F.stddev_pop)
    return {"bollinger_position": ratio(c - (mean - 2 * dev), 4 * dev), "bollinger_width": ratio(4 * dev, mean)}


def directional(s: Series, n: int) -> dict[str, Column]:
    """Sums of directional movement over true range, of the rows within the frame but its first."""
    frame = s.frame(n - 1)
    full = F.count("close").over(s.frame(n)) == n
    tr = F.sum("true_range").over(frame)
    plus, minus = (F.when(full, ratio(F.sum(c).over(frame), tr) * 100) for c in ("_plus", "_minus"))
    return {"plus_di": plus, "minus_di": minus, "adx_proxy": ratio(F.abs(plus - minus), plus + minus) * 100}


def movements(s: Series) -> dict[str, Column]:
    up, down = F.col("high") - s.back("high"), s.back("low") - F.col("low")
    return {"_plus": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), "_minus": F.when((down > up) & (down > 0), down).when(up.isNotNull(), 0.0)}


def candle_shape() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - low
    top, bottom = F.greatest(o, c), F.least(o, c)
    return {"close_location": ratio(c - low, span), "body_ratio": ratio(F.abs(c - o), span), "upper_wick": ratio(h - top, span), "lower_wick": ratio(bottom - low, span), "body_pressure": ratio(c - o, span), "wick_pressure": ratio((bottom - low) - (h - top), span)}


def consecutive(s: Series, bullish: bool = True, carried: Column | None = None) -> Column:
    """Length of the current run of bars that close up (or down); needs column _n, the row's number from 0.

    carried: number of the last row that broke a run before the chunk at hand.
    """
    match = F.col("close") >= F.col("open") if bullish else F.col("close") < F.col("open")
    before = s.w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.when(~match, F.col("_n"))).over(before)
    return F.col("_n") - F.coalesce(broken, F.lit(-1) if carried is None else F.coalesce(carried, F.lit(-1)))


def taker_flow(s: Series, n: int) -> dict[str, Column]:
    r = F.col("taker_ratio")
    return {"taker_imbalance": 2 * r - 1, "taker_mean": s.full(r, n, F.avg), "taker_z": zscore(s, r, n)}


def correlation_beta(s: Series, n: int, own: str, ref: str) -> dict[str, Column]:
    """Correlation with, and beta against, paired returns; two pairs are enough, no deviation gives null."""
    frame = s.frame(n)
    both = F.col(own).isNotNull() & F.col(ref).isNotNull()
    x, y = F.when(both, F.col(own)), F.when(both, F.col(ref))
    enough = F.count(x).over(frame) >= 2
    cov, vx, vy = F.covar_pop(x, y).over(frame), F.var_pop(x).over(frame), F.var_pop(y).over(frame)
    return {"correlation": F.when(enough & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)), "beta": F.when(enough & (vy > 0), ratio(cov, vy))}


#: Specs of a series that in_chunks() has cut.
CHUNKED = Series(("symbol", "_chunk"))


def in_chunks(bars: DataFrame, s: Series, halo: int, span: int = chunks.SPAN) -> DataFrame:
    """Bars in chunks of time with `halo` bars before each; features of specs CHUNKED then equal those of whole series."""
    return chunks.in_chunks(bars, list(s.by), s.order, halo, span)


def own_rows(features: DataFrame) -> DataFrame:
    """The rows themselves, without halos."""
    return chunks.own_rows(features, keep_row=True)


def chunked_core_features(bars: DataFrame, n: int = 20, span: int = chunks.SPAN) -> DataFrame:
    """core_features() without a task that holds a whole series."""
    return own_rows(core_features(in_chunks(bars, Series(), 3 * n, span), n, CHUNKED)).drop("_row")


def core_features(bars: DataFrame, n: int = 20, s: Series = Series()) -> DataFrame:
    """The rolling feature set of one window length. No frame but those of the runs reaches back over 3 n rows; in
    chunks, a run's start is carried from earlier ones."""
    in_parts = "_chunk" in bars.columns
    if in_parts:
        up = F.col("close") >= F.col("open")
        bars = chunks.last_before(bars, [c for c in s.by if c != "_chunk"], {"_bull": F.when(~up, F.col("_row")), "_bear": F.when(up, F.col("_row"))})
    first = {
        **returns(s),
        **moving_average(s, n),
        **rolling_extremes(s, n),
        **range_position(s, n),
        **relative_volume(s, n),
        **volatility_expansion(s, n),
        **windowed_ema(s, n),
        **windowed_macd_line(s, n),
        **bollinger(s, n),
        **candle_shape(),
        **movements(s),
        "true_range": true_range(s),
        "taker_ratio": ratio(F.col("taker_buy"), F.col("quote_volume")),
        "_change": F.col("close") - s.back("close"),
        "_n": F.col("_row") if in_parts else F.row_number().over(s.w) - 1,
    }
    x = bars.select("*", *(c.alias(k) for k, c in first.items()))
    second = {
        **realized_volatility(s, n, "return_1"),
        **windowed_macd_signal(s, n),
        **windowed_rsi(s, n),
        **atr(s, n),
        **directional(s, n),
        **taker_flow(s, n),
        "bull_run": consecutive(s, True, F.col("_bull") if in_parts else None),
        "bear_run": consecutive(s, False, F.col("_bear") if in_parts else None),
        "range_z": zscore(s, F.col("high") - F.col("low"), n),
    }
    return x.select("*", *(c.alias(k) for k, c in second.items())).drop("_plus", "_minus", "_change", "_n", "_bull", "_bear")


def reference_features(bars: DataFrame, reference: str, n: int = 20, time: str = "t", s: Series = Series()) -> DataFrame:
    """Returns of a reference symbol at the same time, the difference, and correlation and beta; needs return_1."""
    at = Window.partitionBy(time)
    x = bars.withColumn("ref_return", F.max(F.when(F.col("symbol") == reference, F.col("return_1"))).over(at))
    return x.select("*", (F.col("return_1") - F.col("ref_return")).alias("relative_return"), *(c.alias(k) for k, c in correlation_beta(s, n, "return_1", "ref_return").items()))


def breadth(features: DataFrame, time: str = "t") -> DataFrame:
    """Per time: share of rising symbols, mean return, share above the mean, mean taker flow, and the mean of the shares."""
    share = lambda c: F.avg(c.cast("double"))
    out = features.groupBy(time).agg(share(F.col("return_1") > 0).alias("positive_share"), F.avg("return_1").alias("mean_return"), share(F.col("above_ma") == 1).alias("above_ma_share"), F.avg("taker_ratio").alias("mean_taker"), F.count("*").alias("symbols"))
    parts = F.filter(F.array("positive_share", "above_ma_share"), lambda x: x.isNotNull())
    return out.withColumn("risk_on", ratio(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.size(parts)))


# Recursive indicators -----------------------------------------------------------------------------------------------


def ema(df: DataFrame, source: str, span: int, to: str, s: Series = Series()) -> DataFrame:
    return recurrence(df, list(s.by), s.order, {to: (source, 2 / (span + 1))}, {to: span})


def wilder(df: DataFrame, source: str, period: int, to: str, s: Series = Series()) -> DataFrame:
    return recurrence(df, list(s.by), s.order, {to: (source, 1 / period)}, {to: period})


def wilder_inputs(s: Series) -> dict[str, Column]:
    """Gains, losses, true range and directional movements, which start from 0 at a series' first bar."""
    d = F.col("close") - s.back("close")
    moves = {k: F.coalesce(c, F.lit(0.0)) for k, c in movements(s).items()}
    return {"_gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), "true_range": true_range(s), **moves}


def _recursive(x: DataFrame, by: list[str], order: str, means: dict[str, tuple[str, float, int]], rsi_period: int, atr_period: int, adx_period: int) -> DataFrame:
    """Wilder RSI, ATR and ADX, MACD 12/26/9 and further exponential means (name -> column, alpha, rows) of rows that have
    wilder_inputs() and their number _row."""
    a = 1 / adx_period
    first = {"_g": ("_gain", 1 / rsi_period, rsi_period), "_l": ("_loss", 1 / rsi_period, rsi_period), "wilder_atr": ("true_range", 1 / atr_period, atr_period), "_tr": ("true_range", a, adx_period), "_sp": ("_plus", a, adx_period), "_sm": ("_minus", a, adx_period), "_e12": ("close", 2 / 13, 12), "_e26": ("close", 2 / 27, 26), **means}
    x = recurrence(x, by, order, {k: v[:2] for k, v in first.items()}, {k: v[2] for k, v in first.items()}, "_row")
    plus, minus = ratio(F.col("_sp"), F.col("_tr")) * 100, ratio(F.col("_sm"), F.col("_tr")) * 100
    x = x.select(
        "*",
        F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("_g"), F.col("_l")))).alias("wilder_rsi"),
        plus.alias("wilder_plus_di"),
        minus.alias("wilder_minus_di"),
        F.coalesce(ratio(F.abs(plus - minus), plus + minus) * 100, F.lit(0.0)).alias("_dx"),
        (F.col("_e12") - F.col("_e26")).alias("macd_line"),
    )
    x = recurrence(x, by, order, {"wilder_adx": ("_dx", a), "macd_line_signal": ("macd_line", 2 / 10)}, {"wilder_adx": adx_period, "macd_line_signal": 9}, "_row")
    return x.withColumn("macd_line_histogram", F.col("macd_line") - F.col("macd_line_signal")).drop("_gain", "_loss", "_plus", "_minus", "_g", "_l", "_tr", "_sp", "_sm", "_e12", "_e26", "_dx")


def wilder_indicators(bars: DataFrame, rsi_period: int = 14, atr_period: int = 20, adx_period: int = 14, s: Series = Series()) -> DataFrame:
    """Wilder RSI, ATR and ADX, MACD 12/26/9 and Keltner position, in chunks of time."""
    x = in_chunks(bars.drop("true_range"), s, 1)
    x = own_rows(x.select("*", *(c.alias(k) for k, c in wilder_inputs(Series((*s.by, "_chunk"), s.order)).items())))
    x = _recursive(x, list(s.by), s.order, {"_e20": ("close", 2 / 21, 20)}, rsi_period, atr_period, adx_period)
    keltner = ratio(F.col("close") - (F.col("_e20") - F.col("wilder_atr")), 2 * F.col("wilder_atr"))
    return x.withColumn("keltner_position", keltner).drop("_e20", "_row")


def study_frame(bars: DataFrame, s: Series = Series(), span: int = chunks.SPAN) -> DataFrame:
    """Indicator frame of a series of bars (open, high, low, close, quote_volume, taker_buy, trades): ATR, RSI, ADX,
    exponential means of 8, 18, 50 and 200 bars, MACD, Bollinger, Keltner and Donchian positions, returns, volatility,
    participation and candle shape. A column is null until its frame is full; macd_above_signal is 0 until then.

    Rolling columns are made in chunks of time with the rows before them, recursive ones from chunk ends; what rolls over
    recursive columns follows in chunks again. No task holds a series.
    """
    inner = Series((*s.by, "_chunk"), s.order)
    c = F.col("close")
    volume, trades = (F.nullif(F.col(x).cast("double"), F.lit(0.0)) for x in ("quote_volume", "trades"))
    x = in_chunks(bars, s, 64, span)
    bands = bollinger(inner, 20)
    high, low = inner.full(F.col("high"), 20, F.max, 1), inner.full(F.col("low"), 20, F.min, 1)
    shape = candle_shape()
    x = x.select("*", *(v.alias(k) for k, v in {
        **wilder_inputs(inner),
        **returns(inner, lags=(1, 6, 30)),
        "boll_position": bands["bollinger_position"],
        "boll_width": bands["bollinger_width"],
        "donchian_high": high,
        "donchian_low": low,
        "taker_buy_share": F.col("taker_buy") / volume,
        "volume_z": zscore(inner, F.col("quote_volume").cast("double"), 60),
        "_trade_size": volume / trades,
        "body_fraction": shape["body_ratio"],
        "upper_wick": shape["upper_wick"],
        "lower_wick": shape["lower_wick"],
    }.items()))
    x = x.select("*", inner.full(F.col("return_1"), 30, F.stddev_pop).alias("realized_vol"), zscore(inner, F.col("_trade_size"), 60).alias("trade_size_z"))
    means = {f"_m{n}": ("close", 2 / (n + 1), n) for n in (8, 18, 20, 50, 200)}
    x = _recursive(own_rows(x), list(s.by), s.order, means, 14, 20, 14)
    atr_, span_ = F.col("wilder_atr"), F.col("donchian_high") - F.col("donchian_low")
    x = x.select("*", atr_.alias("atr"), ratio(atr_, c).alias("atr_pct"), F.col("wilder_rsi").alias("rsi"), F.col("wilder_adx").alias("adx"), (F.col("_m8") / c - 1).alias("ema_short_rel"), (F.col("_m50") / c - 1).alias("ema_long_rel"), (F.signum(F.col("_m8") - F.col("_m18")) + F.signum(F.col("_m50") - F.col("_m200"))).alias("ema_stack"), ratio(F.col("macd_line_histogram"), atr_).alias("macd_hist_norm"), F.coalesce((F.col("macd_line") > F.col("macd_line_signal")).cast("double"), F.lit(0.0)).alias("macd_above_signal"), ratio(c - (F.col("_m20") - atr_), 2 * atr_).alias("keltner_position"), ratio(c - F.col("donchian_low"), span_).alias("donchian_position"), ratio(F.nullif(span_, F.lit(0.0)), atr_).alias("donchian_span_atr"))
    # Rolling over recursive columns.
    x = in_chunks(x.drop("_row"), s, 64, span)
    x = x.select("*", (F.col("_m50") / inner.back("_m50", 5) - 1).alias("ema_long_slope"), zscore(inner, F.col("realized_vol"), 60).alias("vol_of_vol"), zscore(inner, F.col("atr_pct"), 60).alias("atr_pct_z"))
    inside = ["_row", "_trade_size", "true_range", "wilder_atr", "wilder_rsi", "wilder_adx", "wilder_plus_di", "wilder_minus_di", "macd_line", "macd_line_signal", "macd_line_histogram", *means]
    return own_rows(x).drop(*inside)


#: Columns of the study frame that a coarser frame gives as context, under a prefix.
CONTEXT = ("rsi", "adx", "atr_pct", "ema_long_rel", "ema_long_slope", "donchian_position", "return_6", "realized_vol")


def study_features(bars: DataFrame, daily: DataFrame, reference: str, s: Series = Series(), close_t: str = "close_t") -> DataFrame:
    """study_frame() of bars with the context of daily bars that are closed by then: the series' own under d1_, that of a
    reference series under ref_, hour of the day and day of the week (Monday is 0) of the bar's begin."""
    own = study_frame(daily, s).select(*s.by, F.col(close_t).alias("_known"), *(F.col(c).alias(f"d1_{c}") for c in CONTEXT))
    x = asof(study_frame(bars, s), own, close_t, "_known", list(s.by), [f"d1_{c}" for c in CONTEXT]).drop("_known")
    other = own.where(F.col(s.by[0]) == reference).select("_known", *(F.col(f"d1_{c}").alias(f"ref_{c}") for c in ("ema_long_rel", "realized_vol", "return_6")))
    x = asof_for_all(x, other, close_t, "_known", ["ref_ema_long_rel", "ref_realized_vol", "ref_return_6"], 7 * 86400)
    at = F.timestamp_seconds(s.order)
    return x.withColumn("hour_of_day", F.hour(at)).withColumn("day_of_week", F.weekday(at))


def donchian(s: Series, n: int) -> dict[str, Column]:
    """High and low of the n bars before this one."""
    high, low = s.full(F.col("high"), n, F.max, 1), s.full(F.col("low"), n, F.min, 1)
    return {"donchian_high": high, "donchian_low": low, "donchian_position": ratio(F.col("close") - low, high - low)}

"""Scalar column functions: text, time, ratios, buckets, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quote assets that a symbol may end with.
QUOTE_ASSETS = ("USDT", "USDC", "BUSD", "BTC", "ETH")


def clean_text(c: Column, case: str | None = None) -> Column:
    """Trimmed; blank becomes null; case is lower, upper or None."""
    t = F.nullif(F.trim(c), F.lit(""))
    return F.lower(t) if case == "lower" else F.upper(t) if case == "upper" else t


def base_asset(symbol: Column, quote: str = "USDT") -> Column:
    return F.regexp_replace(symbol, f"{quote}$", "")


def quote_asset(symbol: Column) -> Column:
    out = F.lit(None).cast("string")
    for q in reversed(QUOTE_ASSETS):
        out = F.when(symbol.endswith(q), F.lit(q)).otherwise(out)
    return out


def timeframe_seconds(timeframe: Column) -> Column:
    """Seconds of 15m, 4h or 1d; null for anything else."""
    n = F.regexp_extract(timeframe, r"^(\d+)([mhd])$", 1)
    unit = F.regexp_extract(timeframe, r"^(\d+)([mhd])$", 2)
    size = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.try_multiply(n.try_cast("bigint"), size.cast("bigint"))


def from_epoch(value: Column) -> Column:
    """Timestamp of epoch milliseconds, or microseconds where the number is too large for milliseconds."""
    return F.when(value > 10_000_000_000_000, F.timestamp_micros(value)).otherwise(F.timestamp_millis(value))


def rfc3339(text: Column) -> Column:
    """Instant of a text with Z or an offset; null where there is no zone."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is null or b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: by 0 it is infinite, of 0 by 0 not a number; null where either is null."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).when(a < 0, -inf)))


def change(now: Column, before: Column) -> Column:
    """now / before - 1."""
    return ratio(now, before) - 1


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).when(x.isNotNull(), 0)


def flag(x: Column) -> Column:
    return F.when(x, 1).when(~x, 0)


def steps(x: Column, limits: list[float]) -> Column:
    """Number of limits that x has reached."""
    out = F.when(x.isNotNull(), len(limits))
    for i, limit in reversed(list(enumerate(limits))):
        out = F.when(x < limit, i).otherwise(out)
    return out


def clip(x: Column, low: float, high: float) -> Column:
    """x within low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def bps(a: Column, b: Column) -> Column:
    return ratio(a - b, b) * 10000


def session_of(hour: Column) -> Column:
    """asia before 8, europe before 16, else us (UTC hours)."""
    return F.when(hour < 8, "asia").when(hour < 16, "europe").when(hour.isNotNull(), "us")


def stop_and_target(entry: Column, side: Column, stop: Column | float, target: Column | float) -> tuple[Column, Column]:
    """Prices at distances given as shares of the entry price."""
    s, t = (x if isinstance(x, Column) else F.lit(x) for x in (stop, target))
    long = side == "long"
    return F.when(long, entry * (1 - s)).otherwise(entry * (1 + s)), F.when(long, entry * (1 + t)).otherwise(entry * (1 - t))


def in_r(price: Column, entry: Column, side: Column, risk: Column) -> Column:
    """Distance from the entry in units of risk, positive in the trade's favour."""
    return ratio(F.when(side == "long", price - entry).otherwise(entry - price), risk)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def wallet_ok(address: Column) -> Column:
    return F.coalesce(address.rlike(r"^0x[0-9a-fA-F]{40}$"), F.lit(False))


def canonical_json(*columns: Column) -> Column:
    """JSON of a row whose numbers with an exponent are written as Python and SQL write them: 0.0001, 12345678.5, -9e-05,
    1e+16. Numbers inside arrays and structs stay as they are."""
    parts = []
    for c in columns:
        text = F.to_json(F.struct(c))
        field = F.regexp_extract(text, r'^\{(".*":)-?\d+\.\d+E-?\d+\}$', 1)
        number = F.regexp_extract(text, r":(-?\d+\.\d+E-?\d+)\}$", 1)
        power = F.regexp_extract(number, r"E(-?\d+)$", 1).try_cast("int")
        plain = F.regexp_replace(F.regexp_replace(number.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
        short = F.concat(F.regexp_replace(F.regexp_replace(number, "E.*$", ""), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        short = F.when(F.abs(power) > 99, F.concat(F.regexp_extract(short, "^.*e.", 0), F.abs(power).cast("string"))).otherwise(short)
        inner = F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)
        parts.append(F.nullif(F.when(field == "", inner).when(power.between(-4, 15), F.concat(field, plain)).otherwise(F.concat(field, short)), F.lit("")))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of a row."""
    return F.sha2(canonical_json(*columns), 256)


def rfc3339_text(at: Column) -> Column:
    """An instant as text in UTC with Z, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def calendar_keys(at: Column) -> dict[str, Column]:
    return {"month": F.date_format(at, "yyyy-MM"), "day": F.to_date(at), "quarter": F.concat(F.year(at).cast("string"), F.lit("-Q"), F.quarter(at).cast("string"))}


def time_between(later: Column, earlier: Column, unit: str) -> Column:
    """Hours, minutes or seconds from one instant to another, with fractions."""
    size = {"hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000}[unit]
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(size))


def atr_stop_and_target(entry: Column, side: Column, atr: Column, stop: float, target: float) -> tuple[Column, Column]:
    """Prices at multiples of the average true range from the entry."""
    long = side == "long"
    return F.when(long, entry - stop * atr).otherwise(entry + stop * atr), F.when(long, entry + target * atr).otherwise(entry - target * atr)


def more_protective(side: Column, a: Column, b: Column) -> Column:
    """Of two stops, the one nearer to the entry."""
    return F.when(side == "long", F.greatest(a, b)).otherwise(F.least(a, b))


def last_with_prefix(df: DataFrame, prefix: str) -> Column:
    """The last column that is named prefix or prefix_N; null without one."""
    named = [c for c in df.columns if re.fullmatch(rf"{re.escape(prefix)}(_\d+)?", c)]
    return F.col(named[-1]) if named else F.lit(None).cast("double")


def mean_of_present(*columns: Column) -> Column:
    """Mean of the values that are there; null without any."""
    parts = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return ratio(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.size(parts))

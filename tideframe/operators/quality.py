"""Checks of source tables: rules, duplicates, gaps, order, coverage, manifests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import clean_text, rfc3339

# Columns of a candle source, and columns that only the future can fill.
CANDLE_COLUMNS = (
    "schema_version", "venue", "market_type", "symbol", "base_asset", "quote_asset", "timeframe", "open_time", "close_time",
    "source_available_at", "open", "high", "low", "close", "volume", "quote_volume", "number_of_trades",
    "taker_buy_base_volume", "taker_buy_quote_volume", "data_source", "source_file", "checksum",
)
LEAKAGE_COLUMNS = (
    "forward_return_1", "forward_return_3", "forward_return_12", "max_favorable_excursion_r", "max_adverse_excursion_r",
    "target_before_stop", "expected_r_after_costs", "no_trade_reason", "gross_r", "net_r", "exit_time", "exit_reason",
)


def require_columns(df: DataFrame, needed: Iterable[str], forbidden: Iterable[str] = LEAKAGE_COLUMNS) -> DataFrame:
    """df itself, or ValueError when a column is missing or one is there that knows the future."""
    missing, leaking = sorted(set(needed) - set(df.columns)), sorted(set(forbidden) & set(df.columns))
    if missing or leaking:
        raise ValueError(f"missing columns: {missing}; columns that know the future: {leaking}")
    return df


def normalize_candles(raw: DataFrame) -> DataFrame:
    """Typed candles from text columns: trimmed, cased, times as instants, prices as decimals; bad values become null."""
    lower, upper = ("venue", "market_type", "timeframe"), ("symbol", "base_asset", "quote_asset")
    prices = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")
    times = ("open_time", "close_time", "source_available_at")
    out = []
    for c in raw.columns:
        x = F.col(c)
        t = clean_text(x, "lower" if c in lower else "upper" if c in upper else None)
        out.append((t.try_cast("decimal(38,18)") if c in prices else t.try_cast("bigint") if c == "number_of_trades" else rfc3339(t) if c in times else t).alias(c))
    return raw.select(*out)


def violations(df: DataFrame, rules: dict[str, Column], to: str = "violations") -> DataFrame:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return df.withColumn(to, F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()))))


def candle_rules(open_t: str = "t", close_t: str = "close_t") -> dict[str, Column]:
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return {
        "close_after_open": F.col(close_t) > F.col(open_t),
        "positive_prices": (o > 0) & (h > 0) & (low > 0) & (c > 0),
        "high_not_below_low": h >= low,
        "high_covers_body": h >= F.greatest(o, c),
        "low_covers_body": low <= F.least(o, c),
        "volume_not_negative": v >= 0,
        "range_within_limit": (h - low) / F.greatest(o, F.lit(1.0)) <= 1.0,
    }


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the largest `order`."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *(F.col("_r")[c].alias(c) for c in rest)).select(*df.columns)


def gaps(df: DataFrame, by: Sequence[str], time: str, expected: int | Column, tolerance: int = 0) -> DataFrame:
    """Rows that follow their predecessor by more than `expected` (+ tolerance) units, with that distance."""
    w = Window.partitionBy(*by).orderBy(time)
    x = df.select(*by, F.lag(time).over(w).alias("previous"), F.col(time).alias("next")).withColumn("distance", F.col("next") - F.col("previous"))
    return x.where(F.col("distance") > (expected if isinstance(expected, Column) else F.lit(expected)) + tolerance)


def out_of_order(df: DataFrame, by: Sequence[str], arrival: str, time: str) -> DataFrame:
    """Rows whose time lies before one that arrived earlier."""
    w = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("latest_before", F.max(time).over(w)).where(F.col(time) < F.col("latest_before"))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nulls, rows, share."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(columns)))).alias("p")
    return counts.select(pairs, "rows").select("p.column", "p.nulls", "rows", F.try_divide(F.col("nulls"), F.col("rows")).alias("share"))


def manifest(df: DataFrame, time: str) -> DataFrame:
    """Rows, first and last time, and a content digest that doesn't depend on order or partitioning."""
    return df.agg(F.count("*").alias("rows"), F.min(time).alias("first_t"), F.max(time).alias("last_t"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def coverage(present: DataFrame, by: str, day: str, start: int, end: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Days from start to end (day numbers) of each key: expected, present, missing and share.

    keys: those that should be there, so that a key without any row is missed as well; by default those that are.
    """
    seen = present.where(F.col(day).between(start, end)).groupBy(by).agg(F.count_distinct(day).alias("present"))
    wanted = present.select(by).distinct() if keys is None else present.sparkSession.createDataFrame([(k,) for k in keys], f"{by} string")
    x = wanted.join(seen, by, "left").select(by, F.lit(end - start + 1).cast("long").alias("expected"), F.coalesce("present", F.lit(0)).cast("long").alias("present"))
    return x.select("*", (F.col("expected") - F.col("present")).alias("missing"), F.round(F.col("present") / F.col("expected"), 8).alias("share"))


def write_clean(df: DataFrame, path: str, partition_by: Sequence[str], order: Sequence[str]) -> None:
    """Parquet in a Hive layout, sorted within its files."""
    df.repartition(*(F.col(c) for c in partition_by)).sortWithinPartitions(*partition_by, *order).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def payload_violations(df: DataFrame, payload: str, required: Sequence[str], forbidden: Sequence[str], age: str, max_age: float) -> DataFrame:
    """JSON payloads against a contract: violations (missing, forbidden and stale fields, in order) and action (ok or skip)."""
    x = df.withColumn("_m", F.from_json(payload, "map<string,string>"))
    field = lambda c: F.try_element_at("_m", F.lit(c))
    stale = F.coalesce(field(age).try_cast("double") > max_age, F.lit(False))
    found = F.array_compact(F.array(*(F.when(field(c).isNull(), F.lit(f"{c}_missing")) for c in required), *(F.when(field(c).isNotNull(), F.lit(f"{c}_forbidden")) for c in forbidden), F.when(stale, F.lit("stale"))))
    return x.withColumn("violations", found).withColumn("action", F.when(F.size("violations") > 0, "skip").otherwise("ok")).drop("_m")


#: Availability classes of columns that may feed features.
FEATURE_CLASSES = ("signal_time", "post_close", "static", "assumption")


def with_availability(df: DataFrame, classes: Mapping[str, str]) -> DataFrame:
    """df with each column's availability class in its metadata."""
    return df.select(*(F.col(c).alias(c, metadata={"availability": classes[c]}) if c in classes else F.col(c) for c in df.columns))


def feature_columns(df: DataFrame) -> list[str]:
    """Sorted names of columns whose availability class lets them feed features; reads the schema only."""
    return sorted(f.name for f in df.schema.fields if f.metadata.get("availability") in FEATURE_CLASSES)

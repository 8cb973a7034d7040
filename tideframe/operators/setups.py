"""Trade setups, candidates and the rows made from them: signals, ledger entries, trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import atr_stop_and_target


def rule_setups(features: DataFrame, stop_atr: float = 1.5, target_atr: float = 3.0, oversold: float = 30, overbought: float = 70) -> DataFrame:
    """One row a bar and rule that fires, with stop and target: breakouts beyond the Donchian range, reversions by RSI.

    Needs close, donchian_high, donchian_low, rsi and atr; a missing one keeps its rules silent. Bars with a null or
    zero ATR have no setup.
    """
    c = F.col("close")
    rules = [("breakout", "long", c > F.col("donchian_high")), ("breakout", "short", c < F.col("donchian_low")), ("reversion", "long", F.col("rsi") < oversold), ("reversion", "short", F.col("rsi") > overbought)]
    fired = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(family).alias("family"), F.lit(side).alias("side"))) for family, side, when in rules)))
    x = features.where(F.col("atr") > 0).select("*", F.explode(fired).alias("_s")).select("*", "_s.family", "_s.side").drop("_s")
    stop, target = atr_stop_and_target(c, F.col("side"), F.col("atr"), stop_atr, target_atr)
    return x.withColumn("stop", stop).withColumn("target", target)


def all_bar_setups(features: DataFrame, number: str, stride: int = 1, stop_atr: float = 1.5, target_atr: float = 3.0) -> DataFrame:
    """Both sides of every stride-th bar with a positive ATR; `number` is the bar's number in its series."""
    kept = features.where((F.col("atr") > 0) & (F.col(number) % stride == 0))
    x = kept.select("*", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("side"))
    stop, target = atr_stop_and_target(F.col("close"), F.col("side"), F.col("atr"), stop_atr, target_atr)
    return x.withColumn("stop", stop).withColumn("target", target)


def trend_pullback(features: DataFrame, max_return: float, max_position: float) -> DataFrame:
    """Rising trends in a dip: close over its mean, rising mean, return at most max_return, low in the range."""
    c = F.col
    found = features.where((c("close") > c("ma")) & (c("ma_slope") > 0) & (c("return_1") <= max_return) & (c("range_position") <= max_position))
    return found.withColumn("score", 1 - c("range_position"))


def training_target(mode: str, min_r: float = 0.0, min_mae: float = -1.0) -> Column:
    """1 or 0 from target_before_stop, realized_r and mae_r: target_first, min_r, or clean (both, and a bounded drawdown)."""
    first, enough = F.col("target_before_stop"), F.col("realized_r") >= min_r
    how = {"target_first": first, "min_r": enough, "clean": first & enough & (F.col("mae_r") >= min_mae)}
    if mode not in how:
        raise ValueError(f"unknown target {mode}")
    return F.when(F.col("realized_r").isNull(), None).when(how[mode], 1).otherwise(0)


def reasons(checks: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))


def first_failing(checks: Mapping[str, Column]) -> Column:
    """Name of the first condition that holds; null where none does."""
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in checks.items()))


def flags(column: str, values: Sequence[str], prefix: str) -> list[Column]:
    """A 0/1 column for each value."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def usable_rows(df: DataFrame, decision: str, features: Sequence[str]) -> DataFrame:
    """Rows out of warm-up: a decision feature, and no missing value among the features that have any value at all."""
    some = df.agg(*(F.count(c).alias(c) for c in features)).first()
    live = [c for c in features if some[c]]
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in live), F.col(decision).isNotNull()))


def numeric_features(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Sorted names of numeric columns that are no keys; reads the schema only."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return sorted(c for c, t in df.dtypes if c not in keys and (t in numeric or t.startswith("decimal")))


def scenario_gate(df: DataFrame, scenario: Mapping[str, object]) -> Column:
    """Optional limits of a scenario: symbols, max_rank, min_expected_r, min_probability; a missing value fails."""
    checks = []
    if scenario.get("symbols"):
        checks.append(F.col("symbol").isin(*scenario["symbols"]))
    for key, column, low in (("max_rank", "rank", False), ("min_expected_r", "expected_r", True), ("min_probability", "probability", True)):
        if scenario.get(key) is not None:
            checks.append(F.col(column) >= scenario[key] if low else F.col(column) <= scenario[key])
    return F.coalesce(reduce(lambda a, b: a & b, checks, F.lit(True)), F.lit(False))


def signals(scored: DataFrame, now: str, min_expected_r: float, min_probability: float, max_age_s: int) -> DataFrame:
    """One signal a scored row: request id, freshness, prices, action with reasons."""
    fresh = F.col(now) - F.col("decision_t")
    checks = {"expected_r_below_threshold": F.col("expected_r") < min_expected_r, "probability_below_threshold": F.col("probability") < min_probability, "stale": fresh > max_age_s, "estimate_missing": F.col("expected_r").isNull() | F.col("probability").isNull()}
    x = scored.withColumn("reason_codes", reasons(checks)).withColumn("freshness_s", fresh)
    return x.withColumn("request_id", F.concat_ws(":", "symbol", "decision_t", "id")).withColumn("action", F.when(F.size("reason_codes") > 0, "skip").otherwise("take"))


def ledger(signals_: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Entries of taken signals: closed where a label has an exit, else open."""
    x = signals_.where(F.col("action") == "take").join(labels, list(on), "left")
    return x.withColumn("status", F.when(F.col("realized_r").isNotNull(), "closed").otherwise("open")).withColumn("exit_reason", F.when(F.col("status") == "closed", F.coalesce("exit_reason", F.lit("label"))))


def trade_rows(selected: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Selected rows with their outcome (null without a label) and a confidence from the expected R, within 0.01 and 1."""
    x = selected.join(labels, list(on), "left")
    return x.withColumn("confidence", F.when(F.col("expected_r").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.col("expected_r")))))


def short_legs(ranked: DataFrame, shorts: DataFrame, k: int, on: Sequence[str] = ("t", "symbol")) -> DataFrame:
    """Of rows with rank and size of their time: the k best as longs, and for the k worst the rows of `shorts`."""
    longs = ranked.where(F.col("rank") <= k)
    low = ranked.where(F.col("rank") > F.col("size") - k).select(*on)
    return longs.select(*shorts.columns).unionByName(shorts.join(low, list(on)).select(*shorts.columns))


def per_group_sample(df: DataFrame, by: Sequence[str], n: int, seed: int, *key: str) -> DataFrame:
    """n rows of each group without replacement, and a random side; the same for one seed, whatever the partitioning.

    Rows are picked over two levels, so that a group that is large is not sorted in one task.
    """
    h = F.xxhash64(*key, F.lit(seed))
    x = df.withColumn("_h", h).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    order = [F.col("_h"), *(F.col(c) for c in key)]
    first = x.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_k") <= n)
    out = first.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n)
    return out.withColumn("side", F.when(F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(2)) == 0, "long").otherwise("short")).drop("_h", "_part", "_k")

"""Ranking and admission of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n_per_time(signals: DataFrame, n: int, time: str = "decision_t", score: str = "confidence", tie: str = "id", descending_tie: bool = False) -> DataFrame:
    """Signals with their rank within a time; in_top tells the first n. Flat signals use up ranks too."""
    w = Window.partitionBy(time).orderBy(F.col(score).desc_nulls_last(), F.col(tie).desc() if descending_tie else F.col(tie).asc())
    return signals.withColumn("rank", F.row_number().over(w)).withColumn("in_top", F.col("rank") <= n)


def daily_cap(signals: DataFrame, k: int, time: str = "decision_t", order: tuple[str, ...] = ("rank", "id"), day_s: int = 86400) -> DataFrame:
    """The first k signals of each UTC day in order of time, then of `order`."""
    w = Window.partitionBy(F.expr(f"{time} div {day_s}")).orderBy(time, *order)
    return signals.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def cross_sectional_rank(df: DataFrame, column: str, to: str, time: str = "t") -> DataFrame:
    """Average percentile rank within a time, mapped to -1 .. 1; null stays null."""
    at, c = Window.partitionBy(time), F.col(column)
    low = F.rank().over(at.orderBy(c.asc_nulls_last()))
    ties = F.count(c).over(Window.partitionBy(time, column))
    pct = (low + (ties - 1) / 2) / F.count(c).over(at)
    return df.withColumn(to, F.when(c.isNotNull(), 2 * pct - 1))


def relative_label(df: DataFrame, column: str, to: str, min_rows: int, time: str = "t") -> DataFrame:
    """Whether a row is in the upper half of its time by average percentile rank, where enough rows are there."""
    ranked = cross_sectional_rank(df, column, "_r", time)
    return ranked.withColumn(to, F.when(F.count(column).over(Window.partitionBy(time)) >= min_rows, F.col("_r") > 0)).drop("_r")


def long_short_book(df: DataFrame, score: str, k: int, time: str = "t", name: str = "symbol") -> DataFrame:
    """The k best rows of a time as longs and the k worst as shorts, where it has at least 2 k."""
    at = Window.partitionBy(time)
    x = df.where(F.col(score).isNotNull()).select("*", F.row_number().over(at.orderBy(F.col(score).desc(), name)).alias("_top"), F.row_number().over(at.orderBy(F.col(score).asc(), name)).alias("_bottom"), F.count("*").over(at).alias("_n"))
    leg = F.when(F.col("_top") <= k, "long").when(F.col("_bottom") <= k, "short")
    return x.where(F.col("_n") >= 2 * k).withColumn("leg", leg).where("leg is not null").drop("_top", "_bottom", "_n")


def relative_strength(bars: DataFrame, lookback: int, time: str = "t", name: str = "symbol") -> DataFrame:
    """Returns over `lookback` bars, their rank within a time and that rank's share of the symbols there."""
    w = Window.partitionBy(name).orderBy(time)
    r = F.try_divide(F.col("close"), F.lag("close", lookback).over(w)) - 1
    x = bars.withColumn("strength", r).where("strength is not null")
    at = Window.partitionBy(time)
    return x.select("*", F.row_number().over(at.orderBy(F.col("strength").desc(), name)).alias("strength_rank"), F.count("*").over(at).alias("strength_of"))


def ordered_filter(df: DataFrame, by: list[str], order: list[str], start: Callable[[], Callable[..., bool]], fields: list[str]) -> DataFrame:
    """Rows that a rule with memory keeps: each key's rows go by in order, start() makes the key's rule, and the rule is
    asked with the fields of one row after another.

    Rows stream through sorted partitions, so that a key may have any number of rows: a task holds one batch of them and
    one rule. Rows that are equal in key and order come in any order among them.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rule = None, None
        for rows in batches:
            kept = []
            for own, values in zip(zip(*(rows[c] for c in by)), zip(*(rows[c] for c in fields))):
                if rule is None or own != key:
                    key, rule = own, start()
                kept.append(rule(*values))
            yield rows[kept]

    return df.repartition(*(F.col(c) for c in by)).sortWithinPartitions(*by, *order).mapInPandas(keep, df.schema)


def non_overlapping(trades: DataFrame, by: str = "symbol", start: str = "decision_t", end: str = "exit_t", tie: str = "id") -> DataFrame:
    """Greedy in order of start: a trade is kept when it starts no earlier than the last kept one of its key ended."""

    def rule() -> Callable[..., bool]:
        until = [float("-inf")]

        def ask(begins: int, ends: int) -> bool:
            if begins < until[0]:
                return False
            until[0] = ends
            return True

        return ask

    return ordered_filter(trades, [by], [start, tie], rule, [start, end])


def admitted(signals: DataFrame, cap: int, cooldown: int, by: str = "symbol", order: str = "decision_t", tie: str = "id", result: str = "net_r") -> DataFrame:
    """Per key: at most `cap` accepted signals, and after a loss the next `cooldown` ones are skipped.

    The cooldown counts down on skipped signals only, and not while the cap blocks.
    """

    def rule() -> Callable[..., bool]:
        taken, wait = [0], [0]

        def ask(r: float) -> bool:
            if taken[0] >= cap:
                return False
            if wait[0] > 0:
                wait[0] -= 1
                return False
            taken[0] += 1
            wait[0] = cooldown if r < 0 else 0
            return True

        return ask

    return ordered_filter(signals, [by], [order, tie], rule, [result])

"""Configured predicates. A missing feature makes a predicate false, never null."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OPS = {"<": lt, "<=": le, ">": gt, ">=": ge, "==": eq, "!=": ne}


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    value: float | str | bool

    @property
    def column(self) -> Column:
        if self.op not in _OPS:
            raise ValueError(f"unknown operator {self.op}")
        return F.coalesce(_OPS[self.op](F.col(self.feature), F.lit(self.value)), F.lit(False))


def all_of(conditions: Sequence[Condition]) -> Column:
    return reduce(and_, (c.column for c in conditions), F.lit(True))


def any_group(groups: Sequence[Sequence[Condition]]) -> Column:
    """True where all conditions of some group hold."""
    return reduce(or_, (all_of(g) for g in groups), F.lit(False))


def symbols_in(column: str, symbols: Sequence[str]) -> Column:
    """Case-folded membership; an empty list admits all."""
    return F.upper(column).isin([s.upper() for s in symbols]) if symbols else F.lit(True)


def candidates(df: DataFrame, decision: str, conditions: Sequence[Condition], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with a decision feature that meet all conditions, the first of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.where(F.col(decision).isNotNull() & all_of(conditions)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def abstain(df: DataFrame, groups: Sequence[Sequence[Condition]]) -> DataFrame:
    """Fail-closed: blocked when a group matches or a feature that a group needs is missing; missing names those."""
    names = sorted({c.feature for g in groups for c in g})
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in names)))
    return df.withColumn("missing", missing).withColumn("blocked", (F.size("missing") > 0) | any_group(groups))


def funnel(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Per condition, in one pass: rows passing alone, missing, before and after it in sequence, smallest and largest value."""
    aggs = []
    before = F.lit(True)
    for i, c in enumerate(conditions):
        after = before & c.column
        aggs.append(F.struct(F.lit(i).alias("step"), F.lit(f"{c.feature} {c.op} {c.value}").alias("condition"), F.count_if(c.column).alias("alone"), F.count_if(F.col(c.feature).isNull()).alias("missing"), F.count_if(before).alias("before"), F.count_if(after).alias("after"), F.min(c.feature).cast("double").alias("smallest"), F.max(c.feature).cast("double").alias("largest")))
        before = after
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s")).withColumn("rejected", F.col("before") - F.col("after"))


def time_split(df: DataFrame, time: str, train_end: int, validation_end: int, test_end: int) -> DataFrame:
    t = F.col(time)
    return df.withColumn("split", F.when(t <= train_end, "train").when(t <= validation_end, "validation").when(t <= test_end, "test"))


def walk_forward(times: DataFrame, time: str, train: int, validation: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """Windows over distinct times: fold, first and last time of each part. Times are a small table beside the rows."""
    n = train + validation + test
    x = times.select(time).distinct().withColumn("_i", F.row_number().over(Window.orderBy(time)) - 1)
    at = lambda k: F.lead(time, k).over(Window.orderBy("_i"))
    start = F.first(time).over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) if anchored else F.col(time)
    out = x.select("_i", start.alias("train_start"), at(train - 1).alias("train_end"), at(train).alias("validation_start"), at(train + validation - 1).alias("validation_end"), at(train + validation).alias("test_start"), at(n - 1).alias("test_end"))
    return out.where((F.col("_i") % step == 0) & F.col("test_end").isNotNull()).select((F.col("_i") / step).cast("int").alias("fold"), *out.columns[1:])


def time_folds(df: DataFrame, time: str, folds: int) -> DataFrame:
    """Rows with the number of their fold: equal spans of time between the first and the last row, the last one closed."""
    ends = df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    x = df.join(F.broadcast(ends))  # one row
    fold = F.floor((F.col(time) - F.col("_lo")) * folds / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)))
    return x.withColumn("fold", F.least(F.coalesce(fold, F.lit(0)), F.lit(folds - 1)).cast("int")).drop("_lo", "_hi")

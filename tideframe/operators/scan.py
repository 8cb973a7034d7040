"""First-order recurrences y = d * y_before + a * x as window sums over chunks, and finite weighted sums.

A series is cut into chunks of rows. Within a chunk the recurrence is a running sum; what a chunk passes on to later
ones is a short weighted sum over chunk ends, because d ** chunk is tiny. So one long series is not one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from tideframe.operators.chunks import numbered


def recurrence(df: DataFrame, by: list[str], order: str, columns: dict[str, tuple[str, float]], min_rows: dict[str, int] | None = None, index: str | None = None) -> DataFrame:
    """Add exponentially weighted means.

    columns: new column -> (source column, alpha); y = (1 - alpha) * y_before + alpha * x, and y = x at the first row
    with a value. Null values before that row give null; later nulls count as 0. min_rows: null until so many
    rows with or after the first value. index: a column with the row's number (from 0) in its series, if there is one.
    """
    i = F.col(index or "_i")
    if index:
        out = df
    elif isinstance(df.schema[order].dataType, NumericType):
        out = numbered(df, by, order).withColumn("_i", F.col("_row")).drop("_row", "_chunk", "_next")
    else:
        out = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    # One chunk length for all columns, so that they share windows, one aggregation and one join.
    chunk = min(max(8, min(512, int(500 / -math.log(1 - alpha)))) if alpha < 1 else 512 for _, alpha in columns.values())
    names = list(enumerate(columns.items()))
    # One row a series: the first row with a value, of each column.
    firsts = out.groupBy(*by).agg(*(F.min(F.when(F.col(source).isNotNull(), i)).alias(f"_f{k}") for k, (_, (source, _)) in names))
    out = out.join(firsts, by).withColumn("_c", F.floor(i / chunk).cast("int")).withColumn("_q", (i % chunk).cast("int"))
    inside = Window.partitionBy(*by, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = []
    for k, (_, (source, alpha)) in names:
        x, first = F.col(source), F.col(f"_f{k}")
        add = F.when(i == first, x).when(i > first, alpha * F.coalesce(x, F.lit(0.0))).otherwise(0.0)
        power = F.pow(F.lit(1 - alpha), F.col("_q")) if alpha < 1 else F.when(F.col("_q") == 0, 1.0).otherwise(1.0)
        local.append((add if alpha == 1 else power * F.sum(add / power).over(inside)).alias(f"_l{k}"))
    out = out.select("*", *local)
    # What a chunk leaves to later ones: a short weighted sum over the ends of those before.
    ends = out.groupBy(*by, "_c").agg(*(F.max_by(f"_l{k}", "_q").alias(f"_e{k}") for k, _ in names))
    over = Window.partitionBy(*by).orderBy("_c")
    carries = []
    for k, (_, (_, alpha)) in names:
        passed = (1 - alpha) ** chunk
        depth = max(1, math.ceil(math.log(1e-18) / math.log(passed))) if 0 < passed < 1 else 1
        carries.append(sum((F.coalesce(F.lag(f"_e{k}", m + 1).over(over), F.lit(0.0)) * passed**m for m in range(depth)), F.lit(0.0)).alias(f"_y{k}"))
    out = out.join(ends.select(*by, "_c", *carries), [*by, "_c"])
    result = []
    for k, (new, (_, alpha)) in names:
        y = F.col(f"_l{k}") + F.col(f"_y{k}") * F.pow(F.lit(1 - alpha), F.col("_q") + 1)
        result.append(F.when(i - F.col(f"_f{k}") >= (min_rows or {}).get(new, 1) - 1, y).alias(new))
    return out.select(*(c for c in df.columns if c not in columns), *result)


def weighted_lags(x: str, weights: list[float], w) -> Column:
    """Sum of weights[i] * (value i rows back); null until all are there."""
    return sum((F.lag(x, i).over(w) * k for i, k in enumerate(weights) if k), F.lit(0.0))


def ema_weights(n: int, span: int | None = None, seed: str = "first") -> list[float]:
    """Weights of an exponential mean over a frame of n values that starts from its first value, or from its mean."""
    a = 2 / ((span or n) + 1)
    w = [a * (1 - a) ** i for i in range(n)]
    if seed == "first":
        w[-1] = (1 - a) ** (n - 1)
        return w
    return [k + (1 - a) ** n / n for k in w]

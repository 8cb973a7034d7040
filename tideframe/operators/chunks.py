"""Long series in chunks of time, so that no task holds a whole series.

Each chunk also gets the `halo` rows before it. Rolling columns whose frames reach no further back then give the same
values within a chunk as over the whole series. What reaches back without bound is carried as one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Units of the order column in a chunk; for seconds, some months of hourly bars.
SPAN = 120 * 86400


def numbered(df: DataFrame, by: list[str], order: str, span: int = SPAN, halo: int = 0) -> DataFrame:
    """Add _chunk, _row (number of the row in its series, from 0) and _next (later chunks whose halo may hold the row)."""
    x = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(span)).cast("long"))
    over = Window.partitionBy(*by).orderBy("_chunk")
    # One row a chunk from here on: a small table beside the series.
    sizes = x.groupBy(*by, "_chunk").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = F.collect_list(F.struct(F.col("_chunk").alias("chunk"), F.col("_start").alias("start"))).over(over.rowsBetween(1, halo + 1)) if halo else F.array().cast("array<struct<chunk:bigint,start:bigint>>")
    starts = starts.withColumn("_next", F.filter(later, lambda c: c["start"] < F.col("_start") + F.col("_size") + halo)).drop("_size")
    inside = Window.partitionBy(*by, "_chunk").orderBy(order)
    return x.join(starts, [*by, "_chunk"]).withColumn("_row", F.col("_start") + F.row_number().over(inside) - 1).drop("_start")


def in_chunks(df: DataFrame, by: list[str], order: str, halo: int, span: int = SPAN) -> DataFrame:
    """Rows with _chunk, _row and _own; the `halo` rows before a chunk are in it, too, with _own false."""
    x = numbered(df, by, order, span, halo)
    copies = F.concat(F.array(F.struct(F.col("_chunk").alias("chunk"), F.lit(True).alias("own"))), F.transform(F.filter("_next", lambda c: c["start"] <= F.col("_row") + halo), lambda c: F.struct(c["chunk"].alias("chunk"), F.lit(False).alias("own"))))
    x = x.withColumn("_c", F.explode(copies)).drop("_chunk", "_next")
    return x.select("*", F.col("_c.chunk").alias("_chunk"), F.col("_c.own").alias("_own")).drop("_c")


def own_rows(df: DataFrame, keep_row: bool = False) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk", *([] if keep_row else ["_row"]))


def last_before(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """df with, for each value, its maximum over the own rows of all earlier chunks of the series."""
    per = df.where("_own").groupBy(*by, "_chunk").agg(*(F.max(c).alias(k) for k, c in values.items()))
    over = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(per.select(*by, "_chunk", *(F.max(k).over(over).alias(k) for k in values)), [*by, "_chunk"])

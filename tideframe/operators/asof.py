"""As-of joins without range blow-up: one union, one sort per key and bucket of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Units of time in a bucket of asof(); for seconds, a week.
BUCKET = 7 * 86400


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], columns: list[str], max_age: int | None = None, allow_exact: bool = True, prefix: str = "", bucket: int | None = BUCKET) -> DataFrame:
    """Left rows with `columns` of the latest right row not later than left_time.

    Of right rows with equal time, the one with the largest column values counts. max_age: nothing older than so many
    units. allow_exact=False takes strictly earlier rows only. Right times that are null are left out; left rows
    with a null time get nulls.

    A key's rows are parted by buckets of time, so that a long series is not one task. What a bucket needs from those
    before it is one right row; a key's buckets with right rows are a small table. bucket=None: one part a key.
    """
    struct = F.struct(F.col(right_time).alias("_rt"), *(F.col(c).alias(c) for c in columns))
    r = right.where(F.col(right_time).isNotNull()).groupBy(*by, right_time).agg(F.max(struct).alias("_r")).select(*by, F.col(right_time).alias("_t"), F.lit(1 if not allow_exact else 0).alias("_side"), "_r")
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(0 if not allow_exact else 1).alias("_side"), F.struct(*left.columns).alias("_l"))
    parts = list(by)
    if bucket is not None:
        parts.append("_b")
        part = F.floor(F.col("_t") / F.lit(bucket)).cast("long")
        r, rows = r.withColumn("_b", part), rows.withColumn("_b", part)
        lasts = r.groupBy(*parts).agg(F.max("_r").alias("_r"))
        # The last right row before each bucket that has left rows: one row a key and bucket from here on.
        wanted = rows.where("_b IS NOT NULL").select(*parts).distinct().withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(0))
        steps = wanted.unionByName(lasts.withColumn("_side", F.lit(1))).withColumn("_before", F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b", "_side").rowsBetween(Window.unboundedPreceding, -1)))
        seeds = steps.where("_side = 0 AND _before IS NOT NULL").select(*parts, F.col("_before._rt").alias("_t"), F.lit(0).alias("_side"), F.col("_before").alias("_r"))
        r = r.unionByName(seeds)
    w = Window.partitionBy(*parts).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(r, allowMissingColumns=True).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    fresh = F.lit(True) if max_age is None else F.col("_t") - F.col("_hit._rt") <= max_age
    return both.select("_l.*", *(F.when(fresh, F.col("_hit")[c]).alias(prefix + c) for c in columns), F.when(fresh, F.col("_hit._rt")).alias(prefix + right_time))


def asof_for_all(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], bucket: int) -> DataFrame:
    """As-of join without a key, by buckets of time.

    A bucket's left rows see its own right rows and the last one before it, so that no task holds the whole series. The
    last right row of each bucket is all that is carried.
    """
    r = right.where(F.col(right_time).isNotNull()).select(F.col(right_time).alias("_at"), *columns).withColumn("_b", F.expr(f"_at div {bucket}"))
    lasts = r.groupBy("_b").agg(F.max_by(F.struct("_at", *columns), "_at").alias("_r"))
    x = left.withColumn("_b", F.expr(f"{left_time} div {bucket}"))
    # One row a bucket: a small table, which one task can fill forward.
    filled = x.select("_b").distinct().join(lasts, "_b", "full_outer").withColumn("_before", F.last("_r", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    seeds = filled.where("_before is not null").select("_b", "_before.*")
    return asof(x, r.select("_b", "_at", *columns).unionByName(seeds), left_time, "_at", ["_b"], columns, bucket=None).drop("_b", "_at")


def flagged_left(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Left join with a column that tells whether a right row was there."""
    return left.join(right.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unique_left(left: DataFrame, right: DataFrame, on: list[str], required: bool = False) -> DataFrame:
    """Left join with a right side whose keys are unique, else ValueError; required: each left key must be there."""
    if not right.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated keys {on}")
    if required and not left.join(right, on, "left_anti").isEmpty():
        raise ValueError(f"missing keys {on}")
    return left.join(right, on, "left")


def usable_from(event_time: Column, available: Column) -> Column:
    """When a row may be used: once it has happened and is known."""
    return F.greatest(event_time, available)


def pointer_time(df: DataFrame, event_time: str, available: str, by: list[str], to: str) -> DataFrame:
    """Usable time under the pointer rule: a row that is known late hides those behind it until then."""
    w = Window.partitionBy(*by).orderBy(event_time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.max(usable_from(F.col(event_time), F.col(available))).over(w))


def interval_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_time: str, by: list[str], bucket: int) -> DataFrame:
    """Pairs with left_start <= right_time <= left_end, joined on time buckets.

    The left side is the one with few rows; an interval no longer than `bucket` has two copies at most.
    """
    spans = left.withColumn("_b", F.explode(F.sequence(F.expr(f"{left_start} div {bucket}"), F.expr(f"{left_end} div {bucket}"))))
    points = right.withColumn("_b", F.expr(f"{right_time} div {bucket}"))
    return spans.join(points, [*by, "_b"]).where(F.col(right_time).between(F.col(left_start), F.col(left_end))).drop("_b")


def interval_sums(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_time: str, by: list[str], name: str, sums: dict[str, Column], bucket: int) -> DataFrame:
    """For each left row (its name is unique within a key): by, name and sums of right rows with left_start <= right_time
    <= left_end.

    Running totals over the union of right rows and interval ends, not pairs: rows out are rows in. A bucket of time must
    be at least as long as the longest interval (else an error), so that an interval touches two at most and totals
    are taken within a bucket only. Null values count as 0; intervals without right rows give 0; null times have no
    part in it.
    """
    values = list(sums)
    zero = [F.lit(0.0).alias(c) for c in values]
    part = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    points = right.where(F.col(right_time).isNotNull()).select(*by, part(right_time).alias("_b"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema[name].dataType).alias(name), F.lit(False).alias("_apart"), *(F.coalesce(x.cast("double"), F.lit(0.0)).alias(c) for c, x in sums.items()))
    short = F.when(F.col(left_end) - F.col(left_start) <= bucket, part(left_start) < part(left_end)).otherwise(F.raise_error(F.lit("an interval is longer than a bucket")).cast("boolean"))
    spans = left.where(F.col(left_start).isNotNull() & F.col(left_end).isNotNull())
    begins = spans.select(*by, part(left_start).alias("_b"), F.col(left_start).alias("_t"), F.lit(0).alias("_side"), name, short.alias("_apart"), *zero)
    ends = spans.select(*by, part(left_end).alias("_b"), F.col(left_end).alias("_t"), F.lit(2).alias("_side"), name, F.lit(False).alias("_apart"), *zero)
    rows = points.unionByName(begins).unionByName(ends)
    inside = Window.partitionBy(*by, "_b")
    running = inside.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*by, "_side", name, "_apart", *(F.sum(c).over(running).alias(c) for c in values), *(F.sum(c).over(inside).alias(f"_all_{c}") for c in values)).where("_side <> 1")
    share = lambda c: F.when(F.col("_side") == 2, F.col(c)).when(F.col("_apart"), F.col(f"_all_{c}") - F.col(c)).otherwise(-F.col(c))
    return rows.groupBy(*by, name).agg(*(F.sum(share(c)).alias(c) for c in values))

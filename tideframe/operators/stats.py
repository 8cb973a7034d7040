"""Statistics and small models fitted from aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.scalars import ratio, sigmoid
from tideframe.operators.chunks import SPAN, numbered


#: Parts of a key's values, by approximate quantiles, so that ranks and quantiles of a key are not one task.
CELLS = 64


def with_cell(df: DataFrame, column: str, by: Sequence[str], to: str, cells: int = CELLS) -> DataFrame:
    """df with a part number of each value within its key; equal values are in one part, larger ones in no lower part.

    Bounds are approximate quantiles, one array a key; nulls are in the lowest part. A key of null is a key.
    """
    marks = [(i + 1) / cells for i in range(cells - 1)]
    bounds = df.groupBy(*by).agg(F.percentile_approx(column, marks, 16 * cells).alias("_bounds"))
    named = bounds.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_bounds")
    on = [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    joined = df.join(named, on) if by else df.crossJoin(F.broadcast(named))
    value = F.col(column)
    return joined.withColumn(to, F.coalesce(F.size(F.filter("_bounds", lambda m: m < value)), F.lit(0))).drop("_bounds", *(f"_k{i}" for i in range(len(by))))


def with_average_rank(df: DataFrame, column: str, by: Sequence[str], to: str, cells: int = CELLS) -> DataFrame:
    """df with the rank of each value in its key, the mean one for ties, from 1; nulls are lowest.

    Ranked within parts of a key; the sizes of lower parts are a small table.
    """
    x = with_cell(df, column, by, "_cell", cells)
    over = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    lower = x.groupBy(*by, "_cell").agg(F.count("*").alias("_size")).withColumn("_lower", F.coalesce(F.sum("_size").over(over), F.lit(0)))
    named = lower.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_cell").alias("_c"), "_lower")
    x = x.join(named, [*(x[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)), x["_cell"] == F.col("_c")])
    inside = F.rank().over(Window.partitionBy(*by, "_cell").orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, "_cell", column)) - 1) / 2
    return x.withColumn(to, F.col("_lower") + inside).drop("_cell", "_c", "_lower", *(f"_k{i}" for i in range(len(by))))


def grouped_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, to: str, cells: int = CELLS) -> DataFrame:
    """by and the q-quantile of a key's values, linear between neighbours, exactly; nulls are left out.

    Distinct values are counted first. Only the parts that hold the two neighbours are ordered.
    """
    counts = with_cell(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), value, by, "_cell", cells)
    over = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_size")).withColumn("_lower", F.coalesce(F.sum("_size").over(over), F.lit(0)))
    sizes = sizes.withColumn("_at", (F.sum("_size").over(Window.partitionBy(*by)) - 1) * F.lit(q))
    wanted = sizes.where((F.col("_lower") <= F.ceil("_at")) & (F.floor("_at") < F.col("_lower") + F.col("_size")))
    x = counts.join(wanted.drop("_size"), [*by, "_cell"])
    upto = F.col("_lower") + F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_upto", upto)
    holds = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i)
    low, high = (F.max(F.when(holds(f(F.col("_at"))), F.col(value))) for f in (F.floor, F.ceil))
    g = x.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.max("_at").alias("_at"))
    return g.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias(to))


def roc_auc(scored: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve by rank sums, per key; null without both classes. label is 0 or 1."""
    x = with_average_rank(scored, score, by, "_r")
    pos = F.sum(label).cast("double")
    neg = F.count("*") - pos
    return x.groupBy(*by).agg(F.round(ratio(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2, pos * neg), 8).alias("auc"), F.count("*").alias("rows"))


def spearman(pairs: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    x = with_average_rank(with_average_rank(pairs, a, by, "_a"), b, by, "_b")
    return x.groupBy(*by).agg(F.round(F.corr("_a", "_b"), 8).alias("spearman"), F.count("*").alias("rows"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, mean over present values, deviation after missing ones were set to the mean."""
    aggs = []
    for c in columns:
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.sqrt(F.var_pop(c) * F.count(c) / F.count("*")).alias("deviation")))
    return df.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def standardized(df: DataFrame, moments_: dict[str, tuple[float, float]]) -> list[Column]:
    """(x - mean) / deviation with missing values at the mean; 0 where there is no deviation."""
    return [F.lit(0.0) if not d else (F.coalesce(F.col(c), F.lit(m)) - m) / d for c, (m, d) in moments_.items()]


def fit_ridge(df: DataFrame, columns: Sequence[str], target: str, penalty: float) -> dict[str, float]:
    """Ridge regression on standardized features from one aggregation of products; the intercept isn't penalised.

    Returns weights of raw features and "intercept". k columns give k * k sums, whatever the rows.
    """
    m = {r["feature"]: (r["mean"] or 0.0, r["deviation"] or 0.0) for r in moments(df, columns).collect()}
    z = [*standardized(df, {c: m[c] for c in columns}), F.lit(1.0), F.col(target).cast("double")]
    k = len(columns) + 1
    named = df.where(F.col(target).isNotNull()).select(*(c.alias(f"z{i}") for i, c in enumerate(z)))
    row = named.agg(*(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k + 1))).first()
    a, y = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"s{i}_{j}"] or 0.0
        y[i] = row[f"s{i}_{k}"] or 0.0
    a[np.arange(k - 1), np.arange(k - 1)] += penalty
    w = np.linalg.solve(a + 1e-12 * np.eye(k), y)
    out = {c: float(w[i] / m[c][1]) if m[c][1] else 0.0 for i, c in enumerate(columns)}
    out["intercept"] = float(w[-1] - sum(out[c] * m[c][0] for c in columns))
    return out


def linear_score(weights: dict[str, float]) -> Column:
    """Null where a feature is missing."""
    out = F.lit(weights["intercept"])
    for c, w in weights.items():
        if c != "intercept":
            out = out + F.col(c) * w
    return out


def probability(weights: dict[str, float]) -> Column:
    return sigmoid(linear_score(weights))


def single_feature_threshold(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Midpoint between the means of label 1 and 0, and on which side label 1 lies."""
    up, down = F.avg(F.when(F.col(label) == 1, F.col(feature))), F.avg(F.when(F.col(label) == 0, F.col(feature)))
    return df.agg(F.round((up + down) / 2, 8).alias("threshold"), F.when(up >= down, 1).otherwise(-1).alias("direction"))


def threshold_sweep(scored: DataFrame, score: str, r: str, thresholds: Sequence[float], min_trades: int) -> DataFrame:
    """Per threshold: trades at or above it and their mean; chosen marks the best mean with enough trades.

    Ties go to more trades, then to the higher threshold.
    """
    x = scored.select(r, F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col(score))).alias("threshold"))
    g = x.groupBy("threshold").agg(F.count(r).alias("trades"), F.round(F.avg(r), 8).alias("mean_r"))
    enough = F.when(F.col("trades") >= min_trades, F.struct("mean_r", "trades", "threshold"))
    best = F.max(enough).over(Window.partitionBy(F.lit(0)))  # a row for each threshold
    return g.withColumn("chosen", F.coalesce(F.struct("mean_r", "trades", "threshold") == best, F.lit(False)))


def pick(position: Column, seed: Column, below: Column) -> Column:
    """A number from 0 to below - 1, from an MD5 of a position and a seed."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", position.cast("string"), seed.cast("string"))), 1, 8), 16, 10).cast("long")
    return h % below


def block_bootstrap(values: DataFrame, value: str, order: str, block: int, iterations: int, seed: int | Column, span: int = SPAN, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """by, n, mean, low, high and naive_t of each key: mean and its interval by moving blocks, all keys in one job.

    Resamples have as many values as the key. Block sums are differences of running sums, which are made in chunks of the
    order column (a number, in units of span); a resample is a set of block starts, so resampling moves no values. With at
    most `block` values the interval is their range. naive_t: mean by its standard error, 0 without a deviation, null with
    fewer than two values. seed: a number, or a column of the key. Null values are left out; a key without any has no row.
    """
    keys = list(by) or ["_all"]
    x = values.withColumn("_all", F.lit(0)) if not by else values
    x = x.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("v"))
    total = x.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("_d"), F.min("v").alias("_min"), F.max("v").alias("_max"))
    rows = numbered(x, keys, "_o", span).drop("_next")
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_chunk").agg(F.sum("v").alias("_e"))  # one row a chunk
    before = ends.select(*keys, "_chunk", F.coalesce(F.sum("_e").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_b"))
    sums = rows.withColumn("_s", F.sum("v").over(inside)).join(before, [*keys, "_chunk"]).select(*keys, (F.col("_row") + 1).alias("i"), (F.col("_s") + F.col("_b")).alias("p"))
    sums = sums.unionByName(total.select(*keys, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("p")))
    # Draws: iterations x blocks of each key, in lists of at most 1,000.
    drawn = total.where(F.col("n") > block).select(*keys, "n", F.ceil(F.col("n") / block).alias("_blocks"), (F.lit(seed) if isinstance(seed, int) else seed).alias("_seed"))
    drawn = drawn.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1, F.lit(1000).cast("long"))))
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.col("_j"), F.least(F.col("_j") + 999, F.col("_blocks") - 1))))
    length = F.when(F.col("j") == F.col("_blocks") - 1, F.col("n") - (F.col("_blocks") - 1) * block).otherwise(block)  # the last block is cut
    drawn = drawn.withColumn("i", pick(F.col("it") * F.col("_blocks") + F.col("j"), F.col("_seed"), F.col("n") - block + 1)).withColumn("_to", F.col("i") + length)
    both = drawn.join(sums.withColumnRenamed("p", "_a"), [*keys, "i"]).join(sums.select(*keys, F.col("i").alias("_to"), F.col("p").alias("_z")), [*keys, "_to"])
    means = both.groupBy(*keys, "it").agg((F.sum(F.col("_z") - F.col("_a")) / F.first("n")).alias("m"))
    tail = (1 - confidence) / 2
    q = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))  # of as many values as iterations
    t = F.when(F.col("n") >= 2, F.when(F.col("_d") > 0, F.col("mean") / (F.col("_d") / F.sqrt("n"))).otherwise(0.0))
    out = total.join(q, keys, "left")
    return out.select(*by, "n", "mean", F.coalesce(F.get("q", F.lit(0)), "_min").alias("low"), F.coalesce(F.get("q", F.lit(1)), "_max").alias("high"), t.alias("naive_t"))


def difference_interval(df: DataFrame, by: Sequence[str], first: Column, value: str, order: str, block: int, iterations: int, seed: int, span: int = SPAN) -> DataFrame:
    """Mean of the rows where `first` holds less that of the others, with the half-widths of their bootstrap intervals added
    in quadrature: by, difference, low, high, n. The second part's seed is seed + 1. A key needs both parts."""
    sided = df.where(first.isNotNull()).withColumn("_first", first)
    x = block_bootstrap(sided, value, order, block, iterations, F.when(F.col("_first"), seed).otherwise(seed + 1), span, [*by, "_first"])
    half = (F.col("high") - F.col("low")) / 2
    side = lambda c, f: F.max(F.when(F.col("_first") == f, c))
    g = x.groupBy(*by).agg(side(F.col("mean"), True).alias("_a"), side(F.col("mean"), False).alias("_b"), side(half, True).alias("_ha"), side(half, False).alias("_hb"), F.sum("n").alias("n"))
    g = g.where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("_h", F.sqrt(F.col("_ha") * F.col("_ha") + F.col("_hb") * F.col("_hb")))
    difference = F.col("_a") - F.col("_b")
    return g.select(*by, difference.alias("difference"), (difference - F.col("_h")).alias("low"), (difference + F.col("_h")).alias("high"), "n")


def purged_folds(samples: DataFrame, time: str, exit_time: str, folds: Sequence[tuple[int, int]], embargo: int) -> DataFrame:
    """Rows by fold and part: test within the fold's span, train with an exit before its start less the embargo."""
    f = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(folds)))).alias("f")
    x = samples.select("*", f).select(*samples.columns, "f.fold", "f.lo", "f.hi")
    part = F.when((F.col(time) >= F.col("lo")) & (F.col(time) < F.col("hi")), "test").when(F.col(exit_time) < F.col("lo") - embargo, "train")
    return x.withColumn("part", part).where("part is not null").drop("lo", "hi")


def _ridge_of_sums(features: int, penalty: float):
    """Solves each fold's ridge regression from the sums over its training rows (standardised, intercept unpenalised)."""

    def solve(folds: pa.Table) -> pa.Table:
        rows, weights = folds.to_pylist(), []
        for r in rows:
            k, n = features, r["n"]
            mean = np.array([r[f"x{i}"] for i in range(k)]) / n
            cov = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
            dev = np.sqrt(np.maximum(cov.diagonal(), 0))
            use = dev > 1e-12 * np.maximum(1, np.abs(mean))
            dev[~use] = 1
            z = cov / np.outer(dev, dev) * n + penalty * np.eye(k)
            rhs = (np.array([r[f"y{i}"] for i in range(k)]) - mean * r["y"]) / dev
            w = np.zeros(k)
            w[use] = np.linalg.solve(z[np.ix_(use, use)], rhs[use])
            w = w / dev
            weights.append([float(r["y"] / n - w @ mean), *map(float, w)])
        return pa.table({"fold": pa.array([r["fold"] for r in rows], pa.int32()), "train_size": [r["n"] for r in rows], "_weights": pa.array(weights, pa.list_(pa.float64()))})

    return solve


def walk_forward(samples: DataFrame, features: Sequence[str], label: str, time: str, exit_time: str, folds: int = 6, embargo: int = 7 * 86400, min_train: int = 400, selectivity: float = 0.5, penalty: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample predictions and diagnostics of purged walk-forward folds.

    Test windows are `folds` equal parts of the span of `time` (numbers). A sample trains a fold if its exit is before the
    window's start less the embargo; so it trains all folds from some number on, and each fold's sums are running sums
    over folds of one aggregation of products. A fold with fewer than min_train training rows, or one class only, is
    left out. The model is a ridge regression of the label (0 or 1); probability is the sigmoid of its value, to 12 digits; selected
    tells whether it is at least the (1 - selectivity)-quantile of the fold's training rows. Rows with a missing feature or
    label train nothing, and have no prediction.

    Returns (samples' columns, fold, probability, selected) and (fold, train_size, test_size, train_end, threshold, auc,
    train_auc).
    """
    k = len(features)
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*features, label]))
    span = samples.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    step = lambda c: (F.col(c) - F.col("_lo")) * float(folds) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    x = samples.where(whole).crossJoin(F.broadcast(span))
    x = x.withColumn("fold", F.least(F.lit(folds - 1), F.floor(step(time))).cast("int"))
    x = x.withColumn("_from", F.greatest(F.lit(0), F.floor((F.col(exit_time) + embargo - F.col("_lo")) * float(folds) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))) + 1).cast("int")).drop("_lo", "_hi")
    values = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    named = {f"x{i}": v for i, v in enumerate(values)} | {f"x{i}_{j}": values[i] * values[j] for i in range(k) for j in range(i, k)} | {f"y{i}": v * y for i, v in enumerate(values)} | {"y": y}
    sums = x.where(F.col("_from") < folds).groupBy(F.col("_from").alias("fold")).agg(F.count("*").alias("n"), F.max(time).alias("train_end"), *(F.sum(c).alias(n) for n, c in named.items()))
    every = samples.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    upto = Window.partitionBy(F.lit(0)).orderBy("fold")  # a row a fold
    sums = every.join(sums, "fold", "left").select("fold", *(F.sum(c).over(upto).alias(c) for c in ("n", *named)), F.max("train_end").over(upto).alias("train_end"))
    sums = sums.where((F.col("n") >= min_train) & (F.col("y") > 0) & (F.col("y") < F.col("n")))
    fits = sums.groupBy(F.lit(0).alias("_g")).applyInArrow(_ridge_of_sums(k, penalty), "fold int, train_size long, _weights array<double>")
    fits = F.broadcast(fits)  # a row a fold
    score = F.get("_weights", F.lit(0)) + sum((F.get("_weights", F.lit(i + 1)) * v for i, v in enumerate(values)), F.lit(0.0))
    test = x.join(fits, "fold").withColumn("probability", F.round(sigmoid(score), 12)).drop("_weights", "_from", "train_size")
    trained = x.where(F.col("_from") < folds).withColumn("fold", F.explode(F.sequence(F.col("_from"), F.lit(folds - 1)))).join(fits, "fold").select("fold", label, F.round(sigmoid(score), 12).alias("probability"))
    cut = grouped_quantile(trained, ["fold"], "probability", 1 - selectivity, "threshold")
    predictions = test.join(F.broadcast(cut), "fold").withColumn("selected", F.col("probability") >= F.col("threshold")).select(*samples.columns, "fold", "probability", "selected")
    auc = roc_auc(test.select("fold", label, "probability"), "probability", label, ["fold"]).withColumnRenamed("rows", "test_size")
    train_auc = roc_auc(trained, "probability", label, ["fold"]).select("fold", F.col("auc").alias("train_auc"), F.col("rows").alias("train_size"))
    ends = sums.select("fold", "train_end")
    diagnostics = train_auc.join(auc, "fold").join(cut, "fold").join(ends, "fold").select("fold", "train_size", "test_size", "train_end", "threshold", "auc", "train_auc")
    return predictions, diagnostics

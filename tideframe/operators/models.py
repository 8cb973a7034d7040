"""Small models and their reports, fitted from aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.scalars import content_hash, sigmoid
from tideframe.operators.stats import linear_score


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with missing values at the mean, less the mean, over the deviation; 0 where there is none."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in columns})
    devs = filled.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    return filled.withColumns({c: (F.col(c) - F.lit(means[c])) / F.lit(devs[c]) if devs[c] else F.lit(0.0) for c in columns})


def variant_matrix(df: DataFrame, variants: Mapping[str, Column], r: Mapping[str, Column], parts: Mapping[str, Column]) -> DataFrame:
    """Trades and mean R of each variant in each part of the sample, in one pass; a variant without trades has a null mean."""
    cells = [(v, p) for v in variants for p in parts]
    aggs = [c for v, p in cells for c in (F.count_if(variants[v] & parts[p]).alias(f"n_{v}_{p}"), F.avg(F.when(variants[v] & parts[p], r[v])).alias(f"m_{v}_{p}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(p).alias("part"), F.col(f"n_{v}_{p}").alias("trades"), F.col(f"m_{v}_{p}").alias("mean_r")) for v, p in cells)))
    return df.agg(*aggs).select(rows.alias("_r")).select("_r.*")


def importance(df: DataFrame, columns: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    """feature, importance (size of its correlation with the target) and rank; ties by name."""
    sums = df.agg(*(F.round(F.abs(F.corr(c, target)), digits).alias(c) for c in columns))
    every = F.array(*(F.struct(F.coalesce(F.col(c), F.lit(0.0)).alias("importance"), F.lit(c).alias("feature")) for c in columns))
    ordered = F.array_sort(every, lambda a, b: F.when(a["importance"] != b["importance"], F.signum(b["importance"] - a["importance"])).when(a["feature"] < b["feature"], -1).otherwise(1).cast("int"))
    return sums.select(F.posexplode(ordered).alias("_p", "_f")).select("_f.feature", "_f.importance", (F.col("_p") + 1).alias("rank"))


def scored(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """expected_r, probability and the names of missing features; both are null where one is missing."""
    names = [c for c in weights if c != "intercept"]
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in names)))
    score = linear_score(dict(weights))
    return df.withColumn("expected_r", score).withColumn("probability", sigmoid(F.col("expected_r"))).withColumn("missing", missing)


def random_entries(df: DataFrame, key: str, r: str, seeds: int, below: str) -> DataFrame:
    """Per seed: entries and mean of the rows whose digest of key and seed is below a hexadecimal bound."""
    x = df.select(r, F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda s: F.struct(s.cast("long").alias("seed"), F.md5(F.concat_ws(":", F.col(key).cast("string"), s.cast("string"))).alias("h"))), lambda x: x["h"] < below)).alias("s"))
    return x.groupBy(F.col("s.seed").alias("seed")).agg(F.count("*").alias("entries"), F.avg(r).alias("mean_r"))


def sign(models: DataFrame, columns: Sequence[str], to: str = "digest") -> DataFrame:
    return models.withColumn(to, content_hash(*(F.col(c) for c in columns)))


def checked(models: DataFrame, columns: Sequence[str], to: str, digest: str = "digest") -> DataFrame:
    """Whether each row still has the content it was signed with."""
    return models.withColumn(to, F.col(digest).eqNullSafe(content_hash(*(F.col(c) for c in columns))))


def boosted(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, depth: int, iterations: int, rate: float = 0.05, least: int = 40) -> DataFrame:
    """test with the probability of label 1 by gradient-boosted trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    put = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=iterations, stepSize=rate, minInstancesPerNode=least, seed=7).fit(put.transform(train))
    return model.transform(put.transform(test)).withColumn("probability", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "prediction")

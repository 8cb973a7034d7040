"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document is a set of weighted terms: its words, each as often as it stands there. For every slot, each term draws, from
its hash alone, r and c of Gamma(2, 1) and b of U(0, 1). With t = floor(ln(weight) / r + b), the value of the term is
ln(a) = ln(c) - r * (t - b + 1), and the term of least value is the slot's sample. Two documents have the same sample
with a probability of their generalised Jaccard similarity (sum of the smaller weights by sum of the larger ones). A value
tells its term and t, so the slot keeps the value alone, which needs a minimum and no row of a table of terms.

Gamma quantiles come from a table of LEVELS values in equal steps of probability, an array column of one row that is
broadcast (128 kB whatever the data). All slots are minima of one aggregation, inside whole-stage code.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.llm.common import documents, text_of, unused

SLOTS = 64
#: Bits of a hash that choose r and c; the rest are b.
LEVEL_BITS = 13
LEVELS = 1 << LEVEL_BITS
_SPACE = r"[\x20\x09-\x0D]+"


def gamma_quantiles(levels: int = LEVELS) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), at the middle of each step."""
    p = (np.arange(levels) + 0.5) / levels
    low, high = np.zeros(levels), np.full(levels, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def quantile_table(spark: SparkSession, r_name: str, c_name: str) -> DataFrame:
    """One row: quantiles, and their logarithms."""
    q = gamma_quantiles()
    text = json.dumps({"r": q.tolist(), "c": np.log(q).tolist()})
    # Depends on a column, so that the optimizer doesn't copy the arrays into each expression.
    parsed = F.from_json(F.when(F.col("id") >= 0, F.lit(text)), "r array<double>, c array<double>").alias("t")
    return spark.range(1).select(parsed).select(F.col("t.r").alias(r_name), F.col("t.c").alias(c_name))


def with_terms(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the array of distinct terms (hash, count) of a text; words are separated by ASCII white space."""
    hashes, lasts = unused(df, "_hashes", "_lasts")
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), "")
    df = df.withColumn(hashes, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))))
    last = F.transform(hashes, lambda h, i: F.when(F.get(F.col(hashes), i + 1).eqNullSafe(h), F.lit(None)).otherwise(i))
    df = df.withColumn(lasts, F.array_compact(last))
    count = lambda at, k: at - F.coalesce(F.get(F.col(lasts), k - 1), F.lit(-1))
    return df.withColumn(to, F.transform(lasts, lambda at, k: F.struct(F.get(F.col(hashes), at).alias("term"), count(at, k).alias("n")))).drop(hashes, lasts)


def slot_value(term: Column, weight: Column, slot: int, r_table: Column, c_table: Column) -> Column:
    """ln(a) of a term in a slot; weight is a logarithm."""
    bits = F.xxhash64(term, F.lit(slot))
    r = F.get(r_table, bits.bitwiseAND(LEVELS - 1).cast("int"))
    log_c = F.get(c_table, F.shiftrightunsigned(bits, LEVEL_BITS).bitwiseAND(LEVELS - 1).cast("int"))
    b = F.shiftrightunsigned(bits, 2 * LEVEL_BITS) * F.lit(2.0 ** (2 * LEVEL_BITS - 64))
    return log_c - r * (F.floor(weight / r + b) - b + F.lit(1.0))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", to: str = "slots", slots: int = SLOTS) -> DataFrame:
    """One row (keys, slots) for each distinct row of keys: an array of 32-bit numbers, one a slot.

    Rows with equal keys are one document whose terms of the larger weight count, so repeated rows change nothing. Null
    texts count as empty; texts without words have the same slots, those of no term. Null keys are keys. Other columns are
    dropped. An empty table gives an empty result.
    """
    taken = ["terms_", "r_", "c_", "t_", "term_", "weight_", "none_", *(f"s{i}_" for i in range(slots))]
    clash = set(taken) & {k.lower() for k in keys}
    if clash:
        raise ValueError(f"keys must not be named {sorted(clash)}")
    rows = with_terms(docs, text, "terms_").select(*keys, "terms_").join(F.broadcast(quantile_table(docs.sparkSession, "r_", "c_")))
    rows = rows.select(*keys, "r_", "c_", F.explode_outer("terms_").alias("t_"))
    none = F.col("t_").isNull()
    # Without nulls in what the slots read: a term of its own stands for no terms.
    rows = rows.select(*keys, "r_", "c_", F.coalesce(F.col("t_.term"), F.lit(0)).alias("term_"), F.when(none, F.lit(-1.0)).otherwise(F.ln(F.col("t_.n"))).alias("weight_"))
    least = [F.min(slot_value(F.col("term_"), F.col("weight_"), i, F.col("r_"), F.col("c_"))).alias(f"s{i}_") for i in range(slots)]
    return rows.groupBy(*keys).agg(*least).select(*keys, F.array(*(F.xxhash64(f"s{i}_").bitwiseAND(0xFFFFFFFF) for i in range(slots))).alias(to))


def likeness(a: Column, b: Column) -> Column:
    """Share of slots that agree: an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")


def as_hex(slots: Column) -> Column:
    """8 hex digits a slot."""
    return F.array_join(F.transform(slots, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


# The query: texts, edited texts and next documents ------------------------------------------------------------------------------------------------------


def in_order(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, place, id, text, next_text, halo) in ascending order of id (null first), then text.

    next_text is the text of the row that follows; after the last row, the first. Each bucket, a range of the order, ends
    with a halo row, a copy of the row that follows it. Texts are shuffled once, by bucket; rows that repeat an id and a
    text stay in one bucket. buckets: at most so many, whose bounds are at the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct("id", "h")
    keys = rows.select("id", "h").repartitionByRange(buckets, "id", "h").withColumn("part", F.spark_partition_id())
    heads = [r["head"] for r in keys.groupBy("part").agg(F.min(key).alias("head")).orderBy("head").collect()]

    id_type = docs.schema[id_col].dataType

    def head(i: int) -> Column:
        return F.struct(F.lit(heads[i]["id"]).cast(id_type).alias("id"), F.lit(heads[i]["h"]).alias("h"))

    def bucket_of(low: int, high: int) -> Column:
        """The last bucket from low to high whose head is not behind the row."""
        if low >= high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(key >= head(mid), bucket_of(mid, high)).otherwise(bucket_of(low, mid - 1))

    rows = rows.withColumn("bucket", bucket_of(0, max(len(heads) - 1, 0)))
    bounds = spark.createDataFrame([(r["id"], r["h"], (i - 1) % len(heads)) for i, r in enumerate(heads)], f"id {id_type.simpleString()}, h long, before int")
    first = rows.join(F.broadcast(bounds), rows["id"].eqNullSafe(bounds["id"]) & (rows["h"] == bounds["h"])).select(F.col("before").alias("bucket"), rows["id"], "text", rows["h"]).dropDuplicates(["bucket"])
    both = rows.select("bucket", "id", "text", "h", F.lit(False).alias("halo")).unionByName(first.select("bucket", "id", "text", "h", F.lit(True).alias("halo")))
    order = Window.partitionBy("bucket").orderBy("halo", "id", "h")
    return both.select("bucket", F.row_number().over(order).alias("place"), "id", "text", F.lead("text").over(order).alias("next_text"), "halo")


def compare_edited(docs: DataFrame, slots: int = SLOTS, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the first floor(n_chars / 2) code points (or all) of the next document in place of the last as many;
    documents follow each other as in in_order(). Null texts count as empty, two texts without words are alike. A single
    row is its own next. Repeated ids and rows are fingerprinted each. Other columns are not read; an empty table gives
    an empty result.
    """
    rows = in_order(docs, buckets, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "place", "id", "halo", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    whole = F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"))
    both = F.when(F.col("halo"), F.array(whole)).otherwise(F.array(whole, F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    kinds = rows.select("bucket", "place", "id", "halo", "n_chars", F.explode(both).alias("k")).select("bucket", "place", "id", "halo", "n_chars", "k.*")
    kinds = kinds.withColumn("sha", F.when(F.col("kind") == 1, F.sha2("text", 256)))
    # What a row needs besides its slots is among the keys. All keys begin with the bucket, so nothing is shuffled again.
    found = fingerprints(kinds, ["bucket", "place", "kind", "id", "halo", "n_chars", "sha"], slots=slots)
    order = Window.partitionBy("bucket").orderBy("place", "kind")
    lined = found.select("*", F.lead("slots").over(order).alias("edited"), F.lead("sha").over(order).alias("edited_sha256"), F.lead("slots", 2).over(order).alias("next"))
    lined = lined.where((F.col("kind") == 0) & ~F.col("halo"))
    return lined.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("slots")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("slots"), F.col("edited")).alias("near_edited"), likeness(F.col("slots"), F.col("next")).alias("near_next"))


def op13_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))

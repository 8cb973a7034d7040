"""Exact deduplication as a stateful stream.

A stream reads documents file by file. Its state is keyed by the digest of a text, never expires and lives in RocksDB,
on disk. For each digest it keeps the stable identifier of the document that stays (the largest id), the locator of
that document's content (file and row) and the number of documents. Rows of a batch are combined by digest before
they reach the state, so a text with very many copies sends one row a task.

A digest that was seen before is a hit. For hits, the full bytes are compared with the content at the kept locator;
texts that differ in spite of an equal digest become groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import bloom_semi, documents, maybe_in, scratch, stage, text_of, unused

#: Settings of the state store while the stream runs.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each partition's store sets aside some MB of disk, however few keys it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Stores of a stream that has ended are closed at the next maintenance; until then their memory stays with executors.
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


#: Stands for a null id in the state, below all others.
_NO_ID = -(2**63)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _located(source: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_of(text_col)
    return source.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        digest(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(F.col("_metadata.file_name")).alias("file_key"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def stream_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all files at path and return its state, one row a digest.

    checkpoint: a folder of an earlier run goes on with its state and reads only files that came since.
    """
    checkpoint = checkpoint or scratch(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # as a glob, the path may also be a single file
        state = (
            _located(source, id_col, text_col, digest)
            .groupBy("digest", "n_bytes")
            .agg(F.max(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "file_key", "row_index")).alias("stays"), F.count("*").alias("group_size"))
        )
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        # The state's value is what the aggregation keeps of a digest: the row that stays, then the count.
        state = spark.read.format("statestore").load(checkpoint)
        value = F.col("value").cast("struct<stays:struct<doc_id:bigint,file_key:bigint,row_index:bigint>,group_size:bigint>")
        return state.select("key.digest", "key.n_bytes", value.alias("v")).select("digest", "n_bytes", F.nullif("v.stays.doc_id", F.lit(_NO_ID)).alias("keep_id"), "v.stays.file_key", "v.stays.row_index", "v.group_size")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup_files(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, checkpoint: str | None = None) -> DataFrame:
    """Group equal texts of the Parquet files at path; the largest id of a group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row read. Null text counts as empty, and
    all empty texts are one group. Rows that repeat an id with an equal text count in group_size; each of them is
    marked kept when its id is the group's largest. Rows with a null id belong to groups and are never kept unless
    the whole group has none; then one of them is. Other columns are not read. An empty table gives an empty result.
    """
    state = stage(stream_state(spark, path, id_col, text_col, digest, files_per_batch, checkpoint), "state")
    rows = _located(spark.read.parquet(path), id_col, text_col, digest)
    key = F.xxhash64("digest", "n_bytes")

    # Hits: full bytes against the content at the kept locator. The Bloom filter leaves out texts seen once.
    repeated = state.where("group_size > 1")
    members = bloom_semi(rows.withColumn("key", key), "key", repeated.select(key.alias("key")))
    kept = members.join(repeated.select("digest", "n_bytes", "file_key", "row_index"), ["digest", "n_bytes", "file_key", "row_index"], "left_semi")
    hits = members.alias("m").join(kept.select("digest", "n_bytes", F.col("text").alias("kept_text")).alias("k"), ["digest", "n_bytes"])
    differing = stage(hits.where("text <> kept_text").select("doc_id", "digest", "n_bytes", "file_key", "row_index", F.sha2(F.encode("text", "UTF-8"), 512).alias("variant")), "differing")

    narrow = rows.select("doc_id", "digest", "n_bytes", "file_key", "row_index", sha256(F.col("text")).alias("text_sha256"))
    if differing.isEmpty():
        out = narrow.join(state.select("digest", "n_bytes", "keep_id", "group_size", F.col("file_key").alias("f"), F.col("row_index").alias("r")), ["digest", "n_bytes"])
    else:
        stays = F.max(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "file_key", "row_index"))
        groups = differing.groupBy("digest", "n_bytes", "variant").agg(stays.alias("s"), F.count("*").alias("group_size")).select("digest", "n_bytes", "variant", F.nullif("s.doc_id", F.lit(_NO_ID)).alias("keep_id"), "group_size", F.col("s.file_key").alias("f"), F.col("s.row_index").alias("r"))
        less = differing.groupBy("digest", "n_bytes").agg(F.count("*").alias("less"))
        first = state.join(less, ["digest", "n_bytes"], "left").select("digest", "n_bytes", F.lit("").alias("variant"), "keep_id", (F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"), F.col("file_key").alias("f"), F.col("row_index").alias("r"))
        marked = narrow.join(differing.select("file_key", "row_index", "variant"), ["file_key", "row_index"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
        out = marked.join(first.unionByName(groups), ["digest", "n_bytes", "variant"])
    here = F.col("keep_id").isNotNull() | ((F.col("file_key") == F.col("f")) & (F.col("row_index") == F.col("r")))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & here).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """exact_dedup_files for any DataFrame, which is written to the shared folder first."""
    staged = scratch(docs.sparkSession, "docs")
    docs.select(F.col(id_col), F.col(text_col)).write.option("compression", "zstd").parquet(staged)
    return exact_dedup_files(docs.sparkSession, staged, id_col, text_col, **options)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that exact_dedup() drops, and all columns whatever their names.

    Rows that repeat an id and a text leave one. Only rows whose id may be among those of groups with more than one row
    are shuffled. Rows with a null id stay.
    """
    found = stage(exact_dedup(docs, id_col, text_col, **options).where("group_size > 1").select("doc_id", "kept", "text_sha256"), "copies")
    maybe = maybe_in(docs.sparkSession, found.select("doc_id").distinct())
    id_, suspect, sha, kept = unused(docs, "_id", "_suspect", "_sha", "_kept")
    key = F.col(id_col).cast("long")
    flagged = docs.withColumn(suspect, F.when(key.isNull(), False).otherwise(maybe(F.coalesce(key, F.lit(0)))))
    suspects = flagged.where(F.col(suspect)).withColumn(id_, key).withColumn(sha, sha256(text_of(text_col)))
    in_group = found.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.bool_or("kept").alias(kept))
    judged = suspects.join(in_group, [id_, sha], "left")
    stay = judged.where(F.col(kept).isNull()).select(*docs.columns).unionByName(judged.where(F.col(kept)).dropDuplicates([id_, sha]).select(*docs.columns))
    return flagged.where(~F.col(suspect)).select(*docs.columns).unionByName(stay)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_files(spark, f"{sf_dir}/documents.parquet")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

"""Shared helpers: table access, scratch tables in the shared folder, bounded Bloom filters."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch folders made in this process, oldest first; clean_scratch() removes them.
_scratch: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and all runs on one machine, as in local
    tests, a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}/{name}"
    _scratch.append(path.rsplit("/", 1)[0])
    return path


def clean_scratch(spark: SparkSession) -> None:
    """Remove scratch tables of earlier operators, whose results have been written elsewhere by now."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _scratch:
        path = hadoop.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim_driver(spark: SparkSession) -> None:
    """Have the driver's JVM give native memory that it has freed back to the system, as `jcmd System.trim_native_heap`.

    What the compilers of a driver that plans many jobs have freed stays in the allocator's arenas, some hundred MB.
    A JVM that has no such command is left as it is.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # The server's own class is not public, so that its methods are called by way of the interface.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = gateway.new_array(jvm.java.lang.Object, 4)  # the last two are no parameters and no signature
    given[0], given[1] = commands, "systemTrimNativeHeap"
    try:
        invoke.invoke(server, given)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getName() != "java.lang.reflect.InvocationTargetException":
            raise


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, for rows that hold whole texts or sets; a bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, str(size))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in an Arrow batch for the jobs run meanwhile: rows hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


# Bounded vectors, summed or or-ed over the cluster ---------------------------------------------------------------

_SLOTS = 1 << 14


def _sliced(vector: np.ndarray) -> pa.RecordBatch:
    """Non-zero slices of a vector as rows (slice number, bytes)."""
    parts = vector.reshape(-1, _SLOTS)
    used = np.flatnonzero(parts.any(axis=1))
    return pa.record_batch({"slot": pa.array(used, pa.int32()), "cells": pa.array([parts[i].tobytes() for i in used], pa.binary())})


def vector_total(partial: DataFrame, length: int, dtype: str, how: str) -> np.ndarray:
    """Combine rows (slot, cells) of partial vectors, one vector a task, into one of fixed length at the driver.

    Its size depends on the length parameter alone, never on the data. A slot's rows are streamed.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = None, None
        for batch in batches:
            done = []
            for at, cells in zip(batch.column("slot").to_pylist(), batch.column("cells")):
                part = np.frombuffer(cells.as_buffer(), dtype)
                if at != slot:
                    if slot is not None:
                        done.append((slot, total.tobytes()))
                    slot, total = at, part.copy()
                elif how == "or":
                    total |= part
                else:
                    total += part
            yield pa.record_batch({"slot": pa.array([x[0] for x in done], pa.int32()), "cells": pa.array([x[1] for x in done], pa.binary())})
        if slot is not None:
            yield pa.record_batch({"slot": pa.array([slot], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    # Behind the exchange: a task has one Python worker at a time, whose memory stays while it is reused.
    merged = partial.repartition("slot").sortWithinPartitions("slot").mapInArrow(combine, "slot int, cells binary")
    out = np.zeros(length, dtype)
    for row in merged.collect():
        out[row["slot"] * _SLOTS : (row["slot"] + 1) * _SLOTS] = np.frombuffer(row["cells"], dtype)
    return out


def may_hold(spark: SparkSession, keys: DataFrame, bits: int = 1 << 24) -> Callable[[np.ndarray], np.ndarray]:
    """A function for tasks that tells of int64 values whether they may be among keys (one bigint column); some others
    pass as well.

    For use before an exact join. The broadcast is bits / 8 bytes (2 MB by default) whatever the number of keys; with
    very many keys more rows pass, and the join that follows still decides.
    """
    name = keys.columns[0]

    def places(k: np.ndarray) -> list[np.ndarray]:
        u = k.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        v = (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return [((x >> np.uint64(20)) % np.uint64(bits)).astype(np.int64) for x in (u, v, u ^ (v << np.uint64(7)))]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for p in places(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield _sliced(own)

    total = vector_total(keys.where(F.col(name).isNotNull()).mapInArrow(fill, "slot int, cells binary"), bits // 8, "uint8", "or")
    shared = spark.sparkContext.broadcast(total)

    def among(k: np.ndarray) -> np.ndarray:
        own, ok = shared.value, np.ones(len(k), bool)
        for p in places(k):
            ok &= (own[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return ok

    return among


def maybe_in(spark: SparkSession, keys: DataFrame, bits: int = 1 << 24):
    """may_hold() as a UDF of a bigint column without nulls."""
    among = may_hold(spark, keys, bits)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(among(k.to_numpy()))

    return maybe


def bloom_semi(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows of df whose bigint key (not null) may be among keys."""
    return df.where(maybe_in(df.sparkSession, keys, bits)(F.col(key)))


def result_path(spark: SparkSession, name: str) -> str:
    """Where a result goes that clean_scratch() leaves."""
    return f"{shared_dir(spark)}/result-{uuid.uuid4().hex}/{name}"

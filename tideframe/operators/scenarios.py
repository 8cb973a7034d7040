"""Runs of a matrix of scenarios, whose failures are rows, and the library's views and functions for SQL users."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from tideframe.sources.files import merged


def run_scenarios(spark: SparkSession, base: Mapping[str, object], matrix: Mapping[str, Mapping[str, object]], runner: Callable[[SparkSession, dict], DataFrame], folder: str, schema: str, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """runner(spark, merged configuration) for each scenario, a few at once, each in a job group of its name.

    Returns the rows of those that completed (schema, then scenario), from Parquet under `folder`, and a report: scenario,
    run_status (completed or failed), error, message, config. A scenario that fails, while its plan or its jobs are made,
    is a row of the report and leaves the others alone. What is at the driver is a line a scenario.
    """

    def run(name: str) -> tuple[str, str, str | None, str | None, str]:
        config = merged(base, matrix[name])
        spark.sparkContext.setJobGroup(f"scenario {name}", name, True)
        try:
            rows = runner(spark, config)
            rows.select(*spark.createDataFrame([], schema).columns).write.mode("overwrite").parquet(f"{folder}/scenario={name}")
        except Exception as e:  # noqa: BLE001 - whatever a runner raises is a row
            return name, "failed", type(e).__name__, str(e).splitlines()[0][:500] if str(e) else "", json.dumps(config, sort_keys=True)
        return name, "completed", None, None, json.dumps(config, sort_keys=True)

    with ThreadPoolExecutor(at_once) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(run), matrix))
    report = spark.createDataFrame(lines, "scenario string, run_status string, error string, message string, config string")
    done = [name for name, status, *_ in lines if status == "completed"]
    parts = [spark.read.schema(schema).parquet(f"{folder}/scenario={name}").withColumn("scenario", F.lit(name)) for name in done]
    rows = parts[0] if parts else spark.createDataFrame([], f"{schema}, scenario string")
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, report


_WINDOW = "fold int, train_start long, train_end long, validation_start long, validation_end long, test_start long, test_end long"


class WalkForwardWindows:
    """Windows over the ordered rows of a table of times: a row each time a window's last time comes by. Holds the times
    of one window."""

    def __init__(self):
        self.held: deque = deque()
        self.seen, self.first = 0, None

    def eval(self, row: Row, train: int, validation: int, test: int, step: int, anchored: bool) -> Iterator[tuple]:
        n = train + validation + test
        self.first = row[0] if self.first is None else self.first
        self.held.append(row[0])
        self.seen += 1
        if len(self.held) > n:
            self.held.popleft()
        start = self.seen - n
        if start >= 0 and start % step == 0:
            t = self.held
            yield start // step, self.first if anchored else t[0], t[train - 1], t[train], t[train + validation - 1], t[train + validation], t[n - 1]


def register_sql(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """Tables as temporary views, and walk_forward_windows(TABLE(times) ORDER BY time, train, validation, test, step,
    anchored) as a table function: with a single partition of distinct times, the rows of predicates.walk_forward()."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.udtf.register("walk_forward_windows", udtf(WalkForwardWindows, returnType=_WINDOW))

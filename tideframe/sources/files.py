"""Scans of files: candle CSVs, minute and kline archives, metrics, snapshots with manifests; a content-keyed cache."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions.scalars import clean_text, from_epoch
from tideframe.operators.quality import require_columns


def candle_csv(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """CSV with a header as text columns; ValueError for missing columns, columns that know the future, or no row."""
    rows = require_columns(spark.read.option("header", True).csv(path), columns)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def _last(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in key and not c.startswith("_")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def minute_archive(spark: SparkSession, path: str, start: int, end: int, names: Sequence[str] = ("open_time", "open", "high", "low", "close", "volume")) -> DataFrame:
    """Minute bars of files named after their pair: header lines go, of repeated open times the last line stays.

    Times are seconds within start <= t < end; numbers that can't be read become null. Lines are ordered by file, and by
    place within it.
    """
    raw = spark.read.schema(", ".join(f"{c} string" for c in names)).csv(path)
    x = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"pair=([^/]+)/", 1).alias("pair"), *(F.col(c).try_cast("long" if c == names[0] else "double").alias(c) for c in names), F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"))
    return _last(x.where(F.col(names[0]).between(start, end - 1)), ["pair", names[0]], F.col("_at"))


def kline_lines(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Kline lines without header: open time (ms or us), open, high, low, close, volume, close time, then optional fields.

    Lines that don't begin with a number go. Close times are the last unit of a bar, hence one microsecond is added.
    Optional fields (quote volume, trades, taker volume) default to 0. start, end: seconds.
    """
    f = F.split("value", ",")
    opened = F.get(f, F.lit(0)).try_cast("long")
    number = lambda i: F.get(f, F.lit(i)).try_cast("double")
    closed = F.unix_micros(from_epoch(F.get(f, F.lit(6)).try_cast("long"))) + 1
    x = spark.read.text(path).select(
        opened.alias("raw"), F.unix_micros(from_epoch(opened)).alias("open_us"), closed.alias("close_us"),
        number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"), number(5).alias("volume"),
        *(F.coalesce(number(i), F.lit(0.0)).alias(c) for i, c in ((7, "quote_volume"), (8, "trades"), (9, "taker_buy"))),
    )
    return x.where(F.col("raw").isNotNull() & F.col("open_us").between(start * 1_000_000, end * 1_000_000 - 1)).drop("raw")


def metrics_csv(spark: SparkSession, path: str, numbers: Sequence[str]) -> DataFrame:
    """Metrics CSV with a header: blank numbers are null, and source_file tells where a row is from."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(clean_text(F.col(c)).try_cast("double").alias(c) if c in numbers else F.col(c) for c in raw.columns), F.col("_metadata.file_name").alias("source_file"))


def snapshots(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Rows of all snapshots root/prefix_*/ with the time of their manifest.json ({"created_at": ...}).

    A snapshot without a manifest, or with one that can't be read, gives no rows.
    """
    of = F.regexp_extract(F.col("_metadata.file_path"), rf"/({prefix}_[^/]+)/", 1)
    m = spark.read.schema("created_at long").option("mode", "PERMISSIVE").json(f"{root}/{prefix}_*/manifest.json").select(of.alias("snapshot"), "created_at").where("created_at is not null")
    rows = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(f"{root}/{prefix}_*/rows")
    return rows.select("*", of.alias("snapshot")).join(m, "snapshot")


def materialize(build: Callable[[], DataFrame], folder: str, config: Mapping[str, object]) -> DataFrame:
    """build() as Parquet under a digest of its configuration; a hit reads what was written whole and builds nothing."""
    import hashlib

    key = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    spark = SparkSession.active()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(f"{folder}/{key}")
    return spark.read.parquet(f"{folder}/{key}")


def merged(base: Mapping[str, object], overrides: Mapping[str, object]) -> dict[str, object]:
    """A configuration with overrides put in, level by level."""
    out = dict(base)
    for k, v in overrides.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def scenarios(spark: SparkSession, base: Mapping[str, object], matrix: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """One row a scenario: its name and its merged configuration as JSON."""
    return spark.createDataFrame([(k, json.dumps(merged(base, v), sort_keys=True)) for k, v in matrix.items()], "scenario string, config string")


def dictionary(df: DataFrame, groups: Mapping[str, tuple[str, int]], version: str) -> DataFrame:
    """One row a column of df that has an entry: name, group, lookback, availability, rows with a value, and version."""
    names = [c for c in df.columns if c in groups]
    counts = df.agg(*(F.count(c).alias(c) for c in names))
    kind = {f.name: f.metadata.get("availability", "signal_time") for f in df.schema.fields}
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(groups[c][0]).alias("group"), F.lit(groups[c][1]).alias("lookback"), F.lit(kind[c]).alias("availability"), F.col(c).alias("rows"), F.lit(version).alias("version")) for c in names)))
    return counts.select(rows.alias("_d")).select("_d.*")


def daily_closes(spark: SparkSession, path: str, micro_from: int = 10**15) -> DataFrame:
    """symbol, day, close of daily kline files named after their symbol (symbol=.../), with or without a header line.

    A file's open times are microseconds if its largest is over micro_from, else milliseconds. Of a day's repeated lines the
    last of the last file stays; closes that can't be read are null.
    """
    f = F.split("value", ",")
    lines = spark.read.text(path).select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1)).alias("symbol"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"), F.get(f, F.lit(0)).try_cast("long").alias("_open"), F.get(f, F.lit(4)).try_cast("double").alias("close")).where("_open IS NOT NULL")
    units = lines.groupBy("_file").agg(F.when(F.max("_open") > micro_from, 1_000_000).otherwise(1_000).alias("_unit"))
    dated = lines.join(units, "_file").withColumn("day", F.to_date(F.timestamp_seconds(F.expr("_open div _unit"))))
    return _last(dated.select("symbol", "day", "close", "_file", "_line"), ["symbol", "day"], F.struct("_file", "_line"))


def aggregate_trades(spark: SparkSession, path: str) -> DataFrame:
    """symbol, id, us, price, qty, first_id, last_id, aggressive_buy of trade files without header (symbol=.../).

    Lines that don't begin with a number go; lines with fewer than eight fields are an error. Times are milliseconds or
    microseconds by their size.
    """
    f = F.split("value", ",")
    lines = spark.read.text(path).select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1)).alias("symbol"), f.alias("f")).where(F.col("f")[0].rlike("^[0-9]+$"))
    lines = lines.withColumn("f", F.when(F.size("f") >= 8, F.col("f")).otherwise(F.raise_error(F.lit("a trade line has fewer than eight fields")).cast("array<string>")))
    at = lambda i, kind: F.col("f")[i].cast(kind)
    return lines.select("symbol", at(0, "long").alias("id"), F.unix_micros(from_epoch(at(5, "long"))).alias("us"), at(1, "double").alias("price"), at(2, "double").alias("qty"), at(3, "long").alias("first_id"), at(4, "long").alias("last_id"), (F.lower(F.trim(F.col("f")[6])) != "true").alias("aggressive_buy"))


_NUMBER = "decimal(38,18)"


def _field(payload: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A field of a JSON text, typed, and what is wrong with it (null if nothing). kind: text, ms, number, number?."""
    raw = clean_text(F.get_json_object(payload, f"$.{name}"))
    if kind == "text":
        value = F.upper(raw)
    elif kind == "ms":
        value = F.timestamp_millis(raw.try_cast("long"))
    else:
        value = raw.try_cast(_NUMBER)
    wrong = value.isNull() if kind != "number?" else value.isNull() & raw.isNotNull()
    return value, F.when(wrong, F.concat(F.when(raw.isNull(), "missing ").otherwise("malformed "), F.lit(name)))


def funding_pages(spark: SparkSession, path: str, venue: str, market_type: str) -> DataFrame:
    """Funding rows of JSON pages, an array of objects a line: venue, market_type, symbol, funding_t, available_t (seconds;
    known when due), rate, mark_price, reason. Rows with a reason (a required field is missing or malformed) are kept."""
    rows = spark.read.text(path).select(F.explode_outer(F.from_json("value", "array<string>")).alias("row"), "value")
    fields = {"symbol": ("symbol", "text"), "at": ("fundingTime", "ms"), "rate": ("fundingRate", "number"), "mark_price": ("markPrice", "number?")}
    typed = {k: _field(F.col("row"), *v) for k, v in fields.items()}
    reason = F.when(F.col("row").isNull(), "malformed page").otherwise(F.coalesce(*(w for _, w in typed.values())))
    x = rows.select(*(v.alias(k) for k, (v, _) in typed.items()), reason.alias("reason"))
    at = F.unix_seconds("at")
    return x.select(F.lit(venue.lower()).alias("venue"), F.lit(market_type.lower()).alias("market_type"), "symbol", at.alias("funding_t"), at.alias("available_t"), "rate", "mark_price", "reason")


_RATIO = {"long_short_ratio": ("longShortRatio", "number"), "long_account": ("longAccount", "number"), "short_account": ("shortAccount", "number")}
#: Tables of crowding messages by kind: their columns, and field and type of each. Names of fields.
CROWDING = {
    "open_interest": {"symbol": ("symbol", "text"), "event_time": ("time", "ms"), "open_interest": ("openInterest", "number")},
    "open_interest_hist": {"symbol": ("symbol", "text"), "event_time": ("timestamp", "ms"), "sum_open_interest": ("sumOpenInterest", "number"), "sum_open_interest_value": ("sumOpenInterestValue", "number"), "cmc_circulating_supply": ("CMCCirculatingSupply", "number?")},
    "global_long_short": {"symbol": ("symbol", "text"), "event_time": ("timestamp", "ms"), **_RATIO},
    "top_long_short_position": {"symbol": ("symbol", "text"), "event_time": ("timestamp", "ms"), "long_short_ratio": ("longShortRatio", "number"), "long_position": ("longAccount", "number"), "short_position": ("shortAccount", "number")},
    "top_long_short_account": {"symbol": ("symbol", "text"), "event_time": ("timestamp", "ms"), **_RATIO},
}


def routed_messages(spark: SparkSession, path: str, to: str, routes: Mapping[str, Mapping[str, tuple[str, str]]] = CROWDING) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed tables of JSON lines {"kind", "period", "available_ms", "row": {...}} by kind, and the lines that don't fit.

    The lines are read once, and written under `to` in a folder a kind (one more for rejects), from which tables are read
    with their own columns: what the route has, then period and source_available_at. Rejects: line and reason (malformed
    line, unknown kind, or the first field that is missing or malformed).
    """
    envelope = F.from_json("value", "kind string, period string, available_ms long, row string").alias("m")
    lines = spark.read.text(path).select(F.col("value").alias("line"), envelope).select("line", "m.*")
    rows, reasons = [], []
    for kind, columns in routes.items():
        typed = {c: _field(F.col("row"), *spec) for c, spec in columns.items()}
        own = F.col("kind") == kind
        rows.append(F.when(own, F.struct(*(v.alias(c) for c, (v, _) in typed.items()), "period", F.timestamp_millis("available_ms").alias("source_available_at"))).alias(kind))
        reasons.append(F.when(own, F.coalesce(*(w for _, w in typed.values()))))
    known = F.col("kind").isin(*routes)
    reason = F.when(F.col("kind").isNull(), "malformed line").when(~known, "unknown kind").otherwise(F.coalesce(*reasons))
    x = lines.select("line", *rows, reason.alias("reason"), F.when(reason.isNull(), F.col("kind")).otherwise("rejected").alias("table"))
    kept = F.col("table") == "rejected"
    x.select(F.when(kept, F.col("line")).alias("line"), *(F.when(~kept, F.col(k)).alias(k) for k in routes), "reason", "table").write.partitionBy("table").parquet(to)
    written = spark.read.schema(x.schema).parquet(to)
    return {k: written.where(F.col("table") == k).select(f"{k}.*") for k in routes}, written.where("table = 'rejected'").select("line", "reason")

"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. With target weight w, block k of a source is released at floor(k / w) and due at
ceil((k + 1) / w). At each slot the released block with the earliest deadline goes next. Weights are whole numbers
out of a total, so the schedule repeats after that many slots; one period, whose size depends on the weights alone,
is worked out once and every block finds its slot by arithmetic.

Then at any slot t below the point where the first source runs out, a source has had less than one block more or less
than w * t. Beyond it, slots of exhausted sources stay free and the others keep their order. No document is dropped: a source
of weight 0 comes after all others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.llm.common import documents, stage

#: Rows of one numbering group at most (about); a larger source is spread over more groups, so that none grows with
#: the corpus. Smaller sources are spread too, over up to SPREAD groups.
GROUP_ROWS, SPREAD = 20_000, 256
#: Slots of a period for each source at least, so that sources which get a slot only because none gets less take at
#: most one slot in so many from the others.
SOURCE_SLOTS = 32
#: Rows of a period that are broadcast at most; a larger one is written in parts of so many rows and joined.
PERIOD_ROWS = 100_000


def pfair_period(shares: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period of sum(shares) slots."""
    return list(_pfair(shares))


def _pfair(shares: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    total = sum(shares.values())
    released: list[tuple[int, int, str, int, int]] = []
    nexts = [(0, s, 0) for s in sorted(shares) if shares[s] > 0]
    heapq.heapify(nexts)
    for slot in range(total):
        while nexts and nexts[0][0] <= slot:
            release, s, k = heapq.heappop(nexts)
            deadline = -(-(k + 1) * total // shares[s])
            # Of equal deadlines, the window that overlaps its successor goes first: its successor has less room.
            overlaps = (k + 1) * total % shares[s] != 0
            heapq.heappush(released, (deadline, not overlaps, s, k, release))
        deadline, _, s, k, release = heapq.heappop(released)
        yield s, k, slot, release, deadline
        if k + 1 < shares[s]:
            heapq.heappush(nexts, ((k + 1) * total // shares[s], s, k + 1))


def _period_table(spark: SparkSession, shares: Mapping[str, int]) -> DataFrame:
    """pfair_period as a table (_s, _k, _t, _r, _d), never held as a whole as Python objects."""
    names, rows, parts = pa.array(sorted(shares), pa.string()), _pfair(shares), []
    number = {s: i for i, s in enumerate(names.to_pylist())}
    while some := list(islice(rows, PERIOD_ROWS)):
        cells = np.array([(number[s], *rest) for s, *rest in some], np.int64)
        part = spark.createDataFrame(pa.table({"_s": names.take(pa.array(cells[:, 0])), **{c: cells[:, i] for i, c in enumerate(("_k", "_t", "_r", "_d"), 1)}}))
        if not parts and len(some) < PERIOD_ROWS:
            return F.broadcast(part)
        parts.append(stage(part, f"period{len(parts)}"))
    if not parts:
        return spark.createDataFrame([], "_s string, _k long, _t long, _r long, _d long")
    return reduce(DataFrame.unionByName, parts)


def tempered_shares(counts: Mapping[str, int], temperature: float, slots: int) -> dict[str, int]:
    """Whole shares in proportion to count ** temperature, by largest remainder, but at least 1 each.

    Out of `slots`, or of SOURCE_SLOTS a source where that is more. A share is less than 1 off its proportion among
    those above 1; the sources that are raised to 1 take at most one slot in SOURCE_SLOTS from these.
    """
    weight = {s: c**temperature for s, c in counts.items() if c > 0}
    if not weight:
        return {}
    slots = max(slots, SOURCE_SLOTS * len(weight))
    shares: dict[str, int] = {}
    left = sorted(weight, key=lambda s: (weight[s], s))
    total, n = math.fsum(weight.values()), slots
    # From the lightest on: what is below one slot of what is left gets one.
    while left and weight[left[len(shares)]] * n < total:
        s = left[len(shares)]
        shares[s] = 1
        total, n = total - weight[s], n - 1
    exact = {s: weight[s] * n / total for s in left[len(shares) :]}
    shares |= {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: slots - sum(shares.values())]:
        shares[s] += 1
    return shares


def mix(docs: DataFrame, shares: Mapping[str, int] | None = None, temperature: float = 0.5, slots: int = 1000, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """Give every row its place in the mixture.

    shares: source to whole weight; by default count ** temperature out of `slots` or more (tempered_shares). A source
    that shares leaves out gets weight 1; one of weight 0 comes after all others, block by block. The number of sources is small against the rows: their counts, and nothing else, come to the driver.
    Adds mix_block (block within the source), mix_slot, mix_release, mix_deadline and mix_offset (row within the
    block); ordering by mix_slot, mix_offset is the mixture. Rows of a source are taken in the order of a hash of id
    and content (repeated rows in any order), so that an id with many rows is spread. A null source is a source of its
    own. An empty table stays empty. prefix: of the names added; columns of such names are replaced, all others pass,
    whatever their names.
    """
    spark = docs.sparkSession
    added = [prefix + c for c in ("block", "slot", "release", "deadline", "offset")]
    docs = docs.drop(*added)
    source = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    content = [c for c, t in docs.dtypes if "map<" not in t]
    place = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), *content)
    # A row travels as one struct, so that no name of its columns meets one of those used here.
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), source.alias("_s"), place.alias("_h"))
    counts = {r["_s"]: r["count"] for r in keyed.groupBy("_s").count().collect()}
    if shares is None:
        shares = tempered_shares(counts, temperature, slots)
    else:
        shares = {"s" + s if s is not None else "n": w for s, w in shares.items()}
        shares = {s: shares.get(s, 1) for s in counts}
        if any(w < 0 or w != int(w) for w in shares.values()):
            raise ValueError("weights must be whole numbers of 0 or more")
    if not counts:
        return docs.select("*", *(F.lit(None).cast("long").alias(c) for c in added))

    period = sum(shares.values())
    blocks = {s: -(-c // block_docs) for s, c in counts.items()}
    # Sources of weight 0 begin where the last round of the others ends, one after another.
    end = max((-(-blocks[s] // w) * period for s, w in shares.items() if w), default=0)
    last: dict[str, int] = {}
    for s in sorted(s for s, w in shares.items() if not w):
        last[s], end = end, end + blocks[s]

    # Number the rows of each source 0, 1, 2 ...: sources are split into hash groups of bounded size.
    groups = spark.createDataFrame([(s, max(math.ceil(c / GROUP_ROWS), min(SPREAD, math.ceil(c / 64))), max(1, shares[s]), last.get(s)) for s, c in counts.items()], "_s string, _groups long, _share long, _last long")
    split = keyed.join(F.broadcast(groups), "_s").withColumn("_g", F.floor(F.pmod(F.shiftright("_h", 8), F.lit(1 << 40)) * F.col("_groups") / F.lit(1 << 40)).cast("long"))
    sizes = split.groupBy("_s", "_g").count()
    starts = sizes.withColumn("_start", F.sum("count").over(Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))).select("_s", "_g", F.coalesce("_start", F.lit(0)).alias("_start"))
    within = Window.partitionBy("_s", "_g").orderBy("_h", "_id")
    numbered = split.withColumn("_n", F.row_number().over(within) - 1).join(starts, ["_s", "_g"]).withColumn("_n", F.col("_n") + F.col("_start"))

    table = _period_table(spark, shares)
    block = F.floor(F.col("_n") / F.lit(block_docs)).cast("long")
    round_ = F.floor(F.col("_block") / F.col("_share")).cast("long")
    placed = numbered.withColumn("_block", block).withColumn("_k", F.col("_block") % F.col("_share")).join(table, ["_s", "_k"], "left" if last else "inner")
    at = lambda c, late=0: F.coalesce(F.col("_last") + F.col("_block") + late, round_ * period + F.col(c))
    return placed.select(
        "_doc.*",
        F.col("_block").alias(added[0]),
        at("_t").alias(added[1]),
        at("_r").alias(added[2]),
        at("_d", 1).alias(added[3]),
        (F.col("_n") % F.lit(block_docs)).cast("long").alias(added[4]),
    )


def laid_out(mixed: DataFrame, partitions: int | None = None, prefix: str = "mix_") -> DataFrame:
    """Rows in the order of the mixture: ranges of slots, each sorted."""
    order = [f"{prefix}slot", f"{prefix}offset"]
    ranged = mixed.repartitionByRange(partitions, *order) if partitions else mixed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source"))

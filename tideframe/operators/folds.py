"""Folds with memory over each key's rows in order: admission under an exposure cap, exits that wait for a profit.

Rows stream through sorted partitions. A task holds one batch and the state of one key, whatever the key's number of rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tideframe.operators.setups import first_failing


class Fold(Protocol):
    """What a key's rows go through: each gives rows of the result, and so does their end."""

    def row(self, *values) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def ordered_fold(df: DataFrame, by: list[str], order: list[str], fields: list[str], start: Callable[..., Fold], schema: str) -> DataFrame:
    """Rows of `schema` that a fold gives; start(*key) makes the fold of a key, which gets `fields` of its rows in order.

    Rows that are equal in key and order come in any order among them. Null keys are keys.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(types)
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, types)], schema=types)

        for batch in batches:
            out: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in by))
            for own, values in zip(keys, zip(*(batch.column(c).to_pylist() for c in fields))):
                if fold is None or own != key:
                    if fold is not None:
                        out += fold.end()
                    key, fold = own, start(*own)
                out += fold.row(*values)
            yield packed(out)
        if fold is not None:
            yield packed(list(fold.end()))

    columns = list(dict.fromkeys([*by, *order, *fields]))
    return df.select(*columns).repartition(*(F.col(c) for c in by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


# Admission -------------------------------------------------------------------------------------------------------------


class Exposure:
    """Takes a candidate while the risk of those that are open, and its own, stay within the cap.

    Open risk is released at the exit time (an exit at a candidate's time counts as before it); a null exit never is.
    cap: most accepted ones; after a loss the next `cooldown` candidates are skipped, which only skipping counts down.
    """

    def __init__(self, key: tuple, max_exposure: float | None, cap: int | None, cooldown: int):
        self.key, self.max_exposure, self.cap, self.cooldown = key, max_exposure, cap, cooldown
        self.exits: list[tuple[int, float]] = []  # a heap: the first to be released on top
        self.held: list[float] = []  # risk that is never released
        self.taken = self.wait = 0

    def reason(self, at: int, exit_at: int | None, risk: float, result: float | None) -> str | None:
        while self.exits and self.exits[0][0] <= at:
            heapq.heappop(self.exits)
        if self.cap is not None and self.taken >= self.cap:
            return "trade_cap"
        if self.wait > 0:
            self.wait -= 1
            return "cooldown"
        if self.max_exposure is not None and sum(r for _, r in self.exits) + sum(self.held) + risk > self.max_exposure:
            return "symbol_exposure_cap"
        if exit_at is None:
            self.held.append(risk)
        else:
            heapq.heappush(self.exits, (exit_at, risk))
        self.taken += 1
        self.wait = self.cooldown if result is not None and result < 0 else 0
        return None

    def row(self, name, at, exit_at, risk, result):
        return [(*self.key, name, self.reason(at, exit_at, risk, result))]

    def end(self):
        return []


def admission(candidates: DataFrame, by: list[str], checks: Mapping[str, Column], max_exposure: float | None = None, cap: int | None = None, cooldown: int = 0, name: str = "id", time: str = "decision_t", exit_time: str = "exit_t", risk: str = "risk", result: str = "net_r") -> DataFrame:
    """Key, name and reason of each candidate: null when accepted, else why not.

    checks come first (reason -> condition that rejects) and need no order; a candidate that fails one is not seen by the
    fold, so it takes no exposure and no place. Then, per key in order of time and name: trade_cap, cooldown,
    symbol_exposure_cap, as Exposure has them. Only candidates that pass the checks are sorted.
    """
    marked = candidates.withColumn("_reason", first_failing(checks))
    schema = StructType([candidates.schema[c] for c in [*by, name]]).toDDL() + ", reason string"
    passed = marked.where("_reason IS NULL").select(*by, F.col(name), F.col(time), F.col(exit_time), F.col(risk).cast("double").alias(risk), F.col(result).cast("double").alias(result))
    folded = ordered_fold(passed, by, [time, name], [name, time, exit_time, risk, result], lambda *key: Exposure(key, max_exposure, cap, cooldown), schema)
    return marked.where("_reason IS NOT NULL").select(*by, name, F.col("_reason").alias("reason")).unionByName(folded)


# Exits that wait for a profit ------------------------------------------------------------------------------------------


class Extremes:
    """Largest value after a row, among those seen: rows that no later one exceeds, in a stack."""

    def __init__(self):
        self.at: list[int] = []
        self.value: list[float] = []

    def add(self, at: int, value: float) -> None:
        while self.value and self.value[-1] <= value:
            self.at.pop()
            self.value.pop()
        self.at.append(at)
        self.value.append(value)

    def after(self, at: int) -> float | None:
        k = bisect_right(self.at, at)
        return self.value[k] if k < len(self.at) else None


class ProfitExits:
    """Entries leave at a fading bar with the target reached, or, once max_hold old, with the costs earned.

    Open entries wait in heaps by their price: those with the lowest one reach a threshold first, so a bar looks at those
    that leave and one more.
    """

    def __init__(self, key: tuple, target: float, cost: float, min_hold: int, max_hold: int):
        self.key, self.target, self.cost, self.min_hold, self.old_from = key, target, cost, min_hold, max(min_hold, max_hold)
        self.fresh: deque = deque()  # entries (n, price) that are not min_hold old
        self.aging: deque = deque()  # those that are not old
        self.open: list[tuple[float, int]] = []
        self.old: list[tuple[float, int]] = []
        self.left: set[int] = set()  # gone from one heap and still in the other
        self.highs, self.lows = Extremes(), Extremes()
        self.last: tuple[int, float] | None = None

    def out(self, entry: int, price: float, at: int, close: float, reason: str) -> tuple:
        high, low = self.highs.after(entry), self.lows.after(entry)
        best, worst = (0.0 if high is None else max(0.0, high / price - 1)), (0.0 if low is None else min(0.0, -low / price - 1))
        return (*self.key, entry, price, at, close, reason, "open" if reason == "open_unrealized" else "closed", close / price - 1, best, worst)

    def row(self, n, high, low, close, fading, enters):
        self.highs.add(n, high)
        self.lows.add(n, -low)
        while self.fresh and n - self.fresh[0][0] >= self.min_hold:
            at, price = self.fresh.popleft()
            heapq.heappush(self.open, (price, at))
        while self.aging and n - self.aging[0][0] >= self.old_from:
            at, price = self.aging.popleft()
            if at in self.left:
                self.left.discard(at)
            else:
                heapq.heappush(self.old, (price, at))
        gone = []
        if fading:
            for heap, least, reason in ((self.open, self.target, "profit_fade"), (self.old, self.cost, "profitable_time_fade")):
                while heap and close / heap[0][0] - 1 >= least:
                    price, at = heapq.heappop(heap)
                    if at in self.left:
                        self.left.discard(at)
                    else:
                        self.left.add(at)
                        gone.append(self.out(at, price, n, close, reason))
        if enters:
            self.fresh.append((n, close))
            self.aging.append((n, close))
        self.last = (n, close)
        return gone

    def end(self):
        waiting = {at: price for price, at in [*self.open, *((p, a) for a, p in self.fresh)]}
        return [self.out(at, price, *self.last, "open_unrealized") for at, price in waiting.items() if at not in self.left]


def profit_exits(bars: DataFrame, target: float, cost: float, min_hold: int, max_hold: int, by: str = "symbol", number: str = "n", enters: str = "enters") -> DataFrame:
    """Exits of long entries that are only sold with a profit: by, entry_n, entry, exit_n, exit, reason, status,
    return_share, best, worst.

    bars: number of the row, high, low, close, fading and whether an entry is made at the close. An entry leaves at the
    first fading bar at least min_hold rows on with a return of target (profit_fade) or, at least max_hold rows on, of
    cost (profitable_time_fade); else it stays open and is valued at the last bar (open_unrealized). best and worst are
    the moves from the next row to the exit, at least and at most 0.
    """
    key = StructType([bars.schema[by]]).toDDL()
    schema = f"{key}, entry_n long, entry double, exit_n long, exit double, reason string, status string, return_share double, best double, worst double"
    return ordered_fold(bars, [by], [number], [number, "high", "low", "close", "fading", enters], lambda *k: ProfitExits(k, target, cost, min_hold, max_hold), schema)

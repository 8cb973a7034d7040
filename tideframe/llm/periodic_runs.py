"""Periodic runs of words, by suffix automata with link-cut access.

A run is a stretch of words with smallest period q that is at least twice as long and that no neighbouring word extends.
The automaton of a text has a tree of suffix links, in which the path from a prefix's state to the root holds all its
suffixes. Each word appended makes its whole path "last seen here": the access of link-cut trees, which recolours the
path. Where the path had been coloured by an earlier end j, the deepest state of that segment tells how many words before
j and before the new end i agree. If they are at least the distance i - j, a square ends at i, with the distance as its
smallest period; squares of one period at neighbouring ends are one run.

The tree is known once the automaton is built, so preferred paths need no splay trees: coloured segments lie in stacks on
heavy chains, and an access pops what it covers on the few chains between a state and the root.

Only stretches in which each word is within a repeated sequence of six words go through an automaton; each word of a run
of 12 words or more is (one of the sequences on either side of a period's distance covers it), so none is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import bound_batches, documents

#: A run's least length in words, and of sequences by which stretches without runs are passed over: with windows of
#: MIN_LENGTH / 2 words none is lost.
MIN_LENGTH = 12
_WINDOW = MIN_LENGTH // 2
_FACTORS = np.array([0x9E3779B97F4A7C15 ** (k + 1) % 2**64 for k in range(_WINDOW)], np.uint64)

Run = tuple[int, int, int]


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states (0 is the root), and the state of each prefix."""
    link, length, moves, prefixes = [-1], [0], [{}], []
    last = 0
    for c in symbols:
        state = len(length)
        length.append(length[last] + 1)
        moves.append({})
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = state
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                half = len(length)
                length.append(length[at] + 1)
                moves.append(moves[to].copy())
                link.append(link[to])
                link[to] = link[state] = half
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = half
                    at = link[at]
        prefixes.append(state)
        last = state
    return link, length, prefixes


def chain_tops(link: list[int], length: list[int]) -> list[int]:
    """The top state of each state's heavy chain; a path to the root meets at most log2(states) chains."""
    order = np.argsort(length, kind="stable").tolist()
    size, heavy = [1] * len(link), [-1] * len(link)
    for v in reversed(order[1:]):
        size[link[v]] += size[v]
    for v in order[1:]:
        up = heavy[link[v]]
        if up < 0 or size[v] > size[up]:
            heavy[link[v]] = v
    top = list(range(len(link)))
    for v in order[1:]:
        if heavy[link[v]] == v and link[v] > 0:
            top[v] = top[link[v]]
    return top


def squares_to_runs(symbols: list[int]) -> list[Run]:
    """All runs (start, length, period) of a sequence, whatever their length, by start and period."""
    link, length, prefixes = automaton(symbols)
    top = chain_tops(link, length)
    chains: list[list[tuple[int, int]]] = [[] for _ in link]  # at a chain's top: (deepest length, last end), deepest first
    latest: dict[int, list[int]] = {}  # period -> the run seen last: start, end, period
    runs = []
    for end, state in enumerate(prefixes):
        while state > 0:
            head, depth = top[state], length[state]
            chain, agree = chains[head], 0
            while chain:
                agree, before = chain[-1]
                if agree > depth:  # the path leaves this segment at the state
                    agree = depth
                    whole = False
                else:
                    chain.pop()
                    whole = True
                period = end - before
                if period <= agree:
                    run, start = latest.get(period), before - agree + 1
                    if run is not None and run[1] >= end - 1:
                        run[1] = end
                        if start < run[0]:
                            run[0] = start
                    else:
                        latest[period] = run = [start, end, period]
                        runs.append(run)
                if not whole or agree == depth:
                    break
            chain.append((depth, end))
            state = link[head]
    return sorted((start, end - start + 1, period) for start, end, period in runs)


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Maximal stretches (begin, end) of at least MIN_LENGTH words that repeated windows cover; hashes that agree by
    chance only add to them."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    grams = h[:n] * _FACTORS[0]
    for k in range(1, _WINDOW):
        grams += h[k : k + n] * _FACTORS[k]
    order = np.argsort(grams)
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return []
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    covered = np.zeros(len(words) + 2, np.int8)
    for k in range(_WINDOW):
        covered[1 + k : 1 + k + n] |= repeated
    edges = np.diff(covered)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - begins >= MIN_LENGTH
    return list(zip(begins[long].tolist(), ends[long].tolist()))


def find_runs(words: list[bytes]) -> list[Run]:
    """Runs (start, length, period) of at least MIN_LENGTH words, by start, then period."""
    out = []
    for begin, end in stretches(words):
        names: dict[bytes, int] = {}
        symbols = [names.setdefault(w, len(names)) for w in words[begin:end]]
        out += [(begin + s, n, p) for s, n, p in squares_to_runs(symbols) if n >= MIN_LENGTH]
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without what repeats a run's first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, n, period in runs:
        kept[start + period : start + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Returns id, n_words, runs (array of start, length, period, by start, then period) and collapsed, a row for each row.

    Words are separated by ASCII white space and compared by their bytes. Runs have 12 words or more; collapsed is the text
    without the words that any run contains after its first period, joined by single spaces. prepare(id, words) may
    replace a text's words before. Null texts count as empty and have no runs; repeated rows are judged each; other
    columns are not read; an empty table gives an empty result. A text's repeating stretch takes some 700 bytes a word
    in its task; nothing is shuffled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    fields = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            counts, found, collapsed = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
                if prepare is not None:
                    words = prepare(ids[i].as_py(), words)
                runs = find_runs(words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(collapse(words, runs))
            yield pa.record_batch({"id": ids, "n_words": pa.array(counts, pa.int64()), "runs": pa.array(found, fields), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})

    out = texts.mapInArrow(search, f"id {id_type}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's edit: of every tenth document, the words from some word on repeat a few of themselves."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), prepare=repeat_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

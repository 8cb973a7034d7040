"""Prefix trie, periodic runs and weighted sampling against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from tideframe.llm import periodic_runs, prefix_trie, weighted_sampling

LONG = "lorem ipsum dolor " * 20000
ODD = ["", None, " \n\t ", "a", "日本語 テスト x", "🙂🙂 ok", "a\x00b c", "x y " * 20, "same text here", "same text here", LONG]


def table(spark, texts):
    """Rows with columns whose names clash with what operators add."""
    schema = "doc_id long, text string, bucket string, place string, runs string, terms_ string, n_words string, h string"
    return spark.createDataFrame([(i, t, "b", "p", "r", "t", "n", "h") for i, t in enumerate(texts)], schema)


# Prefix trie -----------------------------------------------------------------------------------------------------------


def trie_of(convs, borrow):
    """Rows of the trie of convs: id -> turns (role, text)."""
    rebuilt = {}
    for c, own in convs.items():
        h = prefix_trie.head_length(c) if borrow else 0
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + own[h:] if borrow else own
    members, below = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        n = len(members[node])
        leaves[node] = sum(leaves[x] for x in below[node]) if below[node] else 1
        saved[node] = sum(saved[x] for x in below[node]) + (n - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(rebuilt[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_rows(spark, convs):
    rows = [(c, i if i else None, r, t, "x", "y") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, size string").orderBy(F.rand(1))


@pytest.mark.parametrize("partitions,shard", [(1, 1024), (3, 5), (7, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, partitions, shard, seed):
    some = random.Random(seed)
    convs = {c: [(some.choice("ua"), some.choice(["", "é", "xy", "zzz"])) for _ in range(some.choice([1, 2, 3, 5, 9]))] for c in some.sample(range(450), 120)}
    lists = prefix_trie.turn_lists(turn_rows(spark, convs))
    for borrow in (False, True):
        got = prefix_trie.prefix_trie(prefix_trie.borrow_heads(lists) if borrow else lists, partitions, shard)
        assert sorted((tuple(r) for r in got.select(*NODE).collect()), key=str) == trie_of(convs, borrow)


def test_prefix_trie_of_copies_spreads_over_shards(spark):
    """One conversation held by a third of all, one first turn by the others; turnless ones belong to the root."""
    convs = {c: [("u", "hot"), ("a", "deep"), ("u", "end")] for c in range(300)} | {c: [("u", "hot"), ("a", str(c))] for c in range(300, 900)}
    lists = prefix_trie.turn_lists(turn_rows(spark, convs))
    none = spark.createDataFrame([(1000,)], "conv_id long").withColumn("turns", F.array().cast(lists.schema["turns"].dataType))
    got = prefix_trie.prefix_trie(lists.unionByName(none), 4, 16)
    assert sorted((tuple(r) for r in got.select(*NODE).collect()), key=str) == trie_of(convs | {1000: []}, False)
    listed = prefix_trie.end_lists(lists, 4, 16).collect()
    assert sorted(c for r in listed for c in r["ends"]) == list(range(900)) and max(len(r["ends"]) for r in listed) <= 16


def test_prefix_trie_odd_rows(spark):
    """Null roles and texts count as empty, null ids make no conversation, repeated rows are turns each."""
    rows = [(1, None, None, None), (1, 0, "u", "a"), (2, 0, "", ""), (2, 1, "u", "a"), (2, 1, "u", "a"), (None, 0, "u", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(prefix_trie.turn_lists(turns), 2)
    want = trie_of({1: [("", ""), ("u", "a")], 2: [("", ""), ("u", "a"), ("u", "a")]}, False)
    assert sorted((tuple(r) for r in got.select(*NODE).collect()), key=str) == want
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(turns.where("false")), 2).count() == 0
    apart = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "bc")], "role string, text string").select(prefix_trie.turn_digest(F.col("role"), F.col("text")).alias("d")).collect()
    assert len({bytes(r["d"]) for r in apart}) == 2


def test_op11(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", F.col("turn").asc_nulls_first()).collect()
    convs = defaultdict(list)
    for r in rows:
        convs[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    got = prefix_trie.op11_prefix_trie(spark, SF)
    assert got.columns == NODE and sorted((tuple(r) for r in got.collect()), key=str) == trie_of(convs, True)


# Periodic runs ---------------------------------------------------------------------------------------------------------


def runs_of(x):
    """All runs by definition."""
    out = set()
    for q in range(1, len(x) // 2 + 1):
        i = q
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[j - q]:
                j += 1
            if j - i >= q and not any(all(x[k] == x[k - p] for k in range(i - q + p, j)) for p in range(1, q)):
                out.add((i - q, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_of_sequences():
    some = random.Random(5)
    for _ in range(1500):
        n, letters = some.randint(0, 50), some.choice([1, 2, 3, 6])
        x = [some.randrange(letters) for _ in range(n)]
        if n > 4 and some.random() < 0.5:
            a, p = some.randrange(n), some.randint(1, n // 2)
            x = x[:a] + [x[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
        assert periodic_runs.squares_to_runs(x) == runs_of(x)
        words = [b"w%d" % c for c in x]
        assert periodic_runs.find_runs(words) == [r for r in runs_of(x) if r[1] >= 12]


def test_heavy_chains_are_few():
    link, length, prefixes = periodic_runs.automaton([1, 2, 1, 1, 2, 1, 2, 2] * 50)
    top = periodic_runs.chain_tops(link, length)
    for v in prefixes:
        chains = 0
        while v > 0:
            v, chains = link[top[v]], chains + 1
        assert chains <= math.log2(len(link)) + 1


def digests_of(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    names = {}
    runs = [r for r in runs_of([names.setdefault(w, len(names)) for w in words]) if r[1] >= 12]
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12(spark):
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len(got) == len(texts)
    short = [(i, t) for i, t in texts if len((t or "").split()) < 900]  # brute force is quadratic
    assert len(short) > 100 and any(got[i][0] for i, _ in short)
    for i, t in short:
        assert got[i] == digests_of(i, t)


def test_periodic_runs_odd_rows(spark):
    docs = table(spark, ODD)
    got = periodic_runs.periodic_runs(docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    by_id = {r["doc_id"]: r for r in rows}
    assert [tuple(r) for r in by_id[7]["runs"]] == [(0, 40, 2)] and by_id[7]["collapsed"] == "x y"
    assert [tuple(r) for r in by_id[10]["runs"]] == [(0, 60000, 3)] and by_id[10]["collapsed"] == "lorem ipsum dolor"
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == 0 and by_id[1]["runs"] == [] and by_id[1]["collapsed"] == ""
    assert by_id[6]["n_words"] == 2
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0
    assert periodic_runs.repeat_tail(None, [b"a"]) == [b"a"]


# Weighted sampling -------------------------------------------------------------------------------------------------------

Q = weighted_sampling.gamma_quantiles()


def slots_of(text, slots=weighted_sampling.SLOTS):
    counts = Counter(xxhash.xxh64(w, seed=42).intdigest() for w in (text or "").encode().split())
    terms = [(t, math.log(n)) for t, n in counts.items()] or [(0, -1.0)]
    out = []
    for i in range(slots):
        least = math.inf
        for t, weight in terms:
            z = xxhash.xxh64(i.to_bytes(4, "little"), seed=xxhash.xxh64(t.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
            r, c, b = Q[z & 8191], Q[z >> 13 & 8191], (z >> 26) * 2.0**-38
            least = min(least, np.log(c) - r * (math.floor(weight / r + b) - b + 1.0))
        out.append(xxhash.xxh64(struct.pack("<d", least), seed=42).intdigest() & 0xFFFFFFFF)
    return out


def compared(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, next_ = slots_of(text), slots_of(edited), slots_of(after)
        near = [sum(x == y for x, y in zip(own, s)) / len(own) for s in (other, next_)]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join("%08x" % s for s in own), "".join("%08x" % s for s in other), *near)
    return out


def test_op13(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = weighted_sampling.op13_weighted_sampling(spark, SF)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == compared(rows)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_compare_edited_odd_rows(spark, buckets):
    docs = table(spark, ODD)
    got = weighted_sampling.compare_edited(docs, buckets=buckets)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == compared(list(enumerate(ODD)))


def test_compare_edited_without_rows_or_with_repeated_ids(spark):
    docs = table(spark, ODD)
    assert weighted_sampling.compare_edited(docs.where("false")).count() == 0
    (one,) = weighted_sampling.compare_edited(docs.where("doc_id = 8")).collect()
    assert one["near_next"] == 1.0
    repeated = docs.where("doc_id IN (3, 8)").unionByName(docs.where("doc_id = 8")).withColumn("doc_id", F.lit(5).cast("long")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    rows = weighted_sampling.compare_edited(repeated, buckets=3).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 9), (5, 1), (5, 14), (5, 14)]
    assert len({r["fingerprint"] for r in rows}) == 3


def test_collision_rate_is_generalised_jaccard(spark):
    """Over many slots, with weights far apart."""
    some = random.Random(2)
    texts = []
    for _ in range(6):
        a = {f"w{k}": some.randint(1, 9) for k in some.sample(range(60), 40)}
        b = {w: some.choice([n, some.randint(1, 9)]) for w, n in a.items() if some.random() < 0.8} | {f"v{k}": some.randint(1, 3) for k in range(5)}
        texts.append((a, b))
    docs = spark.createDataFrame([(i, k, " ".join(w for w, n in bag.items() for _ in range(n))) for i, pair in enumerate(texts) for k, bag in enumerate(pair)], "pair int, side int, text string")
    found = defaultdict(list)
    for block in range(4):  # 32 slots each, of terms by other names
        named = docs.withColumn("text", F.regexp_replace("text", "([wv])", f"$1{block}x"))
        for r in weighted_sampling.fingerprints(named, ["pair", "side"], slots=64).orderBy("pair", "side").collect():
            found[r["pair"], r["side"]] += r["slots"]
    for i, (a, b) in enumerate(texts):
        words = {*a, *b}
        true = sum(min(a.get(w, 0), b.get(w, 0)) for w in words) / sum(max(a.get(w, 0), b.get(w, 0)) for w in words)
        near = np.mean([x == y for x, y in zip(found[i, 0], found[i, 1])])
        assert abs(near - true) < 4 * math.sqrt(true * (1 - true) / 256)


def test_keys_that_clash_are_refused(spark):
    with pytest.raises(ValueError):
        weighted_sampling.fingerprints(table(spark, ["a"]), ["terms_"])


def test_no_python_on_the_main_path(spark):
    plan = weighted_sampling.op13_weighted_sampling(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan

"""Prefix trie of conversations, by vertical bitmaps.

Conversations are sorted over the cluster by their paths (the digests of their turns), so that the members of each node
are neighbours, and cut into shards of a bounded number of them; a hot first turn, or copies of one conversation, spread
over many shards. A shard keeps, for each (position, turn), the bitset of its conversations that have it. A node's
children are found depth first: its bitset, intersected with the postings of the turns at the next position, gives each
child's bitset; popcounts give members, lowest bits the smallest id, bits that end there the end lists.

A node can lie in several shards only if it is on the path that the last conversation of one and the first of the next
have in common. Counts of members add up over shards; what counts distinct nodes is put right by a row for each node of
such a common path. So only these edge nodes are shuffled and merged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import bound_batches, stage

#: Most conversations, and turns, of a shard. A conversation that has more turns is a shard of its own.
SHARD, SHARD_TURNS = 1024, 1 << 17
_DIGEST = 16
_ROOT = bytes(_DIGEST)
_NODE = "shard long, edge boolean, edge_parent boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends array<long>"
_SIDE = "first_path binary, first_sizes array<long>, last_path binary, last_sizes array<long>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(*columns: Column) -> Column:
    """16 bytes that tell the given strings (null: empty)."""
    texts = [F.coalesce(c, F.lit("")) for c in columns]
    apart = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]  # no two pairs look alike
    return F.unhex(F.substring(F.sha2(F.concat(*apart), 256), 1, 2 * _DIGEST))


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (conv_id, turns) for each conversation id that is not null: digest and code points of its turns by turn
    number (null first), then digest. Repeated rows are turns each. Texts are not shuffled."""
    digest = turn_digest(F.col(role_col), F.col(text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long").alias("size")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


# One shard ---------------------------------------------------------------------------------------------------------


def child_digest(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=_DIGEST).digest()


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _DIGEST] == b[: mid * _DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Rows:
    """Node rows, column by column."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _NODE.split(", ")]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def take(self) -> list[list]:
        out, self.columns = self.columns, [[] for _ in self.columns]
        return out


def shard_trie(shard: int, members: list[tuple[int, bytes, list[int]]], rows: Rows) -> None:
    """Add a row for each node of these conversations (id, path, sizes), which are in the order of their paths."""
    first, last = members[0][1], members[-1][1]
    by_id = sorted(members, key=lambda m: m[0])  # so the lowest bit is the smallest id
    ids = [m[0] for m in by_id]
    paths = [[path[k : k + _DIGEST] for k in range(0, len(path), _DIGEST)] for _, path, _ in by_id]
    postings: list[dict[bytes, int]] = []
    ends: list[int] = []
    for k, path in enumerate(paths):
        bit = 1 << k
        while len(postings) < len(path):
            postings.append({})
        while len(ends) <= len(path):
            ends.append(0)
        ends[len(path)] |= bit
        for position, turn in enumerate(path):
            at = postings[position]
            at[turn] = at.get(turn, 0) | bit

    # A frame: frame of its parent, bitset, depth, node, size of its last text, edge, smallest id; then, once its children
    # are pushed: their number, leaves below, saved tokens below.
    begun = [[None, (1 << len(ids)) - 1, 0, _ROOT, 0, True, ids[0], None, 0, 0]]
    while begun:
        frame = begun[-1]
        up, held, depth, node, size, edge, smallest, children, leaves, saved = frame
        if children is None:
            rest, frame[7] = held & ~ends[depth], 0
            on = slice(depth * _DIGEST, (depth + 1) * _DIGEST)
            while rest:
                k = (rest & -rest).bit_length() - 1
                turn = paths[k][depth]
                child = held & postings[depth][turn]
                rest ^= child
                frame[7] += 1
                # Edge nodes are on the shard's first or last path.
                child_edge = edge and any(p[on] == turn and common_turns(p, by_id[k][1]) > depth for p in (first, last))
                begun.append([frame, child, depth + 1, child_digest(node, turn), by_id[k][2][depth], child_edge, ids[k], None, 0, 0])
            if frame[7]:
                continue
            leaves = 1
        begun.pop()
        count = held.bit_count()
        saved += (count - 1) * size
        ended, here = held & ends[depth], []
        while ended:
            low = ended & -ended
            here.append(ids[low.bit_length() - 1])
            ended ^= low
        rows.add(shard, edge, up is not None and up[5], node, up and up[3], depth, smallest, up and up[6], count, frame[7], leaves, saved, here)
        if up is not None:
            up[8] += leaves
            up[9] += saved


def between(left: bytes, right: bytes, sizes: list[int], rows: Rows) -> None:
    """Rows that put right what two neighbouring shards both count, whose last and first paths these are."""
    common = common_turns(left, right)
    twice = -1 if common * _DIGEST == len(left) else 0  # a leaf of the left shard that goes on, or ends, in the right one
    nodes = [_ROOT]
    for k in range(common):
        nodes.append(child_digest(nodes[-1], right[k * _DIGEST : (k + 1) * _DIGEST]))
    below = 0
    for depth in range(common, -1, -1):
        below += sizes[depth - 1] if depth else 0
        rows.add(None, True, True, nodes[depth], nodes[depth - 1] if depth else None, depth, None, None, 0, -1 if depth < common else 0, twice, below, None)


# All shards ----------------------------------------------------------------------------------------------------------


def shard_rows(lists: DataFrame, partitions: int | None = None, shard: int = SHARD) -> DataFrame:
    """Node rows of each shard, corrections between them, and the first and last path of each partition; staged."""
    spark = lists.sparkSession
    bound_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.transform("turns", lambda t: F.hex(t["digest"]))
    flat = lists.select("conv_id", F.unhex(F.array_join(path, "")).alias("path"), F.col("turns.size").alias("sizes"))
    ordered = stage(flat, "paths").repartitionByRange(partitions, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    schema = f"{_NODE}, partition int, {_SIDE}"
    types = [pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, k = TaskContext.get().partitionId(), 0
        rows, first, last, members, turns = Rows(), None, None, [], 0

        def full() -> pa.RecordBatch:
            columns = rows.take()
            none = [None] * len(columns[0])
            return pa.record_batch([pa.array(c, t) for c, t in zip([*columns, *[none] * 5], types)], names)

        for batch in batches:
            for member in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), batch.column("sizes").to_pylist()):
                if members and (len(members) >= shard or turns + len(member[2]) > SHARD_TURNS):
                    shard_trie(partition << 32 | k, members, rows)
                    between(members[-1][1], member[1], member[2], rows)
                    members, turns, k = [], 0, k + 1
                    yield full()
                members.append(member)
                turns += len(member[2])
                first, last = first or member, member
        if members:
            shard_trie(partition << 32 | k, members, rows)
            yield full()
            side = [partition, first[1], first[2], last[1], last[2]]
            yield pa.record_batch([pa.array([v], t) for v, t in zip([None] * 13 + side, types)], names)

    return stage(ordered.mapInArrow(search, schema), "shards")


def partition_corrections(sides: DataFrame) -> DataFrame:
    """Correction rows between neighbouring partitions; sides has one row for each partition that isn't empty."""

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows()
            for left, right, sizes in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "sizes"))):
                between(left, right, sizes, rows)
            types = [pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows.columns, types)], [c.split()[0] for c in _NODE.split(", ")])

    # As many rows as partitions, whatever the data.
    numbered = sides.groupBy().agg(F.sort_array(F.collect_list("partition")).alias("all"))
    after = numbered.select(F.explode(F.arrays_zip(F.col("all").alias("partition"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("next"))).alias("p")).select("p.*")
    right = sides.select(F.col("partition").alias("next"), F.col("first_path").alias("right"), F.col("first_sizes").alias("sizes"))
    pairs = sides.select("partition", F.col("last_path").alias("left")).join(after.where("next IS NOT NULL"), "partition").join(right, "next")
    return pairs.select("left", "right", "sizes").mapInArrow(correct, _NODE)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 (hex) of each node's ids, ascending and joined by commas, from its lists (node, shard, ends).

    A node's ids come in shards that follow one another, so they are streamed, not held.
    """
    ordered = ends.select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, shas = [], []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if at != node:
                    if node is not None:
                        nodes.append(node)
                        shas.append(state.hexdigest())
                    node, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids)).encode())
            yield pa.record_batch({"node": pa.array(nodes, pa.binary()), "sha": pa.array(shas, pa.string())})
        if node is not None:
            yield pa.record_batch({"node": pa.array([node], pa.binary()), "sha": pa.array([state.hexdigest()], pa.string())})

    return ordered.mapInArrow(digest, "node binary, sha string")


def prefix_trie(lists: DataFrame, partitions: int | None = None, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of conversations: node and parent (16 bytes each), depth, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    lists: conv_id (distinct, not null) and turns, as turn_lists() gives them; no turns is a member of the root alone.
    conv_id is the smallest member, n_convs the members, saved_tokens the sum over the subtree of each node's code points
    that are held once instead of n_convs times, ends_sha256 the digest of the members that end here. An empty table has
    no root and gives an empty result. Digests of turns stand for turns; each conversation's (20 bytes a turn) are held by
    a task. Any shard size and number of partitions gives the same result.
    """
    rows = shard_rows(lists, partitions, shard)
    nodes = rows.where("partition IS NULL")
    result = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own_ends = F.sha2(F.array_join(F.col("ends").cast("array<string>"), ","), 256).alias("ends_sha256")
    inner = nodes.where("NOT edge AND NOT edge_parent").select(*result[:-1], own_ends)

    # Edge nodes: one row for each shard that has them, and corrections.
    edge = nodes.where("edge").unionByName(partition_corrections(rows.where("partition IS NOT NULL")), allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = edge.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    merged = stage(merged, "edges")
    smallest = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    listed = edge.where(F.size("ends") > 0)
    top = merged.join(smallest, "parent", "left").join(end_digests(listed), "node", "left")
    top = top.select(*result[:-1], F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))

    # Nodes of one shard below an edge node: its smallest member may be in another shard. A shard's children of a node
    # are bounded, so no key of this join is hot.
    known = nodes.where("edge").select("shard", F.col("node").alias("parent")).join(smallest, "parent")
    below = nodes.where("NOT edge AND edge_parent").drop("parent_conv_id").join(known, ["shard", "parent"]).select(*result[:-1], own_ends)
    return inner.unionByName(below).unionByName(top)


def end_lists(lists: DataFrame, partitions: int | None = None, shard: int = SHARD) -> DataFrame:
    """Rows (node, shard, ends) with the ids of the conversations that end at a node, in the order of shard; a hot node
    has several rows."""
    return shard_rows(lists, partitions, shard).where(F.size("ends") > 0).select("node", "shard", "ends")


# The query -----------------------------------------------------------------------------------------------------------


def borrow_heads(lists: DataFrame, every: int = 100, longest: int = 6) -> DataFrame:
    """Each conversation c with the first crc32(c) % longest turns of conversation c - c % every in place of its own."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest)).cast("int")
    own = lists.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    heads = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest - 1).alias("head"))
    borrowed = F.slice(F.coalesce("head", F.array().cast(lists.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(borrowed, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = stage(turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "lists")
    return prefix_trie(borrow_heads(lists)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def head_length(conv_id: int, longest: int = 6) -> int:
    return zlib.crc32(str(conv_id).encode()) % longest

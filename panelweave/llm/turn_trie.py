"""The trie of conversation prefixes, from sorted matrices of turn ids.

Every distinct conversation is one row of padded turn ids. In the rows' order, which numpy's lexsort gives, the members
of a node stand together; a node of depth d starts where one of the first d columns differs from the row
before, so the columns' change masks, OR-accumulated from the left, mark all starts of all depths. The
aggregates of a depth are then one reduceat over its starts.

Rows are range-sharded by their turns, and a shard is worked off in blocks of bounded size. Only nodes on the border of
two neighbouring blocks are split; how many turns neighbours share is known beforehand, so each block counts what
starts in it, and the parts of a split node add up.

A turn's id is its SHA-256, cut to 128 bits: equal turns have equal ids, others differ. Inside a block ids are
ranks. Every text is hashed where it is scanned; it never travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Cells of a block's matrix; a longer conversation is a block of its own.
CELLS = 1 << 20
#: Turns that a shard has on average, and the least number of shards.
SHARD_TURNS, SHARDS = 2_000_000, 8
#: Bits of a conversation's id within one list of ids: lists have at most 4,096.
LIST_BITS = 12
#: Bytes of a turn's id.
ID = 16
NO_END = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (hexadecimal) and size (bytes of text) of each turn; rows without a conv_id are no conversation's."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(name, 1, 2 * ID).alias("id"), F.octet_length(text).cast("long").alias("size")).where("conv_id is not null")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id and its turns: the first h of conversation c - c % family, then its own from h on, h = crc32(c) % most.

    Ordered by turn, null first, then by id. A family's conversations share one partition: one shuffle.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    rows = turns.withColumn("family", first)
    whole = rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, most - 1))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    whole = whole.withColumns({"head": head, "h": h})
    turns_ = F.concat(F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", 1, F.col("h"))), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return whole.select("conv_id", turns_.alias("turns"))


def _lists(rows: DataFrame) -> DataFrame:
    """Of each distinct sequence of turns, lists of at most 4,096 members: key, part, n, least, sizes, members.

    ``key`` has the ids one after another, so its order is that of the sequences. However many conversations are equal,
    what meets is their lists.
    """
    keyed = rows.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"), F.shiftright("conv_id", LIST_BITS).alias("part"), "conv_id"
    )
    members = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    return keyed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"), members.alias("members"))


def _shared(a: bytes | None, b: bytes | None) -> int:
    """How many turns two sequences share at their beginnings; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // ID
    x, y = (np.frombuffer(s, np.uint8, n * ID).reshape(n, ID) for s in (a, b))
    differs = (x != y).any(axis=1)
    return int(differs.argmax()) if differs.any() else n


def _borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, first, last, after = (batch.column(c).to_pylist() for c in ("before", "first", "last", "after"))
        shared = [[_shared(a, b) for a, b in zip(*pair, strict=True)] for pair in ((before, first), (last, after))]
        yield pa.RecordBatch.from_arrays([batch.column("pid"), *(pa.array(s, pa.int32()) for s in shared)], ["pid", "back", "ahead"])


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, list[int], str, int, int]]:
    """The distinct sequences of a sorted shard: key, members, least member, sizes, digest of the members, and the shard's borders."""
    now, n, least, sizes, digest, back, ahead = None, 0, 0, [], None, -1, -1
    for batch in batches:
        for key, count, low, size, members, b, a in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "sizes", "members", "back", "ahead")), strict=True):
            if key != now:
                if now is not None:
                    yield now, n, least, sizes, digest.hexdigest(), back, ahead
                now, n, least, sizes, digest, back, ahead = key, 0, low, size, hashlib.sha256(), b, a
            if n:
                digest.update(b",")
            digest.update(members.encode())
            n, least = n + count, min(least, low)
    if now is not None:
        yield now, n, least, sizes, digest.hexdigest(), back, ahead


def _path_names(key: bytes, depth: int) -> list[bytes]:
    """Names of the nodes on a sequence's path, from the root to ``depth``."""
    state, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for d in range(depth):
        state.update(key[d * ID : (d + 1) * ID])
        out.append(state.digest())
    return out


def block_nodes(rows: list[tuple], back: int, ahead: int) -> dict[str, list]:
    """The nodes that have members among ``rows``, distinct sequences of one block: columns of NODES, name, parent_name.

    ``back`` and ``ahead`` are the turns that the first and the last row share with the neighbouring blocks.
    Nodes that lie in several blocks, and the root, have a name and only this block's part; children of such have a parent_name.
    """
    keys, n, least, sizes, ends = (list(c) for c in list(zip(*rows, strict=True))[:5])
    length = np.fromiter((len(k) // ID for k in keys), np.int64, len(keys))
    width = int(length.max(initial=0))
    inside = np.arange(width) < length[:, None]
    ids = np.full(inside.shape, -1, np.int64)
    # ranks keep the ids' order; both halves of an id are big-endian
    halves = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    by = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.r_[False, (halves[by[1:]] != halves[by[:-1]]).any(axis=1)] if len(by) else np.zeros(0, bool)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    ids[inside] = rank
    order = np.lexsort(ids.T[::-1]) if width else np.arange(len(keys))
    weight = np.zeros(ids.shape, np.int64)
    weight[inside] = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if len(by) else []
    ids, inside, weight, length = ids[order], inside[order], weight[order], length[order]
    n, least = np.asarray(n, np.int64)[order], np.asarray(least, np.int64)[order]

    starts = np.ones(ids.shape, bool)
    starts[1:] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
    starts[0] = np.arange(width) >= back
    # turns that a row shares with the next one: where none is left, no other row extends it
    first_change = np.where(starts[1:].any(axis=1), starts[1:].argmax(axis=1), width) if width else np.zeros(len(keys) - 1, np.int64)
    shared = np.minimum(np.r_[first_change, ahead], length)
    leaf = (shared < length).astype(np.int64)
    leaf[(length == 0)] = 0
    born = starts & inside
    # bytes of members' turns from each depth on, less those of the nodes that start here: each node counts once
    total = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
    saved = n[:, None] * total(weight) - total(weight * born)

    first_names, last_names = _path_names(keys[order[0]], max(back, 0)), _path_names(keys[order[-1]], max(ahead, 0))
    out: dict[str, list] = {c: [] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "name", "parent_name")}
    above = np.zeros(len(keys), np.int64)  # place of each row's node one level up, among that level's nodes
    above_least, above_names = np.zeros(0, np.int64), np.zeros(0, object)
    for depth in range(width + 1):
        if depth:
            at = np.flatnonzero(starts[:, depth - 1])
            at = at if len(at) and at[0] == 0 else np.r_[0, at]
            real = inside[at, depth - 1]
        else:
            at, real = np.zeros(1, np.int64), np.ones(1, bool)
        node = np.cumsum(np.bincount(at, minlength=len(keys))) - 1
        lows = np.minimum.reduceat(least, at)
        names = np.full(len(at), None, object)
        if depth == 0 or depth <= back:
            names[0] = first_names[depth]
        if 0 < depth <= ahead:
            names[-1] = last_names[depth]
        children = np.add.reduceat(born[:, depth].astype(np.int64), at) if depth < width else np.zeros(len(at), np.int64)
        spared = np.add.reduceat(saved[:, max(depth - 1, 0)], at) if width else np.zeros(len(at), np.int64)
        # the sequence that ends in a node stands first among its members; a part that begins in an earlier block has none here
        ended = (length[at] == depth) & real
        if depth == 0:
            ended &= back < 0
        elif depth <= back:
            ended[0] &= False
        leaves = np.add.reduceat(leaf, at)
        if depth == 0 and ended[0] and len(keys) == 1 and ahead < 0:
            leaves[0] = 1  # nothing but turnless conversations: the root is the only leaf
        up = above[at] if depth else at
        pick = np.flatnonzero(real)
        out["conv_id"] += lows[pick].tolist()
        out["depth"] += [depth] * len(pick)
        if depth:
            parent_names = above_names[up[pick]]
            out["parent_conv_id"] += [p if q is None else None for p, q in zip(above_least[up[pick]].tolist(), parent_names, strict=True)]
            out["parent_name"] += parent_names.tolist()
        else:
            out["parent_conv_id"].append(None)
            out["parent_name"].append(None)
        out["n_convs"] += np.add.reduceat(n, at)[pick].tolist()
        out["n_children"] += children[pick].tolist()
        out["n_leaves"] += leaves[pick].tolist()
        out["saved_tokens"] += spared[pick].tolist()
        out["ends_sha256"] += [ends[order[at[i]]] if ended[i] else None for i in pick.tolist()]
        out["name"] += names[pick].tolist()
        above, above_least, above_names = node, lows, names
    return out


def _nodes(cells: int):
    kinds = {"ends_sha256": pa.string(), "name": pa.binary(), "parent_name": pa.binary()}

    def made(rows: list[tuple], back: int, ahead: int) -> pa.RecordBatch:
        found = block_nodes(rows, back, ahead)
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in found.items()], list(found))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        back, width = -1, 0
        for row in _sequences(batches):
            wide = len(row[0]) // ID
            if rows and max(width, wide) * (len(rows) + 1) > cells:
                ahead = _shared(rows[-1][0], row[0])
                yield made(rows, back, ahead)
                rows, back, width = [], ahead, 0
            elif not rows:
                back = row[5]
            rows.append(row)
            width = max(width, wide)
        if rows:
            yield made(rows, back, rows[-1][6])

    return run


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, cells: int = CELLS) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie: the columns of NODES.

    A null role or text is an empty one, a null turn comes first; turns of one number are ordered by the SHA-256 of
    role and text, also repeated rows, which all count. Rows without a conv_id belong to no conversation. Other columns
    are ignored. Without conversations there is no node, not even a root. Texts of any length are hashed where they
    are read. Of one conversation a task holds the ids and sizes of its turns, 24 bytes each; of any number of equal
    conversations it holds one list of 4,096 ids at a time. What is stored is in the checkpoint folder.
    """
    lists = cut(_lists(rebuilt(turns_of(conversations), family, most)))
    n_turns = lists.agg(F.sum(F.length("key"))).first()[0]
    if n_turns is None:
        return conversations.sparkSession.createDataFrame([], NODES)
    shards = max(SHARDS, n_turns // ID // SHARD_TURNS)
    stored = cut(lists.repartitionByRange(shards, "key").sortWithinPartitions("key", "part")).withColumn("pid", F.spark_partition_id())
    # one row for each shard, whatever the number of conversations
    ends = stored.groupBy("pid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    by_pid = Window.orderBy("pid")
    borders = ends.select("pid", F.lag("last").over(by_pid).alias("before"), "first", "last", F.lead("first").over(by_pid).alias("after"))
    borders = borders.mapInArrow(_borders, "pid int, back int, ahead int")
    found = cut(stored.join(F.broadcast(borders), "pid").select("key", "n", "least", "sizes", "members", "back", "ahead").mapInArrow(_nodes(cells), NODES + ", name binary, parent_name binary"))

    names = [f.strip().split()[0] for f in NODES.split(",")]
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    split = cut(found.where("name is not null").groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), *total.values(), F.max("ends_sha256").alias("ends_sha256"), F.max("parent_name").alias("parent_name")))
    parents = split.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = found.where("name is null and parent_name is not null").drop("parent_conv_id").withColumnRenamed("n_children", "own_children")
    below = join_hot(below, parents, ["parent_name"], "n_children").drop("n_children").withColumnRenamed("own_children", "n_children")
    border = split.join(parents.drop("n_children"), "parent_name", "left")
    whole = found.where("name is null and parent_name is null").select(*names).unionByName(below.select(*names)).unionByName(border.select(*names))
    return whole.fillna({"ends_sha256": NO_END})

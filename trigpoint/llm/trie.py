"""The prefix tree of conversations, with sums over subtrees by heavy-path decomposition.

A node is a sequence of first turns. Its largest child, the one with most conversations (of equal ones, the one with the smallest id), is
heavy; chains of heavy children are paths. A light child has at most half of its parent's conversations, so a conversation meets
at most log2(conversations) light edges. Paths are stored as arrays of their nodes. In each round the paths that wait for no light child
sum their arrays from the end, and what stands at their tops is attached to the parents' places; as many rounds as light edges lie on one way.

Turns are compared by 128-bit hashes. Long conversations are spread over tasks: rows are sorted by range, summed within each
partition, and what a partition's first conversation brings along from the ones before it is added afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, staged

#: Nodes of a path that stand in one array.
CHUNK = 4096
#: A parent's row is sent to all executors if it has more than one in so many of all nodes as its children; there are fewer such parents than that.
HOT = 1000
#: Bytes of a list of ids that are put together before it is hashed.
PIECE = 1 << 20
#: Fixed odd numbers; 3 modulo 4, so that two turns that change places change the sum.
_A, _B = np.uint64(0x9E3779B97F4A7C17), np.uint64(0xD6E8FEB86659FD93)


def turn_keys(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, a, b, n): turns as 128-bit hashes of role and text, with the text's code points. Null role and text are empty; rows without
    a conversation's id belong to none and go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), role, text).alias("b"), F.length(text).cast("long").alias("n"),
    )


def _powers(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    out, e = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while e.any():
            out = np.where(e & np.uint64(1), out * base, out)
            base, e = base * base, e >> np.uint64(1)
    return out


_TURN = ("conv_id", "depth", "a", "b", "pa", "pb", "ta", "tb", "n")
_CHAIN = "part long, first boolean, edge int, last boolean, " + ", ".join(f"{c} long" for c in _TURN)
_CHAIN_SCHEMA = pa.schema([("part", pa.int64()), ("first", pa.bool_()), ("edge", pa.int32()), ("last", pa.bool_()), *((c, pa.int64()) for c in _TURN)])
_CHAIN_OUT = pa.schema([*((c, pa.int64()) for c in _TURN), ("last", pa.bool_())])


def _chain_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted turns of a partition and hashes what comes up to each, as if its first conversation began here.

    edge: 1 for the first row, 2 for the last one, 3 for both.
    """
    part = TaskContext.get().partitionId()
    conv, depth, sums, in_first, held = None, 0, [np.uint64(0)] * 2, True, None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        new = np.r_[conv is None or ids[0] != conv, ids[1:] != ids[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        carried = np.maximum.accumulate(new) == 0  # rows that go on with the last batch's conversation
        at = np.arange(len(ids)) - begin + np.where(carried, depth, 0)
        columns = {}
        with np.errstate(over="ignore"):
            for k, (name, base) in enumerate((("a", _A), ("b", _B))):
                terms = b.column(2 + k).to_numpy().view(np.uint64) * _powers(base, at)
                total = np.cumsum(terms, dtype=np.uint64)
                upto = total - (total - terms)[begin] + np.where(carried, sums[k], np.uint64(0))
                columns[name], columns["p" + name] = upto.view(np.int64), (upto - terms).view(np.int64)
                sums[k] = upto[-1]
        first_run = in_first & (carried | (np.cumsum(new) == 1) & (conv is None))
        edge = np.zeros(len(ids), np.int32)
        edge[0] = held is None
        out = batch(_CHAIN_SCHEMA, np.full(len(ids), part), first_run, edge, np.r_[new[1:], False], ids, at + 1, *(columns[c] for c in ("a", "b", "pa", "pb")), *b.columns[2:])
        conv, depth, in_first = ids[-1], int(at[-1]) + 1, bool(first_run[-1])
        if held is not None:
            yield _end(held, 0, bool(new[0]))
        held = out
    if held is not None:
        yield _end(held, 2, False)


def _end(b: pa.RecordBatch, edge: int, last: bool) -> pa.RecordBatch:
    edges, lasts = b.column(2).to_numpy().copy(), b.column(3).to_numpy(zero_copy_only=False).copy()
    edges[-1] += edge
    lasts[-1] = last
    return batch(_CHAIN_SCHEMA, b.column(0), b.column(1), edges, lasts, *b.columns[4:])


def chains(keys: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, ta, tb, n, last): turns (conv_id, turn, a, b, n) in the order of turn (null first; rows of one turn in
    an order of their own, always the same), numbered from 1, with 128-bit hashes of all turns up to them (a, b), before them (pa, pb) and of themselves (ta, tb).

    A partition holds a range of turns, so a conversation of any length is spread over tasks.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b", "n"]
    keys = keys.select("conv_id", "turn", "a", "b", "n")
    rows = keys.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order).drop("tie")
    rows = staged(map_arrow(rows, _chain_part, _CHAIN), "chains")
    ends: dict[int, dict[int, tuple]] = {}
    for r in rows.where("edge > 0").select("part", "edge", "conv_id", "depth", "a", "b").collect():  # two rows a partition
        ends.setdefault(r.part, {}).update(dict.fromkeys([k for k in (1, 2) if r.edge & k], r))
    carry, closed, state, before = {}, set(), (None, 0, np.uint64(0), np.uint64(0)), None
    with np.errstate(over="ignore"):
        for part in sorted(ends):
            first, end = ends[part][1], ends[part][2]
            conv, depth, a, b = state
            if conv == first.conv_id:
                carry[part] = (depth, a, b)
            elif before is not None:
                closed.add(before)
            own = [np.int64(x).view(np.uint64) for x in (end.a, end.b)]
            if conv == end.conv_id:
                power = np.array([depth])
                state = (conv, depth + end.depth, a + _powers(_A, power)[0] * own[0], b + _powers(_B, power)[0] * own[1])
            else:
                state = (end.conv_id, end.depth, *own)
            before = part
    closed.add(before)
    ended = [part for part in closed if part is not None]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, first = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            own = [b.column(c).to_numpy().copy() for c in range(5, 10)]
            last = b.column(3).to_numpy(zero_copy_only=False) | np.isin(part, ended) & (b.column(2).to_numpy() & 2 > 0)
            for p in np.unique(part[first]).tolist() if carry else ():
                if p in carry:
                    depth, *sums = carry[p]
                    at = first & (part == p)
                    own[0][at] += depth
                    with np.errstate(over="ignore"):
                        for k, base in enumerate((_A, _B)):
                            shift = _powers(base, np.array([depth]))[0]
                            for c in (1 + k, 3 + k):
                                own[c][at] = (own[c][at].view(np.uint64) * shift + sums[k]).view(np.int64)
            yield batch(_CHAIN_OUT, b.column(4), *own, *b.columns[10:], last)

    return map_arrow(rows, add, ", ".join(f"{c} long" for c in _TURN) + ", last boolean")


def _lists(ends: DataFrame) -> DataFrame:
    """(a, b, depth, sha): SHA-256 of the ascending decimal ids of each node's rows (a, b, depth, conv_id), joined by commas.

    Ids are written out, in pieces, by ranges of (node, id), so that the ids of one node are spread; a node's pieces then go through its
    hash one after the other, as SHA-256 asks for, none of them held for longer.
    """
    node = ["depth", "a", "b"]
    piece = pa.schema([*((c, pa.int64()) for c in (*node, "from_id")), ("text", pa.binary())])
    digest = pa.schema([*((c, pa.int64()) for c in node), ("sha", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, start, size = [], None, None, 0
        for b in batches:
            out = []
            for *own, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (own != key or size > PIECE):
                    out.append((*key, start, b",".join(held)))
                    held, size = [], 0
                if not held:
                    key, start = own, conv
                held.append(b"%d" % conv)
                size += len(held[-1]) + 1
            yield batch(piece, *(zip(*out, strict=True) if out else [[]] * 5))
        if held:
            yield batch(piece, *([x] for x in (*key, start, b",".join(held))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for b in batches:
            out = []
            for d, a, c, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (d, a, c) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (d, a, c), hashlib.sha256(text)
                else:
                    state.update(b",")
                    state.update(text)
            yield batch(digest, *(zip(*out, strict=True) if out else [[]] * 4))
        if key is not None:
            yield batch(digest, *([x] for x in (*key, state.hexdigest())))

    order = [*node, "conv_id"]
    pieces = map_arrow(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), write, "depth long, a long, b long, from_id long, text binary")
    pieces = pieces.repartition(*node).sortWithinPartitions(*node, "from_id")
    return map_arrow(pieces, hashed, "depth long, a long, b long, sha string")


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes, the root among them, by (conv_id, depth): their parent, children, and whether they are their parent's heavy child."""
    node = rows.groupBy("depth", "a", "b").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n").alias("n"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("n"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    node = staged(node.unionByName(root), "nodes")
    # of the largest children the one with the smallest id
    parents = node.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("heavy"))
    node = staged(node.join(parents, ["depth", "a", "b"], "left").select(
        *node.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (-F.col("heavy.least")).alias("heavy")), "parents")
    some = node.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("_heavy"), "n_children")
    bound = node.count() // HOT
    hot, keys = some.where(F.col("n_children") > bound).drop("n_children"), ["depth", "pa", "pb"]
    below = node.where("depth > 0")
    near = below.join(F.broadcast(hot), keys)  # fewer than HOT parents
    far = below.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(some.drop("n_children"), keys)
    top = node.where("depth = 0").select("*", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("long").alias("_heavy"))
    node = near.unionByName(far).unionByName(top).withColumn("light", F.coalesce(F.col("_heavy") != F.col("conv_id"), F.lit(True)))
    return staged(node.drop("_heavy", "heavy", "pa", "pb"), "linked")


def _tops(node: DataFrame) -> DataFrame:
    """(conv_id, depth, top_conv, top_depth): the top of each node's path, in as many rounds as the logarithm of the longest path.

    A node that hasn't arrived stands a power of two of steps below where it looks, on a path, so no place is looked at twice in a round.
    """
    up = node.select("conv_id", "depth", F.when(F.col("light"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("top_conv"), (F.col("depth") - F.when(F.col("light"), 0).otherwise(1)).alias("top_depth"), F.col("light").alias("done"))
    up = staged(up, "up")
    while not up.where(~F.col("done")).isEmpty():
        seen = up.select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"), F.col("top_conv").alias("to_conv"), F.col("top_depth").alias("to_depth"), F.col("done").alias("arrived"))
        further = up.where(~F.col("done")).join(seen, ["top_conv", "top_depth"]).select("conv_id", "depth", F.col("to_conv").alias("top_conv"), F.col("to_depth").alias("top_depth"), F.col("arrived").alias("done"))
        up = staged(up.where("done").unionByName(further), "up")
    return up.drop("done")


_PATH = ["top_conv", "top_depth", "chunk"]


def _suffix_sums(paths: DataFrame) -> DataFrame:
    """Paths whose arrays leaves and saved have got what was attached (more: place, leaves, saved) and what comes after them (leaves_after,
    saved_after), and are summed from the end."""
    at = {c: i for i, c in enumerate(paths.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(b.columns)
            more = b.column(at["more"])
            sizes = b.column(at["leaves"]).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            entries = more.flatten()
            places = np.repeat(ends - sizes, more.value_lengths().to_numpy()) + entries.field("i").to_numpy()
            for c in ("leaves", "saved"):
                flat = b.column(at[c]).flatten().to_numpy().copy()
                np.add.at(flat, places, entries.field(c).to_numpy())
                total = np.r_[0, np.cumsum(flat)]
                sums = np.repeat(total[ends] + b.column(at[f"{c}_after"]).to_numpy(), sizes) - total[:-1]
                out[at[c]] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(sums, pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    return map_arrow(paths, run, paths.schema).drop("more", "leaves_after", "saved_after")


def _subtree_sums(node: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of all nodes."""
    own = node.select(
        "conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"),
        F.greatest(F.col("n_children") - 1, F.lit(0)).alias("waits"))
    place = F.col("depth") - F.col("top_depth")
    own = staged(own.join(_tops(node), ["conv_id", "depth"]).withColumn("chunk", F.floor(place / CHUNK)).withColumn("i", place % CHUNK), "placed")
    forks = own.where("waits > 0").select("conv_id", "depth", *_PATH, "i")
    items = F.sort_array(F.collect_list(F.struct("i", "conv_id", "leaves", "saved")))  # a chunk at most
    paths = own.groupBy(*_PATH).agg(items.alias("own"), F.sum("waits").alias("waits"), F.max(F.when((F.col("chunk") == 0) & (F.col("i") == 0), F.col("parent_conv_id"))).alias("parent_conv_id"))
    none = F.array().cast("array<struct<i:bigint,leaves:bigint,saved:bigint>>")
    rest = paths.select(*_PATH, "parent_conv_id", F.col("own.conv_id").alias("convs"), F.col("own.leaves").alias("leaves"), F.col("own.saved").alias("saved"), none.alias("more"), "waits")
    whole = Window.partitionBy("top_conv", "top_depth")
    later = whole.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    all_of = lambda c: total(c) + total(F.col(f"more.{c}"))
    done: list[DataFrame] = []
    while True:
        rest = staged(rest.withColumn("open", F.sum("waits").over(whole)), "paths")
        after = [F.coalesce(F.sum(all_of(c)).over(later), F.lit(0)).alias(f"{c}_after") for c in ("leaves", "saved")]
        ready = rest.where("open = 0").select(*_PATH, "parent_conv_id", "convs", "leaves", "saved", "more", *after)
        done.append(staged(_suffix_sums(ready), "done"))
        rest = rest.where("open > 0").drop("open")
        if rest.isEmpty():
            break
        # what stands at the tops is summed by parent before it is looked up where the parent is
        tops = done[-1].where("chunk = 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("top_depth") - 1).alias("depth"))
        sent = tops.agg(F.sum(F.col("leaves")[0]).alias("leaves"), F.sum(F.col("saved")[0]).alias("saved"), F.count(F.lit(1)).alias("arrived")).join(forks, ["conv_id", "depth"])
        sent = sent.groupBy(*_PATH).agg(F.collect_list(F.struct("i", "leaves", "saved")).alias("_more"), F.sum("arrived").alias("_arrived"))
        rest = rest.join(sent, _PATH, "left").withColumn("more", F.concat("more", F.coalesce("_more", none))).withColumn("waits", F.col("waits") - F.coalesce("_arrived", F.lit(0))).drop("_more", "_arrived")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select("top_depth", "chunk", F.posexplode(F.arrays_zip("convs", "leaves", "saved")).alias("i", "x"))
    return out.select(F.col("x.convs").alias("conv_id"), (F.col("top_depth") + F.col("chunk") * CHUNK + F.col("i")).alias("depth"), F.col("x.leaves").alias("n_leaves"), F.col("x.saved").alias("saved_tokens"))


def prefix_trie(keys: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of turns (conv_id, turn, a, b, n), see
    turn_keys().

    A node is named by the smallest id of its conversations and its depth. convs: (conv_id) of all conversations, distinct, those without turns among them;
    without it, those that have turns. Repeated rows are turns each for itself. No conversation gives no row, not even a root.
    """
    rows = staged(chains(keys), "turns")
    last = rows.where("last").select("conv_id", "depth", "a", "b")
    convs = staged(last.select("conv_id") if convs is None else convs.select("conv_id"), "convs")
    node = _nodes(rows, convs)
    zero = F.lit(0).cast("long")
    turnless = convs.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    ends = _lists(last.unionByName(turnless))
    node = node.join(ends, ["depth", "a", "b"], "left").join(_subtree_sums(node), ["conv_id", "depth"])
    return node.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuild(keys: DataFrame, first: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, a, b, n) of conversations that begin as others do, and all conversations (conv_id).

    Conversation c gets the first `first` turns of conversation `base` (all if there are fewer, none if there is no such one), then its own turns
    after its first `first`. Both are of conv_id; first is a small number, as many copies of a turn are made as there are conversations on one base.
    """
    rows = staged(chains(keys).select("conv_id", F.col("depth").alias("turn"), F.col("ta").alias("a"), F.col("tb").alias("b"), "n", "last"), "ordered")
    convs = staged(rows.where("last").select("conv_id", F.col("turn").alias("size")), "convs")
    sizes = convs.withColumn("first", first.cast("long")).withColumn("base", base.cast("long"))
    most = sizes.agg(F.max("first")).first()[0] or 0
    sizes = staged(sizes.join(convs.select(F.col("conv_id").alias("base"), F.col("size").alias("have")), "base", "left").withColumn("have", F.least(F.coalesce("have", F.lit(0)), "first")), "sizes")
    begin = rows.where(F.col("turn") <= most).select(F.col("conv_id").alias("base"), "turn", "a", "b", "n")
    begin = sizes.select("conv_id", "first", "base").join(begin, "base").where(F.col("turn") <= F.col("first")).select("conv_id", "turn", "a", "b", "n")
    own = rows.join(sizes.select("conv_id", "first", "have"), "conv_id").where(F.col("turn") > F.col("first"))
    own = own.select("conv_id", (F.col("turn") - F.col("first") + F.col("have")).alias("turn"), "a", "b", "n")
    return begin.unionByName(own), convs.select("conv_id")

"""The prefix trie of conversations, from the common prefixes of neighbours in sorted order.

Distinct conversations are sorted by their turns. Between two neighbours stands the number of turns that both begin
with; a node of the trie is a longest run of conversations between which no number is below its depth. Where such runs
begin and end is asked of all numbers at once (all nearest smaller values): each sorted block finds those that lie in it,
with one stack, and leaves what reaches over its edges: the falling minima of its numbers from the left, the rising ones
to the right, equal ones merged. One task reads these remains, a few rows a block, in the same way, which closes the runs
over several blocks. A run whose enclosing run is more than one turn shallower stands for the nodes of all depths
between. Sums over a node's run are built up as runs close; what depends on the depth follows from the bytes of the
run's first conversation.

A conversation is a row of 24 bytes a turn (a digest and a length); texts aren't sorted or moved beyond the first grouping.

Defined cases: a null role or text counts as empty, a null turn comes first; equal turns of one conversation go by
digest; a turn of any length counts whole; rows without a conversation's id belong to none and are left out;
conversations without turns end at the root; an empty table has no root and gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole, written

WIDTH = 16  # bytes of a turn's digest
NONE = hashlib.sha256(b"").hexdigest()
_IDS = 50_000  # ids that are joined into one text
_KINDS = RUN, REMAIN, NAME = 0, 1, 2
_OUT = "kind int, block long, idx long, uid long, parent long, depth long, n long, conv long, leaves long, splits long, weight long, rest long, raw boolean, ends string, key binary, numbers array<long>"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 1) -> DataFrame:
    """(base, conv_id, steps): each conversation's turns in order, as digest and bytes of the text. ``base`` is the id
    without its remainder by ``group``; conversations of one base lie in one partition."""
    role, text, conv = whole(role_col), whole(text_col), F.col(id_col).cast("long")
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(said, 256), 1, 2 * WIDTH))
    step = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where(conv.isNotNull()).select((conv - conv % group).alias("base"), conv.alias("conv_id"), step.alias("step")).repartition("base")
    turns = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return turns.withColumn("steps", F.transform("steps", lambda s: F.struct(s["digest"].alias("digest"), s["bytes"].alias("bytes"))))


def spliced(turns: DataFrame, at_most: int = 8) -> DataFrame:
    """(conv_id, steps): the first h turns of the conversation whose id is the base, then the own turns after the first
    h, with h = crc32(id) modulo ``at_most`` + 1. A base has nine conversations at most, so its group is small."""
    own, h = F.col("c.steps"), (F.crc32(F.col("c.conv_id").cast("string")) % (at_most + 1)).cast("int")
    head = F.get(F.filter("all", lambda c: c["conv_id"] == F.col("base")), 0)["steps"]
    head = F.coalesce(head, F.slice(own, 1, 0))
    together = turns.groupBy("base").agg(F.collect_list(F.struct("conv_id", "steps")).alias("all"))
    return together.select("base", "all", F.explode("all").alias("c")).select(F.col("c.conv_id").alias("conv_id"), F.concat(F.slice(head, F.lit(1), h), F.slice(own, h + 1, F.greatest(F.size(own), F.lit(1)))).alias("steps"))


class _Item:
    """Neighbouring conversations: sums over them, and ``path``, the bytes of the first one's first 0, 1, ... turns.

    ``rest`` has the bytes of the nodes that the others are the first to reach. ``raw``: one conversation, whose own end
    isn't placed yet. ``frame``: a closed run, which isn't placed yet.
    """

    __slots__ = ("n", "leaves", "conv", "weight", "rest", "path", "ends", "raw", "frame")

    def __init__(self, n, conv, leaves, weight, rest, path, ends, raw):
        self.n, self.conv, self.leaves, self.weight, self.rest, self.path, self.ends, self.raw, self.frame = n, conv, leaves, weight, rest, path, ends, raw, None

    def add(self, other: _Item, depth: int) -> None:
        self.n += other.n
        self.leaves += other.leaves
        self.conv = min(self.conv, other.conv)
        self.weight += other.weight
        self.rest += other.rest + int(other.path[-1] - other.path[depth])


class _Frame:
    """A run that isn't closed: its depth (None where it isn't known), how many numbers equal it, what it holds so far."""

    __slots__ = ("depth", "uid", "item", "splits", "names")

    def __init__(self, depth, uid, item=None, splits=1):
        self.depth, self.uid, self.item, self.splits, self.names = depth, uid, item, splits, []


class _Tree:
    """Numbers and items from left to right. ``edges``: runs that reach over the left edge; ``stack``: those that don't."""

    def __init__(self, block: int, depth: int | None) -> None:
        self.block, self.given, self.rows = block, 0, []
        self.edges, self.stack, self.now = [self.opened(depth)], [], None

    def opened(self, depth: int | None) -> _Frame:
        self.given += 1
        return _Frame(depth, (self.block << 32) + self.given)

    def write(self, kind: int, **values) -> None:
        self.rows.append(tuple(kind if n == "kind" else values.get(n) for n in _NAMES))

    def placed(self, item: _Item, parent: _Frame) -> None:
        """The nodes of an item from one turn below its parent on."""
        if not (item.raw or item.frame):
            return
        low, frame = parent.depth + 1, item.frame
        high = frame.depth if frame else len(item.path) - 1
        if high >= low:
            ended = len(item.path) - 1 == high
            before = item.path[max(low - 1, 0) : high] if low else np.concatenate([[0], item.path[:high]])
            saved = item.weight - item.n * before - (item.rest + item.path[-1] - before)
            up = None if parent.depth < 0 else parent.uid
            self.write(RUN, uid=frame and frame.uid, parent=up, depth=low, n=item.n, conv=item.conv, leaves=item.leaves, splits=frame.splits + 1 - ended if frame else 0, ends=item.ends if ended else None, numbers=saved)
        for uid in frame.names if frame else ():
            self.write(NAME, uid=uid, conv=item.conv)
        item.raw, item.frame = False, None

    def number(self, depth: int) -> None:
        """What stands right of the item that was read last."""
        item, self.now = self.now, None
        if item.raw:
            item.leaves = int(len(item.path) - 1 > depth)
        while True:
            over = self.stack[-1] if self.stack else self.edges[-1]
            if over.depth is None:
                over.item = item
                self.edges.append(self.opened(depth))
                return
            if depth > over.depth:
                frame = self.opened(depth)
                self.placed(item, frame)
                frame.item = item
                self.stack.append(frame)
                return
            self.placed(item, over)
            if over.item is None:
                over.item = item
            else:
                over.item.add(item, over.depth)
            if depth == over.depth:
                over.splits += 1
                return
            if not self.stack:
                self.edges.append(self.opened(depth))
                return
            self.stack.pop()
            item = over.item
            item.frame = over

    def remains(self, first: bytes, last: bytes) -> None:
        every = [(e.depth, e.uid, e.splits, e.item, 0) for e in self.edges] + [(f.depth, f.uid, f.splits, f.item, 1) for f in self.stack] + [(None, None, 0, self.now, 2)]
        for i, (depth, uid, splits, x, parent) in enumerate(every):
            own = {} if x is None else {"n": x.n, "conv": x.conv, "leaves": x.leaves, "weight": x.weight, "rest": x.rest, "raw": x.raw, "ends": x.ends, "numbers": x.path}
            self.write(REMAIN, block=self.block, idx=i, uid=uid, parent=parent, depth=depth, splits=splits, key=first if i == 0 else last if i == len(every) - 1 else None, **own)

    def flushed(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            kinds = {"raw": pa.bool_(), "ends": pa.string(), "key": pa.binary(), "numbers": pa.list_(pa.int64()), "kind": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(_NAMES, zip(*self.rows))], names=_NAMES)
            self.rows = []


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) // WIDTH


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n, conv, bytes, ends) of one block to its closed runs and its remains."""
    from pyspark import TaskContext

    tree, first, last = _Tree(TaskContext.get().partitionId() + 1, None), None, None
    for batch in batches:
        keys, ns, convs, sizes, ends = (batch.column(i) for i in range(5))
        for i, key in enumerate(keys.to_pylist()):
            if first is None:
                first = key
            else:
                tree.number(_common(last, key))
            n, path = ns[i].as_py(), np.concatenate([[0], np.cumsum(sizes[i].values.to_numpy(zero_copy_only=False), dtype=np.int64)])
            tree.now = _Item(n, convs[i].as_py(), 0, n * int(path[-1]), 0, path, ends[i].as_py(), True)
            last = key
        yield from tree.flushed(5000)
    if first is not None:
        tree.remains(first, last)
        yield from tree.flushed()


def _over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The remains of all blocks, in order, to the runs that reach over an edge."""
    tree, last = _Tree(0, -1), None
    for batch in batches:
        for r in batch.to_pylist():
            item = None
            if r["n"] is not None:
                item = _Item(r["n"], r["conv"], r["leaves"], r["weight"], r["rest"], np.array(r["numbers"], np.int64), r["ends"], r["raw"])
            if r["parent"] and tree.now:  # the last edge's items are followed by one at its own depth
                same.item.add(tree.now, same.depth)
                tree.now = None
            if r["parent"] == 1:
                tree.stack.append(_Frame(r["depth"], r["uid"], item, r["splits"]))
            elif r["parent"] == 2:
                tree.now, last = item, r["key"]
            else:
                if r["depth"] is not None:
                    tree.number(r["depth"])
                    same = tree.stack[-1] if tree.stack else tree.edges[-1]
                    same.splits += r["splits"] - 1
                    same.names.append(r["uid"])
                elif last is not None:
                    tree.number(_common(last, r["key"]))
                tree.now = item
        yield from tree.flushed(5000)
    if tree.now is not None:
        tree.number(-1)
        yield from tree.flushed()


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kid, conv_id) to texts of up to _IDS ids of one kid."""
    kid, ids, out = None, [], []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != kid or len(ids) == _IDS:
                if ids:
                    out.append((kid, ids[0], ",".join(map(str, ids))))
                kid, ids = k, []
            ids.append(c)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["kid", "first", "ids"])
            out = []
    out += [(kid, ids[0], ",".join(map(str, ids)))] if ids else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["kid", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kid, first, ids) to the digest of each kid's ids, which are read one text at a time."""
    kid, state, out = None, None, []
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == kid:
                state.update(b"," + text.encode())
                continue
            if state:
                out.append((kid, state.hexdigest()))
            kid, state = k, hashlib.sha256(text.encode())
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["kid", "ends"])
            out = []
    out += [(kid, state.hexdigest())] if state else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["kid", "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of (conv_id, steps): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A node's last turn is the one at its depth in the conversation conv_id.

    Copies are counted before anything is sorted. The ids that end at a node are joined in parallel, a bounded number at
    a time; only their digest, which can't be split, reads them one after another, as a stream.
    """
    key = F.unhex(F.array_join(F.transform("steps", lambda s: F.hex(s["digest"])), ""))
    kid = F.unhex(F.substring(F.sha2(F.col("key"), 256), 1, 2 * WIDTH))
    rows = written(conversations.select("conv_id", key.alias("key"), F.transform("steps", lambda s: s["bytes"]).alias("bytes")).withColumn("kid", kid))
    ids = rows.select("kid", "conv_id").repartitionByRange("kid", "conv_id").sortWithinPartitions("kid", "conv_id").mapInArrow(_joined_ids, "kid binary, first long, ids string")
    ends = ids.repartition("kid").sortWithinPartitions("kid", "first").mapInArrow(_hashed, "kid binary, ends string")
    distinct = rows.groupBy("kid").agg(F.any_value("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.any_value("bytes").alias("bytes"))
    blocks = written(distinct.join(ends, "kid").select("key", "n", "conv", "bytes", "ends").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_block, _OUT))
    over = written(blocks.where(F.col("kind") == REMAIN).repartition(1).sortWithinPartitions("block", "idx").mapInArrow(_over_blocks, _OUT))
    closed = blocks.where(F.col("kind") == RUN).unionByName(over.where(F.col("kind") == RUN))
    names = closed.where("uid is not null").select("uid", "conv").unionByName(over.where(F.col("kind") == NAME).select("uid", "conv"))
    runs = closed.join(names.select(F.col("uid").alias("parent"), F.col("conv").alias("up")), "parent", "left")
    nodes = runs.select("*", F.posexplode("numbers").alias("at", "saved"))
    end = F.col("at") == F.size("numbers") - 1
    return nodes.select(
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("at")).alias("depth"), F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, F.col("splits")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce(F.when(end, F.col("ends")), F.lit(NONE)).alias("ends_sha256"),
    )

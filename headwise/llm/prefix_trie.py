"""Prefixes that conversations share, by z-fast tries that map tasks fill and a shuffle merges.

A conversation is a string of turns. The hash of its first d turns is the XOR of one 128-bit hash per turn
and place, so that all prefix hashes of a stretch of turns come from a running XOR, and a stretch can
start anywhere. Stretches have `STRETCH` turns at most, so no conversation is ever one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import ship
from headwise.session import materialise, scratch_path

#: Turns in a stretch; prefix hashes that a task's trie holds before it is emptied.
STRETCH, HELD = 256, 1 << 19
#: Conversation numbers are grouped by this many, and the first of a group lends at most FIRST - 1 turns.
GROUP, FIRST = 100, 6
#: Ids written into one piece of text before it is hashed.
IDS_PER_PIECE = 1 << 16

_NONE = bytes(16)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the greatest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: a branching place or an end, with the edge above it.

    The edge covers the depths above..end; `path` has the prefix hashes and turn lengths of one
    stretch through it, from depth `base` on. The totals are those of stretches that end here.
    """

    __slots__ = ("above", "end", "base", "path", "lengths", "below", "weight", "least", "rest")

    def __init__(self, above: int, end: int, base: int, path: list[bytes], lengths: list[int]) -> None:
        self.above, self.end, self.base, self.path, self.lengths = above, end, base, path, lengths
        self.below: dict[bytes, Node] = {}
        self.weight, self.least, self.rest = 0, None, 0

    def hash(self, depth: int) -> bytes:
        return self.path[depth - self.base]

    @property
    def handle(self) -> bytes:
        """The prefix hash at the two-fattest depth of the edge; hashes of different depths differ."""
        return self.hash(two_fattest(self.above, self.end))


class ZFastTrie:
    """A compacted trie over prefix hashes, its nodes found by their handles.

    Several roots are held at once, one for each prefix that a stretch starts after.
    """

    def __init__(self) -> None:
        self.roots: dict[bytes, Node] = {}
        self._handles: dict[bytes, Node] = {}
        self.held = 0

    def _locate(self, base: int, path: list[bytes]) -> tuple[Node, Node | None, int]:
        """(deepest node on the path, the node whose edge the path leaves or None, the depth it leaves at)."""
        low, high = base, base + len(path) - 1
        node, edge = self.roots[path[0]], None
        while low < high:  # fat binary search for the deepest node whose whole string starts the path
            depth = two_fattest(low, high)
            found = self._handles.get(path[depth - base])
            if found is None:
                high = depth - 1
            elif found.end < base + len(path) and found.hash(found.end) == path[found.end - base]:
                node, low = found, found.end
            else:
                edge, high = found, depth - 1
        last = base + len(path) - 1
        if node.end == last:
            return node, None, last
        # A handle that lies on the path names the edge it leaves; else that edge starts with the next turn.
        if edge is None or edge.above != node.end:
            edge = node.below.get(path[node.end + 1 - base])
        if edge is None:
            return node, None, node.end
        low, high = node.end + 1, min(edge.end, last)
        while low < high:
            middle = (low + high + 1) // 2
            if edge.hash(middle) == path[middle - base]:
                low = middle
            else:
                high = middle - 1
        return node, edge, low

    def insert(self, base: int, path: list[bytes], lengths: list[int], weight: int, least: int, rest: int) -> None:
        """Add a stretch: prefix hashes at depths base, base + 1, ..., and the lengths of its turns."""
        if path[0] not in self.roots:
            self.roots[path[0]] = Node(base, base, base, path[:1], [0])
        node, edge, depth = self._locate(base, path)
        last = base + len(path) - 1
        if edge is not None and depth < edge.end:
            middle = Node(node.end, depth, edge.base, edge.path, edge.lengths)
            del self._handles[edge.handle]
            node.below[middle.hash(node.end + 1)] = middle
            edge.above = depth
            middle.below[edge.hash(depth + 1)] = edge
            self._handles[middle.handle], self._handles[edge.handle] = middle, edge
            node = middle
        elif edge is not None:
            node = edge
        if node.end < last:
            leaf = Node(node.end, last, base, path, lengths)
            node.below[leaf.hash(node.end + 1)] = leaf
            self._handles[leaf.handle] = leaf
            self.held += len(path)
            node = leaf
        node.weight += weight
        node.least = least if node.least is None else min(node.least, least)
        node.rest += rest

    def expand(self, counts: bool) -> Iterator[tuple]:
        """(depth, hash, hash before, length, weight, least, sum) for every depth of every edge, bottom up.

        Weights add up over a subtree, `least` is its smallest. The sum is over the subtree's depths, of length
        times weight with `counts`, else of the lengths of depths beyond `least`; the rests of all stretches are
        added. A root is told only at depth 0, since any other is some node's depth elsewhere.
        """
        stack = [(root, False) for root in self.roots.values()]
        sums: dict[int, int] = {}
        while stack:
            node, seen = stack.pop()
            if not seen:
                stack.append((node, True))
                stack += [(child, False) for child in node.below.values()]
                continue
            total = node.rest
            for child in node.below.values():
                node.weight += child.weight
                node.least = child.least if node.least is None else min(node.least, child.least)
                total += sums.pop(id(child))
            for depth in range(node.end, node.above, -1):
                length = node.lengths[depth - node.base]
                total += length * node.weight if counts else length * (depth > node.least)
                yield depth, node.hash(depth), node.hash(depth - 1), length, node.weight, node.least, total
            sums[id(node)] = total
            if not node.end:
                yield 0, _NONE, None, 0, node.weight, node.least, total


_PARTIAL = "depth long, hash binary, before binary, length long, weight long, least long, total long"


def _partial_nodes(stretches: DataFrame, counts: bool) -> DataFrame:
    """Nodes as map tasks see them: every task fills a trie batch by batch and expands its edges.

    Equal stretches of a batch are inserted as one. A trie that holds many prefix hashes is
    expanded and begun anew: the shuffle that follows adds up a node's totals anyway.
    """
    names = ("depth", "hash", "before", "length", "weight", "least", "total")
    schema = pa.schema([(n, pa.binary() if n in ("hash", "before") else pa.int64()) for n in names])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def emptied(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        nodes = trie.expand(counts)
        while rows := list(islice(nodes, 1 << 16)):
            yield packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("root1", "root2", "x1", "x2")], axis=1)
            _, first, which = np.unique(marks, axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
            weight, rest = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.add.at(weight, which, batch.column("weight").to_numpy())
            np.add.at(rest, which, batch.column("rest").to_numpy())
            np.minimum.at(least, which, batch.column("least").to_numpy())
            bases, turns = batch.column("base").to_numpy(), batch.column("turns")
            flat, offsets = turns.flatten(), turns.offsets.to_numpy()
            offsets = offsets - offsets[0]
            lanes = np.stack([flat.field(c).to_numpy() for c in ("z1", "z2")], axis=1)
            lengths = flat.field("length").to_numpy()
            for n, row in enumerate(first.tolist()):
                low, high = offsets[row], offsets[row + 1]
                path = np.bitwise_xor.accumulate(np.concatenate([marks[row : row + 1, :2], lanes[low:high]]), axis=0)
                hashes = path.astype(">i8").view("V16").ravel().tolist()
                own = [0, *lengths[low:high].tolist()]
                trie.insert(int(bases[row]), hashes, own, int(weight[n]), int(least[n]), int(rest[n]))
            if trie.held > HELD:
                yield from emptied(trie)
                trie = ZFastTrie()
        yield from emptied(trie)

    columns = ("base", "root1", "root2", "x1", "x2", "turns", "weight", "least", "rest")
    return stretches.select(*columns).mapInArrow(run, _PARTIAL)


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, folder: str) -> DataFrame:
    """Turns with their place in their conversation from 1: conv, place, t1, t2, length.

    t1 and t2 are two hashes of role and text. Turns are sorted over range partitions and counted within
    each, so that a conversation of any length is spread over tasks; what earlier
    partitions hold of a conversation is added afterwards.
    """
    spark = turns.sparkSession
    words = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), words[0].alias("role"), words[1].alias("text")
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            convs = batch.column(0).to_numpy()
            if not len(convs):
                continue
            heads = np.flatnonzero(np.diff(convs, prepend=convs[0] - 1))
            nth = np.arange(len(convs)) - np.repeat(heads, np.diff(np.append(heads, len(convs))))
            if convs[0] == conv:
                nth[: heads[1] if len(heads) > 1 else len(nth)] += seen
            conv, seen = convs[-1], int(nth[-1]) + 1
            columns = [batch.column(0), pa.array(np.full(len(convs), part, np.int32)), pa.array(nth + 1), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "nth", "t1", "t2", "length"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("conv", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "role", "text").alias("t2"),
                F.length("text").cast("long").alias("length"))
    )
    counted = materialise(hashed.mapInArrow(count, "conv long, part int, nth long, t1 long, t2 long, length long"), f"{folder}/counted")
    spans = counted.groupBy("conv", "part").agg(F.max("nth").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.sum("n").over(earlier)).where("offset > 0").drop("n")
    return counted.join(offsets, ["conv", "part"], "left").select(
        "conv", (F.col("nth") + F.coalesce("offset", F.lit(0))).alias("place"), "t1", "t2", "length"
    )


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from the first one of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % FIRST


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations with the first turns of their group's first one: conv, place, t1, t2, length.

    A conversation has a row for each turn; one without turns has a single row, place 0 and the rest NULL.
    `turns` are numbered turns. The group's first conversation lends five turns at most.
    """
    convs = turns.select("conv").distinct().withColumn("h", borrowed(F.col("conv")))
    base = F.col("conv") - F.col("conv") % GROUP
    heads = turns.where((F.col("place") < FIRST) & (F.col("conv") % GROUP == 0)).select(
        F.col("conv").alias("base"), "place", "t1", "t2", "length"
    )
    lent = convs.withColumn("base", base).join(heads, "base").where("place <= h")
    begins = convs.join(lent.groupBy("conv").agg(F.count("*").alias("lent")), "conv", "left").select(
        "conv", "h", F.coalesce("lent", F.lit(0)).alias("lent")
    )
    own = turns.join(begins, "conv").where("place > h")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "t1", "t2", "length")
    empty = F.lit(None).cast("long")
    bare = convs.select("conv", F.lit(0).cast("long").alias("place"), *[empty.alias(c) for c in ("t1", "t2", "length")])
    return lent.select("conv", "place", "t1", "t2", "length").unionAll(own).unionAll(bare)


def stretches(whole: DataFrame) -> DataFrame:
    """Rebuilt conversations in stretches: conv, base, root1, root2, turns, rest, depth, x1, x2.

    `turns` are structs (z1, z2, length) of up to 256 turns after depth `base`, x1 and x2 their hash, root1 and root2
    that of the turns before; `rest` has the code points of the turns after, depth is the number of all turns.
    """
    salted = [F.xxhash64(F.lit(n), "place", "t1", "t2").alias(f"z{n}") for n in (1, 2)]
    turns = whole.select("conv", "place", F.floor(F.greatest(F.col("place") - 1, F.lit(0)) / STRETCH).alias("nth"), *salted, "length")
    real = F.col("place") > 0
    grouped = turns.groupBy("conv", "nth").agg(
        F.array_sort(F.collect_list(F.when(real, F.struct("place", "z1", "z2", "length")))).alias("turns"),
        F.coalesce(F.bit_xor(F.when(real, F.col("z1"))), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor(F.when(real, F.col("z2"))), F.lit(0)).alias("x2"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("length"),
        F.max("place").alias("last"),
    )
    order = Window.partitionBy("conv").orderBy("nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return grouped.select(
        "conv",
        (F.col("nth") * STRETCH).alias("base"),
        F.coalesce(F.bit_xor("x1").over(before), zero).alias("root1"),
        F.coalesce(F.bit_xor("x2").over(before), zero).alias("root2"),
        F.transform("turns", lambda t: F.struct(t["z1"].alias("z1"), t["z2"].alias("z2"), t["length"].alias("length"))).alias("turns"),
        F.coalesce(F.sum("length").over(order.rowsBetween(1, Window.unboundedFollowing)), zero).alias("rest"),
        F.max("last").over(Window.partitionBy("conv")).alias("depth"),
        "x1",
        "x2",
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """(hash, ends_sha256): conversations that end at a node, joined in ascending order and hashed.

    SHA-256 takes its input in order, so one node's text is hashed by one task, as a stream. Range
    partitions write the ids into pieces of text first, so that this task reads a row
    for 65,536 conversations.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, low = [], 0
            for n in range(1, len(hashes) + 1):
                if n == len(hashes) or hashes[n] != hashes[low] or n - low == IDS_PER_PIECE:
                    rows.append((hashes[low], convs[low], ",".join(map(str, convs[low:n]))))
                    low = n
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for hash, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if hash == node:
                    running.update(b",")
                else:
                    if node is not None:
                        done.append((node, running.hexdigest()))
                    node, running = hash, hashlib.sha256()
                running.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["hash", "ends"])
        if node is not None:
            yield pa.RecordBatch.from_pydict({"hash": pa.array([node], pa.binary()), "ends": [running.hexdigest()]})

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.select("hash", "conv").repartitionByRange(parts, "hash", "conv").sortWithinPartitions("hash", "conv")
    written = pieces.mapInArrow(write, "hash binary, first long, piece string")
    return written.repartition("hash").sortWithinPartitions("hash", "first").mapInArrow(digest, "hash binary, ends string")


def prefix_nodes(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node of the prefix tree of the rebuilt conversations.

    Turns are ordered by `turn` (missing first; equal ones by role and text), a NULL role or text is empty,
    rows without a conversation's number are left out. Every conversation c begins with the first h
    turns of c - c % 100 (h = crc32 of c's digits, modulo 6; as many as there are) and goes on with its own after
    the first h. A node is a different sequence of first turns, its members are the
    conversations that begin so. Columns: `conv` (smallest member), depth, parent_<conv>, n_convs, n_children, n_leaves
    (nodes of the subtree without children), saved_tokens (over the subtree, members but one times the code points
    of the node's last text), ends_sha256 (of the members that end there, ascending, comma-joined). No
    turns give no rows.

    Map tasks insert stretches of conversations into z-fast tries and expand their edges; nodes of
    all tasks are merged by their hash. Of a subtree's sums, what counts every member comes
    from that pass. What counts a node once needs its owner, the smallest member: along a conversation's path it
    owns the deepest nodes, so a second pass over the owners adds up their own
    lengths and leaves. A node reaches a shuffle once per task, however many members it has.
    """
    spark = turns.sparkSession
    ship(spark)
    folder = scratch_path(spark, "prefix-trie")
    placed = materialise(numbered_turns(turns, conv, turn, role, text, folder), f"{folder}/turns")
    cut = materialise(stretches(rebuilt(placed)), f"{folder}/stretches")

    first = _partial_nodes(cut.select("*", F.lit(1).cast("long").alias("weight"), F.col("conv").alias("least")), True)
    nodes = materialise(
        first.groupBy("depth", "hash").agg(
            F.first("before").alias("before"),
            F.first("length").alias("length"),
            F.sum("weight").alias("n_convs"),
            F.min("least").alias("conv"),
            F.sum("total").alias("every"),
        ),
        f"{folder}/nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("before").alias("hash")).agg(F.count("*").alias("n_children"))
    parented = materialise(
        nodes.join(children, "hash", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), f"{folder}/parented"
    )
    owners = parented.groupBy("conv").agg(
        F.count_if(F.col("depth") > 0).alias("owned"),
        F.sum("length").alias("owned_length"),
        F.count_if(F.col("n_children") == 0).alias("weight"),
    )
    # An owner's path is its own beyond `least`; a stretch's rest is what is its own after it.
    owning = cut.join(owners, "conv").withColumn("least", F.col("depth") - F.col("owned"))
    last = F.col("base") + F.size("turns") == F.col("depth")
    second = _partial_nodes(owning.withColumn("rest", F.least("rest", "owned_length")), False)
    once = second.groupBy("hash").agg(F.sum("weight").alias("n_leaves"), F.sum("total").alias("once"))

    zs = [F.col(f"root{n}").bitwiseXOR(F.col(f"x{n}")) for n in (1, 2)]
    ends = _end_digests(cut.where(last).select("conv", _packed(*zs).alias("hash")))
    empty = hashlib.sha256(b"").hexdigest()
    told = materialise(
        parented.join(once, "hash", "left").join(ends, "hash", "left").select(
            "hash",
            "before",
            F.col("conv").alias(conv),
            "depth",
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("every") - F.col("once")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(empty)).alias("ends_sha256"),
        ),
        f"{folder}/told",
    )
    parents = parented.where("n_children > 0").select(F.col("hash").alias("before"), F.col("conv").alias(f"parent_{conv}"))
    return told.join(parents, "before", "left").select(
        conv, "depth", f"parent_{conv}", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def _packed(first: Column, second: Column) -> Column:
    """Two longs as 16 bytes, highest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in (first, second)])

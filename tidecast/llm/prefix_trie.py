"""The trie of conversations' common beginnings, from partial tries that merge by key.

Each task walks its conversations through a trie of its own and emits the node table; tables merge by node key in a tree
of rounds, which sum members and ends.  A node's key is a chain of 128-bit hashes of the turns down to it, so equal keys
are equal sequences wherever they were met.  The rollup goes from the bottom up by doubling: a round adds what stands
2**k levels below, so that even a very deep trie takes few rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import attach, cut, discard

#: Nodes, and ends, that a task's trie holds before its table goes out and a new one begins.
HELD = 50_000
#: Partial tables that one step of a merge round puts together.
FAN = 32
ROOT = bytes(16)
_NODE = "slot int, key binary, jumps array<binary>, depth bigint, chars bigint, n bigint, conv_id bigint, first_end bigint, ends string"


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, role, text): conversations that begin like their hundred's first one, and a row of pos -1 for each.

    With h the unsigned CRC-32 of conversation c's decimal id modulo 6: the first h turns of conversation c - c % 100
    (all if it has fewer, none if it is absent), then c's own after its first h.  Turns go by turn_col, null first, ties
    by role and text; null role or text is empty; rows of null id belong to no conversation and are left out.
    """
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    turns = cut(turns.withColumn("pos", F.row_number().over(ordered).cast("long") - 1).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 6).drop("turn"), "turns")
    each = turns.filter("pos = 0").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    begin = turns.filter("pos < 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "pos", "role", "text")
    heads = each.join(begin, "base").filter("pos < h").select("conv_id", "pos", "role", "text")
    own = turns.filter("pos >= h").select("conv_id", (F.col("pos") + 5).alias("pos"), "role", "text")
    return heads.unionByName(own).unionByName(each.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text")))


class Partial:
    """One task's trie, as columns by node."""

    def __init__(self, slot: int) -> None:
        self.slot, self.path = slot, [ROOT]
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.jumps: list[list[bytes]] = []
        self.depth: list[int] = []
        self.chars: list[int] = []
        self.n: list[int] = []
        self.conv: list[int] = []
        self.ends: list[list[int]] = []
        self.held = 0

    def visit(self, conv: int, chars: int) -> int:
        """Count conv as a member of the node that the path has come to."""
        key, depth = self.path[-1], len(self.path) - 1
        k = self.at.get(key)
        if k is None:
            k = self.at[key] = len(self.n)
            jumps, step = [], 1
            while step <= depth:
                jumps.append(self.path[depth - step])
                step *= 2
            self.jumps.append(jumps), self.depth.append(depth), self.chars.append(chars), self.n.append(0), self.conv.append(conv), self.ends.append([])
            self.held += 1
        self.n[k] += 1
        return k

    def turn(self, role: str, text: str) -> None:
        role_ = role.encode()
        self.path.append(hashlib.blake2b(self.path[-1] + len(role_).to_bytes(8) + role_ + text.encode(), digest_size=16).digest())

    def end(self, conv: int, k: int) -> None:
        self.ends[k].append(conv)
        self.held += 1

    def table(self) -> pa.RecordBatch:
        keys = list(self.at)
        columns = [
            pa.array([self.slot] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array(self.jumps, pa.list_(pa.binary())), pa.array(self.depth, pa.int64()), pa.array(self.chars, pa.int64()),
            pa.array(self.n, pa.int64()), pa.array(self.conv, pa.int64()), pa.array([e[0] if e else None for e in self.ends], pa.int64()), pa.array([",".join(map(str, e)) if e else None for e in self.ends], pa.string()),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in _NODE.split(", ")])


def partial_tries(turns: DataFrame, held: int = HELD) -> DataFrame:
    """The node tables of each task's conversations; ids are range-partitioned, so lists of ends follow one another.

    The turns of a conversation stream through one task, which holds 16 bytes for each, and its trie up to `held` nodes
    and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, conv, node = Partial(TaskContext.get().partitionId()), None, -1
        for batch in batches:
            for c, pos, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "pos", "role", "text"))):
                if pos == -1:
                    if conv is not None:
                        trie.end(conv, node)
                    if trie.held >= held:
                        yield trie.table()
                    conv, trie.path = c, [ROOT]
                    node = trie.visit(c, 0)
                else:
                    trie.turn(role, text)
                    if trie.held >= 2 * held:
                        yield trie.table()
                    node = trie.visit(c, len(text))
        if conv is not None:
            trie.end(conv, node)
            yield trie.table()

    return turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, _NODE)


def merged(tables: DataFrame, fan: int = FAN) -> DataFrame:
    """One row a node: partial tables by key, `fan` slots to one each round, until one slot is left.

    n and conv_id are members and the smallest of them; chunks counts the pieces that its list of ends is in, and ends is
    the hash of the piece where there is one."""
    slots = (tables.agg(F.max("slot")).first()[0] or 0) + 1
    out = tables.select("slot", "key", "jumps", "depth", "chars", "n", "conv_id", F.when(F.col("ends").isNotNull(), 1).otherwise(0).cast("long").alias("chunks"), F.sha2("ends", 256).alias("ends"))
    while True:
        slots = -(-slots // fan)
        sums = (F.first("jumps").alias("jumps"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("chunks").alias("chunks"), F.min("ends").alias("ends"))
        out = out.withColumn("slot", F.floor(F.col("slot") / fan).cast("int")).groupBy("key", "slot").agg(*sums)
        if slots == 1:
            return out.drop("slot")


def ends_in_pieces(tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, all_ends): hashes of lists of ends in several pieces, streamed in order; memory holds one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "all_ends"])
        for batch in batches:
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        yield done()
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
        if key is not None:
            yield done()

    pieces = tables.filter("ends is not null").select("key", "first_end", "ends").join(nodes.filter("chunks > 1").select("key"), "key", "left_semi")
    return pieces.repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(run, "key binary, all_ends string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, n_children, n_leaves, saved) of (key, jumps, n, chars): children, and sums over the subtree, top included."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    children = nodes.filter("depth > 0").groupBy(F.get("jumps", F.lit(0)).alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    state = nodes.join(children, "key", "left").select(
        "key", "jumps", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")
    )
    state, step = cut(state, "rollup"), 1
    while step <= deepest:
        below = state.filter(F.size("jumps") > 0).groupBy(F.get("jumps", F.lit(0)).alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        over = state.join(below, "key", "left").select(
            "key", F.when(F.size("jumps") > 0, F.slice("jumps", F.lit(2), F.greatest(F.size("jumps") - 1, F.lit(0)))).otherwise(F.col("jumps")).alias("jumps"), "n_children",
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
        )
        before, state = state, cut(over, "rollup")
        discard(before)
        step *= 2
    return state.drop("jumps")


def trie(turns: DataFrame, held: int = HELD, fan: int = FAN) -> DataFrame:
    """One row a node of (conv_id, pos, role, text), where each conversation has a row of pos -1 beside its turns.

    key, depth, parent (null for the root), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points that sharing the node's and its subtree's turns saves), ends_sha256 (of the decimal ids of
    the members that end here, ascending, joined by commas).  No conversations: no nodes, not even the root.
    """
    tables = cut(partial_tries(turns, held), "partial-tries")
    nodes = cut(merged(tables, fan), "nodes")
    ends = ends_in_pieces(tables, nodes)
    sums = rolled_up(nodes)
    parents = sums.filter("n_children > 0").join(nodes, "key").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "key").join(ends, "key", "left").withColumn("parent", F.get("jumps", F.lit(0)))
    out = attach(out, parents, ["parent"], ["key"])
    sha = F.coalesce("all_ends", "ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return out.select("key", "parent", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), sha)


def digest(conversations: DataFrame, **how) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the
    rebuilt conversations' trie (see rebuilt and trie)."""
    return trie(rebuilt(conversations), **how).drop("key", "parent")

"""Connected components of an edge table, by union-find within partitions and star contractions between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import cut


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """node -> the smallest node of its component, by union-find with path halving."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


#: Edges that one task's union-find takes.
FOREST = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = forest(pair for batch in batches for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
    own = {x: r for x, r in own.items() if x != r}
    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["a", "b"])


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, per_task: int = FOREST) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component, itself included.

    edges is read twice, so it had better be a stored table.  Edges are dealt to tasks of about per_task, each of which shrinks its own to a union-find forest of stars.  Of one
    task's edges that is the answer; the forests of several meet in large-star and small-star rounds, each written to
    the shared folder, until nothing changes.  Only counts and a checksum come to the driver.  Null ends and loops are
    dropped; an empty table has no components.
    """
    given = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    tasks = max(1, -(-given.count() // per_task))
    now = given.repartition(tasks).mapInArrow(_contract, "a long, b long")
    if tasks == 1:
        return _stars(cut(now, "forest", narrow=True))
    now = cut(now.distinct(), "forest", narrow=True)
    seen = _print(now)
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: every node's smaller neighbours and the node itself go to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = cut(down, "large", narrow=True)
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = cut(small, "small", narrow=True)
        told = _print(now)
        if told == seen:
            break
        seen = told
    return _stars(now)


def _stars(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

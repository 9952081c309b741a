"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import cut

#: Rows that the two codebooks are fitted on at most, rounds of k-means, and centroids a half at most.
SAMPLE, ROUNDS, MOST_CENTROIDS = 20_000, 12, 64
#: Rows that a cell holds on average, and vectors that a query reranks at least.
CELL_ROWS, MIN_RERANK = 4, 256
NEIGHBOURS = 20
#: Queries on which the number of vectors to rerank is learned, and the share of their true neighbours it must reach.  On
#: vectors with hardly any structure that is half of all vectors, on clustered ones a small part.
PROBES, RECALL = 64, 0.96
#: Entries and queries that one task scores against each other at most, about, and queries that one task routes.
BLOCK, QUERY_BLOCK, ROUTED = 4096, 4096, 128


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from k distinct rows; an empty centroid stays where it is."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (-2 * x @ c.T + (c**2).sum(1)[None, :]).argmin(1)


def visits(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: dict[int, int], want: int) -> list[int]:
    """Cells in order of summed distance of the query's halves to their two centroids until they hold `want` rows.

    Distance is the negative inner product, so that nearest means largest.  A heap holds the frontier of the grid of
    both centroid orders; each cell's two successors enter once.
    """
    half = books[0].shape[1]
    a, b = -(books[0] @ query[:half]), -(books[1] @ query[half:])
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out, have = [(float(a[ia[0]] + b[ib[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        cell = int(ia[i]) * len(ib) + int(ib[j])
        if n := counts.get(cell):
            out.append(cell)
            have += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(ia) and q < len(ib) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(a[ia[p]] + b[ib[q]]), p, q))
    return out


def blocks_of(counts: dict[int, int], size: int = BLOCK) -> dict[int, tuple[int, int]]:
    """cell -> (first block, blocks): neighbouring cells share a block of `size` entries, a larger cell has several."""
    out, block, have = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if have and have + n > size:
            block, have = block + 1, 0
        parts = -(-n // size)
        out[cell] = (block, parts)
        if parts > 1:
            block, have = block + parts, 0
        else:
            have += n
    return out


def _matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    """The rows of a column of lists of dim numbers, none of them null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    return np.array(column, np.float64).reshape(-1, dim)


def reach(entries: DataFrame, probed: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: dict[int, int], neighbours: int, recall: float) -> int:
    """How many vectors a query must rerank so that `recall` of the probed queries' true neighbours are among them.

    The probes are searched exhaustively: each task keeps their best of its entries.  A neighbour needs as many vectors
    as the cells up to its own hold, in the order in which its query visits them.
    """
    dim, total = probed.shape[1], sum(counts.values())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, scores = np.zeros((len(probed), 0), np.int32), np.zeros((len(probed), 0))
        for batch in batches:
            scores = np.hstack([scores, probed @ _matrix(batch.column("v"), dim).T])
            cells = np.hstack([cells, np.tile(batch.column("cell").to_numpy().astype(np.int32), (len(probed), 1))])
            if scores.shape[1] > neighbours + 1:
                top = np.argpartition(-scores, neighbours, axis=1)[:, : neighbours + 1]
                scores, cells = np.take_along_axis(scores, top, 1), np.take_along_axis(cells, top, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(probed)), scores.shape[1]), pa.int32()), pa.array(cells.ravel(), pa.int32()), pa.array(scores.ravel())], ["probe", "cell", "score"])

    top = Window.partitionBy("probe").orderBy(F.desc("score"), "cell")
    near = entries.select("v", "cell").mapInArrow(best, "probe int, cell int, score double").withColumn("r", F.row_number().over(top)).filter(F.col("r") <= neighbours + 1)
    needs = []
    found: dict[int, list[int]] = defaultdict(list)
    for row in near.collect():
        found[row["probe"]].append(row["cell"])
    for probe, cells in found.items():
        order = visits(probed[probe], books, counts, total)
        upto = dict(zip(order, np.cumsum([counts[c] for c in order]).tolist()))
        needs += [upto[c] for c in cells]
    needs.sort()
    return needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))] if needs else total


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    neighbours: int = NEIGHBOURS,
    every: int = 20,
    min_rerank: int = MIN_RERANK,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
    probes: int = PROBES,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every row whose id is divisible by `every`.

    Nearness is the inner product in double precision; a query's own row is no candidate, other rows of equal vectors
    are; ties go to the smaller id.  Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do those of another length than most, nor rows of null id.

    Equal vectors stand in the index once, with their neighbours + 1 smallest ids: no search returns more of them.
    Both halves are quantised by k-means on a bounded sample (`sample` rows, first by hash); every vector is indexed.
    A query visits cells by the heap until they hold as many vectors as reach() found to catch `recall` of the true
    neighbours of `probes` queries, min_rerank at least, meets the entries of visited cells in blocks, and keeps its best of each block.
    Neighbouring cells share a block and a large cell is dealt over several; queries are dealt in blocks too.  Cell
    counts, at most MOST_CENTROIDS ** 2 numbers, and the probes' neighbours are what the driver holds.  Empty table: no
    rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    finite = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    usual = finite.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    rows = finite.filter(F.size("v") == dim).withColumn("vk", F.xxhash64("v"))
    # -0.0 and 0.0 hash alike; the vector itself is in the partition key, so a hash only orders
    rank = F.row_number().over(Window.partitionBy("vk", "v").orderBy("id"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= neighbours + 1)
    points = cut(few.groupBy("vk", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    fitted = points.orderBy(F.xxhash64("vk"), "vk").limit(sample).select("v").collect()
    x = _matrix([r.v for r in fitted], dim)
    half = dim // 2
    total = points.count()
    k = int(min(MOST_CENTROIDS, max(1, round((total / cell_rows) ** 0.5))))
    books = (kmeans(x[:, :half], k), kmeans(x[:, half:], k)) if half else (np.zeros((1, 0)), kmeans(x, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            cell = nearest(m[:, :half], books[0]) * len(books[1]) + nearest(m[:, half:], books[1]) if len(m) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("v"), batch.column("ids"), batch.column("vk")], ["cell", "v", "ids", "vk"])

    entries = cut(points.mapInArrow(assign, "cell int, v array<double>, ids array<bigint>, vk long"), "entries")
    counts = {r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()}
    blocks = blocks_of(counts)
    asked = cut(rows.filter(F.col("id") % every == 0).groupBy("vk", "v").agg(F.min("id").alias("qk")), "asked")
    distinct = asked.count()
    query_blocks = -(-distinct // QUERY_BLOCK)
    probed = _matrix([r.v for r in asked.orderBy(F.xxhash64("vk", F.lit(1)), "vk").limit(probes).select("v").collect()], dim)
    want = max(min_rerank, reach(entries, probed, books, counts, neighbours, recall))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            qk = batch.column("qk").to_pylist()
            for s in range(0, len(m), 64):
                took = []
                for key, q in zip(qk[s : s + 64], m[s : s + 64]):
                    per = defaultdict(list)
                    for cell in visits(q, books, counts, want):
                        first, n = blocks[cell]
                        for block in range(first, first + n):
                            per[block].append(cell)
                    took += [(key, q, block, cells) for block, cells in per.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t[0] for t in took], pa.int64()), pa.array([t[1] for t in took], pa.list_(pa.float64())), pa.array([t[2] for t in took], pa.int32()), pa.array([t[3] for t in took], pa.list_(pa.int32()))],
                    ["qk", "q", "block", "cells"],
                )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, vk = batch.column("cell").to_pylist(), batch.column("vk").to_pylist()
            block = [blocks[c][0] + v % blocks[c][1] for c, v in zip(cell, vk)]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column("cell"), batch.column("v"), batch.column("ids")], ["block", "cell", "v", "ids"])

    # a distinct query vector searches once; qk names it by its smallest id
    tasks = max(1, -(-distinct // ROUTED))
    routed = asked.select("qk", "v").repartition(tasks, "qk").mapInArrow(route, "qk long, q array<double>, block int, cells array<int>").withColumn("qb", F.pmod(F.xxhash64("qk"), F.lit(max(1, query_blocks))).cast("int"))
    dealt = entries.mapInArrow(deal, "block int, cell int, v array<double>, ids array<bigint>").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(0, query_blocks - 1)))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if left.num_rows and right.num_rows:
            e, cell = _matrix(left.column("v"), dim), left.column("cell").to_numpy()
            ids = left.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            for s in range(0, right.num_rows, 256):
                part = right.slice(s, 256)
                got = np.einsum("qd,ed->qe", _matrix(part.column("q"), dim), e)
                for name, row, visited in zip(part.column("qk").to_pylist(), got, part.column("cells").to_pylist()):
                    here = np.flatnonzero(np.isin(cell, visited))
                    if len(here) > 4 * neighbours:
                        floor = np.partition(row[here], -neighbours - 1)[-neighbours - 1]
                        here = here[row[here] >= floor]
                    for b in here[np.lexsort((first[here], -row[here]))]:
                        out_q += [name] * len(ids[b])
                        out_id += ids[b]
                        out_s += [row[b]] * len(ids[b])
        return pa.table({"qk": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    met = dealt.groupBy("block", "qb").cogroup(routed.groupBy("block", "qb")).applyInArrow(score, "qk long, vec_id long, score double")
    top = Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    best = cut(met.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= neighbours + 1).select("qk", "vec_id", "score"), "best")
    named = rows.filter(F.col("id") % every == 0).select("id", "vk", "v").join(asked, ["vk", "v"]).select(F.col("id").alias("query_id"), "qk")
    own = named.join(best, "qk").filter("vec_id != query_id")
    final = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= neighbours)
    return final.select("query_id", "rank", "vec_id", "score")

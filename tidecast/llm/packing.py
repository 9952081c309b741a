"""Best-fit packing of documents into training sequences, under conflicts of source and duplicate cluster."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import BLANK, ascii_lower, cut
from tidecast.llm.mixing import word_count

#: Tokens (words) a bin holds, documents a shard packs at about, and pieces of one source a bin takes at most.
CAPACITY, SHARD_ROWS, PER_SOURCE = 2048, 4096, 2

LAYOUT = "doc_id long, piece int, token_start long, n_tokens long, bin_id long, bin_offset int"


class Bins:
    """Open bins in order of their residual, each with bitmaps of the sources and duplicate clusters it holds.

    by_residual[r] lists the bins with r tokens left; a bit of `some` is set for each r that has any, so that the
    successor of r is the lowest set bit from r up.  A source has `per_source` bitmaps, the k-th set when the bin holds
    k pieces of it.
    """

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def fit(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece; its bin and its offset there.  The tightest compatible bin takes it, else a new one."""
        rest = self.some >> need
        r = need
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            held = self.by_residual[r]
            for k, b in enumerate(held):
                if not self.clusters[b] >> cluster & 1 and not self.sources[b][-1] >> source & 1:
                    del held[k]
                    if not held:
                        self.some &= ~(1 << r)
                    self._add(b, source, cluster)
                    self._open(b, r - need)
                    return b, self.capacity - r
            rest >>= step + 1
            r += 1
        b = len(self.clusters)
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self._add(b, source, cluster)
        self._open(b, self.capacity - need)
        return b, 0

    def _add(self, b: int, source: int, cluster: int) -> None:
        self.clusters[b] |= 1 << cluster
        for k, seen in enumerate(self.sources[b]):
            if not seen >> source & 1:
                self.sources[b][k] |= 1 << source
                break

    def _open(self, b: int, residual: int) -> None:
        if residual:
            self.by_residual[residual].append(b)
            self.some |= 1 << residual


def pack_shard(rows: Iterable[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """(doc_id, piece, token_start, n_tokens, bin, offset) for rows (doc_id, n, source, cluster).

    Whole bins' worth of a longer document fill bins of their own; the pieces that are left go in by best fit, longest
    first.  A document without tokens is an empty piece at the start of no bin (bin null).
    """
    rests, ids, clusters, full = [], {}, {}, 0
    for doc, n, source, cluster in rows:
        whole = n // capacity
        for piece in range(whole):
            yield doc, piece, piece * capacity, capacity, -1 - full, 0
            full += 1
        if n % capacity or not n:
            rests.append((n % capacity, ids.setdefault(source, len(ids)), clusters.setdefault(cluster, len(clusters)), doc, whole))
    bins = Bins(capacity, per_source)
    for need, source, cluster, doc, whole in sorted(rests, key=lambda x: (-x[0], x[2], x[1])):
        where = bins.fit(need, source, cluster) if need else (None, 0)
        yield doc, whole, whole * capacity, need, *where


def cluster_key(text):
    """The default duplicate cluster: equal texts but for case and white space at the ends."""
    return F.md5(ascii_lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """The layout of docs in bins of `capacity` words: doc_id, piece, token_start, n_tokens, bin_id, bin_offset.

    Every word of every row is in exactly one bin.  A bin holds no two pieces of one duplicate cluster and at most
    per_source pieces of one source.  Documents longer than a bin are cut into bins of their own and a rest.

    Only ids, counts and two hashes move.  Rows that agree in all of these are counted before they move and numbered
    after, so that repeats have places of their own.  Rows are dealt by a hash of their contents and number to shards of
    about shard_rows rows, each packed by itself in bounded memory: the layout depends on nothing but the rows.

    Null text or no words: one piece of 0 tokens in no bin (bin_id null).  Null source: a source of its own.  Empty
    table: no rows.
    """
    cluster = F.col(cluster_col).cast("string") if cluster_col else cluster_key(F.col(text_col))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        word_count(F.col(text_col)).alias("n"),
        F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("(none)"))).alias("source"),
        F.xxhash64(cluster).alias("cluster"),
    )
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = counted.select(*narrow.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("number"))
    rows = cut(numbered.withColumn("place", F.xxhash64(*numbered.columns)), "pieces")
    shards = max(1, -(-rows.count() // shard_rows))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["doc_id", "n", "cluster", "source", "number"])
        ids = [None if pd.isna(d) else int(d) for d in ordered["doc_id"]]
        out = list(pack_shard(zip(ids, ordered["n"].tolist(), ordered["source"].tolist(), ordered["cluster"].tolist()), capacity, per_source))
        opened = sum(1 for x in out if x[4] is not None and x[4] < 0)
        first = int(key[0]) << 32
        bin_id = [None if x[4] is None else first + (-1 - x[4] if x[4] < 0 else opened + x[4]) for x in out]
        return pd.DataFrame(
            {
                "doc_id": pd.array([x[0] for x in out], "Int64"),
                "piece": [x[1] for x in out],
                "token_start": [x[2] for x in out],
                "n_tokens": [x[3] for x in out],
                "bin_id": pd.array(bin_id, "Int64"),
                "bin_offset": [x[5] for x in out],
            }
        )

    dealt = rows.withColumn("shard", F.pmod("place", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, LAYOUT)

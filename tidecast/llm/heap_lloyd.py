"""Product codes of vectors by Lloyd rounds that rescan only parts whose bounds the centroids' drift has violated.

Vectors lie in blocks, one row each.  A block keeps, for every part position and codebook entry, a heap of its parts
there, keyed by lower minus upper bound (the distance to the second-nearest entry less that to the nearest, as last
scanned) plus the drift that the entry had summed up by then.  A round pops the parts whose key the sum has reached,
scans these exactly and pushes them back; the others can't have changed.  Heaps are kept as ascending arrays, so what a
round pops is one slice.  All that decides is integers; bounds are rounded towards popping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import attach, cut, discard

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a block's vectors at most, which bounds a task's memory; and their largest magnitude, so that sums of
#: squares stay exact in 64 bits.
BLOCK, MOST = 1 << 18, 1 << 28
#: Relative error that bounds are widened by: far above that of doubles.
SLIP = 1e-12


@dataclass
class Codebooks:
    """entries [part, entry, component]; drift: what each entry's slack has lost so far, summed over the rounds."""

    entries: np.ndarray
    drift: np.ndarray
    totals: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, seeds: np.ndarray) -> Codebooks:
        """From seed vectors [entry, dimension]."""
        k, size = len(seeds), seeds.shape[1] // PARTS
        return cls(np.ascontiguousarray(seeds.reshape(k, PARTS, size).transpose(1, 0, 2)), np.zeros((PARTS, k)), np.zeros((PARTS, k, size + 1), np.int64))

    def moved(self, change: np.ndarray) -> Codebooks:
        """With the change of each entry's parts' sum and count; entries without parts stay."""
        totals = self.totals + change
        count = totals[:, :, -1:]
        entries = np.where(count > 0, totals[:, :, :-1] // np.maximum(count, 1), self.entries)
        step = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2))
        most = np.argmax(step, 1)
        others = np.repeat(step.max(1)[:, None], step.shape[1], 1)
        for p in range(PARTS):
            others[p, most[p]] = np.delete(step[p], most[p]).max(initial=0)
        return Codebooks(entries, (self.drift + step + others) * (1 + SLIP), totals)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


@dataclass
class Block:
    """x [part, row, component]; code [part, row]; the heaps of part p's entries, one behind the other in `order` (rows)
    and `key`, entry j from ends[p, j] to ends[p, j + 1]."""

    x: np.ndarray
    code: np.ndarray
    order: np.ndarray
    key: np.ndarray
    ends: np.ndarray

    @classmethod
    def new(cls, vectors: np.ndarray, k: int) -> Block:
        """Nothing is assigned: every part stands in entry 0's heap with a key that any drift has reached."""
        n, d = vectors.shape
        x = np.ascontiguousarray(vectors.reshape(n, PARTS, d // PARTS).transpose(1, 0, 2))
        ends = np.full((PARTS, k + 1), n, np.int64)
        ends[:, 0] = 0
        return cls(x, np.full((PARTS, n), 255, np.uint8), np.tile(np.arange(n, dtype=np.int32), (PARTS, 1)), np.full((PARTS, n), -np.inf), ends)

    def advance(self, books: Codebooks) -> tuple[np.ndarray, int]:
        """Assign every part to its nearest entry; returns the change of sums and counts, and how many parts were popped."""
        k = books.entries.shape[1]
        change, popped = np.zeros_like(books.totals), 0
        for p in range(PARTS):
            ends, order, key, limit = self.ends[p], self.order[p], self.key[p], books.drift[p] * (1 + SLIP) + SLIP
            reach = [int(np.searchsorted(key[ends[j] : ends[j + 1]], limit[j], side="right")) for j in range(k)]
            rows = np.concatenate([order[ends[j] : ends[j] + reach[j]] for j in range(k)])
            if not len(rows):
                continue
            popped += len(rows)
            part = self.x[p][rows]
            gap = ((part[:, None, :] - books.entries[p][None]) ** 2).sum(2)
            best = gap.argmin(1)
            near = np.sqrt(gap[np.arange(len(rows)), best].astype(np.float64))
            gap[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            far = np.sqrt(gap.min(1).astype(np.float64))
            slack = far - near - SLIP * (far + near) + books.drift[p][best]
            old = self.code[p][rows]
            for rows_, codes, sign in ((part[old < k], old[old < k], -1), (part, best, 1)):
                np.add.at(change[p, :, :-1], codes, sign * rows_)
                change[p, :, -1] += sign * np.bincount(codes, minlength=k)
            self.code[p][rows] = best
            by = np.lexsort((rows, slack, best))
            rows, slack, first = rows[by], slack[by], np.searchsorted(best[by], np.arange(k + 1))
            heaps = []
            for j in range(k):
                rest, its = key[ends[j] + reach[j] : ends[j + 1]], order[ends[j] + reach[j] : ends[j + 1]]
                at = np.searchsorted(rest, slack[first[j] : first[j + 1]])
                heaps.append((np.insert(rest, at, slack[first[j] : first[j + 1]]), np.insert(its, at, rows[first[j] : first[j + 1]])))
            self.key[p], self.order[p] = np.concatenate([h[0] for h in heaps]), np.concatenate([h[1] for h in heaps])
            self.ends[p, 1:] = np.cumsum([len(h[0]) for h in heaps])
        return change, popped

    def errors(self, books: Codebooks) -> np.ndarray:
        return sum(((self.x[p] - books.entries[p][self.code[p]]) ** 2).sum(1) for p in range(PARTS))

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(a).tobytes() for a in (self.x, self.code, self.order, self.key, self.ends)]

    @classmethod
    def unpacked(cls, n: int, k: int, x: bytes, code: bytes, order: bytes, key: bytes, ends: bytes) -> Block:
        take = lambda raw, kind, *shape: np.frombuffer(raw, kind).reshape(PARTS, *shape).copy()
        return cls(np.frombuffer(x, np.int64).reshape(PARTS, n, -1), take(code, np.uint8, n), take(order, np.int32, n), take(key, np.float64, n), take(ends, np.int64, k + 1))


def _schema(label: str) -> str:
    return f"ids array<bigint>, labels array<{label}>, x binary, code binary, heap_order binary, heap_key binary, heap_ends binary, change array<bigint>, popped bigint"


_NAMES = ["ids", "labels", "x", "code", "heap_order", "heap_key", "heap_ends", "change", "popped"]


def _row(ids: pa.Array, labels: pa.Array, block: Block, change: np.ndarray, popped: int) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    raw = [pa.array([b], pa.binary()) for b in block.packed()]
    return pa.RecordBatch.from_arrays([one(ids), one(labels), *raw, one(pa.array(change.reshape(-1))), pa.array([popped], pa.int64())], _NAMES)


def _first(kept: DataFrame, books: Codebooks, dimension: int, label: str) -> DataFrame:
    most = max(1, BLOCK // max(1, dimension))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            get = lambda name: table.column(name).combine_chunks() if isinstance(table.column(name), pa.ChunkedArray) else table.column(name)
            vectors = get("v").flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dimension)
            if vectors.size and max(int(vectors.max()), -int(vectors.min())) >= MOST:
                raise ArithmeticError(f"a component is {MOST // SCALE} or more, which squared distances of 64 bits can't hold")
            block = Block.new(vectors, books.entries.shape[1])
            return _row(get("vec_id"), get("label"), block, *block.advance(books))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                yield whole(table.slice(0, most))
                held = table.slice(most).to_batches()
        if sum(b.num_rows for b in held):
            yield whole(pa.Table.from_batches(held))

    return kept.mapInArrow(blocks, _schema(label))


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
            yield ids, labels, Block.unpacked(len(ids), k, *(batch.column(c)[i].as_buffer() for c in _NAMES[2:7]))


def _next(state: DataFrame, books: Codebooks, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, block in _blocks(batches, books.entries.shape[1]):
            yield _row(ids, labels, block, *block.advance(books))

    return state.mapInArrow(run, _schema(label))


def _codes(state: DataFrame, books: Codebooks, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, block in _blocks(batches, books.entries.shape[1]):
            block.advance(books)
            code = np.ascontiguousarray(block.code.T).tobytes().hex()
            width = 2 * PARTS
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([code[i : i + width] for i in range(0, len(code), width)], pa.string()), pa.array(block.errors(books), pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def compress(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks.

    Vectors that are null or hold null or non-finite components take no part.  Each component x becomes
    floor(4096 * x), vectors are cut into 8 equal parts, and each part position has a codebook that starts as that part
    of the 16 smallest vec_ids (of all, where there are fewer; repeated ids by their vectors; null ids last).  A round
    assigns parts to the nearest entry (ties: the lower index) and moves entries to the floored means; entries without
    parts stay.  After the rounds, parts are assigned again.

    Vectors stay in the task that read them: no key is shuffled, so many copies of one vector make no hot task.  Each
    round's blocks are written to the shared folder, and only sums by part and entry leave them; codebooks are all that
    the driver holds.  Rows that repeat an id each get a row and count each.  Vectors of several lengths, or of one
    that 8 doesn't divide, and components of 65536 or more raise.  Empty table: no rows, codebooks without entries.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    label = vectors.schema[label_col].dataType.simpleString()
    kept = vectors.filter(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))
    seeds = np.array([r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()] or np.zeros((0, 0)), np.int64)
    least, most = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), Codebooks.of(seeds)
    if least != most or most % PARTS:
        raise ValueError(f"vectors have {least} to {most} components; they need one length, which {PARTS} divides")
    books = Codebooks.of(seeds)
    state = cut(_first(kept, books, most, label), "blocks-0")
    for r in range(rounds):
        moved = state.select(F.posexplode("change").alias("slot", "x")).groupBy("slot").agg(F.sum("x").alias("x")).toArrow()
        change = np.zeros(books.totals.size, np.int64)
        change[moved.column("slot").to_numpy()] = moved.column("x").to_numpy()
        books = books.moved(change.reshape(books.totals.shape))
        if r + 1 < rounds:
            before, state = state, cut(_next(state, books, label), f"blocks-{r + 1}")
            discard(before)
    out = cut(_codes(state, books, label), "codes")
    discard(state)
    return out, books


def digest(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that takes part (see compress); errors of
    equal labels are summed before rows meet their label's sum, a hot label's dealt over several tasks."""
    codes, books = compress(vectors, **how)
    keyed = codes.withColumn("by", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")))
    sums = keyed.groupBy("by").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = attach(keyed, sums, ["by"], ["vec_id", "code"])
    return met.select("vec_id", "code", "error", F.coalesce("label_error", "error").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))

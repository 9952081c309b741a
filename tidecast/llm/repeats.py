"""Windows of a fixed length that repeat anywhere in a corpus: anchors, segments and spans.

Equal windows choose equal anchors, the gram with the least hash among those inside, so windows only need comparing
with those of the same anchor.  Neighbouring windows of one anchor form a segment.  An anchor that occurs once has no
repeat.  Segments of equal content, told by 128 bits of BLAKE2 over their bytes, are aggregated before anything else
moves: their first stands for them.  The different segments round one anchor go to a kernel that compares their real
bytes or words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidecast.llm.arrow_text import flat, steps
from tidecast.llm.common import attach, cut, discard
from tidecast.llm.rolling import BYTES, mix, prefix, ranges, spaced, words

#: Bits of a sieve at most: 8 MB, whatever the corpus.  A full sieve lets everything through, which costs shuffle only.
SIEVE_BITS = 1 << 26
#: Segments that a kernel task gets about, and the segments of one anchor beyond which its windows are dealt by hash.
SHARD_SEGMENTS, HOT_SEGMENTS = 8_000, 40_000

_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Unit:
    """What a window counts: `length` symbols a window, anchors of `gram` symbols; bytes, or words."""

    length: int
    gram: int
    by_word: bool

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """(symbols, begins, bytes, place) of some texts: 64-bit numbers that propose anchors, where each text's begin,
        and what they are really made of: symbols i to j are bytes[i:j], or words bytes[place[i]:place[j] - 1]."""
        if self.by_word:
            text, of, start, end = words(data, offsets, lower=False)
            raw, place = spaced(text, start, end)
            with np.errstate(over="ignore"):
                symbols = ranges(prefix(BYTES[text]), start, end)
            return symbols, np.searchsorted(of, np.arange(len(offsets))), raw, place
        raw = data[offsets[0] : offsets[-1]]
        return BYTES[raw], offsets - offsets[0], raw, None


def bounds(place: np.ndarray | None, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols first to end begin and end among the bytes."""
    return (first, end) if place is None else (place[first], place[end] - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - span :]) if width > span else m


def segments(symbols: np.ndarray, begins: np.ndarray, unit: Unit) -> dict[str, np.ndarray]:
    """The segments of some texts: text, first and last window start, anchor place and hash.

    Places count from the first symbol of all.
    """
    n, width = len(symbols), unit.length - unit.gram + 1
    none = np.zeros(0, np.int64)
    if n < unit.length:
        return {"text": none, "first": none, "last": none, "anchor": none, "g": np.zeros(0, np.uint64)}
    with np.errstate(over="ignore"):
        sums = prefix(symbols)
        at = np.arange(n - unit.gram + 1)
        gram = ranges(sums, at, at + unit.gram)
        least = sliding_min((gram & _HIGH) | at.astype(np.uint64), width)
        ends = np.repeat(begins[1:], np.diff(begins))
        start = np.flatnonzero(np.arange(n - unit.length + 1) + unit.length <= ends[: n - unit.length + 1])
        anchor = (least[start] & _LOW).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        first = start[head]
        last = start[np.append(head[1:], len(start)) - 1] if len(head) else first
        anchor = anchor[head]
    return {"text": np.searchsorted(begins, first, side="right") - 1, "first": first, "last": last, "anchor": anchor, "g": gram[anchor]}


def names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Two 64-bit columns: 128 bits of BLAKE2 over raw[start:end] and a number, for each range."""
    view = memoryview(np.ascontiguousarray(raw))
    found = [blake2b(view[a:b], digest_size=16, salt=x).digest() for a, b, x in zip(start.tolist(), end.tolist(), map(int.to_bytes, extra.tolist(), [8] * len(extra)))]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


class Sieve:
    """A Bloom filter of bounded size over 64-bit keys: two bits a key."""

    def __init__(self, words64: np.ndarray) -> None:
        self.words, self.mask = words64, np.uint64(len(words64) * 64 - 1)

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int = SIEVE_BITS) -> Sieve:
        """From the column `key`; words of bits are combined on the executors, and the bounded bitmap comes to the driver."""
        n = keys.count()
        bits = 1 << 12
        while bits < 16 * n and bits < most_bits:
            bits *= 2
        place = F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("p")
        table = keys.select(place).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
        return cls(out)

    def has(self, key: np.ndarray) -> np.ndarray:
        key = key.astype(np.uint64)
        a, b = key & self.mask, (key >> np.uint64(32)) & self.mask
        one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
        return ((self.words[(a >> six).astype(np.int64)] >> (a & low)) & (self.words[(b >> six).astype(np.int64)] >> (b & low)) & one).astype(bool)


def place_key(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.uint64)) + first.astype(np.uint64))


def _scan(docs: DataFrame, unit: Unit, schema: str, make: Callable) -> DataFrame:
    """make(segments, doc ids by text, begins, bytes, place) -> arrays of the schema, step by step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in steps(offsets):
                symbols, begins, raw, place = unit.symbols(data, offsets[i : j + 1])
                yield make(segments(symbols, begins, unit), ids[i:j], begins, raw, place)

    return docs.mapInArrow(run, schema)


def _hashes(docs: DataFrame, unit: Unit) -> DataFrame:
    def make(s, ids, *_):
        return pa.RecordBatch.from_arrays([pa.array(np.unique(s["g"]).astype(np.int64)), pa.array(_counts(s["g"]), pa.int32())], ["g", "n"])

    return _scan(docs, unit, "g long, n int", make)


def _counts(g: np.ndarray) -> np.ndarray:
    return np.unique(g, return_counts=True)[1].astype(np.int32)


def _places(docs: DataFrame, unit: Unit, sieve) -> DataFrame:
    """(g, c1, c2, doc_id, first, last): segments whose anchor the sieve lets through; places count within the document.

    c1 and c2 name the content and where its anchor stands in it."""

    def make(s, ids, begins, raw, place):
        keep = sieve.value.has(s["g"])
        first, last, text = s["first"][keep], s["last"][keep], s["text"][keep]
        name = names(raw, *bounds(place, first, last + unit.length), s["anchor"][keep] - first)
        base = begins[text]
        return pa.RecordBatch.from_arrays(
            [pa.array(s["g"][keep].astype(np.int64)), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(ids[text]), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
            ["g", "c1", "c2", "doc_id", "first", "last"],
        )

    return _scan(docs, unit, "g long, c1 long, c2 long, doc_id long, first int, last int", make)


def _contents(docs: DataFrame, unit: Unit, sieve) -> DataFrame:
    """(g, doc_id, first, anchor, content): the real bytes of the segments at places that the sieve lets through."""

    def make(s, ids, begins, raw, place):
        base = begins[s["text"]]
        doc = ids[s["text"]]
        keep = np.flatnonzero(sieve.value.has(place_key(doc, s["first"] - base)))
        first = s["first"][keep]
        a, b = bounds(place, first, s["last"][keep] + unit.length)
        size = b - a
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(a - ends[:-1], size)
        content = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[at]))])
        return pa.RecordBatch.from_arrays(
            [pa.array(s["g"][keep].astype(np.int64)), pa.array(doc[keep]), pa.array((first - base[keep]).astype(np.int32)), pa.array((s["anchor"][keep] - base[keep]).astype(np.int32)), content],
            ["g", "doc_id", "first", "anchor", "content"],
        )

    return _scan(docs, unit, "g long, doc_id long, first int, anchor int, content binary", make)


def _by_window(contents: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, lo, hi) for anchors with too many segments for one task: each window by itself, as equal segments go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("content"))
            for doc, first, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("first").to_pylist(), offsets[:-1], offsets[1:]):
                _, begins, raw, place = unit.symbols(data, np.array([a, b]))
                at = np.arange(int(begins[-1]) - unit.length + 1)
                name = names(raw, *bounds(place, at, at + unit.length), np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(np.full(len(at), doc)), pa.array((at + first).astype(np.int32))], ["c1", "c2", "doc_id", "lo"])

    rows = contents.select("doc_id", "first", "content").mapInArrow(run, "c1 long, c2 long, doc_id long, lo int")
    owner = rows.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "lo")).alias("own"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    late = attach(rows, owner, ["c1", "c2"], ["doc_id", "lo"], "inner").filter(F.struct("doc_id", "lo") != F.col("own"))
    return late.select("doc_id", "lo", (F.col("lo") + unit.length).alias("hi"))


def repeated_spans(docs: DataFrame, unit: Unit, kernel: Callable[[pa.Table, int], tuple], shard_segments: int = SHARD_SEGMENTS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, spans): the symbols of each document that a window covers which also starts earlier.

    docs has doc_id (no nulls) and text.  kernel(table of segments, length) gives (row, place of the window's start
    from the anchor) of each window that another segment of its anchor holds at an earlier (doc_id, place).
    Everything that moves is hashes and places, but for the contents of different segments round one anchor.
    """
    spark = docs.sparkSession
    anchors = _hashes(docs, unit).groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("g").alias("key"))
    anchors = cut(anchors, "anchors")
    sieve = spark.sparkContext.broadcast(Sieve.of(anchors))
    discard(anchors)
    places = cut(_places(docs, unit, sieve), "places")
    firsts = cut(places.groupBy("g", "c1", "c2").agg(F.min(F.struct("doc_id", "first")).alias("own"), F.count(F.lit(1)).alias("n")), "firsts")
    copies = attach(places, firsts.filter("n > 1").select("g", "c1", "c2", "own"), ["g", "c1", "c2"], ["doc_id", "first"], "inner", salts=4).filter(F.struct("doc_id", "first") != F.col("own"))
    whole = copies.select("doc_id", F.col("first").alias("lo"), (F.col("last") + unit.length).alias("hi"))
    several = firsts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    compared = cut(firsts.join(several, "g").select("g", "m", F.col("own.doc_id").alias("doc_id"), F.col("own.first").alias("first")), "compared")
    key = lambda doc, first: pa.array(place_key(doc.to_numpy(), first.to_numpy()).astype(np.int64))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([key(batch.column("doc_id"), batch.column("first"))], ["key"])

    wanted = spark.sparkContext.broadcast(Sieve.of(compared.select("doc_id", "first").mapInArrow(keys, "key long")))
    contents = cut(_contents(docs, unit, wanted), "contents")
    hot = cut(several.filter(F.col("m") > hot_segments).select("g"), "hot")
    shards = max(1, -(-compared.count() // shard_segments))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        row, place = kernel(group, unit.length)
        doc, start = group.column("doc_id").to_numpy()[row], group.column("anchor").to_numpy()[row].astype(np.int64) + place
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + unit.length)
        at = np.flatnonzero(head)
        tail = np.append(at[1:], len(doc)) - 1 if len(at) else at
        return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "lo": pa.array(start[at], pa.int32()), "hi": pa.array(start[tail] + unit.length, pa.int32())})

    usual = contents.join(hot, "g", "left_anti").withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    near = usual.groupBy("shard").applyInArrow(compare, "doc_id long, lo int, hi int")
    # the join with the few hot anchors needs nothing of a shard
    far = _by_window(contents.join(hot, "g", "left_semi"), unit)
    spans = whole.union(near).union(far)
    out = cut(spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(places, firsts, compared, contents, hot)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same symbols as maximal runs in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def sieved(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with _may: false for rows whose id the table ids (doc_id) certainly lacks."""
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(ids.select(F.xxhash64("doc_id").alias("key"))))

    @F.arrow_udf(BooleanType())
    def may(key: pa.Array) -> pa.Array:
        return pa.array(sieve.value.has(key.to_numpy()))

    return docs.withColumn("_may", may(F.xxhash64(F.col(id_col).cast("long"))))


def with_spans(docs: DataFrame, spans: DataFrame, schema: str, apply: Callable) -> DataFrame:
    """apply(doc_id, bytes of the text, merged spans) -> a row of schema, for every row of docs.

    Documents that a sieve of the ids with spans keeps out are done where they are; only the others' texts are moved.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            found = batch.column("spans").to_pylist()
            rows = [apply(d, data[offsets[k] : offsets[k + 1]], merged([(x["lo"], x["hi"]) for x in found[k] or ()])) for k, d in enumerate(batch.column("doc_id").to_pylist())]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = kinds or [pa.string() if part.split()[1] == "string" else pa.int64() for part in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names)

    marked = sieved(docs, spans)
    still = marked.filter(~F.col("_may")).select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"))
    moved = marked.filter("_may").select("doc_id", "text").join(spans, "doc_id", "left")
    return still.mapInArrow(run, schema).union(moved.mapInArrow(run, schema))

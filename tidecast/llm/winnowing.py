"""Benchmark decontamination by winnowing: fingerprints that every long enough shared span must share, joined and extended.

A window of `length` words keeps the least hash of the grams inside it as its fingerprint.  Equal windows keep equal
fingerprints, so a span of `length` words that a document shares with a benchmark item is always found; what a
fingerprint proposes is then extended to its windows, whose real words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.arrow_text import flat, steps
from tidecast.llm.common import attach, cut, free_name
from tidecast.llm.repeats import Sieve, sliding_min
from tidecast.llm.rolling import ASCII_LOWER, BYTES, prefix, ranges

#: Words of a window and of the grams whose least hash is its fingerprint.
LENGTH, GRAM = 10, 5
#: Windows of a run at most: longer runs are cut, so that a run's text isn't copied for thousands of windows.
RUN = 64
#: The bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text; every byte of other code points is 0x80 or more.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_RUNS = "array<struct<start:int,length:int,prints:array<bigint>,words:string>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("prints", pa.list_(pa.int64())), ("words", pa.string())]))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place, begins) of texts data[offsets[i]:offsets[i + 1]]: words i to j are bytes[place[i]:place[j] - 1], a
    space between, and text k has the words begins[k] to begins[k + 1]."""
    base = offsets[0]
    text = ASCII_LOWER[data[base : offsets[-1]]]
    if not len(text):
        return text, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    solid = IN_WORD[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - base] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    place = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.full(place[-1], 32, np.uint8)
    chars = text[solid]
    out[np.arange(len(chars)) + np.repeat(np.arange(len(start)), end - start)] = chars
    return out, place, np.searchsorted(start, offsets - base)


def fingerprints(sums: np.ndarray, length: int, whole: int, gram: int) -> np.ndarray:
    """The fingerprint of the window of `length` words at each place: the least hash of its grams.

    Windows shorter than `whole` are items of fewer words, which have no gram to choose: the window is its own."""
    gram = length if length < whole else min(gram, length)
    at = np.arange(max(0, len(sums) - gram))
    hashes = ranges(sums, at, at + gram)
    width = length - gram + 1
    return sliding_min(hashes, width) if len(hashes) >= width else hashes[:0]


def runs(data: np.ndarray, offsets: np.ndarray, lengths: Sequence[int], whole: int, gram: int, known) -> tuple[np.ndarray, list[list[dict]]]:
    """(words, runs) of each text; a run is neighbouring windows of one length whose fingerprints are known.

    known(fingerprints) says which; None takes all windows of `whole` words, or of shorter texts the only one.
    """
    raw, place, begins = tokens(data, offsets)
    size = np.diff(begins)
    out: list[list[dict]] = [[] for _ in size]
    with np.errstate(over="ignore"):
        sums = prefix(ranges(prefix(BYTES[raw]), place[:-1], place[1:] - 1)) if len(place) > 1 else np.zeros(1, np.uint64)
        for length in lengths:
            print_ = fingerprints(sums, length, whole, gram)
            of = np.repeat(np.arange(len(size)), size)[: len(print_)]
            fits = np.arange(len(print_)) + length <= begins[of + 1]
            if known is None:
                fits &= (length == whole) | (size[of] == length)
                at = np.flatnonzero(fits)
            else:
                at = np.flatnonzero(fits)
                at = at[known(print_[at])]
            if not len(at):
                continue
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
            first = np.flatnonzero(head)
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            first = np.flatnonzero(rank % RUN == 0)
            for a, b in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
                lo, hi = int(at[a]), int(at[b - 1]) + length
                k = int(of[lo])
                text = raw[place[lo] : place[hi] - 1].tobytes().decode("utf-8", "replace")
                out[k].append({"start": lo - int(begins[k]), "length": length, "prints": print_[at[a:b]].view(np.int64).tolist(), "words": text})
    return size, out


def scanned(rows: DataFrame, lengths: Sequence[int], whole: int, gram: int, sieve=None) -> DataFrame:
    """rows (id, key, text) with n_words and runs in place of text; sieve: the broadcast fingerprints to look for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sieve.value.has if sieve is not None else None
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in steps(offsets):
                size, found = runs(data, offsets[i : j + 1], lengths, whole, gram, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[i:j], batch.column("key")[i:j], pa.array(size, pa.int64()), pa.array(found, _FOUND)], ["id", "key", "n_words", "runs"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "key", "text").mapInArrow(run, f"id {kind}, key string, n_words long, runs {_RUNS}")


def windows(table: DataFrame, *keep: str) -> DataFrame:
    """(keep, start, length, print, window) of the windows of a scanned table's runs."""
    run = table.select(*keep, F.explode("runs").alias("r")).select(*keep, "r.start", "r.length", "r.prints", F.split("r.words", " ").alias("w"))
    each = run.select(*keep, "start", "length", "w", F.posexplode("prints").alias("k", "print"))
    return each.select(*keep, (F.col("start") + F.col("k")).alias("start"), "length", "print", F.array_join(F.slice("w", F.col("k") + 1, F.col("length")), " ").alias("window"))


def row_key(id_col: str, text_col: str) -> Column:
    """The same for rows of one id and text only."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def _named(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    return df.select(F.col(id_col).cast(kind).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def shared(
    docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, key, n_words, n_hit, spans, items) for every row of docs: the maximal runs of words inside occurrences of a
    benchmark window, and the items, sorted as strings, whose windows occur.

    A window is `length` consecutive words of an item; an item of fewer, but not none, is one window.  Words are
    letters a-z, digits and code points from U+0080, A-Z lower-cased.  Fingerprints of the benchmark's windows become a
    sieve of bounded size; the documents' windows that pass it move, with their words, to be joined with the
    benchmark's on fingerprint and words, a hot window's dealt over several tasks.  Documents with the same windows
    share one list of items, so a passage that many documents and many items hold doesn't make pairs of them.

    Null or empty text: no words.  Null ids of documents get their rows as well; items of null id make hits but aren't
    named.  Rows that repeat an id are judged each by its own text; an item_id with several texts has the windows of all.
    Texts are handled whole.  Empty benchmark: no hits.  Empty docs: no rows.
    """
    spark = docs.sparkSession
    items = cut(windows(scanned(_named(benchmark, item_col, item_text_col, "string"), range(1, length + 1), length, gram), "id"), "item-windows")
    known = cut(items.select("length", "print", "window").distinct(), "known-windows")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())
    sieve = spark.sparkContext.broadcast(Sieve.of(known.select(F.col("print").alias("key")).distinct()))
    rows = cut(scanned(_named(docs, id_col, text_col, docs.schema[id_col].dataType.simpleString()), lengths, length, gram, sieve), "scanned")
    maybe = F.size("runs") > 0
    met = windows(rows.filter(maybe).dropDuplicates(["key"]), "key")
    met = attach(met, known.drop("length"), ["print", "window"], ["key", "start"], "inner", salts=4)
    met = met.select("key", F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi"), F.md5("window").alias("w"))
    places = Window.partitionBy("key").orderBy("lo", "hi")
    reach = F.max("hi").over(places.rowsBetween(Window.unboundedPreceding, -1))
    isles = met.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("isle", F.sum("new").over(places.rowsBetween(Window.unboundedPreceding, 0)))
    isles = isles.groupBy("key", "isle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("w").alias("w"))
    hits = cut(
        isles.groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w")).withColumn("same", F.md5(F.array_join("w", ""))),
        "hits",
    )
    holders = items.filter("id is not null").select(F.md5("window").alias("w"), "id").distinct()
    lists = hits.groupBy("same").agg(F.first("w").alias("w")).select("same", F.explode("w").alias("w")).join(holders, "w").groupBy("same").agg(F.sort_array(F.collect_set("id")).alias("items"))
    told = attach(hits.select("key", "n_hit", "spans", "same"), lists, ["same"], ["key"], "left").select("key", "n_hit", "spans", "items")
    nothing = (F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast(told.schema["spans"].dataType).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    few = rows.filter(maybe).select("id", "key", "n_words").join(told, "key", "left")
    out = few.select("id", "key", "n_words", "n_hit", "spans", "items").unionByName(rows.filter(~maybe).select("id", "key", "n_words", *nothing))
    none = lambda c, kind: F.coalesce(F.col(c), F.expr("array()").cast(kind)).alias(c)
    return out.select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("spans", told.schema["spans"].dataType), none("items", "array<string>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs' rows, every column as it was, without those that hold a window of the benchmark (see shared)."""
    bad = shared(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter("n_hit > 0").select("key").distinct()
    key = free_name("_row_key", docs.columns)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(bad.withColumnRenamed("key", key), key, "left_anti").select(docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (see shared)."""
    found = shared(docs, benchmark, **how)
    return found.select(
        F.col("id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

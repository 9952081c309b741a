"""Substring dedup over words by backward search in a compressed FM-index of each shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.arrow_text import flat
from tidecast.llm.repeats import Unit, repeated_spans, with_spans
from tidecast.llm.rolling import numbered, words

LENGTH, GRAM = 20, 6


class Wavelet:
    """A wavelet matrix: bits packed 64 to a word, with the count of ones before each word."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels = []
        self.depth = max(1, int(alphabet - 1).bit_length())
        now = symbols.astype(np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1]
            zeros = int(len(now) - bit.sum())
            self.levels.append((level, packed, ones.astype(np.int32), zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray, base: np.ndarray) -> np.ndarray:
        """How often symbol occurs before `upto`; base is start_of(symbol)."""
        at = upto
        for level, packed, ones, zeros in self.levels:
            word = at >> 6
            one = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + one, at - one)
        return at - base

    def start_of(self, symbols: np.ndarray) -> np.ndarray:
        """Where the run of each symbol begins below the last level."""
        return self.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))


class FMIndex:
    """Backward search over a text of numbers; sorted by `depth` symbols at least, which intervals of patterns no longer need."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        alphabet = int(text.max()) + 1
        self.order = suffix_order(text, depth)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.wavelet = Wavelet(text[self.order - 1], alphabet)
        self.starts = self.wavelet.start_of(np.arange(alphabet))
        self.size = len(text)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of pattern."""
        n = len(symbol)
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]), np.tile(self.starts[symbol], 2))
        base = self.counts[symbol]
        return base + both[:n], base + both[n:]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes (cyclic) in order of their first `depth` symbols, by doubling."""
    rank, have = text.astype(np.int64), 1
    n = len(text)
    while have < depth:
        pair = rank * (int(rank.max()) + 1) + np.roll(rank, -have)
        _, rank = np.unique(pair, return_inverse=True)
        have *= 2
        if int(rank.max()) == n - 1:
            break
    return np.argsort(rank, kind="stable")


def matching(index: FMIndex, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, lo) for each end: how far the words before it match another place too, `most` at most, and that interval."""
    length, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), index.size)
    live = np.arange(len(ends))
    for k in range(most):
        a, b = index.step(text[ends[live] - 1 - k], lo[live], hi[live])
        found = b - a >= 2
        live = live[found]
        lo[live], hi[live] = a[found], b[found]
        length[live] = k + 1
        if not len(live):
            break
    return length, lo


def late_windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place from the anchor) of the windows that the shard also holds at an earlier (doc_id, place).

    The shard's segments, numbered by their real words, a separator after each, are one text with one FM-index.  Every window streams through
    backward search, which stops as soon as its words stand nowhere else; those that match `length` words share
    their interval with their equals, of which the earliest is no repeat.
    """
    n = table.num_rows
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    data, offsets = flat(table.column("content"))
    raw, of, start, end = words(data, offsets, lower=False)
    size = np.bincount(of, minlength=n)
    symbol, _ = numbered(raw, start, end)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(begin[-1], np.int64)
    place = np.arange(len(symbol)) + np.repeat(np.arange(n), size)
    text[place] = symbol + 1
    windows = size - length + 1
    row = np.repeat(np.arange(n), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    index = FMIndex(text, length)
    reach, interval = matching(index, text, begin[row] + offset + length, length)
    hit = np.flatnonzero(reach == length)
    row, offset, interval = row[hit], offset[hit], interval[hit]
    doc, first = table.column("doc_id").to_numpy()[row], table.column("first").to_numpy().astype(np.int64)[row] + offset
    order = np.lexsort((first, doc, interval))
    late = np.ones(len(order), bool)
    late[:1] = False
    late[1:] = interval[order][1:] == interval[order][:-1]
    # the same place seen twice is no earlier one
    own = np.maximum.accumulate(np.where(late, 0, np.arange(len(order))))
    d, f = doc[order], first[order]
    late &= (d != d[own]) | (f != f[own])
    got = order[late]
    return row[got], first[got] - table.column("anchor").to_numpy().astype(np.int64)[row[got]]


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, spans): word ranges covered by windows of `length` words that start earlier too; docs has doc_id, text."""
    return repeated_spans(docs.filter("doc_id is not null"), Unit(length, gram, True), late_windows, **limits)


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    A word goes where a window of `length` words covers it whose words also start at a smaller doc_id, or earlier in
    the same document; windows are judged on the input.  Null text or none but white space has 0 words.  Rows that
    share an id count as one document, place by place.  Rows of null id lose nothing and make nobody lose anything.
    Empty table: no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def apply(doc: int, text: np.ndarray, runs: list[tuple[int, int]]) -> tuple:
        _, _, start, end = words(text, np.array([0, len(text)]), lower=False)
        keep = np.ones(len(start), bool)
        for lo, hi in runs:
            keep[lo:hi] = False
        raw = text.tobytes()
        kept = b" ".join([raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())])
        return doc, len(start), int(len(start) - keep.sum()), hashlib.sha256(kept).hexdigest()

    return with_spans(plain, spans(plain, length, gram, **limits), "doc_id long, n_words long, n_removed long, kept_sha256 string", apply)

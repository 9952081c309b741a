"""Substring dedup over bytes by column-wise construction of the suffix order of many texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.repeats import Unit, repeated_spans, with_spans

LENGTH, GRAM = 100, 32


def late_windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the windows that another row of the same g has at the same column and at an earlier place.

    Rows are aligned by their anchors: equal windows stand in one column.  Each round inserts one symbol of every row,
    from the last column to the first, as a collection's Burrows-Wheeler transform is built: the order of suffixes at a
    column is the next column's order sorted stably by the inserted symbols, which in that order are the transform's
    column.  The common prefix of two neighbours is one more than the least between them a column before, or nothing
    where g or the symbols differ.  Runs of neighbours that share `length` symbols are equal windows.
    """
    n = table.num_rows
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    content = table.column("content").combine_chunks() if isinstance(table.column("content"), pa.ChunkedArray) else table.column("content")
    if isinstance(content, pa.ChunkedArray):
        content = content.chunk(0)
    content = content.cast(pa.large_binary())
    offsets = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + n + 1]
    data = np.frombuffer(content.buffers()[2], np.uint8)
    _, group = np.unique(table.column("g").to_numpy(), return_inverse=True)
    doc, anchor = table.column("doc_id").to_numpy(), table.column("anchor").to_numpy().astype(np.int64)
    # repeated rows stand at the same place: equal ranks, so that neither is earlier than the other
    by_place = np.lexsort((anchor, doc))
    new_place = np.ones(n, bool)
    new_place[1:] = (doc[by_place][1:] != doc[by_place][:-1]) | (anchor[by_place][1:] != anchor[by_place][:-1])
    rank = np.empty(n, np.int64)
    rank[by_place] = np.cumsum(new_place)
    begin = table.column("first").to_numpy().astype(np.int64) - anchor
    size = np.diff(offsets)
    end = begin + size
    at = offsets[:-1] - begin
    by_end = np.argsort(-end, kind="stable")
    by_end = by_end[np.lexsort((group[by_end], -end[by_end]))]
    ends = -end[by_end]
    rows_out, columns_out = [], []
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for column in range(int(end.max()) - 1, int(begin.min()) - 1, -1):
        lo, hi = np.searchsorted(ends, [-column - 1, -column])
        fresh = by_end[lo:hi]
        # a row that has run out to the left leaves; its common prefix passes to the row after it
        stays = begin[order] <= column
        if not stays.all():
            common = _without(common, stays)
            order = order[stays]
        before = np.concatenate([fresh, order])
        prior = np.concatenate([np.zeros(len(fresh), np.int64), common])
        if len(fresh) and len(order):
            prior[len(fresh)] = 0
        transform = data[at[before] + column]
        key = group[before] * 256 + transform
        new = np.argsort(key, kind="stable")
        sorted_key = key[new]
        same = np.zeros(len(new), bool)
        same[1:] = sorted_key[1:] == sorted_key[:-1]
        here = np.flatnonzero(same)
        common = np.zeros(len(new), np.int64)
        if len(here):
            bounds = np.empty(2 * len(here), np.int64)
            bounds[0::2], bounds[1::2] = new[here - 1] + 1, new[here] + 1
            common[here] = np.minimum.reduceat(np.append(prior, 0), bounds)[0::2] + 1
        order = before[new]
        run = common >= length
        if run.any():
            head = np.flatnonzero(~run)
            least = np.minimum.reduceat(rank[order], head)
            late = rank[order] > np.repeat(least, np.diff(np.append(head, len(order))))
            hit = order[late]
            rows_out.append(hit)
            columns_out.append(np.full(len(hit), column))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(columns_out)


def _without(common: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """The common prefixes of neighbours once the others have left: the least over those between."""
    left = np.flatnonzero(stays)
    if not len(left):
        return common[:0]
    out = np.minimum.reduceat(np.append(common, 0), np.append(0, left + 1))[:-1]
    out[0] = 0
    return out


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, spans): byte ranges covered by strings of `length` bytes that start earlier too; docs has doc_id, text."""
    return repeated_spans(docs.filter("doc_id is not null"), Unit(length, gram, False), late_windows, **limits)


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes where a string of `length` bytes covers it that also starts at a smaller doc_id, or earlier in the same
    document; strings are judged on the input.  Null or empty text has 0 bytes.  Rows that share an id count as one
    document, place by place: none of them is earlier than the other.  Rows of null id lose nothing and make nobody
    lose anything.  Empty table: no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def apply(doc: int, text: np.ndarray, runs: list[tuple[int, int]]) -> tuple:
        keep = np.ones(len(text), bool)
        for lo, hi in runs:
            keep[lo:hi] = False
        kept = text[keep] if runs else text
        return doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept.tobytes()).hexdigest()

    return with_spans(plain, spans(plain, length, gram, **limits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", apply)

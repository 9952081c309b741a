"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.arrow_text import STEP, flat, steps
from tidecast.llm.common import aside, attach, cut, discard
from tidecast.llm.components import components
from tidecast.llm.repeats import sieved
from tidecast.llm.rolling import digests, mix, numbered, shingles, words

#: BANDS bands of ROWS values: two sets of similarity 0.8 share no band with probability (1 - 0.8**5)**40 = 1.2e-7.
BANDS, ROWS = 40, 5
SHINGLE, SIMILARITY = 5, 80
#: Shingles that a vectorised step takes at once.
CHUNK = 1 << 14
#: Members or hubs that meet at once, pairs that a task verifies about, and shared elements that a step counts at once.
SLICE, MEETINGS, POSTINGS = 256, 2048, 1 << 21
#: Copies of a hub's text that one task makes.
WAVE = 256

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def hashed_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's set as sorted 64-bit hashes of its distinct shingles, and 128 bits that name the whole set.

    Words are lower-cased A-Z; a text of fewer than `size` words has one shingle of them all, one without words none.
    Shingles are told apart by their real words; a hash has 128 bits, of which the first half goes into signatures.
    """
    text, of, start, end = words(data, offsets, lower=True)
    number, values = numbered(text, start, end)
    texts = len(offsets) - 1
    doc, _, at = shingles(of, number, texts, size)
    lanes = np.concatenate([digests(values), np.full((1, 2), _GOLDEN)])
    number = np.append(number, np.full(size, len(values)))
    last = np.searchsorted(of, np.arange(1, texts + 1))[doc]
    hashed = np.full((len(at), 2), np.uint64(size))
    for k in range(size):
        hashed = mix(hashed * np.uint64(0xD6E8FEB86659FD93) + lanes[np.where(at + k < last, number[at + k], len(values))])
    hashed = hashed[np.lexsort((hashed[:, 0], doc))]
    ends = np.searchsorted(doc, np.arange(texts + 1))
    first = np.ascontiguousarray(hashed[:, 0])
    return [first[a:b] for a, b in zip(ends[:-1], ends[1:])], [blake2b(hashed[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]


def signatures(sets: list[np.ndarray], width: int) -> np.ndarray:
    """SuperMinHash: a row of `width` values for each set, infinite for an empty one.

    In round j an element draws a rank j + r, r in [0, 1), and the next place of its own random permutation, a step of
    Fisher-Yates.  Places are drawn without repeats, which is what lowers the variance, and a set's elements stop once
    j exceeds the whole part of its largest value, as none can lower it then.  Sets go in order of size, so that rounds
    which only small sets need touch few elements.
    """
    out = np.full((len(sets), width), np.inf)
    order = np.argsort([len(s) for s in sets], kind="stable")
    if not len(sets):
        return out
    element = np.concatenate([sets[i] for i in order])
    owner = np.repeat(order, [len(sets[i]) for i in order])
    places = np.arange(width, dtype=np.uint16)
    with np.errstate(over="ignore"):
        for s in range(0, len(element), CHUNK):
            e, d = element[s : s + CHUNK], owner[s : s + CHUNK]
            permutation = np.tile(places, (len(e), 1))
            live = np.arange(len(e))
            for j in range(width):
                drawn = mix(e[live] + np.uint64(j + 1) * _GOLDEN)
                k = j + (mix(drawn ^ _GOLDEN) % np.uint64(width - j)).astype(np.int64)
                place = permutation[live, k]
                permutation[live, k] = permutation[live, j]
                permutation[live, j] = place
                np.minimum.at(out.reshape(-1), d[live] * width + place, j + (drawn >> np.uint64(11)) * 2.0**-53)
                whose = np.unique(d[live])
                most = np.full(len(sets), -1.0)
                most[whose] = out[whose].max(1)
                live = live[most[d[live]] >= j + 1]
                if not len(live):
                    break
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands have keys of their own."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
        for r in range(rows):
            key = mix(key * np.uint64(0xE7037ED1A0B428DB) + bits[:, :, r])
    return key


def fingerprints(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands): set size, 128 bits that name the set, band keys; docs has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in steps(offsets):
                with np.errstate(over="ignore"):
                    sets, names = hashed_sets(data, offsets[i : j + 1], size)
                    keys = band_keys(signatures(sets, bands * rows), bands, rows).astype(np.int64)
                name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                n = np.array([len(s) for s in sets], np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), keys], ["doc_id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<bigint>")


def exact_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, ends, bound): the texts' sets of shingles, numbered by their real words; set i is keys[ends[i]:ends[i + 1]] less i * bound."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text, of, start, end = words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=True)
    number, _ = numbered(text, start, end)
    doc, shingle, _ = shingles(of, number, len(texts), size)
    _, shingle = np.unique(shingle, return_inverse=True)
    bound = int(shingle.max()) + 1 if len(shingle) else 1
    return doc * bound + shingle, np.searchsorted(doc, np.arange(len(texts) + 1)), bound


def similar(texts: list[bytes], a: np.ndarray, b: np.ndarray, size: int, similarity: int) -> np.ndarray:
    """Whether the texts a[i] and b[i] are similar to `similarity` hundredths or more, counted on their real words."""
    keys, ends, bound = exact_sets(texts, size)
    n = np.diff(ends)
    ask = np.repeat(np.arange(len(a)), n[a])
    at = np.arange(len(ask)) - np.repeat(np.cumsum(n[a]) - n[a], n[a]) + np.repeat(ends[a], n[a])
    key = keys[at] + (b[ask] - a[ask]) * bound
    place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    both = np.bincount(ask[keys[place] == key], minlength=len(a)) if len(ask) else np.zeros(len(a), np.int64)
    return (n[a] > 0) & (n[b] > 0) & (100 * both >= similarity * (n[a] + n[b] - both))


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs (a, hub) of documents that are similar to `similarity` hundredths or more, compared by their real words.

    A hub's members are dealt over slices of SLICE or so, and the hub's text goes once to each, in waves; slices share
    tasks of about MEETINGS pairs.  So a hub of any number of members is no hot key, and a text moves once for each of its hubs.
    """
    count = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("_n"))
    hubs = cut(count.select("hub", F.ceil(F.col("_n") / SLICE).cast("int").alias("slices")), "slices", narrow=True)
    shards = max(1, -(-pairs.count() // MEETINGS))
    shard = F.pmod(F.xxhash64("hub", "slice"), F.lit(shards)).cast("int").alias("shard")
    sliced = attach(pairs, hubs.filter("slices > 1"), ["hub"], ["a"]).withColumn("slice", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1))).cast("int"))
    members = sliced.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select(shard, "hub", "slice", "a", F.lit(False).alias("is_hub"), "text")
    # a hub's text fans out after it is met, WAVE copies a task: neither the join nor one task makes all of them
    waves = F.sequence(F.lit(0), F.floor((F.col("slices") - 1) / WAVE).cast("int"))
    centres = hubs.join(texts.select(F.col("doc_id").alias("hub"), "text"), "hub").select("hub", "slices", F.explode(waves).alias("wave"), "text")
    few, many = centres.filter(F.col("slices") <= WAVE), centres.filter(F.col("slices") > WAVE).repartition("hub", "wave")
    within = F.sequence(F.col("wave") * WAVE, F.least(F.col("slices"), (F.col("wave") + 1) * WAVE) - 1)
    centres = few.unionByName(many).select("hub", F.explode(within).alias("slice"), "text")
    rows = members.union(centres.select(shard, "hub", "slice", F.col("hub").alias("a"), F.lit(True).alias("is_hub"), "text"))

    def meet(group: pa.Table) -> pa.Table:
        hub, part, doc, centre = (group.column(c).to_numpy() for c in ("hub", "slice", "a", "is_hub"))
        data, offsets = flat(group.column("text"))
        links_a, links_b = [], []
        held, ids, a, b, places, had = [], [], [], [], [], 0

        def hold(r: int) -> int:
            held.append(data[offsets[r] : offsets[r + 1]].tobytes())
            ids.append(doc[r])
            return len(held) - 1

        def compare() -> None:
            yes = similar(held, np.array(a, np.int64), np.array(b, np.int64), size, similarity) if a else np.zeros(0, bool)
            links_a.extend(ids[x] for x, ok in zip(a, yes) if ok)
            links_b.extend(ids[x] for x, ok in zip(b, yes) if ok)
            for rows_ in (held, ids, a, b, places):
                rows_.clear()

        # a slice's hub comes first, in several rows where its id has several; steps hold about STEP bytes
        now, own = None, []
        for r in np.lexsort((~centre, part, hub)).tolist():
            if (hub[r], part[r]) != now:
                now, own = (hub[r], part[r]), []
                places.clear()
            if centre[r]:
                own.append(r)
                places.append(hold(r))
            else:
                if had > STEP:
                    compare()
                    had = 0
                    places.extend([hold(c) for c in own])
                m = hold(r)
                a.extend([m] * len(places))
                b.extend(places)
            had += int(offsets[r + 1] - offsets[r])
        compare()
        return pa.table({"a": pa.array(links_a, pa.int64()), "b": pa.array(links_b, pa.int64())})

    return rows.groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def group(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked where their sets of `size`-word shingles are similar to `similarity` hundredths or more;
    component_id is the smallest doc_id that links lead to, itself included.

    Equal sets, told by 128 bits of BLAKE2 over 128 bits of each shingle, are one class from the start, by partial
    aggregation, so copies make no pairs.  All other links are compared on the texts' real words.  In each band bucket
    every class is compared with the bucket's hub, its smallest id; where this leaves a bucket in several components,
    settle() compares more hubs.  So no link between candidates that would join components is lost, a group of any
    size makes pairs in proportion to it, and no bucket is gathered in one task.

    Null text or none but white space: no shingles, linked with nothing.  Rows that share an id are one document: their
    links are its links.  Rows of null id link with nothing: component_id null, kept false.  Empty table: no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(plain, size, bands, rows), "prints")
    real = prints.filter("n > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_count")).filter("_count > 1").drop("_count")
    labelled = cut(attach(prints, classes, ["d1", "d2", "n"], ["doc_id"]).withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).select("doc_id", "n", "class_id", "bands"), "classes")
    discard(prints)
    # an id of several rows, with different texts, joins their classes
    shared = labelled.filter("n > 0 and class_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    reps = labelled.filter("n > 0 and doc_id = class_id").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")).distinct()
    buckets = reps.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("_count")).filter("_count > 1").drop("_count")
    members = cut(attach(reps, buckets, ["key"], ["rep"], "inner"), "members")
    pairs = cut(members.filter("rep <> hub").select(F.col("rep").alias("a"), "hub").distinct(), "pairs")
    wanted = cut(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted", narrow=True)
    texts = cut(sieved(plain, wanted).filter("_may").select("doc_id", "text"), "texts")
    edges = cut(verified(pairs, texts, size, similarity), "edges", narrow=True)
    edges = settle(edges, members.select("key", "rep"), texts, size, similarity)
    roots = cut(components(cut(edges.union(several_classes(shared, labelled)), "edges", narrow=True)), "roots", narrow=True)
    discard(members, pairs, wanted, texts)
    final = attach(labelled, roots.select(F.col("node").alias("class_id"), "root"), ["class_id"], ["doc_id"])
    component = F.when(F.col("n") > 0, F.coalesce("root", "class_id")).otherwise(F.col("doc_id"))
    return final.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def links(hubs: list[np.ndarray], sets: list[np.ndarray], similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """(hub, set) indices of the pairs similar to `similarity` hundredths or more, counted by the hubs' postings."""
    none = np.zeros(0, np.int64)
    if not hubs or not sets:
        return none, none
    n_hubs, n_sets = np.array([len(h) for h in hubs]), np.array([len(s) for s in sets])
    element, hub = np.concatenate(hubs), np.repeat(np.arange(len(hubs)), n_hubs)
    order = np.argsort(element, kind="stable")
    element, hub = element[order], hub[order]
    out_h, out_s, s = [], [], 0
    while s < len(sets):
        e = s + 1
        while e < len(sets) and n_sets[s : e + 1].sum() * len(hubs) <= POSTINGS:
            e += 1
        mine, of = np.concatenate(sets[s:e]), np.repeat(np.arange(e - s), n_sets[s:e])
        lo, hi = np.searchsorted(element, mine), np.searchsorted(element, mine, side="right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(np.repeat(of, n) * len(hubs) + hub[at], minlength=(e - s) * len(hubs)).reshape(e - s, len(hubs))
        i, j = np.nonzero(100 * both >= similarity * (n_sets[s:e, None] + n_hubs[None, :] - both))
        out_h.append(j)
        out_s.append(i + s)
        s = e
    return np.concatenate(out_h), np.concatenate(out_s)


def settle(edges: DataFrame, members: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """edges with the links that are still needed to join what belongs together in buckets of several components.

    members is (key, rep).  Buckets in more than one component form clusters, by the representatives they share.  In
    each round a cluster's hubs, members of its smallest components, meet all its members: texts are dealt in slices
    of SLICE members and blocks of SLICE hubs, a task numbers their words, counts all intersections from postings and
    returns only links.  A hub that has met all is done; a cluster is done when those left are of one component.  The hubs of a
    round double, so rounds are few, and no task holds more than a slice and a block.
    """
    roots = cut(components(edges), "roots", narrow=True)
    placed = cut(members.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "placed", narrow=True)
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("rep").alias("hub")).filter("lo < hi").select("key", "hub")
    opened = cut(attach(placed, split, ["key"], ["rep"], "inner"), "open", narrow=True)
    if opened.isEmpty():
        return edges
    clusters = cut(components(cut(opened.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "near", narrow=True)), "clusters", narrow=True)
    left = cut(clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).join(opened.select("rep", "root").distinct(), "rep"), "left", narrow=True)
    own = cut(texts.join(left.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text"), "own")
    hubs = SLICE
    while True:
        sizes = left.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
        whole = sizes.groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        whole = cut(whole.select("cluster", F.col("most.root").alias("largest"), F.ceil(F.col("size") / SLICE).cast("int").alias("slices")), "whole", narrow=True)
        if whole.isEmpty():
            return edges
        small = sizes.join(whole, "cluster").filter("root <> largest").select("cluster", "root", "n")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy("n", "root", "rep"))
        chosen = cut(left.join(small, ["cluster", "root"]).withColumn("r", rank).filter(F.col("r") <= hubs).select("cluster", "rep", F.floor((F.col("r") - 1) / SLICE).cast("int").alias("block")), "hubs", narrow=True)
        blocks = chosen.groupBy("cluster").agg(F.max("block").alias("blocks"))
        here = attach(left, whole.join(blocks, "cluster").select("cluster", "slices", "blocks"), ["cluster"], ["rep"], "inner")
        rows = here.join(own, "rep").select("cluster", F.pmod(F.xxhash64("rep"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("block"), "rep", "text")
        asked = chosen.join(own.toDF("rep", "theirs"), "rep").join(whole.select("cluster", "slices"), "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "block", "rep", "theirs")
        asked = asked.toDF(*(f"_{c}" for c in asked.columns))

        def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            a, b = theirs.column("_rep").to_numpy(), mine.column("rep").to_numpy()
            both = []
            for column in (theirs.column("_theirs"), mine.column("text")):
                data, offsets = flat(column)
                both += [data[p:q].tobytes() for p, q in zip(offsets[:-1], offsets[1:])]
            keys, ends, bound = exact_sets(both, size)
            sets = [keys[p:q] - k * bound for k, (p, q) in enumerate(zip(ends[:-1], ends[1:]))]
            h, s = links(sets[: len(a)], sets[len(a) :], similarity)
            a, b = a[h] if len(h) else a[:0], b[s] if len(s) else b[:0]
            return pa.table({"a": pa.array(np.maximum(a, b)[a != b], pa.int64()), "b": pa.array(np.minimum(a, b)[a != b], pa.int64())})

        keys = ("cluster", "slice", "block")
        edges = cut(edges.union(rows.groupBy(*keys).cogroup(asked.groupBy(*(f"_{k}" for k in keys))).applyInArrow(meet, "a long, b long").distinct()), "edges", narrow=True)
        roots = cut(components(edges), "roots", narrow=True)
        left = cut(left.select("cluster", "rep").join(chosen.select("cluster", "rep"), ["cluster", "rep"], "left_anti").join(roots, F.col("rep") == F.col("node"), "left").select("cluster", "rep", F.coalesce("root", "rep").alias("root")), "left", narrow=True)
        hubs *= 2


def several_classes(shared: DataFrame, labelled: DataFrame) -> DataFrame:
    """Edges between the classes of one id that has rows in several."""
    own = labelled.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("a")).filter("a <> b")
    return shared.join(own.select(F.col("doc_id").alias("a")), "a", "left_semi").union(own.select("doc_id", "a")).union(own.select("doc_id", "b")).toDF("a", "b")


def digest(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return group(docs, size, id_col=id_col, text_col=text_col)


def representatives(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns as they were, without the rows of documents that another of their group stands for."""
    lost = cut(group(docs, size, id_col=id_col, text_col=text_col).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"), "lost")
    # texts of ids that are certainly kept stay where they are
    docs, back = aside(docs, id_col, text_col)
    marked = sieved(docs, lost, id_col)
    moved = marked.filter("_may").join(lost.select(F.col("doc_id").alias("_lost")), F.col(id_col).cast("long") == F.col("_lost"), "left_anti")
    return back(marked.filter(~F.col("_may")).union(moved).drop("_may"))

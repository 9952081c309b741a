"""The layout of packing against a plain search of all bins, and its independence of files and partitions."""

import random

from pyspark.sql import functions as F

from tidecast.llm import packing

SCHEMA = "doc_id long, text string, source string, cluster string"


def plain(pieces, capacity, per_source):
    """(doc, bin, offset) by looking at every bin for each piece; ties go to the bin that came to its residual first."""
    bins, clock, out = [], 0, []
    for need, source, cluster, doc in pieces:
        fits = [b for b in bins if b["left"] >= need and cluster not in b["clusters"] and b["sources"].count(source) < per_source]
        best = min(fits, key=lambda b: (b["left"], b["since"]), default=None)
        if best is None:
            best = {"left": capacity, "clusters": set(), "sources": [], "id": len(bins)}
            bins.append(best)
        out.append((doc, best["id"], capacity - best["left"]))
        best["left"] -= need
        best["clusters"].add(cluster)
        best["sources"].append(source)
        best["since"] = clock = clock + 1
    return out


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        capacity, per_source = rng.randint(5, 40), rng.randint(1, 3)
        rows = [(k, rng.randint(1, capacity - 1), rng.randint(0, 4), rng.randint(0, 30)) for k in range(rng.randint(1, 80))]
        first_of, clusters = {}, {}
        numbered = [(n, first_of.setdefault(s, len(first_of)), clusters.setdefault(c, len(clusters)), k) for k, n, s, c in rows]
        pieces = sorted(numbered, key=lambda x: (-x[0], x[2], x[1]))
        got = [(doc, b, at) for doc, _, _, _, b, at in packing.pack_shard(rows, capacity, per_source)]
        assert got == plain(pieces, capacity, per_source)


def test_layout_depends_on_rows_alone(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 90))), f"s{rng.randint(0, 5)}", f"c{rng.randint(0, 200)}") for i in range(400)]
    rows += [rows[7]] * 30 + [(None, "a b c", None, None)] * 20 + [(5, None, "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    layouts = []
    for parts, cluster in ((1, None), (7, None), (3, "cluster"), (5, "cluster")):
        out = packing.pack(df.orderBy(F.rand(parts)).repartition(parts), capacity=64, shard_rows=100, cluster_col=cluster).collect()
        assert len(out) >= len(rows)
        layouts.append(sorted(map(repr, out)))
    assert layouts[0] == layouts[1] and layouts[2] == layouts[3]

"""Secret scans of very long candidates and of very many matches, in time linear in both."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidecast.llm import secrets

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def peak(text, window=20):
    best = 0.0
    for k in range(len(text) - window + 1):
        part = text[k : k + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def test_entropy_of_every_shape(spark):
    rng = random.Random(6)
    strings = ["".join(rng.choice(SYMBOLS[:n]) for _ in range(size)) for n in (1, 2, 5, 16, 66) for size in (20, 21, 40, 77)] + ["a" * 30 + "b" * 30, "ab" * 25, SYMBOLS]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.peak_entropy(F.col("s")).alias("e")).collect()
    for r in got:
        assert r.e == pytest.approx(peak(r.s), abs=1e-9), r.s
    assert spark.createDataFrame([("short",)], "s string").select(secrets.peak_entropy(F.col("s")).alias("e")).first().e is None


def test_running_sums_over_many_blocks(spark):
    rng = random.Random(7)
    lists = [[rng.randint(-5, 50) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(v,) for v in lists], "v array<bigint>")
    for r in df.select("v", secrets.running(F.col("v"), lambda a, b: a + b).alias("sums"), secrets.running(F.col("v"), F.greatest).alias("most")).collect():
        assert list(r.sums) == [sum(r.v[: k + 1]) for k in range(len(r.v))]
        assert list(r.most) == [max(0, *r.v[: k + 1]) for k in range(len(r.v))]


def test_candidates_apart_from_spans(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        cuts = sorted(rng.sample(range(200), 24))
        candidates = [(a, 3, b, f"c{a}") for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((candidates, [(a, rng.randint(0, 2), a + rng.randint(1, 9)) for a in rng.sample(range(200), rng.randint(0, 8))]))
    df = spark.createDataFrame(rows, "c array<struct<start:int,kind:int,end:int,match:string>>, s array<struct<start:int,kind:int,end:int>>")
    for r in df.select("c", "s", secrets.apart(F.col("c"), F.col("s")).alias("out")).collect():
        assert list(r.out) == [c for c in r.c if not any(s[0] < c[2] and c[0] < s[2] for s in r.s)]


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(9)
    blob = "".join(rng.choice(SYMBOLS) for _ in range(1 << 20))
    lines = [f"token = {rng.getrandbits(60):015x}zz" if k % 3 else f"{rng.getrandbits(160):040x}" for k in range(12_000)]
    many = "\n".join(lines)
    df = spark.createDataFrame([(1, blob), (2, many)], "doc_id long, text string")
    secrets.digest(df.limit(0)).collect()
    start = time.time()
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    took = time.time() - start
    assert got[1].spans == f"entropy:0:{len(blob)}"
    want = [(m.start(), "assign", m.end()) for m in re.finditer(r"token = [0-9a-z]+", many)] + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]{32,}", many)]
    text = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want))
    assert (got[2].n_assign, got[2].n_hex, got[2].base_sha256) == (8000, 4000, hashlib.sha256(text.encode()).hexdigest())
    assert took < 60, took

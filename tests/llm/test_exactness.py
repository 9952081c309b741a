"""Words made to have equal hashes, single tokens of many bytes, and texts longer than a step, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidecast.llm import fm_index, suffix_array, superminhash
from tidecast.llm.arrow_text import STEP
from tidecast.llm.rolling import digests, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.fixture(scope="module")
def twisted(spark):
    """Two documents whose words differ in every letter, though sums over powers of any odd base are equal."""
    other = [chr(99 + k) for k in range(21)]
    left = [thue_morse(2048, "a", b) for b in other]
    right = [thue_morse(2048, b, "a") for b in other]
    return spark.createDataFrame([(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(left[:20] + ["end"]))], SCHEMA)


def test_words_of_equal_sums_are_no_repeats(twisted):
    got = {r.doc_id: r.n_removed for r in fm_index.digest(twisted).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_words_of_equal_sums_make_no_links(twisted):
    got = {r.doc_id: r.component_id for r in superminhash.digest(twisted, 2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = [word() for _ in range(110_000)]
    token = "".join(rng.choice("abcdefghijkl") for _ in range(STEP + 5000))
    changed = list(prose)
    for k in range(0, len(changed), 40):
        changed[k] = word()
    return {1: " ".join(prose), 2: token + " " + " ".join(prose[500:560]), 3: " ".join(changed), 4: token[:3000] + "x" + token, 5: None, 6: " ".join(prose[:4000])}


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    assert len(long_texts[1]) > STEP
    return spark.createDataFrame(list(long_texts.items()), SCHEMA).repartition(2)


def covered(seqs, length):
    seen, out = set(), {}
    for i, s in sorted(seqs.items()):
        keep = np.ones(len(s), bool)
        for k in range(len(s) - length + 1):
            window = hash(s[k : k + length])
            if window in seen:
                keep[k : k + length] = False
            seen.add(window)
        out[i] = keep
    return out


def test_long_bytes(long_docs, long_texts):
    seqs = {i: (t or "").encode() for i, t in long_texts.items()}
    got = {r.doc_id: r for r in suffix_array.digest(long_docs).collect()}
    for i, keep in covered(seqs, 100).items():
        kept = np.frombuffer(seqs[i], np.uint8)[keep].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(seqs[i]), len(seqs[i]) - len(kept), hashlib.sha256(kept).hexdigest())


def test_long_words(long_docs, long_texts):
    seqs = {i: tuple(WORDS.findall(t or "")) for i, t in long_texts.items()}
    got = {r.doc_id: r for r in fm_index.digest(long_docs).collect()}
    for i, keep in covered(seqs, 20).items():
        kept = " ".join(w for w, k in zip(seqs[i], keep) if k)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(seqs[i]), int((~keep).sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_long_sets(long_docs, long_texts):
    sets = {i: {tuple(w[k : k + 2]) for k in range(max(len(w) - 1, min(len(w), 1)))} for i, w in ((i, WORDS.findall(t or "")) for i, t in long_texts.items())}
    assert 0.8 <= len(sets[1] & sets[3]) / len(sets[1] | sets[3]) < 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.digest(long_docs, 2).collect()}
    assert got == {i: (len(s), 1 if i == 3 else i) for i, s in sets.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_shingles_are_told_apart_by_their_words(size):
    rng = np.random.default_rng(size)
    lengths = [0, 1, 2, 3, 4, 5, 40, 200, 0]
    of = np.repeat(np.arange(len(lengths)), lengths)
    word = rng.integers(0, 4, len(of))
    text, number, at = shingles(of, word, len(lengths), size)
    got, ends, names = {}, np.cumsum(lengths), {}
    for t, s, a in zip(text.tolist(), number.tolist(), at.tolist()):
        real = tuple(word[a : min(a + size, ends[t])])
        assert names.setdefault(s, real) == real
        got.setdefault(t, []).append(real)
    for t, n in enumerate(lengths):
        w = tuple(word[ends[t] - n : ends[t]])
        want = {w[k : k + size] for k in range(n - size + 1)} or ({w} if n else set())
        assert len(got.get(t, [])) == len(want) and set(got.get(t, [])) == want


def test_names_of_words_differ():
    rng = random.Random(3)
    values = sorted({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 24))) for _ in range(20_000)})
    lanes = digests(pa.array(values, pa.binary()).slice(1))
    assert len({tuple(x) for x in lanes.tolist()}) == len(values) - 1
    assert len(np.unique(lanes[:, 0])) == len(values) - 1
    again = digests(pa.array(values[::-1], pa.binary()))[::-1]
    assert (again[1:] == lanes).all() and digests(pa.array([], pa.binary())).shape == (0, 2)


@pytest.mark.parametrize("slice_, wave", [(2, 1), (3, 2), (256, 256)])
def test_a_hubs_text_reaches_every_slice_in_waves(spark, monkeypatch, slice_, wave):
    monkeypatch.setattr(superminhash, "SLICE", slice_)
    monkeypatch.setattr(superminhash, "WAVE", wave)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(30)] + [(100 + i, f"alone {i} " * 3) for i in range(5)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 30)] + [(100 + i, 0) for i in range(5)] + [(2, 1)], "a long, hub long")
    got = {(r.a, r.b) for r in superminhash.verified(pairs, texts, 2, 80).collect()}
    assert got == {(i, 0) for i in range(1, 30)} | {(2, 1)}

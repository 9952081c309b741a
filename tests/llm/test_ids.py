"""Rows of null id and repeated rows: every operator returns a row for each and gives what its docstring states."""

import hashlib
import random
from collections import Counter

import pytest

from tidecast.llm import exact_dedup, language_id, line_dedup, packing, secrets, suffix_array, superminhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long"
TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, TEXT), (4, TEXT), (4, TEXT), (9, TEXT + " thirteen"), (7, None), (7, None), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA)


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_one_row_for_each_row(docs):
    given = ids(docs.select("doc_id").collect())
    for out in (exact_dedup.dedup(docs), secrets.digest(docs), line_dedup.digest(docs), superminhash.digest(docs), language_id.digest(docs)):
        assert ids(out.select("doc_id").collect()) == given


def test_near_duplicates_of_null_and_repeated_ids(docs):
    got = superminhash.digest(docs, 5).collect()
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(4, 4, True), (9, 4, False), (7, 7, True)}
    left = superminhash.representatives(docs, 5)
    assert left.columns == docs.columns and ids(left.select("doc_id").collect()) == Counter({None: 2, 4: 2, 7: 2})


def test_packing_places_every_repeated_row(docs):
    got = packing.pack(docs).collect()
    assert ids(got) == ids(docs.select("doc_id").collect())
    assert sum(r.n_tokens for r in got) == 12 * 3 + 13 and sum(r.bin_id is None for r in got) == 3


@pytest.mark.parametrize("limits", [{}, {"shard_segments": 2, "hot_segments": 1}])
def test_byte_repeats_of_repeated_ids(spark, limits):
    """Repeated rows whose anchors also stand in other surroundings, before and after them: none loses to itself."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, early = prose(400), prose(300)
    texts = {3: prose(50) + passage + prose(80), 5: prose(90) + passage + prose(30) + early, 2: early + prose(70), 9: prose(150)}
    rows = [(i, t) for i, t in texts.items() for _ in range(1 if i == 2 else 3)]
    first: dict[str, tuple[int, int]] = {}
    for i, t in sorted(texts.items()):
        for k in range(len(t) - 99):
            first.setdefault(t[k : k + 100], (i, k))
    want = Counter()
    for i, t in rows:
        gone = {j for k in range(len(t) - 99) if first[t[k : k + 100]] != (i, k) for j in range(k, k + 100)}
        kept = "".join(c for j, c in enumerate(t) if j not in gone)
        want[i, len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = suffix_array.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == want
    assert {r.doc_id for r in got if r.n_removed} == {5}

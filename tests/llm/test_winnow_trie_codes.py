"""Operators 11 to 13 against plain searches, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidecast.llm import heap_lloyd, prefix_trie, winnowing

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
EXTRA = ", key string, id int, print long, window string, runs int, w string, same int, words string, parent string, jumps int, slot int, v int, x int, code int"
MORE = ("k", 1, 2, "w", 3, "w", 4, "w", "p", 5, 6, 7, 8, 9)
words_of = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def benchmark():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abé9ß") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = prose(14)
    items = [(0, None), (1, ""), (2, " ?! "), (3, "one Rare"), (4, "rare"), (5, " ".join(prose(9))), (6, " ".join(prose(10))), (7, " ".join(prose(40)))]
    items += [(k, " ".join([*prose(3), *common, *prose(5)])) for k in range(8, 20)] + [(9, " ".join(prose(12))), (8, items[7][1]), (None, " ".join(prose(11)))]
    texts: dict[int | None, str | None] = {0: None, 1: "", 2: "?!", 3: "x ONE, rare-thing", 4: "rare"}
    for i in range(5, 60):
        item = words_of(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(item) - 1))
        texts[i] = "-".join([*prose(rng.randint(0, 30)), *item[a : a + rng.randint(1, 25)], *prose(rng.randint(0, 30))]).upper()
    texts[60] = ", ".join(items[7][1].split() * 40)
    texts[61] = " ".join(prose(20000) + items[6][1].split() + prose(20000))
    texts[62] = "a\x00b" + items[6][1].replace(" ", "\n")
    return items, texts


def found_by_search(items, text):
    w = words_of(text)
    hit, ids = set(), set()
    for i, t in items:
        b = words_of(t)
        m = min(10, len(b))
        if not m:
            continue
        known = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)}
        at = [k for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in known]
        hit.update(p for k in at for p in range(k, k + m))
        if at and i is not None:
            ids.add(str(i))
    return len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def test_winnowing_finds_what_a_search_finds(spark):
    items, texts = benchmark()
    rows = [(i, t, *MORE) for i, t in texts.items()] + [(7, texts[7], *MORE), (7, texts[8], *MORE), (None, texts[9], *MORE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)
    bench = spark.createDataFrame([(i, t, *MORE) for i, t in items], "item_id long, text string" + EXTRA)
    got = sorted((tuple(r) for r in winnowing.digest(docs, bench).collect()), key=repr)
    assert got == sorted(((r[0], *found_by_search(items, r[1])) for r in rows), key=repr)
    clean = winnowing.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(repr(r[:2]) for r in clean.collect()) == sorted(repr(r[:2]) for r in rows if not found_by_search(items, r[1])[4])


def test_winnowing_spans_are_maximal_runs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h x e f g h i")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "b c d e"), ("r", "e f g h i")], "item_id string, text string")
    (row,) = winnowing.shared(docs, bench, length=4, gram=2).collect()
    assert [tuple(s) for s in row.spans] == [(1, 8), (9, 14)] and row.items == ["q", "r"]


def test_winnowing_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert winnowing.digest(docs.filter("false"), bench).collect() == []
    assert [tuple(r) for r in winnowing.digest(docs, bench.filter("false")).collect()] == [(1, 2, 0, 0, sha(""), False)]


def conversations():
    rng = random.Random(9)
    say = [("user", "hi"), ("user", "hello 𝄞"), ("assistant", ""), (None, "hi"), ("user", None), ("assistant", "né")]
    out = []
    for c in [*range(0, 40), 100, 105, 199, 250, 299, 1000, 1001, -5, -100, -101]:
        for t in range(rng.choice([1, 1, 2, 3, 3, 5, 8])):
            out.append((c, rng.choice([t, t, None]), *rng.choice(say)))
    out += [(7, t, "user", f"turn {t % 3}") for t in range(300)] + [(8, t, "user", f"turn {t % 3}") for t in range(280)]
    out += [(300 + k, 1, "user", "the same") for k in range(60)]
    return out + out[:5] + [(None, 1, "user", "nobody")]


def trie_by_search(rows):
    own: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [s[2:] for s in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = [*own.get(base, [])[:h], *own[c][h:]]
    members: dict[tuple, list[int]] = {}
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members.setdefault(tuple(seqs[c][:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    ends = lambda n: ",".join(str(c) for c in members[n] if len(seqs[c]) == len(n))
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], sha(ends(n))) for n, m in members.items()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"held": 3, "fan": 2}])
def test_trie_is_that_of_a_plain_walk(spark, limits):
    rows = conversations()
    table = spark.createDataFrame([(*r, *MORE) for r in rows], "conv_id long, turn long, role string, text string" + EXTRA).repartition(5)
    assert sorted((tuple(r) for r in prefix_trie.digest(table, **limits).collect()), key=repr) == trie_by_search(rows)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def codes_by_search(rows):
    kept = sorted(((i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 8
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda j: (gap(part(v, p), books[p][j]), j))
    for _ in range(6):
        codes = [[nearest(v, p) for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for j in range(len(books[p])):
                its = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == j]
                if its:
                    books[p][j] = [sum(x) // len(its) for x in zip(*its)]
    told, by_label = [], {}
    for i, v, lab in kept:
        c = [nearest(v, p) for p in range(8)]
        e = sum(gap(part(v, p), books[p][c[p]]) for p in range(8))
        told.append((i, "".join(f"{x:02x}" for x in c), e, lab))
        by_label[lab] = by_label.get(lab, 0) + e
    h = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((i, c, e, by_label[lab], h) for i, c, e, lab in told), key=repr)


def vectors(n):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=16) * rng.choice([0.01, 1, 30]), 3)], [None, 1, 2][int(i) % 3]) for i in rng.permutation(n)]
    rows += [(5000 + k, rows[0][1], 7) for k in range(n // 2)] + [(3, rows[-1][1], 1), (3, rows[-1][1], 1), (None, rows[0][1], None)]
    rows += [(9001, None, 1), (9002, [None] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] * 16, None)]
    return rows


@pytest.mark.parametrize("n, block", [(2, 1 << 18), (9, 1 << 18), (400, 1 << 18), (400, 16 * 50)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, n, block):
    monkeypatch.setattr(heap_lloyd, "BLOCK", block)
    rows = vectors(n)
    table = spark.createDataFrame([(*r, *MORE) for r in rows], "vec_id long, embedding array<double>, label int" + EXTRA).repartition(3)
    assert sorted((tuple(r) for r in heap_lloyd.digest(table).collect()), key=repr) == codes_by_search(rows)


def test_rounds_scan_only_what_drift_reached():
    rng = np.random.default_rng(1)
    centres = rng.integers(-40000, 40000, (16, 64))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-200, 200, (2000, 64))
    books, block = heap_lloyd.Codebooks.of(x[:16]), heap_lloyd.Block.new(x, 16)
    popped = []
    for _ in range(6):
        change, n = block.advance(books)
        books = books.moved(change)
        popped.append(n)
        for p in range(8):
            gap = ((block.x[p][:, None, :] - books.entries[p][None]) ** 2).sum(2)
            assert all(np.all(np.diff(block.key[p][a:b]) >= 0) for a, b in zip(block.ends[p][:-1], block.ends[p][1:]))
        block_now = heap_lloyd.Block.unpacked(2000, 16, *block.packed())
        block_now.advance(books)
        assert all((block_now.code[p] == ((block.x[p][:, None, :] - books.entries[p][None]) ** 2).sum(2).argmin(1)).all() for p in range(8))
    assert popped[0] == 16000 and popped[-1] < 1600


def test_vectors_that_cannot_be_cut_raise(spark):
    table = lambda *v: spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        heap_lloyd.digest(table([1.0] * 8, [1.0] * 16))
    with pytest.raises(ValueError):
        heap_lloyd.digest(table([1.0] * 9))
    assert heap_lloyd.digest(table(None)).collect() == []
    assert [r.code for r in heap_lloyd.digest(table([1.0] * 8)).collect()] == ["00" * 8]


def test_new_operators_on_the_smallest_tables(spark):
    from tidecast.llm import queries

    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op11_winnowing", "op12_prefix_trie", "op13_heap_lloyd"):
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        said = db.execute(queries.oracle_sql()[name])
        names = [x[0] for x in said.description]
        assert sorted(names) == columns and got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in said.fetchall()), name

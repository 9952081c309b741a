"""Each operator against brute force, over a fixture of nulls, empty texts, ties, repeats and clashing extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import exact_dedup, fm_index, language_id, line_dedup, mixing, multi_index, packing, secrets, suffix_array, superminhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, _t string, first int, slice int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def corpus() -> dict[int, str | None]:
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß𝄞") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), "A Common Line of text"
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n\t ", 3: "x", 4: "word", 5: "two words"}
    for i in range(6, 40):
        texts[i] = prose(rng.randint(3, 120))
    for i in range(40, 50):
        texts[i] = prose(20) + "\n" + line + "  \n" + passage + " " + prose(15)
    base = prose(90).split()
    for i in range(50, 70):
        changed = list(base)
        for _ in range(rng.randint(0, 12)):
            changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
        texts[i] = " ".join(changed)
    for i in range(70, 78):
        texts[i] = "SAME text " + passage if i % 2 else "same Text " + passage
    texts[78] = prose(3000)
    texts[79] = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password:short AKIAABCDEFGHIJKL99 token=token: abcdefgh12 aZ3kQ9xPm2Lr8TvWc5Yb0Nd7'
    texts[80] = "abc" * 200
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", 1, 5, "k", "t", 1, 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_dedup(docs, none, texts):
    got = by_id(exact_dedup.dedup(docs))
    for i, t in texts.items():
        same = [j for j, u in texts.items() if lower(u) == lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), sha(lower(t)))
    assert exact_dedup.dedup(none).collect() == []


def test_chunks_are_whole_texts(spark, texts):
    df = spark.createDataFrame([(t or "",) for t in texts.values()], "t string")
    for r in df.select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t


def secrets_base(t):
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_secrets(docs, none, texts):
    got = by_id(secrets.digest(docs))
    for i, t in texts.items():
        base = [f"{k}:{a}:{b}" for a, k, b in secrets_base(t or "")]
        assert got[i].base_sha256 == sha(",".join(base)) and set(base) <= set(filter(None, got[i].spans.split(",")))
    assert "entropy:" in got[79].spans
    assert secrets.digest(none).collect() == []


def test_entropy_is_the_windows_largest(spark):
    rng = random.Random(2)
    strings = ["".join(rng.choice("abcdef0123456789ABC") for _ in range(n)) for n in (20, 21, 35, 60)]
    entropy = lambda w: -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w))
    for r in spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.peak_entropy(F.col("s")).alias("e")).collect():
        assert abs(r.e - max(entropy(r.s[k : k + 20]) for k in range(len(r.s) - 19))) < 1e-9


def repeats(seqs, length):
    seen, out = set(), {}
    for i, s in sorted(seqs.items()):
        keep = [True] * len(s)
        for k in range(len(s) - length + 1):
            if s[k : k + length] in seen:
                keep[k : k + length] = [False] * length
            seen.add(s[k : k + length])
        out[i] = keep
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_segments": 20, "hot_segments": 3}])
def test_byte_repeats(docs, none, texts, limits):
    seqs = {i: (t or "").encode() for i, t in texts.items()}
    got = by_id(suffix_array.digest(docs, **limits))
    for i, keep in repeats(seqs, 100).items():
        kept = bytes(c for c, k in zip(seqs[i], keep) if k)
        runs = sum(not k and (j == 0 or keep[j - 1]) for j, k in enumerate(keep))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(seqs[i]), len(seqs[i]) - len(kept), runs, sha(kept))
    if not limits:
        assert suffix_array.digest(none).collect() == []


@pytest.mark.parametrize("limits", [{}, {"shard_segments": 20, "hot_segments": 3}])
def test_word_repeats(docs, none, texts, limits):
    seqs = {i: tuple(WORDS.findall(t or "")) for i, t in texts.items()}
    got = by_id(fm_index.digest(docs, **limits))
    for i, keep in repeats(seqs, 20).items():
        kept = [c for c, k in zip(seqs[i], keep) if k]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(seqs[i]), len(seqs[i]) - len(kept), sha(" ".join(kept)))
    if not limits:
        assert fm_index.digest(none).collect() == []


def near_groups(texts, size):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    got = by_id(superminhash.digest(docs, size))
    for i, (n, component) in near_groups(texts, size).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, i == component)


def test_near_duplicates_of_nothing(none):
    assert superminhash.digest(none).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    with np.errstate(over="ignore"):
        got = superminhash.signatures([np.sort(pool[:200]), np.sort(pool[50:250]), pool[:1]], 200)
    assert abs((got[0] == got[1]).mean() - 150 / 250) < 0.12 and np.isfinite(got).all()


def test_links_count_intersections():
    a, b, c = (np.array(x, np.int64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [7, 8]))
    h, s = superminhash.links([a], [b, c, a], 80)
    assert sorted(zip(h.tolist(), s.tolist())) == [(0, 0), (0, 2)]


def test_line_dedup(docs, none, texts):
    blank = " \t\n\x0b\x0c\r"
    keyed = {i: [(ln, lower(ln.strip(blank))) for ln in (t or "").split("\n")] for i, t in texts.items()}
    holders = {}
    for i, lines in keyed.items():
        for _, k in lines:
            if len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    got = by_id(line_dedup.digest(docs))
    for i, lines in keyed.items():
        kept = [ln for ln, k in lines if len(holders.get(k, ())) < 2 or min(holders[k]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert line_dedup.digest(none).collect() == []
    assert line_dedup.dedup(docs).columns == docs.columns


def test_line_bitmaps_past_one_word(spark):
    lines = [f"line number {k} of many" for k in range(200)]
    df = spark.createDataFrame([(1, "\n".join(lines[::2])), (2, "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got[1] == "\n".join(lines[::2]) and got[2] == "\n".join(lines[1::2])


def test_mixture_spends_its_budget(docs, none, texts):
    rows = mixing.mix(docs, {"lang": {"en": 3}}, (1, 2), 3, 1).select("doc_id", "_tokens", "_take_tokens", "_epoch").collect()
    words = sum(len(WORDS.findall(t or "")) for t in texts.values())
    assert 0.95 * words / 2 <= sum(r._take_tokens for r in rows) <= words / 2
    assert all(0 <= r._take_tokens <= r._tokens and 0 <= r._epoch < 3 for r in rows)
    assert mixing.mix(none, {}).collect() == []


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "a", "s", 10), ("d", "b", "s", 1000), ("e", "a", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, F.lit(400).cast("long"), {}, 1).collect()}
    assert got == {("d", "a"): 10, ("d", "b"): 190, ("e", "a"): 200}


def test_packing(docs, none, texts):
    rows = packing.pack(docs, capacity=128, shard_rows=40).collect()
    words = {i: len(WORDS.findall(t or "")) for i, t in texts.items()}
    for i, n in words.items():
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == n
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    source = {i: None if i % 7 == 0 else i % 3 for i in texts}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_tokens for r in held) <= 128
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(held, held[1:]))
        keys = [lower((texts[r.doc_id] or "").strip()) for r in held]
        assert len(set(keys)) == len(keys)
        assert max(sum(source[r.doc_id] == s for r in held) for s in {source[r.doc_id] for r in held}) <= 2
    assert packing.pack(none).collect() == []


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10, 2)
    assert bins.fit(6, 0, 0) == (0, 0) and bins.fit(7, 1, 1) == (1, 0)
    assert bins.fit(3, 2, 2) == (1, 7)
    assert bins.fit(3, 2, 0) == (2, 0)


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    x[40:60] = x[40]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (220, [0.0] * 6), (240, [float("nan")] * 6), (260, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in range(0, 120, 20):
        s = np.einsum("d,nd->n", x[q], x)
        want = [i for i in np.lexsort((np.arange(120), -s)) if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want and np.allclose([r.score for r in mine], s[want], atol=1e-12)
    assert {r.query_id for r in got} == set(range(0, 120, 20))
    assert multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    books, q = (rng.normal(size=(5, 3)), rng.normal(size=(4, 3))), rng.normal(size=6)
    order = multi_index.visits(q, books, {c: 1 for c in range(20)}, 20)
    score = [books[0][c // 4] @ q[:3] + books[1][c % 4] @ q[3:] for c in order]
    assert sorted(order) == list(range(20)) and score == sorted(score, reverse=True)


def test_language(spark):
    rng = random.Random(3)
    sounds = {"aa": "kapitolu", "bb": "wrzeszcy", "cc": "ñandéüx"}
    rows = [(i, " ".join("".join(rng.choice(sounds[g]) for _ in range(5)) for _ in range(30)), g, "s", 1) for i, g in enumerate(sorted(sounds) * 60)]
    rows += [(1000, None, "aa", "s", 1), (1001, "123 456", "aa", "s", 1), (1002, "kapitolu", None, "s", 1)]
    got = by_id(language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    held = [r for r in rows[:180] if got[r[0]].held_out]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_nothing(none):
    assert language_id.digest(none).collect() == []


def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, None).cache()
        assert now.columns == docs.columns, name
        if name == "language id":
            assert {r.doc_id for r in now.collect()} == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
        if name == "near dedup":
            ids = [r.doc_id for r in now.collect()]
            assert len(ids) == len(set(ids)) < len(texts)
    assert corpus_pipeline.pack_sequences(spark, now, None).count() > 0


def test_language_sample_is_the_lowest_by_hash(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidecast.llm import language_id

    rows = spark.range(3000).selectExpr("if(id % 7 = 0, 'rare', 'common') as lang", "if(id % 5 = 0, 12, if(id % 11 = 0, null, id)) as doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    for most in (1, 40, 1500):
        want = rows.withColumn("r", rank).filter(F.col("r") <= most).select("lang", "doc_id", "r")
        assert sorted(map(str, language_id.lowest(rows, most).collect())) == sorted(map(str, want.collect()))
    assert language_id.lowest(rows.limit(0), 5).count() == 0


def test_documents_with_letters_stay_where_no_language_is_known(docs, texts):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    left = language_id.accepted(unlabelled)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}


def test_pipeline_mixture_ends_at_the_budget(spark, docs):
    import corpus_pipeline

    plan = mixing.mix(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.FRACTION, corpus_pipeline.EPOCHS, corpus_pipeline.SEED).select("doc_id", "text", "n_chars", "_tokens", "_take_tokens").collect()
    assert any(0 < r._take_tokens < r._tokens for r in plan)
    want = []
    for r in plan:
        cut = r._take_tokens < r._tokens
        text = r.text[: list(WORDS.finditer(r.text))[r._take_tokens - 1].end()] if cut else r.text
        want.append((r.doc_id, text, len(text) if cut else r.n_chars))
    got = [(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.mix_sources(spark, docs, None).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_first_words_keeps_white_space(spark):
    rows = [(" a\tb\n\nc \x0b", 2, " a\tb"), ("x " * 30000, 29999, ("x " * 29999)[:-1]), ("é\u00a0ß ü", 1, "é\u00a0ß")]
    for r in spark.createDataFrame(rows, "t string, n long, want string").select("want", mixing.first_words(F.col("t"), F.col("n")).alias("got")).collect():
        assert r.got == r.want

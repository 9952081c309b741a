"""Budgets and prefixes of the mixture against brute force over random trees, weights of 0 included."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidecast.llm import mixing


def shared(budget, children):
    """children: (name, cap, weight) -> name: tokens; those that fill up leave what they can't take to the others."""
    order = sorted((c for c in children if c[2]), key=lambda c: (c[1] / c[2], c[0]))
    out, left = {}, budget
    while order:
        level = [c for c in order if c[1] * sum(x[2] for x in order) <= c[2] * left]
        if not level:
            total = sum(x[2] for x in order)
            given = {c[0]: c[2] * left // total for c in order}
            for c in order[: left - sum(given.values())]:
                given[c[0]] += 1
            return out | given
        name, cap, _ = level[0]
        out[name] = cap
        left -= cap
        order.remove(level[0])
    return out


def brute(leaves, total, weights, epochs):
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    live = {k: n * epochs for k, n in leaves.items() if weight("domain", k[0]) and weight("lang", k[1]) and weight("source", k[2])}
    out = {}
    domains = shared(total, [(d, sum(c for k, c in live.items() if k[0] == d), weight("domain", d)) for d in {k[0] for k in live}])
    for d, got in domains.items():
        langs = shared(got, [(g, sum(c for k, c in live.items() if k[:2] == (d, g)), weight("lang", g)) for g in {k[1] for k in live if k[0] == d}])
        for g, has in langs.items():
            sources = shared(has, [(k[2], c, weight("source", k[2])) for k, c in live.items() if k[:2] == (d, g)])
            out |= {(d, g, s): n for s, n in sources.items()}
    return out


def test_a_weight_of_nothing_leaves_its_tokens_to_the_others(spark):
    leaves = spark.createDataFrame([("d", "a", "s", 100), ("d", "z", "s", 1000), ("e", "a", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, F.lit(800).cast("long"), {"lang": {"z": 0}}, 1).collect()}
    assert got == {("d", "a"): 100, ("e", "a"): 700}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_of_random_trees(spark, seed):
    rng = random.Random(seed)
    leaves = {(rng.choice("abc"), rng.choice("xyz"), rng.choice("pqrs")): rng.randint(0, 500) for _ in range(25)}
    weights = {"domain": {"a": rng.randint(0, 3), "b": 2}, "lang": {"x": rng.randint(0, 5), "z": 7}, "source": {"p": 0, "q": 3}}
    epochs, total = rng.randint(1, 3), rng.randint(0, 3 * sum(leaves.values()))
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, F.lit(total).cast("long"), weights, epochs).collect()}
    want = brute(leaves, total, weights, epochs)
    assert got == want
    room = sum(n * epochs for k, n in leaves.items() if k in want)
    assert sum(got.values()) == min(total, room)


@pytest.mark.parametrize(("broadcast", "rows"), [(50_000, 100_000), (0, 1)])
def test_prefixes_of_seeded_epochs(spark, monkeypatch, broadcast, rows):
    """Every copy taken, and how much of it, with leaves broadcast or not and the crossing bucket cut once or to the end."""
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", broadcast)
    monkeypatch.setattr(mixing.boundaries, "__defaults__", (rows,))
    rng = random.Random(4)
    docs = [(i if i % 11 else None, " ".join("w" for _ in range(rng.randint(0, 30))) or None, rng.choice(["en", "de", None]), f"s{rng.randint(0, 9)}") for i in range(300)]
    docs += [docs[5]] * 3
    weights, fraction, epochs, seed = {"domain": {"web": 5, "code": 0}, "lang": {"en": 3}}, (3, 2), 3, 21
    words = lambda d: len((d[1] or "").split())
    domain = lambda d: "web" if d[3][-1] in "0123" else "books" if d[3][-1] in "4567" else "code"
    leaf = lambda d: (domain(d), d[2] or "(none)", d[3])
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    leaves = {}
    for d in docs:
        leaves[leaf(d)] = leaves.get(leaf(d), 0) + words(d)
    budgets = brute(leaves, sum(leaves.values()) * fraction[0] // fraction[1], weights, epochs)
    want = []
    for name, budget in budgets.items():
        q, rest = divmod(budget, leaves[name]) if leaves[name] else (0, 0)
        mine = [d for d in docs if leaf(d) == name]
        want += [(d[0], e, words(d), words(d)) for d in mine for e in range(q)]
        key = lambda d: md5(f"{seed}|{q}|{'' if d[0] is None else d[0]}|{md5(d[1] or '')}")  # noqa: E731, B023
        have = 0
        for k in sorted({key(d) for d in mine}):
            if have >= rest:
                break
            at = [d for d in mine if key(d) == k]
            over = have + sum(map(words, at)) >= rest
            want += [(d[0], q, words(d), min(words(d), rest - have) if over else words(d)) for d in at]
            have += sum(map(words, at))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    got = [(r.doc_id, r._epoch, r._tokens, r._take_tokens) for r in mixing.mix(df, weights, fraction, epochs, seed).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))

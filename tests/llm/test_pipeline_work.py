"""What the pipeline's stages decide takes effect: labels are corrected, near copies go, one of each group stays."""

import random
import zlib

import corpus_pipeline
from tidecast.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"en": "kapitolu", "de": "wrzeszcy", "fr": "ñandéüx"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_wrong_and_missing_labels_are_corrected_and_counted_in_the_mixture(spark):
    rng = random.Random(1)
    langs = [rng.choice(sorted(SOUNDS)) for _ in range(240)]
    rows = [(i, prose(rng, g, 40), g, "s1", 1) for i, g in enumerate(langs)]
    # of documents that nothing is learned from
    wrong = {i: rng.choice([None, *(x for x in SOUNDS if x != langs[i])]) for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(i, t, wrong.get(i, g), s, n) for i, t, g, s, n in rows] + [(900, None, "en", "s1", 0), (901, "12 34", "en", "s1", 5)]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id: r.lang for r in out.collect()} == dict(enumerate(langs))
    tokens = {g: 40 * langs.count(g) for g in SOUNDS}
    mixed = corpus_pipeline.mix_sources(spark, out, None)
    taken = {g: 0 for g in SOUNDS}
    for r in mixed.collect():
        taken[r.lang] += len(r.text.split())
    assert all(n <= corpus_pipeline.EPOCHS * tokens[g] for g, n in taken.items()) and taken["en"] == min(2 * tokens["en"], max(taken.values()))


def test_a_classifier_that_knows_nothing_keeps_labels(spark):
    rows = [(i, "some words here", None, "s1", 1) for i in range(5)]
    assert language_id.accepted(spark.createDataFrame(rows, SCHEMA)).count() == 5


def test_near_copies_go_and_their_first_stays(spark):
    rng = random.Random(2)
    rows, kept = [], set()
    for k in range(12):
        words = prose(rng, "en", 120).split()
        kept.add(10 * k)
        rows.append((10 * k, " ".join(words), "en", "s1", 1))
        for copy in range(1, 4):
            changed = list(words)
            changed[rng.randrange(120)] = "changed"
            rows.append((10 * k + copy, " ".join(changed), "en", "s1", 1))
    out = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), None)
    assert {r.doc_id for r in out.collect()} == kept


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ALL_ROWS", 60)
    monkeypatch.setattr(language_id, "ALL_LANDMARKS", 9)
    rng = random.Random(4)
    rows = [(i, prose(rng, g, 30), g, "s", 1) for i, g in enumerate(sorted(SOUNDS) * 60)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == tuple(sorted(SOUNDS)) and len(model.marks) == 9

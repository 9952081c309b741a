"""Extra columns called what operators call their own, and labels that must not matter."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidecast.llm import language_id, line_dedup, mixing, queries, superminhash

MIXING = [f"_{n}" for n in (*mixing.OUT, *mixing.BETWEEN)] + ["q", "rest", "cut_key", "cut_take", "domain", "tokens", "epoch", "_partial"]
OTHERS = ["_p", "_told", "_place", "_word", "_bits", "_may", "_n_lines", "_n_dropped", "_lines", "_words", "_kept", "_dropped", "_bitmap_of", "_lost", "doc_id_", "spans", "key", "rep"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("text", F.substring("text", 1, 300)).cache()


def plus(docs, names):
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


def rows(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(columns).collect())


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_mixing_beside_columns_of_its_names(docs, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", broadcast)
    weights = {"lang": {"en": 3}}
    plain, crowded = mixing.mix(docs, weights), mixing.mix(plus(docs, MIXING), weights)
    put = mixing.names(plus(docs, MIXING).columns)
    assert crowded.columns[: len(docs.columns) + len(MIXING)] == plus(docs, MIXING).columns
    assert rows(crowded, ["doc_id", *(put[n] for n in mixing.OUT)]) == rows(plain, ["doc_id", *(f"_{n}" for n in mixing.OUT)])
    for name in MIXING:
        assert [r[0] for r in crowded.select(name).distinct().collect()] == [f"own {name}"]


def test_query_of_mixing_beside_columns_of_its_names(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    plus(docs, MIXING).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (queries.op1_mix_sources(spark, f"{tmp_path}/{k}") for k in "ab")
    assert a.columns == b.columns and rows(a, a.columns) == rows(b, b.columns)


@pytest.mark.parametrize("apply", [language_id.accepted, line_dedup.dedup, superminhash.representatives])
def test_stages_keep_columns_of_their_names(docs, apply):
    crowded = apply(plus(docs, OTHERS))
    assert crowded.columns == plus(docs, OTHERS).columns
    assert rows(crowded, docs.columns) == rows(apply(docs), docs.columns)
    assert [tuple(r) for r in crowded.select(OTHERS).distinct().collect()] == [tuple(f"own {n}" for n in OTHERS)]


def test_pipeline_over_crowded_documents(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    plus(docs, MIXING + OTHERS).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (corpus_pipeline.run(spark, f"{tmp_path}/{k}") for k in "ab")
    assert a.columns == b.columns and rows(a, a.columns) == rows(b, b.columns)


def test_labels_of_held_out_documents_do_not_matter(docs, monkeypatch):
    monkeypatch.setattr(language_id, "ALL_ROWS", 60)
    monkeypatch.setattr(language_id, "ALL_LANDMARKS", 30)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.concat(F.lit("made up "), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    assert rows(language_id.digest(docs), ["doc_id", "lang_pred", "score"]) == rows(language_id.digest(other), ["doc_id", "lang_pred", "score"])


def test_language_of_null_and_repeated_ids(spark, docs):
    odd = docs.limit(20).withColumn("doc_id", F.lit(None).cast("long"))
    crowd = docs.unionByName(docs.limit(20)).unionByName(odd)
    got = language_id.digest(crowd)
    assert got.count() == docs.count() + 40 and got.filter("lang_pred is null or score is null").count() == 0
    assert odd.count() == got.filter("doc_id is null").count()


def test_long_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(300_000)) + "\n" + "a repeated line\n" * 2
    df = spark.createDataFrame([(1, long, "en", "src1", 1), (2, "a repeated line\nshort", "en", "src2", 1), (3, "x" * 2_000_000, "de", "src9", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(df, {}, (1, 1), 1).count() == 3
    assert {r.doc_id: r.n_dropped for r in line_dedup.digest(df).collect()} == {1: 0, 2: 1, 3: 0}
    assert language_id.digest(df).count() == 3
    from tidecast.llm import exact_dedup, packing

    assert sum(r.kept for r in exact_dedup.dedup(df).collect()) == 3
    assert sum(r.n_tokens for r in packing.pack(df).collect()) == 300_006 + 4 + 1

"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import language_id, line_dedup, mixing, packing, superminhash
from tidecast.llm.common import cut, read

#: Weights of the mixture; nodes that aren't named weigh 1.  The budget is all tokens that reach the stage.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}
FRACTION, EPOCHS, SEED = (1, 1), 2, 29


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, labelled with it, which is what the mixture goes by; the others go."""
    return language_id.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return superminhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them; the copy that crosses a leaf's budget ends at the last word
    that fits, and its n_chars follows."""
    mixed = mixing.mix(docs, WEIGHTS, FRACTION, EPOCHS, SEED)
    put = mixing.names(docs.columns)
    tokens, take = F.col(put["tokens"]), F.col(put["take_tokens"])
    crossing = take < tokens
    mixed = mixed.withColumn("text", F.when(crossing, mixing.first_words(F.col("text"), take)).otherwise(F.col("text")))
    return mixed.withColumn("n_chars", F.when(crossing, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage learns a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs

"""Language identification: blended-spectrum n-gram presence kernel, Nystroem landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.arrow_text import flat, steps
from tidecast.llm.common import free_name

#: Hashed n-grams of 1, 2 and 3 bytes; the presence vector's width.
WIDTH = 4096
#: Training rows and landmarks a language at most, and of all languages: the bounds of the labelled sample.
PER_LANG, LANDMARKS = 500, 24
ALL_ROWS, ALL_LANDMARKS = 50_000, 2400
RIDGE = 1e-3
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 0/1 row for each text: which n-grams (n = 1, 2, 3) of its letters, lower-cased, and single blanks occur."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.uint8)
    base, text = int(offsets[0]), _FOLD[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.repeat(offsets[1:] - base, np.diff(offsets))
    at = np.arange(len(text))
    gram = np.zeros(len(text), np.uint32)
    for n in (1, 2, 3):
        live = len(text) - n + 1
        if live <= 0:
            break
        gram = gram[:live] * np.uint32(257) + text[n - 1 :]
        inside = at[:live] + n <= ends[:live]
        bucket = ((gram * np.uint32(2654435761) + np.uint32(n) * np.uint32(40503)) >> np.uint32(20)) % WIDTH
        out[row[:live][inside], bucket[inside]] = 1
    return out


def kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both texts' n-grams."""
    size = lambda m: np.sqrt(np.maximum(m.sum(1, dtype=np.float32), 1))
    return (x.astype(np.float32) @ marks.astype(np.float32).T) / size(x)[:, None] / size(marks)[None, :]


@dataclass(frozen=True)
class Model:
    """langs, the landmarks' presence rows, and the map from kernel values against them to a score for each language."""

    langs: tuple[str, ...]
    marks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.marks) @ self.weights + self.bias


def held_out(doc_id: Column) -> Column:
    """Whether a document is set aside from training: crc32(doc_id as text) mod 4 is 2; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


@F.arrow_udf(T.BinaryType())
def _packed(text: pa.Array) -> pa.Array:
    data, offsets = flat(text)
    return pa.array([row.tobytes() for i, j in steps(offsets) for row in np.packbits(presence(data, offsets[i : j + 1]), axis=1)], pa.binary())


def lowest(rows: DataFrame, per_lang: int) -> DataFrame:
    """(lang, doc_id, r): the per_lang rows of each language that come first by hash of id, r from 1.

    Counts by language and leading 16 bits of the hash tell how far these can reach, so that the ranking gets them and
    one 65536th of a language's rows at most, whatever the table; rows that share an id go together.
    """
    hashed = rows.select("lang", "doc_id").withColumn("h", F.xxhash64("doc_id")).withColumn("b", F.shiftright("h", 48))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    counted = hashed.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    reach = counted.filter(F.col("before") < per_lang).groupBy("lang").agg(F.max("b").alias("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return hashed.join(F.broadcast(reach), "lang").filter("b <= most").select("lang", "doc_id", rank.alias("r")).filter(F.col("r") <= per_lang)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most per_lang rows of each language, first by hash of id, of documents that aren't held out.

    Many languages share ALL_ROWS rows and ALL_LANDMARKS landmarks, one each at least.  Whole texts become presence rows
    on the executors; 512 bytes of each sampled row come to the driver.  Rows of null language or text aren't used.
    None where there is no row to learn from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    languages = max(1, rows.select("lang").distinct().count())
    per_lang, landmarks = max(1, min(per_lang, ALL_ROWS // languages)), max(1, min(landmarks, ALL_LANDMARKS // languages))
    # ids alone are ranked; the chosen, per_lang a language, then pick their texts where these are
    chosen = lowest(rows, per_lang).filter("doc_id is not null").groupBy("lang", "doc_id").agg(F.min("r").alias("r"))
    sample = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "r", _packed("text").alias("p")).collect()
    sample.sort(key=lambda s: (s.lang, s.r, s.p))
    if not sample:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(s.p for s in sample), np.uint8).reshape(len(sample), -1), axis=1)
    langs = tuple(sorted({s.lang for s in sample}))
    marks = x[[i for i, s in enumerate(sample) if s.r <= landmarks]]
    among = kernel(marks, marks).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    whiten = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = kernel(x, marks) @ whiten
    y = np.array([[1.0 if s.lang == k else -1.0 for k in langs] for s in sample])
    mean, bias = phi.mean(0), y.mean(0)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + RIDGE * len(sample) * np.eye(phi.shape[1]), centred.T @ (y - bias))
    return Model(langs, marks, (whiten @ w).astype(np.float32), (bias - mean @ w).astype(np.float32))


def lettered(text: Column) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))


def predicted(model: Model | None, text: Column) -> Column:
    """struct(lang, score): the best-scoring language, and that score taken from -1..1 to 0..1.

    The text alone decides.  `und` with score 0 where it is null or holds no letter, or where nothing was learned.
    """
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def classify(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        found = [model.scores(presence(data, offsets[i : j + 1])) for i, j in steps(offsets)]
        scores = np.concatenate(found) if found else np.zeros((0, len(model.langs)), np.float32)
        best = scores.argmax(1) if len(scores) else np.zeros(0, int)
        top = scores[np.arange(len(best)), best].astype(np.float64)
        return pa.StructArray.from_arrays([pa.array([model.langs[k] for k in best], pa.string()), pa.array(np.clip((top + 1) / 2, 0, 1), pa.float64())], ["lang", "score"])

    return F.when(lettered(text), classify(text)).otherwise(unknown)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; texts of any length go whole, repeated rows each get a row."""
    model = train(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), predicted(model, F.col(text_col)).alias("_p"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def accepted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language can't be told (`und`), and with lang_col as predicted from the text.

    Labels are learned from and then replaced, missing and wrong ones with the rest; all other columns are as they were.
    Where no model could be learned, the rows of null text or without letters go and labels stay.
    """
    model = train(docs, id_col, text_col, lang_col)
    if model is None:
        return docs.filter(lettered(F.col(text_col)))
    kind = docs.schema[lang_col].dataType
    told = free_name("_told", docs.columns)
    got = docs.withColumn(told, predicted(model, F.col(text_col))).filter(F.col(f"{told}.lang") != UNKNOWN)
    return got.withColumn(lang_col, F.col(f"{told}.lang").cast(kind)).select(docs.columns)

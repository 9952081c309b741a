"""Line dedup: hashes range-partitioned and sorted by document and position, keep bitmaps instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import BLANK, SALTS, ascii_lower, aside, cut

LEAST_CHARS = 10
#: Occurrences that one slice of a key has at most, about, where one key holds all lines.
SLICE_ROWS = 1_000_000
#: Hashed bits that tell which documents may have a bitmap: 2 MB of words to broadcast at most.  Full, they let all through.
SIEVE_BITS = 1 << 23


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, pos, h1, h2) of the lines whose key has `least` code points; two 64-bit hashes name a key."""
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "k"),
    )
    return keyed.filter(F.length("k") >= least).select(
        "doc_id",
        "pos",
        F.xxhash64("k").alias("h1"),
        F.xxhash64(F.lit(1), F.col("k")).alias("h2"),
    )


def sliced(hashes: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """hashes with slice, which deals a key's occurrences over tasks by document: SALTS slices, or as many as keep one
    of them below `rows` whatever share of all lines a key has."""
    slices = max(SALTS, -(-hashes.count() // rows))
    return hashes.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))


def first_occurrences(hashes: DataFrame, partitions: int | None = None) -> DataFrame:
    """(h1, h2, slice, owner) of the keys found in two documents or more; owner is the smallest id that holds the key.

    Hashes are range-partitioned by key and slice and sorted within by document and position; the first row of each
    streams out, with its last document.  A key's slices, one row each, then meet to name the owner.
    """
    n = partitions or int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = Window.partitionBy("h1", "h2", "slice").orderBy("doc_id", "pos")
    firsts = (
        hashes.repartitionByRange(n, "h1", "h2", "slice")
        .withColumn("_before", F.lag("doc_id").over(run))
        .withColumn("_new", F.col("_before").isNull() | (F.col("_before") != F.col("doc_id")))
        .filter("_new")
        .groupBy("h1", "h2", "slice")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    )
    ends = firsts.groupBy("h1", "h2").agg(F.min("first_doc").alias("owner"), F.max("last_doc").alias("_last")).filter("owner < _last").drop("_last")
    return firsts.select("h1", "h2", "slice").join(ends, ["h1", "h2"])


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, dropped): for each document that loses lines, a compressed bitmap of them.

    The bitmap is a sorted list of (word, bits), 64 positions a word, of the words with a bit set; a document that is
    missing keeps every line.  A key found in two documents or more loses its lines in all but the smallest doc_id
    that holds it; repeated lines of that document stay.

    Null ids own and lose nothing.  Rows that share an id share a bitmap: their lines count as one document's, position
    by position.  Null or empty text is one empty line, which stays.
    """
    hashes = sliced(cut(line_hashes(docs, id_col, text_col, least).filter("doc_id is not null"), "lines"))
    lost = hashes.join(first_occurrences(hashes), ["h1", "h2", "slice"]).filter("doc_id != owner")
    words = lost.groupBy("doc_id", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return cut(words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped")), "bitmaps", narrow=True)


def _dense(dropped: Column, lines: Column) -> Column:
    """The bitmap with a word for each 64 lines."""
    by_word = F.map_from_entries(F.coalesce(dropped, F.expr("array()").cast("array<struct<word:int,bits:bigint>>")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")), lambda w: F.coalesce(F.element_at(by_word, w), F.lit(0).cast("long")))


def marked(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", bits: int = SIEVE_BITS) -> DataFrame:
    """docs with _may: false for rows that certainly have no bitmap.

    A hashed bit for each id of `bitmaps`, in words of 64 that are broadcast: bits / 64 rows at most, whatever the table.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = bitmaps.select(place(F.col("doc_id")).alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))
    at = docs.withColumn("_place", place(F.col(id_col).cast("long"))).withColumn("_word", F.floor(F.col("_place") / 64).cast("int"))
    met = at.join(F.broadcast(words), "_word", "left")
    bit = F.expr("shiftrightunsigned(_bits, cast(_place % 64 as int)) & 1L")
    return met.withColumn("_may", F.coalesce(bit == 1, F.lit(False))).select(*docs.columns, "_may")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of `bitmaps`, a stored table, taken out of text_col, and _n_lines, _n_dropped.

    Rows without a bitmap stay where they are; the others' texts are moved once, by id.  A text of which nothing is lost
    stays as it is, null too; one that loses every line becomes empty.
    """
    told = marked(docs, bitmaps, id_col)
    still = told.filter(~F.col("_may")).drop("_may").withColumn("_n_lines", F.size(lines_of(F.col(text_col))).cast("long")).withColumn("_n_dropped", F.lit(0).cast("long"))
    docs = told.filter("_may").drop("_may")
    # bitmaps grow with the table: they are never broadcast, at no size
    joined = docs.join(bitmaps.withColumnRenamed("doc_id", "_bitmap_of").withColumnRenamed("dropped", "_dropped").hint("merge"), F.col(id_col).cast("long") == F.col("_bitmap_of"), "left")
    parts = joined.withColumn("_lines", lines_of(F.col(text_col))).withColumn("_words", F.when(F.col("_dropped").isNotNull(), _dense(F.col("_dropped"), F.col("_lines"))))
    bit = lambda i: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.element_at(F.col("_words"), (F.floor(i / 64) + 1).cast("int")), F.pmod(i, F.lit(64)).cast("int")))
    kept = F.filter(F.col("_lines"), lambda _, i: bit(i) == 0)
    out = parts.withColumn("_kept", F.when(F.col("_words").isNotNull(), kept))
    moved = (
        out.withColumn("_n_lines", F.size("_lines").cast("long"))
        .withColumn("_n_dropped", F.when(F.col("_kept").isNull(), F.lit(0).cast("long")).otherwise((F.size("_lines") - F.size("_kept")).cast("long")))
        .withColumn(text_col, F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n")))
        .drop("_bitmap_of", "_dropped", "_lines", "_words", "_kept")
    )
    return still.unionByName(moved)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, every column as it was, without the lines that another document owns (see drop_bitmaps)."""
    docs, back = aside(docs, id_col, text_col)
    return back(apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col), id_col, text_col).drop("_n_lines", "_n_dropped"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = apply_bitmaps(plain, drop_bitmaps(plain))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

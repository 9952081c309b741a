"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ascii_lower, attach, cut

#: A chunk has at least LEAST code points before its cut and at most MOST.
LEAST, MOST = 256, 4096
#: The cut follows nine code points whose membership in ODD spells this mask: about one place in 2**9.
ODD = "acegikmoqsuwyACEGIKMOQSUWY13579"
MASK = "101100101"


def chunk_pattern(least: int = LEAST, most: int = MOST, mask: str = MASK) -> str:
    """A regular expression whose successive matches are the chunks; a cut depends on the text just before it only."""
    window = "".join(f"[{'' if bit == '1' else '^'}{ODD}]" for bit in mask)
    return f"(?s).{{{least},{most}}}?{window}|(?s).{{1,{most}}}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern()), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, recipe, text_sha256): each text's ordered chunk identifiers.

    An identifier is the chunk's SHA-256; beside it go its MD5 and length, by which `unverified` checks it.  The text
    itself goes no further than this narrow step.  Null text counts as empty, whose recipe is the empty list.
    """
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
        .select(
            "doc_id",
            F.transform(
                chunks(F.col("_t")),
                lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("id"), F.unhex(F.md5(c)).alias("check"), F.length(c).alias("n")),
            ).alias("chunks"),
            F.sha2(F.col("_t"), 256).alias("text_sha256"),
        )
    )


def unverified(table: DataFrame) -> DataFrame:
    """One row, clashes: identifiers that stand for chunks of different MD5 or length."""
    return (
        table.select(F.explode("chunks").alias("c"))
        .select("c.id", "c.check", "c.n")
        .distinct()
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("variants"))
        .agg(F.count_if(F.col("variants") > 1).alias("clashes"))
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal after A-Z are lower-cased; the largest id of a group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each input row.

    Texts become recipes in one narrow step, chunk identifiers are deduplicated and verified (a clash fails the job
    rather than merge different texts), and groups form on the ordered identifier lists.  Grouping combines before
    it shuffles, so a group of any size sends one row a task; its rows get the result by a salted join.

    Null or empty text: all of these are one group.  Rows with a null id: they count in group_size and are kept only
    where their whole group has null ids, keep_id then being null.  Repeated rows of the id that stays are all
    marked kept, as they have one id.  Empty table: no rows.  Other columns are ignored.
    """
    table = cut(recipes(docs, id_col, text_col), "recipes")
    keyed = table.select("doc_id", F.col("chunks.id").alias("recipe"), "text_sha256")
    groups = keyed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = attach(keyed, groups.filter("group_size > 1"), ["recipe"], ["doc_id"])
    clashes = unverified(table).select(F.when(F.col("clashes") > 0, F.raise_error(F.lit("one chunk identifier stands for two chunks"))).otherwise(F.lit(0)).alias("_clashes"))
    return found.crossJoin(F.broadcast(clashes)).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long") + F.col("_clashes")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )

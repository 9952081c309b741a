"""Shared pieces of the training-data operators: text normalisation, lineage cuts, salted joins."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Slices that a hot key is dealt over in salted joins.
SALTS = 16
#: Rows of an Arrow batch at most in the jobs that write tables on the way.
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(name: str, taken: Sequence[str]) -> str:
    """name, or name with a number after it that no column has; Spark's names differ by more than case."""
    low = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(low) + 1))) if n.lower() not in low)


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the caller's columns that begin with _ under names that no operator uses, and what turns a table of
    these columns back.  `used` keep their names."""
    put = {c: free_name(f"held of the caller: {c}", docs.columns) for c in docs.columns if c.startswith("_") and c not in used}
    if not put:
        return docs, lambda out: out
    return docs.withColumnsRenamed(put), lambda out: out.withColumnsRenamed({v: k for k, v in put.items()})


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other code point as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that raises, as executors don't share one.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="tidecast-")
        sc.setCheckpointDir(told)
        told = sc.getCheckpointDir()
    return told.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows while a job is planned and run: the JVM and a Python worker each hold a
    batch of whole texts, and by default that is 10000 of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: a later loss of executors recomputes nothing before this.

    narrow writes in as many tasks as there are cores, where that is fewer.  The files go with discard(), or when the
    application ends.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    path = f"{shared_folder(spark)}/tidecast-{uuid.uuid4().hex}-{name}"
    with small_batches(spark):
        df.write.parquet(path)
    where, system = _located(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where the table behind a DataFrame of cut() lies.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() returned, once all that was made of them is written itself."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            where, system = _located(table.sparkSession, path)
            system.delete(where, True)


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join rows with their group's one row, a hot group's rows dealt over `salts` tasks.

    groups has one row for each value of keys and holds only groups that matter (as a rule those of two rows or
    more), since each is repeated `salts` times.  A null key joins nothing.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")

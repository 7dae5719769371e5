"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which an execution deletes its shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SCRATCH: dict[str, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session on one machine (``local`` masters, as in tests) that names
    none gets a folder of its own; on a cluster that is an error, as each
    machine would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="skeinflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor costs the tasks it ran, not the work before
    the table.  The shuffles that led to it are deleted once it is written.
    ``drop_scratch`` removes the tables when results are consumed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _SCRATCH[path] = table
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave; nothing that is still to be computed may read them."""
    for path in [p for p, t in _SCRATCH.items() if any(t is table for table in tables)]:
        _delete(_SCRATCH.pop(path).sparkSession, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this driver; for callers, once results are consumed."""
    while _SCRATCH:
        _delete(spark, _SCRATCH.popitem()[0])


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds

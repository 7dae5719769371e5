"""Text files as numbered lines, read in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that are filled together.
RUN = 4096


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """-> file, block, line_no (from 0, in each file), value.

    Lines are numbered within their split; splits' first numbers come from
    their counts, a row a split, so that no file is read by one task.  Gzip
    files (S18) are one split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return raw.join(blocks, ["file", "block"]).select("file", "block", (F.col("offset") + F.col("id") - F.col("first")).alias("line_no"), "value")


def fill_down(lines: DataFrame, header: Column) -> DataFrame:
    """Each line with ``section``, the number of the last header line at or before it; lines before the first header are dropped.

    Filled within runs of lines, then with the last header of the runs before;
    a split, or a file that is one, may be too much for a task.
    """
    marked = lines.withColumn("_h", F.when(header, F.col("line_no"))).withColumn("_r", F.floor(F.col("line_no") / RUN))
    inside = marked.withColumn("_s", F.last("_h", ignorenulls=True).over(Window.partitionBy("file", "_r").orderBy("line_no")))
    runs = marked.groupBy("file", "_r").agg(F.max("_h").alias("_last"))
    before = Window.partitionBy("file").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "_r", F.max("_last").over(before).alias("_carry"))
    filled = inside.join(runs, ["file", "_r"]).withColumn("section", F.coalesce("_s", "_carry"))
    return filled.where("section is not null").drop("_h", "_r", "_s", "_carry")


def fastq_to_fasta(lines: DataFrame) -> DataFrame:
    """Numbered lines of FASTQ files, gzipped or not, as FASTA lines -> file, block, line_no, value; line_no counts from 0."""
    k = F.col("line_no") % 4
    header = F.regexp_replace("value", "^@", ">")
    return lines.where(k < 2).select("file", "block", (F.floor(F.col("line_no") / 4) * 2 + k).alias("line_no"), F.when(k == 0, header).otherwise(F.col("value")).alias("value"))

"""Operators on tables of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, seq


def normalise_assembly(contigs: DataFrame, *, seq_col: str = "seq") -> DataFrame:
    """F1"""
    return contigs.withColumn(seq_col, seq.normalise(F.col(seq_col)))


def filter_quality(reads: DataFrame, least: float, *, qual: str = "qual") -> DataFrame:
    """F2, Q24: reads whose mean quality is ``least`` or more; apply it before qualities are dropped."""
    return reads.where(seq.mean_phred(F.col(qual)) >= least)


def n50(contigs: DataFrame, *, length: str = "len", by: tuple[str, ...] = ()) -> DataFrame:
    """The length from which longer contigs hold more than half of all bases -> by, n50.

    Lengths are counted first, so that a group's window holds its distinct
    lengths, not its contigs.
    """
    counts = contigs.groupBy(*by, F.col(length).alias("len")).agg((F.count(F.lit(1)) * F.first(length)).alias("bases"))
    order = Window.partitionBy(*by).orderBy(F.desc("len"))
    reached = counts.withColumn("upto", F.sum("bases").over(order)).withColumn("total", F.sum("bases").over(Window.partitionBy(*by)))
    return reached.where(F.col("upto") * 2 > F.col("total")).groupBy(*by).agg(F.max("len").alias("n50"))


def cut_contigs(contigs: DataFrame, size: int, *, name: str = "name", seq_col: str = "seq") -> DataFrame:
    """Pieces of ``size`` bases -> name, chunk, chunk_name, seq."""
    last = F.floor(F.greatest(F.length(seq_col) - 1, F.lit(0)) / size).cast("int")
    pieces = contigs.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    part = F.substring(F.col(seq_col), F.col("chunk") * size + 1, F.lit(size))
    return pieces.select(F.col(name).alias("name"), "chunk", paths.chunk_name(F.col(name), F.col("chunk")).alias("chunk_name"), part.alias("seq"))


def cut_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links between the pieces that bear the ends -> name1, end1, name2, end2, cigar.

    links: (name1, end1, name2, end2, cigar), end 0 left and 1 right; chunks: as
    ``cut_contigs`` gives them.  Successive pieces are linked by 0M.
    """
    last = chunks.groupBy("name").agg(F.max("chunk").alias("last"))
    piece = lambda end, n: F.when(F.col(end) == 1, F.col(n)).otherwise(0)
    moved = links.join(last.select(F.col("name").alias("name1"), F.col("last").alias("l1")), "name1").join(last.select(F.col("name").alias("name2"), F.col("last").alias("l2")), "name2")
    outer = moved.select(
        paths.chunk_name(F.col("name1"), piece("end1", "l1")).alias("name1"), "end1", paths.chunk_name(F.col("name2"), piece("end2", "l2")).alias("name2"), "end2", "cigar"
    )
    inner = chunks.where("chunk > 0").select(
        paths.chunk_name(F.col("name"), F.col("chunk") - 1).alias("name1"), F.lit(1).alias("end1"), F.col("chunk_name").alias("name2"), F.lit(0).alias("end2"), F.lit("0M").alias("cigar")
    )
    return outer.unionByName(inner)


def reads_on_contigs(reads: DataFrame, alignments: DataFrame, *, read: str = "read_idx") -> DataFrame:
    """Reads with an alignment."""
    return reads.join(alignments.select(read), read, "left_semi")


def look_up(rows: DataFrame, contigs: DataFrame, *, name: str = "name") -> DataFrame:
    """Rows with what their contig has."""
    return rows.join(contigs, name)


def reads_of_contigs(reads: DataFrame, alignments: DataFrame, *, read: str = "read_idx") -> DataFrame:
    """Each contig's reads, once each, with what the reads have -> contig, read, ..."""
    return alignments.select("contig", read).distinct().join(reads, read)

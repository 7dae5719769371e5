"""Structural breakpoints: bridges between contigs that reads span, and piers where they leave the graph.

Mappings are rows (read_idx, ord, contig, qs, qe, qlen, ts, te, clen, strand).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_enough(mappings: DataFrame) -> DataFrame:
    """Mappings of at least min(1000, max(min(0.2 read, 0.5 contig), 500)) bases."""
    least = F.least(F.lit(1000), F.greatest(F.least(0.2 * F.col("qlen"), 0.5 * F.col("clen")), F.lit(500)))
    return mappings.where(F.col("qe") - F.col("qs") >= least)


def bridges(mappings: DataFrame) -> DataFrame:
    """Successive mappings of a read -> read_idx, ord, contig1, strand1, pos1, contig2, strand2, pos2, gap.

    pos1 is where the read leaves the first contig, pos2 where it enters the second.
    """
    order = Window.partitionBy("read_idx").orderBy("ord")
    leave = F.when(F.col("strand") == 1, F.col("te")).otherwise(F.col("ts"))
    enter = F.when(F.col("strand") == 1, F.col("ts")).otherwise(F.col("te"))
    rows = mappings.select("read_idx", "ord", F.col("contig").alias("contig1"), F.col("strand").alias("strand1"), leave.alias("pos1"),
        F.lead("contig").over(order).alias("contig2"), F.lead("strand").over(order).alias("strand2"), F.lead(enter).over(order).alias("pos2"), (F.lead("qs").over(order) - F.col("qe")).alias("gap"))
    return rows.where("contig2 is not null")


def piers(mappings: DataFrame, *, aligned: float = 0.8) -> DataFrame:
    """The last mapping of reads that are aligned enough -> read_idx, contig, strand, pos, overhang."""
    by = Window.partitionBy("read_idx")
    rows = mappings.withColumn("covered", F.sum(F.col("qe") - F.col("qs")).over(by) / F.col("qlen")).withColumn("last", F.max("ord").over(by))
    pos = F.when(F.col("strand") == 1, F.col("te")).otherwise(F.col("ts"))
    return rows.where((F.col("ord") == F.col("last")) & (F.col("covered") > aligned)).select("read_idx", "contig", "strand", pos.alias("pos"), (F.col("qlen") - F.col("qe")).alias("overhang"))


def duplex_reads(bridges_: DataFrame, *, near: int = 1000) -> DataFrame:
    """reads that come back over the place they left -> read_idx.  Ends on one strand each, at most ``near`` apart, on one contig."""
    return bridges_.where((F.col("contig1") == F.col("contig2")) & (F.col("strand1") == F.col("strand2")) & (F.abs(F.col("pos1") - F.col("pos2")) <= near)).select("read_idx").distinct()


def without_reads(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """rows of all other reads."""
    return rows.join(reads.select("read_idx").distinct(), "read_idx", "left_anti")


def to_realign(mappings: DataFrame, used: DataFrame) -> DataFrame:
    """reads with an overhang above min(0.2 length, 100) that no solid evidence used -> read_idx."""
    over = mappings.groupBy("read_idx").agg(F.min("qs").alias("a"), (F.max("qlen") - F.max("qe")).alias("b"), F.max("qlen").alias("qlen"))
    return without_reads(over.where(F.greatest("a", "b") > F.least(0.2 * F.col("qlen"), F.lit(100.0))).select("read_idx"), used)


def solid_bridges(bridges_: DataFrame, *, least: int = 5, near: int = 1000, gap_near: int = 1000) -> DataFrame:
    """J13, G30 as sessions (W5): bridges of the same contigs and strands whose ends and gaps follow within bounds -> contig1, strand1, contig2, strand2, session, n, pos1, pos2, gap.

    Sessions run over pos1, then pos2, then the gap; a chain of near ones is
    one.  Numbers differ from ``greedy_bridges``.
    """
    key = ["contig1", "strand1", "contig2", "strand2"]
    rows, parts = bridges_, []
    for column, bound in (("pos1", near), ("pos2", near), ("gap", gap_near)):
        order = Window.partitionBy(*key, *parts).orderBy(column)
        new, next_ = (F.when(x <= bound, 0).otherwise(1) for x in (F.col(column) - F.lag(column).over(order), F.lead(column).over(order) - F.col(column)))
        rows = rows.withColumn("_new", new).withColumn("_next", next_).withColumn(f"_{column}", F.sum("_new").over(order))
        if least > 1:  # one alone stays alone; sessions are numbered before it goes
            rows = rows.where("_new = 0 or _next = 0")
        rows = rows.drop("_new", "_next")
        parts.append(f"_{column}")
    session = F.concat_ws(".", *parts).alias("session")
    mid = lambda c: F.floor(F.avg(c)).cast("long").alias(c)
    return rows.groupBy(*key, session).agg(F.count_distinct("read_idx").alias("n"), mid("pos1"), mid("pos2"), mid("gap")).where(F.col("n") >= least)


def greedy_bridges(bridges_: DataFrame, *, near: int = 1000, gap_near: int = 1000) -> DataFrame:
    """In order of (pos1, pos2, read), a bridge joins the first anchor within bounds -> bridges with ``anchor`` (its pos1, pos2 and gap).

    A group is one pair of oriented contigs; it is cut beforehand where pos1
    leaves a gap above ``near``, over which nothing can join.
    """
    key = ["contig1", "strand1", "contig2", "strand2"]
    order = Window.partitionBy(*key).orderBy("pos1")
    rows = bridges_.withColumn("_new", F.when(F.col("pos1") - F.lag("pos1").over(order) <= near, 0).otherwise(1)).withColumn("run", F.sum("_new").over(order)).drop("_new")

    rows = rows.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy(*key, "run")))
    alone = rows.where("members = 1").withColumn("anchor", F.concat_ws(":", "pos1", "pos2", "gap"))
    # runs one after the other, many of them in a batch
    parts = [*key, "run"]
    runs = rows.where("members > 1").repartition(*parts).sortWithinPartitions(*parts, "pos1", "pos2", "read_idx", "ord")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchors = None, []
        for pdf in batches:
            found = []
            for name, p1, p2, gap in zip(zip(*[pdf[c] for c in parts]), pdf["pos1"], pdf["pos2"], pdf["gap"]):
                if name != now:
                    now, anchors = name, []
                at = next((a for a in anchors if abs(a[0] - p1) <= near and abs(a[1] - p2) <= near and abs(a[2] - gap) <= gap_near), None)
                if at is None:
                    anchors.append(at := (p1, p2, gap))
                found.append(f"{at[0]}:{at[1]}:{at[2]}")
            yield pdf.assign(anchor=found)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", anchor string"
    return alone.unionByName(runs.mapInPandas(fold, schema)).drop("run", "members")


def new_bridges(solid: DataFrame, links: DataFrame) -> DataFrame:
    """Bridges between contig ends that no link joins yet; links: (contig1, strand1, contig2, strand2)."""
    return solid.join(links, ["contig1", "strand1", "contig2", "strand2"], "left_anti")


def free_piers(piers_: DataFrame, solid: DataFrame, *, near: int = 1000) -> DataFrame:
    """Piers that aren't a solid bridge's end: same contig and strand, at most ``near`` away; found by bins."""
    ends = solid.select(F.col("contig1").alias("contig"), F.col("strand1").alias("strand"), F.col("pos1").alias("end")).unionByName(solid.select(F.col("contig2").alias("contig"), (1 - F.col("strand2")).alias("strand"), F.col("pos2").alias("end")))
    b = F.floor(F.col("end") / near)
    ends = ends.withColumn("_bin", F.explode(F.array(b - 1, b, b + 1))).withColumnRenamed("contig", "c2").withColumnRenamed("strand", "s2").withColumnRenamed("_bin", "_bin2")
    placed = piers_.withColumn("_bin", F.floor(F.col("pos") / near))
    near_end = (F.col("contig") == F.col("c2")) & (F.col("strand") == F.col("s2")) & (F.col("_bin") == F.col("_bin2")) & (F.abs(F.col("pos") - F.col("end")) <= near)
    return placed.join(ends, near_end, "left_anti").drop("_bin")


def read_stats(mappings: DataFrame, lengths: DataFrame) -> DataFrame:
    """How reads align -> kind, n: unaligned, jumping (two contigs or more), partial (under 80 %), well."""
    a = mappings.groupBy("read_idx").agg(F.sum(F.col("qe") - F.col("qs")).alias("aligned"), F.count_distinct("contig").alias("contigs"))
    rows = lengths.join(a, "read_idx", "left")
    kind = F.when(F.col("aligned").isNull(), "unaligned").when(F.col("contigs") > 1, "jumping").when(F.col("aligned") < 0.8 * F.col("len"), "partial").otherwise("well")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def pieces(contigs: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Contigs cut at their inner breakpoints -> contig, lo, hi, piece; breakpoints: (contig, pos)."""
    inner = breakpoints.join(contigs, "contig").where("pos > 0 and pos < len").select("contig", "pos")
    marks = inner.unionByName(contigs.select("contig", F.lit(0).cast("long").alias("pos"))).unionByName(contigs.select("contig", F.col("len").cast("long").alias("pos"))).distinct()
    rows = marks.withColumn("hi", F.lead("pos").over(Window.partitionBy("contig").orderBy("pos"))).where("hi is not null")
    return rows.select("contig", F.col("pos").alias("lo"), "hi", F.concat_ws("_", F.col("contig").cast("string"), F.col("pos").cast("string"), F.col("hi").cast("string")).alias("piece"))


def piece_links(pieces_: DataFrame) -> DataFrame:
    """A contig's pieces in a row, joined by 0M -> piece1, piece2, cigar."""
    rows = pieces_.select(F.col("piece").alias("piece1"), F.lead("piece").over(Window.partitionBy("contig").orderBy("lo")).alias("piece2"))
    return rows.where("piece2 is not null").withColumn("cigar", F.lit("0M"))

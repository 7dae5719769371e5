"""Pileup cells, alleles and variant sites.

A pileup is long: (contig, pos, read_idx, allele), a row for each read at each
position.  Columns are named by arguments; results have the default names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.seq import ALPHABET


def allele_counts(cells: DataFrame, *, contig: str = "contig", pos: str = "pos", allele: str = "allele") -> DataFrame:
    """The three most frequent alleles -> contig, pos, ref, n1, alt, n2, n3.

    Ties go to the smaller allele.  Two aggregations, no sort over reads; a
    position meets as many rows as the alphabet has symbols.
    """
    counts = cells.groupBy(F.col(contig).alias("contig"), F.col(pos).alias("pos"), F.col(allele).alias("allele")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("contig", "pos").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "allele"))).alias("r"))
    n = lambda k: F.coalesce(-F.get("r", k)["m"], F.lit(0)).cast("long")
    return ranked.select("contig", "pos", F.get("r", F.lit(0))["allele"].alias("ref"), n(F.lit(0)).alias("n1"), F.get("r", F.lit(1))["allele"].alias("alt"), n(F.lit(1)).alias("n2"), n(F.lit(2)).alias("n3"))


def suspicious_positions(counts: DataFrame, *, min_count: int = 5, ratio: float = 5.0, differs: Column | None = None) -> DataFrame:
    """the second allele is frequent, and far more so than the third.

    ``differs`` says where central bases differ and no homopolymer is beside,
    for alleles that are 3-mer symbols (see ``functions.seq``).
    """
    kept = counts.where((F.col("n2") > min_count) & (F.col("n2") > ratio * F.col("n3")))
    return kept.where(differs) if differs is not None else kept


def least_count(error_rate: Column) -> Column:
    """F3's least count: 3 for reads with few errors, else 5."""
    return F.when(error_rate < 0.015, 3).otherwise(5)


def automatic_snps(sites: DataFrame, *, threshold: float = 0.33) -> DataFrame:
    """sites whose second allele is frequent against the first."""
    return sites.where(F.col("n2") > threshold * F.col("n1"))


def abundant(sites: DataFrame, *, abundance: float = 0.01) -> DataFrame:
    """the second allele reaches the least abundance."""
    return sites.where(F.col("n2") >= abundance * (F.col("n1") + F.col("n2")))


def cap_coverage(cells: DataFrame, cap: int, *, contig: str = "contig", pos: str = "pos", read: str = "read_idx") -> DataFrame:
    """the first ``cap`` reads of a position, by read index."""
    order = Window.partitionBy(contig, pos).orderBy(read)
    return cells.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")


def coverage_cap(abundance: float) -> int:
    """Q3: 50-fold coverage of the rarest strain, 5000 by default."""
    return round(50 / abundance) if abundance else 5000


def min_spacing(sites: DataFrame, distance: int, *, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """From the left, keep a site if it is more than ``distance`` beyond the last one kept.

    Sites are first cut where neighbours are more than ``distance`` apart: there
    the choice starts anew.  So only a run of close sites is folded at once,
    not a contig.
    """
    order = Window.partitionBy(contig).orderBy(pos)
    gap = F.when(F.col(pos) - F.lag(pos).over(order) <= distance, 0).otherwise(1)
    runs = sites.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(order))
    folded = runs.groupBy(F.col(contig).alias("_c"), F.col("_run").alias("_r")).agg(F.sort_array(F.collect_set(pos)).alias("_p"))
    start = F.filter("_p", lambda x: F.lit(False))

    def keep(kept: Column, p: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return F.when(last.isNull() | (p - last > distance), F.concat(kept, F.array(p))).otherwise(kept)

    kept = folded.select("_c", F.explode(F.aggregate("_p", start, keep)).alias("_q"))
    return sites.join(kept, (F.col(contig) == F.col("_c")) & (F.col(pos) == F.col("_q")), "left_semi")


def contig_depth(cells: DataFrame, lengths: DataFrame | None = None, *, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """A4: cells over length -> contig, depth.

    lengths: (contig, len); without it a contig reaches from its first to its
    last position.
    """
    found = cells.groupBy(F.col(contig).alias("contig")).agg(F.count(F.lit(1)).alias("cells"), (F.max(pos) - F.min(pos) + 1).alias("span"))
    if lengths is not None:
        found = found.join(lengths.select(F.col("contig"), F.col("len").alias("_len")), "contig").withColumn("span", F.col("_len"))
    return found.select("contig", (F.col("cells") / F.col("span")).alias("depth"))


def build_pileup(alignments: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """A1: alignments' CIGARs -> contig_id, pos, read_idx, symbol, mismatch.

    alignments: (read_idx, contig_id, start, strand, cigar); reads: (read_idx,
    seq), strand-corrected by strand (false: reverse complement); contigs:
    (contig_id, seq).  A symbol encodes the central base and the two before it
    (``functions.seq.triplet``), of the alignment's columns: insertions move
    the history without a cell, deletions are cells of '-', clips only move
    along the read.  Symbols of contig and reads thus compare per position.
    """
    from ..functions import seq

    runs = alignments.join(reads.select("read_idx", F.col("seq").alias("rseq")), "read_idx")
    oriented = F.when(F.col("strand"), F.col("rseq")).otherwise(seq.reverse_complement(F.col("rseq")))
    own = contigs.select("contig_id", F.col("seq").alias("cseq"))
    # of the contig, only what lies under the alignment
    under = F.substring("cseq", (F.col("start") + 1).cast("int"), cg.reference_length(F.col("cigar")))
    rows = runs.select("read_idx", "contig_id", "start", "cigar", oriented.alias("oriented")).join(own, "contig_id")
    rows = rows.where(F.col("start") < F.length("cseq")).select("contig_id", "read_idx", F.col("start").cast("long").alias("start"), "cigar", "oriented", under.alias("under"))
    types = dict(alignments.dtypes)
    place = "long" if types["start"] == "bigint" else "int"
    schema = f"contig_id {types['contig_id']}, pos {place}, read_idx {types['read_idx']}, symbol smallint, mismatch boolean"
    return rows.mapInArrow(lambda batches: _cells(batches, place), schema)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _alignment_cells(start: int, cigar: str, oriented: str | None, under: str) -> tuple[np.ndarray, ...]:
    """An alignment's cells: pos, symbol, whether it has one, mismatch, and whether that is known."""
    runs = [(int(n), op) for n, op in re.findall(cg._RUN, cigar)]
    op = np.repeat(np.array([ord(op) for _, op in runs], np.uint8), [n for n, _ in runs])
    is_ = lambda letters: np.isin(op, np.frombuffer(letters.encode(), np.uint8))
    on_r, on_q = is_("MD=X"), is_("MI=XSH")
    r, q = np.cumsum(on_r) - on_r, np.cumsum(on_q) - on_q
    used = is_("M=XDI")
    op, r, q = op[used], r[used], q[used]
    gap = op == ord("D")
    read = _letters(oriented or "")
    # 0: beyond the read's end, an empty string, which stands at the alphabet's begin
    base = np.where(gap, ord("-"), np.append(read, 0)[np.minimum(q, len(read))])
    code = np.full(len(base), -1)
    for k, letter in enumerate(ALPHABET):
        code[base == ord(letter)] = k
    code[base == 0] = 0
    known = gap | (oriented is not None)
    # a column's history; before the first one it is C, then G
    b1, has1 = np.r_[2, code[:-1]][: len(code)], np.r_[False, known[:-1]][: len(code)]
    b2, has2 = np.r_[2, 2, code[:-2]][: len(code)], np.r_[False, False, known[:-2]][: len(code)]
    b1, b2 = np.where(has1, b1, 2), np.where(has2, b2, np.where(has1, 2, 1))
    symbol = 33 + 5 * b2 + b1 + 25 * code
    cells = (op != ord("I")) & (r < len(under))
    r, gap = r[cells], gap[cells]
    return start + r, symbol[cells], known[cells], (base[cells] != _letters(under)[r]) & ~gap, known[cells] | gap


def _cells(batches: Iterator[pa.RecordBatch], place: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cells of alignments, about ``most`` in a batch."""
    for batch in batches:
        ids, held, n = [], [], 0
        for k, (start, cigar, oriented, under) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "cigar", "oriented", "under")))):
            if cigar and under is not None:
                held.append(_alignment_cells(start, cigar, oriented, under))
                ids.append(k)
                n += len(held[-1][0])
            if held and (n >= most or k == batch.num_rows - 1):
                yield _batch(batch, ids, held, place)
                ids, held, n = [], [], 0
        if held:
            yield _batch(batch, ids, held, place)


def _batch(batch: pa.RecordBatch, ids: list[int], held: list[tuple[np.ndarray, ...]], place: str) -> pa.RecordBatch:
    pos, symbol, known, mismatch, sure = (np.concatenate(x) for x in zip(*held))
    at = pa.array(np.repeat(ids, [len(h[0]) for h in held]))
    columns = [batch.column("contig_id").take(at), pa.array(pos, pa.int64() if place == "long" else pa.int32()), batch.column("read_idx").take(at), pa.array(symbol.astype(np.int16), mask=~known), pa.array(mismatch.astype(bool), mask=~sure)]
    return pa.RecordBatch.from_arrays(columns, names=["contig_id", "pos", "read_idx", "symbol", "mismatch"])


def error_rate(alignments: DataFrame, *, cap: float = 0.15) -> DataFrame:
    """A2: (contig_id, matches, mismatches, indels) -> contig_id, error_rate; one row has contig_id null and the capped mean over contigs with errors."""
    each = alignments.groupBy("contig_id").agg((F.sum(F.col("mismatches") + F.col("indels")) / (F.sum(F.col("matches") + F.col("mismatches") + F.col("indels")) + 1)).alias("error_rate"))
    mean = each.where("error_rate > 0").agg(F.least(F.avg("error_rate"), F.lit(cap)).alias("error_rate"))
    return each.unionByName(mean.select(F.lit(None).cast(dict(each.dtypes)["contig_id"]).alias("contig_id"), "error_rate"))


def majority_consensus(cells: DataFrame, *, group: tuple[str, ...] = ("contig", "grp"), pos: str = "pos", allele: str = "allele") -> DataFrame:
    """G13 without external programs: the most frequent allele of each position of a group -> group, pos, base, support."""
    n = cells.groupBy(*group, pos, allele).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*group, F.col(pos).alias("pos")).agg(F.min_by(allele, F.struct(-F.col("n"), allele)).alias("base"), F.max("n").alias("support"))


def strongly_mixed(cells: DataFrame, *, min_reads: int = 5, most: float = 0.95, contig: str = "contig", pos: str = "pos", allele: str = "allele") -> DataFrame:
    """positions with enough reads and no allele that nearly all have -> contig, pos, n, top."""
    n = cells.groupBy(F.col(contig).alias("contig"), F.col(pos).alias("pos"), F.col(allele).alias("a")).agg(F.count(F.lit(1)).alias("m"))
    total = n.groupBy("contig", "pos").agg(F.sum("m").alias("n"), F.max("m").alias("top"))
    return total.where((F.col("n") >= min_reads) & (F.col("top") < most * F.col("n")))


def spanning(cells: DataFrame, *, coverage: float = 0.6, contig: str = "contig", pos: str = "pos", read: str = "read_idx") -> DataFrame:
    """cells of reads that reach the first and the last third of a contig's positions, at positions that enough of them cover."""
    positions = cells.select(F.col(contig).alias("contig"), F.col(pos).alias("pos")).distinct()
    order = Window.partitionBy("contig").orderBy("pos")
    third = positions.withColumn("third", F.ntile(3).over(order))
    placed = cells.withColumnRenamed(contig, "contig").withColumnRenamed(pos, "pos").join(third, ["contig", "pos"])
    reach = placed.groupBy("contig", F.col(read).alias("read_idx")).agg(F.min("third").alias("lo"), F.max("third").alias("hi")).where("lo = 1 and hi = 3")
    inside = placed.withColumnRenamed(read, "read_idx").join(reach.select("contig", "read_idx"), ["contig", "read_idx"])
    rows = reach.groupBy("contig").agg(F.count(F.lit(1)).alias("rows"))
    full = inside.groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("n")).join(rows, "contig").where(F.col("n") >= coverage * F.col("rows"))
    return inside.join(full.select("contig", "pos"), ["contig", "pos"]).drop("third")


def overlap_depth(alignments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Aligned bases over length -> contig, depth; alignments: (contig, start_c, end_c), lengths: (contig, len)."""
    bases = alignments.groupBy("contig").agg(F.sum(F.col("end_c") - F.col("start_c")).alias("bases"))
    return lengths.join(bases, "contig", "left").select("contig", F.try_divide(F.coalesce("bases", F.lit(0)).cast("double"), F.col("len")).alias("depth"))

"""Parsers of text lines.  Each takes lines (a ``value`` column, or ``lines.read_lines``) and gives typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import seq as sq
from .lines import fill_down


def _tag(value: str, name: str) -> Column:
    """The text of an optional field NAME:type:text."""
    return F.nullif(F.regexp_extract(value, rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))


def fastq(lines: DataFrame) -> DataFrame:
    """Four lines a record -> file, read_idx, name (up to the first blank), len, seq, qual."""
    record = lines.withColumn("read_idx", F.floor(F.col("line_no") / 4))
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    rows = record.groupBy("file", "read_idx").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    return rows.select("file", "read_idx", F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.length("seq").alias("len"), "seq", "qual")


def fasta(lines: DataFrame) -> DataFrame:
    """-> file, section, name, len, seq; sequences may span lines."""
    filled = fill_down(lines, F.col("value").startswith(">"))
    body = F.sort_array(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line_no", F.trim("value").alias("v")))))
    rows = filled.groupBy("file", "section").agg(F.max(F.when(F.col("line_no") == F.col("section"), F.col("value"))).alias("head"), body.alias("b"))
    rows = rows.withColumn("seq", F.array_join(F.transform("b", lambda x: x["v"]), ""))
    return rows.select("file", "section", F.regexp_extract("head", r"^>(\S*)", 1).alias("name"), F.length("seq").alias("len"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA in splits at record borders -> name, len, seq; no numbering, one pass."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", "^>", "")
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(F.regexp_extract(text, r"^(\S*)", 1).alias("name"), F.length(body).alias("len"), body.alias("seq"))


def gfa_segments(lines: DataFrame) -> DataFrame:
    """S lines -> name, len, seq, depth (dp or DP; else RC or KC over the length; else null), tags."""
    f = F.split("value", "\t")
    rows = lines.where(F.col("value").startswith("S\t"))
    size = F.length(F.get(f, F.lit(2)))
    depth = F.coalesce(_tag("value", "[dD][pP]").try_cast("double"), _tag("value", "[RK]C").try_cast("double") / size)
    return rows.select(F.get(f, F.lit(1)).alias("name"), size.alias("len"), F.get(f, F.lit(2)).alias("seq"), depth.alias("depth"), F.array_join(F.slice(f, 4, 1000), "\t").alias("tags"))


def gfa_links(lines: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """L lines, each link once -> n1, e1, n2, e2, cigar.

    + on the first contig leaves its right end (1), + on the second enters the
    left (0).  With segments, a link to an unknown contig is an error.
    """
    f = F.split("value", "\t")
    rows = lines.where(F.col("value").startswith("L\t"))
    e1, e2 = F.when(F.get(f, F.lit(2)) == "+", 1).otherwise(0), F.when(F.get(f, F.lit(4)) == "+", 0).otherwise(1)
    links = rows.select(F.get(f, F.lit(1)).alias("a"), e1.alias("ea"), F.get(f, F.lit(3)).alias("b"), e2.alias("eb"), F.coalesce(F.get(f, F.lit(5)), F.lit("*")).alias("cigar"))
    swap = (F.col("b") < F.col("a")) | ((F.col("b") == F.col("a")) & (F.col("eb") < F.col("ea")))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    links = links.select(pick("a", "b").alias("n1"), pick("ea", "eb").alias("e1"), pick("b", "a").alias("n2"), pick("eb", "ea").alias("e2"), "cigar").dropDuplicates(["n1", "e1", "n2", "e2"])
    if segments is not None:
        names = segments.select(F.col("name").alias("known"))
        unknown = links.select(F.explode(F.array("n1", "n2")).alias("known")).join(names, "known", "left_anti").first()
        if unknown:
            raise ValueError(f"link to a contig that isn't there: {unknown[0]}")
    return links


def sam(lines: DataFrame, *, amplicon: bool = False) -> DataFrame:
    """Mapped primary and supplementary records -> name, contig, ts, te, qs, qe, qlen, strand, cigar, flag, mapq, nm.

    Dropped: headers, short lines, unmapped and secondary records; primaries
    hard-clipped over 20 % of LN; of amplicons those with NM above 20 % of the
    alignment.  Coordinates are 0-based, half-open (Q9), qs and qe on the
    read's own strand.
    """
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).where(F.size(f) >= 11)
    flag = F.get(f, F.lit(1)).try_cast("int")
    rows = rows.select(F.get(f, F.lit(0)).alias("name"), flag.alias("flag"), F.get(f, F.lit(2)).alias("contig"), (F.get(f, F.lit(3)).try_cast("int") - 1).alias("ts"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"), F.get(f, F.lit(9)).alias("seq"), _tag("value", "LN").try_cast("int").alias("ln"), F.coalesce(_tag("value", "NM").try_cast("int"), F.lit(0)).alias("nm"))
    bits = sq.flags(F.col("flag"))
    rows = rows.where(~bits["unmapped"] & ~bits["secondary"] & (F.col("cigar") != "*"))
    head, tail = cg.clips(F.col("cigar"), ~bits["reverse"])
    span = cg.query_length(F.col("cigar"))
    rows = rows.select("name", "contig", "flag", "mapq", "cigar", "nm", (~bits["reverse"]).alias("strand"), "ts", (F.col("ts") + cg.reference_length(F.col("cigar"))).alias("te"), head.alias("qs"), (head + span).alias("qe"),
        F.coalesce("ln", F.when(F.col("seq") != "*", F.length("seq")), head + span + tail).alias("qlen"), cg.sum_of(F.col("cigar"), "H").alias("hard"), bits["supplementary"].alias("supplementary"))
    rows = rows.where(F.col("supplementary") | (F.col("hard") <= 0.2 * F.col("qlen")))
    if amplicon:
        rows = rows.where(F.col("nm") <= 0.2 * (F.col("qe") - F.col("qs")))
    return rows.drop("hard", "supplementary")


def paf(lines: DataFrame, *, end_to_end: bool = False) -> DataFrame:
    """12 columns, cg and dv -> name, qlen, qs, qe, strand, contig, tlen, ts, te, matches, span, mapq, cigar, dv.

    ``end_to_end`` keeps mapq above 5 whose overhangs, on both, are within
    min(1000, length / 7) at one side each, and extends them to the ends.
    """
    f = F.split("value", "\t")
    ints = {"qlen": 1, "qs": 2, "qe": 3, "tlen": 6, "ts": 7, "te": 8, "matches": 9, "span": 10, "mapq": 11}
    rows = lines.where(F.size(f) >= 12).select(F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(5)).alias("contig"), (F.get(f, F.lit(4)) == "+").alias("strand"), *[F.get(f, F.lit(k)).try_cast("int").alias(c) for c, k in ints.items()], _tag("value", "cg").alias("cigar"), _tag("value", "dv").try_cast("double").alias("dv"))
    if not end_to_end:
        return rows
    slack = F.least(F.lit(1000.0), F.least("qlen", "tlen") / 7)
    left_t = F.when(F.col("strand"), F.col("ts")).otherwise(F.col("tlen") - F.col("te"))
    right_t = F.when(F.col("strand"), F.col("tlen") - F.col("te")).otherwise(F.col("ts"))
    before, after = F.least("qs", left_t), F.least(F.col("qlen") - F.col("qe"), right_t)
    kept = rows.withColumn("_b", before).withColumn("_a", after).where((F.col("mapq") > 5) & (F.col("_b") <= slack) & (F.col("_a") <= slack))
    forward = F.col("strand")
    moved = kept.select("*", (F.col("qs") - F.col("_b")).alias("_qs"), (F.col("qe") + F.col("_a")).alias("_qe"), (F.col("ts") - F.when(forward, F.col("_b")).otherwise(F.col("_a"))).alias("_ts"), (F.col("te") + F.when(forward, F.col("_a")).otherwise(F.col("_b"))).alias("_te"))
    return moved.select(*[F.col(f"_{c}").alias(c) if c in ("qs", "qe", "ts", "te") else F.col(c) for c in rows.columns])


def contained_reads(overlaps: DataFrame) -> DataFrame:
    """Of two reads that overlap in over half of the shorter, the shorter isn't a backbone -> name; ties drop the larger name."""
    over = overlaps.where((F.col("qe") - F.col("qs") > 0.5 * F.least("qlen", "tlen")) & (F.col("name") != F.col("contig")))
    first = (F.col("qlen") < F.col("tlen")) | ((F.col("qlen") == F.col("tlen")) & (F.col("name") > F.col("contig")))
    return over.select(F.when(first, F.col("name")).otherwise(F.col("contig")).alias("name")).distinct()


def gaf(lines: DataFrame, *, identity: float = 0.0, mapped: float = 0.0, mapq: int | None = None, least_steps: int = 1) -> DataFrame:
    """-> name, qlen, qs, qe, path, mapq, identity; six columns suffice.

    A bound of 0 keeps rows without the field; ``mapq`` asks for that value;
    S9 takes paths of two steps or more.
    """
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 6).select(F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).try_cast("int").alias("qlen"), F.get(f, F.lit(2)).try_cast("int").alias("qs"), F.get(f, F.lit(3)).try_cast("int").alias("qe"), F.get(f, F.lit(5)).alias("path"), F.get(f, F.lit(11)).try_cast("int").alias("mapq"), _tag("value", "id").try_cast("double").alias("identity"))
    rows = rows.where(F.size(F.regexp_extract_all("path", F.lit("[<>]"), F.lit(0))) >= least_steps)
    if identity > 0:
        rows = rows.where(F.col("identity").isNull() | (F.col("identity") > identity))
    if mapped > 0:
        rows = rows.where((F.col("qe") - F.col("qs")) / F.col("qlen") > mapped)
    return rows if mapq is None else rows.where(F.col("mapq") == mapq)


def path_steps(rows: DataFrame, *, name: str = "name") -> DataFrame:
    """Parsed paths -> read_idx, idx (from 1), contig, orient."""
    from ..functions import paths

    return rows.select(F.col(name).alias("read_idx"), F.posexplode(paths.parse(F.col("path"))).alias("k", "s")).select("read_idx", (F.col("k") + 1).try_cast("long").alias("idx"), F.col("s.contig").alias("contig"), F.col("s.orient").alias("orient"))


def spaligner(lines: DataFrame) -> DataFrame:
    """Column 6 has alignments by ; and contigs with signs by , -> name, part, path (two contigs or more)."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 6).select(F.get(f, F.lit(0)).alias("name"), F.posexplode(F.split(F.get(f, F.lit(5)), ";")).alias("part", "steps"))
    step = F.transform(F.filter(F.split("steps", ","), lambda x: F.trim(x) != ""), lambda x: F.concat(F.when(F.trim(x).endswith("+"), ">").otherwise("<"), F.regexp_replace(F.trim(x), "[+-]$", "")))
    return rows.where(F.size(step) >= 2).select("name", "part", F.array_join(step, "").alias("path"))


def _sections(lines: DataFrame) -> DataFrame:
    """Lines under a CONTIG line, with its name, length and depth."""
    filled = fill_down(lines, F.col("value").startswith("CONTIG\t"))
    f = F.split("value", "\t")
    heads = filled.where(F.col("line_no") == F.col("section")).select("file", "section", F.get(f, F.lit(1)).alias("contig"), F.get(f, F.lit(2)).try_cast("int").alias("contig_len"), F.get(f, F.lit(3)).try_cast("double").alias("contig_depth"))
    return filled.where(F.col("line_no") != F.col("section")).join(heads, ["file", "section"])


def _read_rows(rows: DataFrame) -> DataFrame:
    """READ lines, numbered within their contig."""
    f = F.split("value", "\t")
    order = Window.partitionBy("file", "section").orderBy("line_no")
    reads = rows.where(F.col("value").startswith("READ\t"))
    return reads.select("file", "section", "contig", (F.row_number().over(order) - 1).try_cast("int").alias("read_idx"), F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(2)).try_cast("int").alias("start"), F.get(f, F.lit(3)).try_cast("int").alias("end"))


def col(lines: DataFrame, *, abundance: float = 0.0, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """-> reads (contig, read_idx, name, start, end), cells (contig, pos, read_idx, allele, ref, alt).

    SNPS lines hold position, reference, alternative, and comma-separated read
    numbers and symbols.  Sites whose alternative is rarer than ``abundance``
    go; at most ``cap`` reads of a site stay, in their order.
    """
    rows = _sections(lines)
    f = F.split("value", "\t")
    snps = rows.where(F.col("value").startswith("SNPS\t")).select("contig", F.get(f, F.lit(1)).try_cast("int").alias("pos"), F.get(f, F.lit(2)).alias("ref"), F.get(f, F.lit(3)).alias("alt"), F.filter(F.split(F.get(f, F.lit(4)), ","), lambda x: x != "").alias("r"), F.filter(F.split(F.get(f, F.lit(5)), ","), lambda x: x != "").alias("a"))
    both = F.arrays_zip("r", "a")
    cells = snps.select("contig", "pos", "ref", "alt", "a", F.posexplode(both).alias("k", "x"))
    n = lambda c: F.size(F.filter("a", lambda x: x == F.col(c)))
    if abundance:
        cells = cells.where(n("alt") >= abundance * (n("ref") + n("alt")))
    if cap is not None:
        cells = cells.where(F.col("k") < cap)
    return _read_rows(rows).drop("file", "section"), cells.select("contig", "pos", F.col("x.r").try_cast("int").alias("read_idx"), F.col("x.a").alias("allele"), "ref", "alt")


def gro(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> reads, groups (contig, win_start, win_end, read_idx, grp).  Reads that a GROUP line doesn't name have no row; empty lists are skipped."""
    rows = _sections(lines)
    f = F.split("value", "\t")
    groups = rows.where(F.col("value").startswith("GROUP\t")).select("contig", F.get(f, F.lit(1)).try_cast("int").alias("win_start"), F.get(f, F.lit(2)).try_cast("int").alias("win_end"), F.filter(F.split(F.get(f, F.lit(3)), ","), lambda x: x != "").alias("r"), F.filter(F.split(F.get(f, F.lit(4)), ","), lambda x: x != "").alias("g"))
    each = groups.select("contig", "win_start", "win_end", F.explode(F.arrays_zip("r", "g")).alias("x"))
    return _read_rows(rows).drop("file", "section"), each.select("contig", "win_start", "win_end", F.col("x.r").try_cast("int").alias("read_idx"), F.col("x.g").try_cast("int").alias("grp"))


def ploidy(lines: DataFrame) -> DataFrame:
    """Contig and ploidy -> contig, ploidy"""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("int").alias("ploidy")).where("ploidy is not null")


def fragments(lines: DataFrame) -> DataFrame:
    """Tab-separated with a header line; contacts refer to row numbers -> fragment, contig, start, end, size"""
    f = F.split("value", "\t")
    rows = lines.where((F.col("line_no") > 0) & (F.size(f) >= 5))
    return rows.select((F.col("line_no") - 1).alias("fragment"), F.get(f, F.lit(1)).alias("contig"), F.get(f, F.lit(2)).try_cast("int").alias("start"), F.get(f, F.lit(3)).try_cast("int").alias("end"), F.get(f, F.lit(4)).try_cast("int").alias("size"))


def contact_pairs(lines: DataFrame) -> DataFrame:
    """Fragment pairs, header dropped -> f1, f2, n"""
    f = F.split("value", "\t")
    return lines.where((F.col("line_no") > 0) & (F.size(f) >= 3)).select(F.get(f, F.lit(0)).try_cast("long").alias("f1"), F.get(f, F.lit(1)).try_cast("long").alias("f2"), F.get(f, F.lit(2)).try_cast("long").alias("n"))


def barcodes(lines: DataFrame) -> DataFrame:
    """Mapped SAM records with BX or BC -> barcode, contig"""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).where(F.size(f) >= 11)
    return rows.select(F.coalesce(_tag("value", "BX"), _tag("value", "BC")).alias("barcode"), F.get(f, F.lit(2)).alias("contig")).where("barcode is not null and contig <> '*'")


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A Parquet matrix (i, j, v) -> the matrix, and each row's sum.  Pickles aren't read."""
    matrix = spark.read.parquet(path).select("i", "j", "v")
    return matrix, matrix.groupBy("i").agg(F.sum("v").alias("coverage"))

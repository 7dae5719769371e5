"""Queries on sequential kernels and biclusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bicluster, kernels, pileup, windows
from .catalog import query, table, view
from .graph_queries import contigs as graph_contigs
from .graph_queries import links, matrix


@query("A1_pileup_build")
def a1(spark, sf_dir):
    seqs = view(spark, sf_dir, "v_seq").where(F.length("seq") >= 60)
    reads = seqs.select(F.col("contig").alias("read_idx"), F.substring("seq", F.lit(11), F.length("seq")).alias("seq"))
    cigar = F.concat(F.lit("2S18M2D3I"), (F.length("seq") - 23).cast("string"), F.lit("M"))
    aln = reads.select("read_idx", F.col("read_idx").alias("contig_id"), F.lit(10).alias("start"), F.lit(True).alias("strand"), cigar.alias("cigar"))
    return pileup.build_pileup(aln, reads, seqs.select(F.col("contig").alias("contig_id"), "seq"))


@query("C10_infix_align", "select contig, cast(0 as bigint) as distance, instr(seq, substr(seq, 31, 40)) - 1 as start from v_seq where length(seq) >= 120")
def c10(spark, sf_dir):
    """Exact infixes are found where they first end."""
    rows = view(spark, sf_dir, "v_seq").where(F.length("seq") >= 120).select("contig", F.substring("seq", 31, 40).alias("query"), F.col("seq").alias("target"))
    return kernels.infix_align(rows).select("contig", "distance", "start")


@query("C11_greedy_align")
def c11(spark, sf_dir):
    """Every piece of 90 letters of the whole texts, against itself without two letters."""
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 90).cast("int"))).alias("piece")
    pieces = view(spark, sf_dir, "v_seq").where(F.length("seq") > 0).select("contig", "seq", starts)
    pieces = pieces.select("contig", "piece", F.substring(F.col("seq"), F.col("piece") * 90 + 1, F.lit(90)).alias("query"))
    rows = pieces.select("contig", "piece", "query", F.concat(F.substring("query", 1, 20), F.substring("query", 23, 90)).alias("target"))
    return kernels.greedy_align(rows).select("contig", "piece", "cigar")


@query("C21_alternative_backbone")
def c21(spark, sf_dir):
    seqs = view(spark, sf_dir, "v_seq").where(F.length("seq") >= 60).select("contig", "seq")
    aln = seqs.select("contig", F.explode(F.array(F.lit(5), F.lit(15), F.lit(45))).alias("ts")).select("contig", "ts", (F.col("ts") + 12).alias("te"), F.lit("ACGTACGTACGT").alias("piece"))
    return kernels.alternative_backbone(seqs, aln)


def _split(spark, sf_dir):
    seqs = view(spark, sf_dir, "v_seq").where(F.length("seq") >= 60).select("contig", "seq")
    wins = seqs.select("contig", F.posexplode(F.array(F.lit(0), F.lit(20))).alias("w", "win_start"))
    intervals = wins.select("contig", "win_start", (F.col("win_start") + 20).alias("win_end"), F.explode(F.array(F.lit(0), F.lit(1))).alias("grp"))
    stitched = intervals.where("win_start = 20 and grp = 0").select("contig", "win_start", "grp", F.lit(1).alias("before"))
    return kernels.split_contigs(seqs, intervals, stitched, links(spark, sf_dir))


@query(
    "G12_split_contigs",
    """with p as (select contig, s as win_start, e as win_end, g as grp from v_seq, (values (0, 20, 0), (0, 20, 1), (20, 40, 0), (20, 40, 1)) v(s, e, g) where length(seq) >= 60 union all select contig, 40, length(seq), 0 from v_seq where length(seq) >= 60)
select contig || '_' || win_start || '_' || grp as name, contig as old, cast(win_start as bigint) as win_start, cast(win_end as bigint) as win_end, grp, substr(seq, cast(win_start + 1 as integer), cast(win_end - win_start as integer)) as seq from p join v_seq using (contig)""",
)
def g12(spark, sf_dir):
    return _split(spark, sf_dir)[0]


@query("G12_split_links")
def g12l(spark, sf_dir):
    return _split(spark, sf_dir)[1]


@query("G14_basic_assembly")
def g14(spark, sf_dir):
    rows = view(spark, sf_dir, "v_aln")
    both = rows.alias("a").join(rows.alias("b"), "read_idx").where("a.ord < b.ord").select(F.col("read_idx").alias("group"), F.col("a.ord").alias("left"), F.col("b.ord").alias("right"), F.abs(F.col("b.start_c") - F.col("a.start_c")).alias("shift"), F.col("a.ord").alias("overlap"))
    return kernels.layout(both)


@query("G22_knots")
def g22k(spark, sf_dir):
    return kernels.knots(links(spark, sf_dir), graph_contigs(spark, sf_dir).where("contig % 2 = 0").select("contig"))


@query("G22_match_knots")
def g22m(spark, sf_dir):
    return kernels.match_knots(g22k(spark, sf_dir), matrix(spark, sf_dir))


@query(
    "G28_bluntify_cuts",
    """with o as (select n1 as contig, e1 as e, (n1 * 7 + n2) % 60 as v from t_link union all select n2, e2, (n1 * 7 + n2) % 60 from t_link),
m as (select contig, coalesce(max(case when e = 0 then v end), 0) as l, coalesce(max(case when e = 1 then v end), 0) as r from o where v > 0 group by contig),
k as (select o.contig, case when e = 0 then v else len - v end as pos from o join m on m.contig = o.contig join t_ctg c on c.contig = o.contig where v > 0 and l + r < len),
p as (select contig, pos from k join t_ctg c using (contig) where pos > 0 and pos < len union select contig, 0 from t_ctg union select contig, len from t_ctg)
select contig, lo, hi from (select contig, cast(pos as bigint) as lo, cast(lead(pos) over (partition by contig order by pos) as bigint) as hi from p) t where hi is not null""",
)
def g28(spark, sf_dir):
    return kernels.cut_overlaps(graph_contigs(spark, sf_dir).select("contig", "len"), links(spark, sf_dir).withColumn("overlap", (F.col("n1") * 7 + F.col("n2")) % 60))


def _values(spark, sf_dir, width):
    cells = view(spark, sf_dir, "v_pileup_event")
    return cells.select("contig", F.floor(F.col("pos") / width).alias("win"), "read_idx", "pos", F.col("allele").isin("A", "C").cast("int").alias("v"))


@query("G36_biclustering")
def g36(spark, sf_dir):
    return bicluster.haplotypes(_values(spark, sf_dir, 12))


@query("G34_bihap_preprocess")
def g34(spark, sf_dir):
    """Two planted splits of the users, each in eight hours, and eight hours of noise."""
    hour, user = F.hour("ts"), F.col("user_id")
    v = F.when(hour % 3 == 0, user % 2).when(hour % 3 == 1, F.floor(user / 2) % 2).otherwise((F.col("event_type") == "click").cast("long"))
    rows = table(spark, sf_dir, "events").select((F.dayofmonth("ts") > 15).cast("int").alias("contig"), F.lit(0).alias("win"), user.alias("read_idx"), hour.alias("pos"), v.cast("int").alias("v"))
    return bicluster.window_regions(rows.groupBy("contig", "win", "read_idx", "pos").agg(F.max("v").alias("v")))


@query("G35_quasibiclique")
def g35(spark, sf_dir):
    return bicluster.window_blocks(_values(spark, sf_dir, 12))


@query(
    "A26_cluster_mean_vector",
    "select contig, cast(floor(pos / 12) as bigint) as win, cast(read_idx % 3 as bigint) as label, pos, cast(round_even(avg(case when allele in ('A', 'C') then 1 else 0 end), 0) as integer) as mean from v_pileup_event group by all",
)
def a26(spark, sf_dir):
    values = _values(spark, sf_dir, 12)
    labels = values.select("contig", "win", "read_idx", (F.col("read_idx") % 3).cast("long").alias("label")).distinct()
    return bicluster.mean_vectors(values, labels)


@query("G32_reassemble_unaligned", "select cast(read_idx as bigint) as read_idx, count(*) as n from (select read_idx, start_c - coalesce(max(end_c) over (partition by read_idx order by start_c, end_c rows between unbounded preceding and 1 preceding), 0) as gap from v_aln union all select read_idx, 2500 - max(end_c) from v_aln group by read_idx union all select o_orderkey, 2500 from orders where o_orderkey not in (select read_idx from v_aln)) t where gap > 100 group by read_idx")
def g32(spark, sf_dir):
    rows = view(spark, sf_dir, "v_aln")
    lengths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_idx"), F.lit(2500).cast("long").alias("len"))
    return windows.unaligned_gaps(rows, lengths, least=100, start="start_c", end="end_c").groupBy("read_idx").agg(F.count(F.lit(1)).alias("n"))

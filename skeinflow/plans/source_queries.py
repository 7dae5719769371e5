"""Queries on readers and writers: tables are written as lines of a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly_graph as ag
from ..sources import formats, sinks
from .catalog import PARTS, query, table, view
from .graph_queries import contigs as graph_contigs
from .graph_queries import links as graph_links

PARTS["t_doc"] = "select 'r' || contig as name, seq, contig from v_seq where length(seq) >= 20"


def _seqs(spark, sf_dir):
    return view(spark, sf_dir, "v_seq").where(F.length("seq") >= 20).select(F.concat(F.lit("r"), F.col("contig").cast("string")).alias("name"), "seq", "contig")


def _lines(df, per: int, *values):
    """Rows as lines; ``values`` are a row's lines, numbered by the row's number."""
    each = df.select("*", F.posexplode(F.array(*values)).alias("k", "value"))
    return each.select(F.lit("f").alias("file"), F.lit(0).alias("block"), (F.col("contig") * per + F.col("k")).alias("line_no"), "value")


@query("S1_scan_reads", "select name, length(seq) as len, seq, repeat('I', cast(length(seq) as integer)) as qual from t_doc")
def s1(spark, sf_dir):
    rows = _seqs(spark, sf_dir)
    lines = _lines(rows, 4, F.concat(F.lit("@"), "name", F.lit(" extra")), F.col("seq"), F.lit("+"), F.repeat(F.lit("I"), F.length("seq")))
    return formats.fastq(lines).select("name", F.col("len").cast("long").alias("len"), "seq", "qual")


@query("S1_scan_fasta", "select name, length(seq) as len, seq from t_doc")
def s1f(spark, sf_dir):
    rows = _seqs(spark, sf_dir)
    lines = _lines(rows, 3, F.concat(F.lit(">"), "name", F.lit(" extra")), F.substring("seq", 1, 10), F.substring("seq", F.lit(11), F.length("seq")))
    return formats.fasta(lines).select("name", F.col("len").cast("long").alias("len"), "seq")


def _gfa(spark, sf_dir):
    s = _seqs(spark, sf_dir).select(F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("LN:i:"), F.length("seq").cast("string")), F.concat(F.lit("DP:f:"), (F.col("contig") % 7 + 0.5).cast("string"))).alias("value"))
    l = graph_links(spark, sf_dir).select(F.concat_ws("\t", F.lit("L"), F.col("n1").cast("string"), F.when(F.col("e1") == 1, "+").otherwise("-"), F.col("n2").cast("string"), F.when(F.col("e2") == 0, "+").otherwise("-"), F.lit("0M")).alias("value"))  # noqa: E741
    return s, l


@query("S2_scan_gfa_segments", "select name, length(seq) as len, seq, contig % 7 + 0.5e0 as depth from t_doc")
def s2(spark, sf_dir):
    return formats.gfa_segments(_gfa(spark, sf_dir)[0]).select("name", F.col("len").cast("long").alias("len"), "seq", "depth")


_LINK = "select case when s then b else a end as n1, case when s then eb else ea end as e1, case when s then a else b end as n2, case when s then ea else eb end as e2, '0M' as cigar from (select *, b < a as s from (select cast(n1 as varchar) as a, e1 as ea, cast(n2 as varchar) as b, e2 as eb from t_link) x) y"


@query("S3_scan_gfa_links", _LINK)
def s3(spark, sf_dir):
    return formats.gfa_links(_gfa(spark, sf_dir)[1])


@query("S4_scan_gfa_py", _LINK)
def s4(spark, sf_dir):
    s, l = _gfa(spark, sf_dir)  # noqa: E741
    names = graph_contigs(spark, sf_dir).select(F.concat_ws("\t", F.lit("S"), F.col("contig").cast("string"), F.lit("ACGT")).alias("value"))
    lines = s.unionByName(names).unionByName(l).unionByName(l)
    return formats.gfa_links(lines, formats.gfa_segments(lines))


@query("S5_scan_gfa_parallel", "select count(*) as segments, cast(sum(length(seq)) as bigint) as bases from t_doc")
def s5(spark, sf_dir):
    return formats.gfa_segments(_gfa(spark, sf_dir)[0]).agg(F.count(F.lit(1)).alias("segments"), F.sum("len").alias("bases"))


PARTS["t_sam"] = "select read_idx, ln, part, supp, cigar, cast(ln * 4 + case when part % 3 = 0 then 16 else 0 end + case when part % 11 = 0 then 256 else 0 end as integer) & ~4 as flag0, case when part % 13 = 0 then 4 else 0 end as un, cast(regexp_extract(cigar, '^(\\d+)S', 1) as integer) as clip from v_cigar"


def _sam(spark, sf_dir):
    rows = view(spark, sf_dir, "v_cigar")
    flag = F.when(F.col("part") % 3 == 0, 16).otherwise(0) + F.when(F.col("part") % 11 == 0, 256).otherwise(0) + F.when(F.col("part") % 13 == 0, 4).otherwise(0)
    fields = [F.col("read_idx"), flag, F.col("supp"), F.col("part"), F.lit(60), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.lit("NM:i:3")]
    return rows.select(F.concat_ws("\t", *[c.cast("string") for c in fields]).alias("value"))


@query(
    "S6_scan_sam",
    """with r as (select read_idx, supp, part, cigar, part % 3 = 0 as rev, list_transform(regexp_extract_all(cigar, '(\\d+)[A-Z]', 1), lambda x: cast(x as integer)) as n from v_cigar where part % 11 <> 0 and part % 13 <> 0)
select cast(read_idx as varchar) as name, cast(supp as varchar) as contig, not rev as strand, part - 1 as ts, part - 1 + n[2] + n[4] + n[5] as te, case when rev then 0 else n[1] end as qs, case when rev then 0 else n[1] end + n[2] + n[3] + n[5] as qe, n[1] + n[2] + n[3] + n[5] as qlen from r""",
)
def s6(spark, sf_dir):
    rows = formats.sam(_sam(spark, sf_dir))
    return rows.select("name", "contig", "strand", *[F.col(c).cast("long").alias(c) for c in ("ts", "te", "qs", "qe", "qlen")])


@query("K9_sink_bam2paf", "select count(*) as n from v_cigar where part % 11 <> 0 and part % 13 <> 0")
def k9(spark, sf_dir):
    return formats.paf(sinks.sam_to_paf(formats.sam(_sam(spark, sf_dir)))).agg(F.count(F.lit(1)).alias("n"))


def _paf(spark, sf_dir):
    rows = view(spark, sf_dir, "v_aln")
    fields = [F.concat(F.lit("r"), F.col("read_idx").cast("string")), F.lit(3000), F.col("start_c"), F.col("end_c"), F.when(F.col("strand") == 1, "+").otherwise("-"), F.concat(F.lit("c"), F.col("contig").cast("string")), F.lit(2500), F.col("start_c"), F.col("end_c"), F.lit(10), F.lit(20), F.col("ord") * 4, F.lit("dv:f:0.25")]
    return rows.select(F.concat_ws("\t", *[c.cast("string") for c in fields]).alias("value"))


@query(
    "S7_scan_paf",
    """with a as (select 'r' || read_idx as name, 'c' || contig as contig, strand = 1 as strand, cast(start_c as integer) as s, cast(end_c as integer) as e, ord * 4 as mapq from v_aln),
b as (select *, least(s, case when strand then s else 2500 - e end) as b, least(3000 - e, case when strand then 2500 - e else s end) as f from a)
select name, contig, strand, s - b as qs, e + f as qe, s - case when strand then b else f end as ts, e + case when strand then f else b end as te from b where mapq > 5 and b <= 2500 / 7.0 and f <= 2500 / 7.0""",
)
def s7(spark, sf_dir):
    return formats.paf(_paf(spark, sf_dir), end_to_end=True).select("name", "contig", "strand", "qs", "qe", "ts", "te")


@query("S8_paf_backbones", "select distinct case when l_partkey < l_suppkey * 10 or (l_partkey = l_suppkey * 10 and l_orderkey > l_suppkey) then l_orderkey else l_suppkey end as name from lineitem where l_quantity * 8 > 0.5 * least(l_partkey, l_suppkey * 10) and l_orderkey <> l_suppkey")
def s8(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("contig"), F.lit(0).alias("qs"), (F.col("l_quantity") * 8).alias("qe"), F.col("l_partkey").alias("qlen"), (F.col("l_suppkey") * 10).alias("tlen"))
    return formats.contained_reads(rows)


PARTS["t_gaf"] = "select read_idx, string_agg(orient || contig, '' order by idx) as path, count(*) as n from v_path_step group by read_idx"


def _gaf(spark, sf_dir):
    order = F.sort_array(F.collect_list(F.struct("idx", F.concat("orient", F.col("contig").cast("string")).alias("s"))))
    paths = view(spark, sf_dir, "v_path_step").groupBy("read_idx").agg(F.array_join(F.transform(order, lambda x: x["s"]), "").alias("path"))
    fields = [F.col("read_idx"), F.lit(100), F.lit(0), F.col("read_idx") % 101, F.lit("+"), F.col("path"), F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.when(F.col("read_idx") % 2 == 0, 60).otherwise(20), F.concat(F.lit("id:f:0."), (F.col("read_idx") % 9 + 1).cast("string"))]
    return paths.select(F.concat_ws("\t", *[c.cast("string") for c in fields]).alias("value"))


@query("S9_scan_gaf", "select cast(read_idx as varchar) as name, path from t_gaf where n >= 2 and (read_idx % 9 + 1) / 10.0 > 0.5 and (read_idx % 101) / 100.0 > 0.3")
def s9(spark, sf_dir):
    return formats.gaf(_gaf(spark, sf_dir), identity=0.5, mapped=0.3, least_steps=2).select("name", "path")


@query("S10_scan_gaf_full", "select cast(read_idx as varchar) as name, path from t_gaf where read_idx % 2 = 0")
def s10(spark, sf_dir):
    return formats.gaf(_gaf(spark, sf_dir), mapq=60).select("name", "path")


@query("S11_scan_spaligner_tsv", "select cast(read_idx as varchar) as name, cast(0 as integer) as part, path from t_gaf where n >= 2")
def s11(spark, sf_dir):
    order = F.sort_array(F.collect_list(F.struct("idx", F.concat(F.col("contig").cast("string"), F.when(F.col("orient") == ">", "+").otherwise("-")).alias("s"))))
    rows = view(spark, sf_dir, "v_path_step").groupBy("read_idx").agg(F.array_join(F.transform(order, lambda x: x["s"]), ",").alias("steps"))
    return formats.spaligner(rows.select(F.concat_ws("\t", F.col("read_idx").cast("string"), *[F.lit("0")] * 4, F.concat("steps", F.lit(";"))).alias("value")))


def _numbered(lines):
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("contig", "kind", "place", "value")
    rows = lines.withColumn("file", F.lit("f")).withColumn("line_no", F.row_number().over(order).cast("long") - 1)
    return rows.select("file", F.floor(F.col("line_no") / 500).alias("block"), "line_no", "value")


def _contigs(cells):
    return cells.select("contig").distinct().select("contig", F.lit(1000).alias("len"), F.lit(2.5).alias("depth"))


def _reads(cells):
    return cells.groupBy("contig").agg(F.max("read_idx").alias("n")).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("read_idx")).select("contig", "read_idx", F.concat(F.lit("n"), F.col("read_idx").cast("string")).alias("name"), F.lit(0).alias("start"), F.lit(9).alias("end"))


@query("S12_scan_col", "select cast(v.contig as varchar) as contig, v.pos, cast(v.read_idx as integer) as read_idx, v.allele from v_pileup_event v join (select contig, pos, max(allele) as alt, min(allele) as ref from v_pileup_event group by all) s on s.contig = v.contig and s.pos = v.pos")
def s12(spark, sf_dir):
    cells = view(spark, sf_dir, "v_pileup_event")
    named = cells.join(cells.groupBy("contig", "pos").agg(F.min("allele").alias("ref"), F.max("allele").alias("alt")), ["contig", "pos"])
    lines = sinks.col_lines(_contigs(cells), _reads(cells), named)
    return formats.col(_numbered(lines))[1].select("contig", "pos", "read_idx", "allele")


@query("K1_sink_col", "select 'SNPS' || chr(9) || pos || chr(9) || min(allele) || chr(9) || max(allele) || chr(9) || string_agg(read_idx, ',' order by read_idx) || chr(9) || string_agg(allele, ',' order by read_idx) as value from v_pileup_event group by contig, pos")
def k1(spark, sf_dir):
    cells = view(spark, sf_dir, "v_pileup_event")
    named = cells.join(cells.groupBy("contig", "pos").agg(F.min("allele").alias("ref"), F.max("allele").alias("alt")), ["contig", "pos"])
    return sinks.col_lines(_contigs(cells), _reads(cells), named).where("kind = 2").select("value")


@query("K1_sink_vcf", "select contig || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || '.' || chr(9) || 'DP=' || (n1 + n2 + n3) as value from t_sites")
def k1v(spark, sf_dir):
    from .pileup_queries import sites

    rows = sites(spark, sf_dir).withColumn("depth", F.col("n1") + F.col("n2") + F.col("n3"))
    return sinks.vcf_lines(rows).where("place >= 0").select("value")


@query("S13_scan_gro", "select cast(contig as varchar) as contig, win as win_start, win as win_end, cast(read_idx as integer) as read_idx, grp from v_groups")
def s13(spark, sf_dir):
    groups = view(spark, sf_dir, "v_groups").select("contig", F.col("win").alias("win_start"), F.col("win").alias("win_end"), "read_idx", "grp")
    return formats.gro(_numbered(sinks.gro_lines(_contigs(groups), _reads(groups), groups)))[1]


@query("K2_sink_gro", "select 'GROUP' || chr(9) || win || chr(9) || win || chr(9) || string_agg(read_idx, ',' order by read_idx) || chr(9) || string_agg(grp, ',' order by read_idx) as value from v_groups group by contig, win")
def k2(spark, sf_dir):
    groups = view(spark, sf_dir, "v_groups").select("contig", F.col("win").alias("win_start"), F.col("win").alias("win_end"), "read_idx", "grp")
    return sinks.gro_lines(_contigs(groups), _reads(groups), groups).where("kind = 2").select("value")


@query("S14_scan_ploidy", "select s_name as contig, s_nationkey as ploidy from supplier")
def s14(spark, sf_dir):
    return formats.ploidy(table(spark, sf_dir, "supplier").select(F.concat_ws(" ", F.regexp_replace("s_name", " ", "_"), F.col("s_nationkey").cast("string")).alias("value"))).select(F.regexp_replace("contig", "_", " ").alias("contig"), "ploidy")


@query("S15_scan_hic_fragments", "select s_suppkey as fragment, 'c' || s_nationkey as contig, cast(s_suppkey * 10 as integer) as start, cast(s_suppkey * 10 + 9 as integer) as \"end\", 9 as size from supplier")
def s15(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select((F.col("s_suppkey") + 1).alias("line_no"), F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), (F.col("s_suppkey") * 10).cast("string"), (F.col("s_suppkey") * 10 + 9).cast("string"), F.lit("9")).alias("value"))
    head = spark.createDataFrame([(0, "id\tchrom\tstart_pos\tend_pos\tsize")], "line_no long, value string")
    return formats.fragments(head.unionByName(rows))


@query("S19_load_matrix", "select i, cast(sum(v) as double) as coverage from t_mx group by i")
def s19(spark, sf_dir):
    from .graph_queries import matrix

    return matrix(spark, sf_dir).groupBy("i").agg(F.sum("v").alias("coverage"))


@query("S20_lookup_contig", "select contig, seq from v_seq")
def s20(spark, sf_dir):
    from ..operators import sequences

    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"))
    return sequences.look_up(wanted, view(spark, sf_dir, "v_seq").select("contig", "seq"), name="contig")


@query("K3_sink_gfa", "select 'L' || chr(9) || n1 || chr(9) || case when e1 = 1 then '+' else '-' end || chr(9) || n2 || chr(9) || case when e2 = 0 then '+' else '-' end || chr(9) || '0M' as value from t_link union all select 'S' || chr(9) || name || chr(9) || seq || chr(9) || 'LN:i:' || length(seq) from t_doc")
def k3(spark, sf_dir):
    links = graph_links(spark, sf_dir).select(F.col("n1").cast("string").alias("n1"), "e1", F.col("n2").cast("string").alias("n2"), "e2", F.lit("0M").alias("cigar"))
    return sinks.gfa_lines(_seqs(spark, sf_dir).select("name", "seq", F.lit(-1.0).alias("depth")), links).select("value")


@query("K4_sink_fasta", "select '>' || name || chr(10) || seq as value from t_doc")
def k4(spark, sf_dir):
    return sinks.fasta_lines(_seqs(spark, sf_dir)).select("value")


@query("K5_sink_gaf", "select read_idx || chr(9) || '-1' || chr(9) || '-1' || chr(9) || '-1' || chr(9) || '+' || chr(9) || path || repeat(chr(9) || '-1', 5) || chr(9) || '255' as value from t_gaf")
def k5(spark, sf_dir):
    rows = formats.gaf(_gaf(spark, sf_dir)).select(F.col("name").alias("read"), F.col("path").alias("steps"))
    return sinks.gaf_lines(rows).select("value")


@query("K6_export_gfa_segments", "select read_idx as seg_id, string_agg(case when idx % 3 > 0 then contig || '-' || (idx % 3) else contig || '' end, '_' order by idx) as name from v_path_step group by read_idx")
def k6(spark, sf_dir):
    rows = view(spark, sf_dir, "v_path_step").select(F.col("read_idx").alias("seg_id"), "idx", "contig", (F.col("idx") % 3).alias("copy"))
    return sinks.segment_names(rows)


@query("K7_export_fasta_segments", "select read_idx as seg_id, string_agg(case when orient = '>' then seq else translate(reverse(seq), 'ACGT', 'TGCA') end, '' order by idx) as seq from v_path_step p join v_seq s on s.contig = p.contig group by read_idx")
def k7(spark, sf_dir):
    rows = view(spark, sf_dir, "v_path_step").select(F.col("read_idx").alias("seg_id"), "idx", "contig", "orient")
    return sinks.segment_sequences(rows, view(spark, sf_dir, "v_seq"))


@query("K8_fa2gfa", "select 'S' || chr(9) || name || chr(9) || seq as value from t_doc")
def k8(spark, sf_dir):
    return sinks.gfa_from_fasta(_seqs(spark, sf_dir)).select("value")


@query("K11_sink_errors", "select 'BRIDGE' || chr(9) || contig1 || chr(9) || pos1 || chr(9) || strand1 || chr(9) || contig2 || chr(9) || pos2 || chr(9) || strand2 || chr(9) || gap || chr(9) || n as value from t_solid union all select 'PIER' || chr(9) || contig || chr(9) || pos || chr(9) || strand from t_pier")
def k11(spark, sf_dir):
    from ..operators import structural as st
    from .graph_queries import mappings, solid

    return sinks.error_lines(solid(spark, sf_dir), st.piers(mappings(spark, sf_dir))).select("value")


@query("K12_sink_clusters", "select 'LABELS' || chr(9) || string_agg(case when mx = mn then -1 else grp end, ',' order by read_idx) as value from (select *, max(grp) over (partition by contig, win) as mx, min(grp) over (partition by contig, win) as mn from v_groups) t group by contig, win")
def k12(spark, sf_dir):
    rows = view(spark, sf_dir, "v_groups").select("contig", F.col("win").alias("win_start"), "read_idx", F.col("read_idx").cast("string").alias("name"), F.col("grp").alias("label"))
    return sinks.cluster_lines(rows).where("kind = 2").select("value")


@query("K13_strip_copy_suffix", "select distinct c_mktsegment as name from customer")
def k13(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 5).cast("string")).alias("name")).distinct()
    return sinks.strip_copies(rows).distinct()


@query("A30_contacts_per_contig", "select c, cast(sum(n) as bigint) as n from (select c1 as c, n from v_contacts union all select c2, n from v_contacts) t group by c")
def a30(spark, sf_dir):
    c = view(spark, sf_dir, "v_contacts")
    return c.select(F.explode(F.array("c1", "c2")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))


@query("A30_hic_distance_law", "select cast(floor((c2 - c1) / 5.0) as bigint) as distance, cast(sum(n) as bigint) as n from v_contacts group by 1")
def a30d(spark, sf_dir):
    return ag.distance_law(view(spark, sf_dir, "v_contacts"), 5)


@query("S18_gunzip_reads", "select cast(contig * 2 as bigint) as line_no, '>' || name || ' extra' as value from t_doc union all select cast(contig * 2 + 1 as bigint), seq from t_doc")
def s18(spark, sf_dir):
    from ..sources import lines as numbered

    rows = _seqs(spark, sf_dir)
    lines = _lines(rows, 4, F.concat(F.lit("@"), "name", F.lit(" extra")), F.col("seq"), F.lit("+"), F.repeat(F.lit("I"), F.length("seq")))
    return numbered.fastq_to_fasta(lines).select(F.col("line_no").cast("long").alias("line_no"), "value")

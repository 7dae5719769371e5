"""Queries on pileups: alleles, sites and contingency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contingency, pileup
from .catalog import PARTS, query, table, view

PARTS["t_top"] = """
select contig, pos, max(case when k = 1 then allele end) as ref, cast(coalesce(max(case when k = 1 then n end), 0) as bigint) as n1,
  max(case when k = 2 then allele end) as alt, cast(coalesce(max(case when k = 2 then n end), 0) as bigint) as n2, cast(coalesce(max(case when k = 3 then n end), 0) as bigint) as n3
from (select *, row_number() over (partition by contig, pos order by n desc, allele) as k from (select contig, pos, allele, count(*) as n from v_pileup_part group by all) a) b group by contig, pos"""
PARTS["t_sites"] = "select * from t_top where n2 > 5 and n2 > 5 * n3"
PARTS["t_cells"] = "select v.contig, v.pos, v.read_idx, case when v.allele = s.ref then 1 else 0 end as is_ref from v_pileup_part v join t_sites s on v.contig = s.contig and v.pos = s.pos and v.allele in (s.ref, s.alt)"
PARTS["t_pairs"] = """
select a.contig, a.pos as p1, b.pos as p2, count(*) filter (where a.is_ref = 0 and b.is_ref = 0) as n00, count(*) filter (where a.is_ref = 0 and b.is_ref = 1) as n01,
  count(*) filter (where a.is_ref = 1 and b.is_ref = 0) as n10, count(*) filter (where a.is_ref = 1 and b.is_ref = 1) as n11
from t_cells a join t_cells b on a.contig = b.contig and a.read_idx = b.read_idx and a.pos < b.pos and b.pos - a.pos <= 200 group by all"""
PARTS["t_sim"] = """
select a.contig, a.read_idx as r1, b.read_idx as r2,
  cast(sum(case when a.is_ref = 0 and b.is_ref = 0 then 3 when a.is_ref = 1 and b.is_ref = 1 then 1 else 0 end) as bigint) as sim,
  cast(sum(case when a.is_ref <> b.is_ref then 1 else 0 end) as bigint) as diff
from t_cells a join t_cells b on a.contig = b.contig and a.pos = b.pos and a.read_idx < b.read_idx group by all"""


def top(spark, sf_dir):
    return pileup.allele_counts(view(spark, sf_dir, "v_pileup_part"))


def sites(spark, sf_dir):
    return pileup.suspicious_positions(top(spark, sf_dir))


def cells(spark, sf_dir):
    return contingency.biallelic(view(spark, sf_dir, "v_pileup_part"), sites(spark, sf_dir))


@query("A3_allele_counts_topk", "select * from t_top")
def a3(spark, sf_dir):
    return top(spark, sf_dir)


@query("W1_rank_alleles", "select contig, pos, allele, count(*) as n, cast(row_number() over (partition by contig, pos order by count(*) desc, allele) as integer) as k from v_pileup_event group by contig, pos, allele")
def w1(spark, sf_dir):
    from pyspark.sql import Window

    n = view(spark, sf_dir, "v_pileup_event").groupBy("contig", "pos", "allele").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("contig", "pos").orderBy(F.desc("n"), "allele")))


@query("F3_suspicious_position", "select * from t_sites")
def f3(spark, sf_dir):
    return sites(spark, sf_dir)


@query("F4_automatic_snp", "select * from t_sites where n2 > 0.33 * n1")
def f4(spark, sf_dir):
    return pileup.automatic_snps(sites(spark, sf_dir))


@query("F5_rare_allele_filter", "select * from t_top where n2 >= 0.3 * (n1 + n2)")
def f5(spark, sf_dir):
    return pileup.abundant(top(spark, sf_dir), abundance=0.3)


@query("F6_coverage_cap", "select contig, pos, read_idx, allele from (select *, row_number() over (partition by contig, pos order by read_idx) as k from v_pileup_part) t where k <= 5")
def f6(spark, sf_dir):
    return pileup.cap_coverage(view(spark, sf_dir, "v_pileup_part"), 5)


@query(
    "W4_greedy_min_spacing",
    """with recursive r as (select contig, pos, row_number() over (partition by contig order by pos) as k from t_sites),
walk as (select contig, k, pos, pos as kept from r where k = 1 union all
  select r.contig, r.k, r.pos, case when r.pos - w.kept > 50 then r.pos else w.kept end from walk w join r on r.contig = w.contig and r.k = w.k + 1)
select s.* from t_sites s join walk w on w.contig = s.contig and w.pos = s.pos and w.kept = w.pos""",
)
def w4(spark, sf_dir):
    return pileup.min_spacing(sites(spark, sf_dir), 50)


@query("A4_contig_depth", "select contig, round(count(*) / cast(max(pos) - min(pos) + 1 as double), 6) as depth from v_pileup_part group by contig")
def a4(spark, sf_dir):
    return pileup.contig_depth(view(spark, sf_dir, "v_pileup_part")).withColumn("depth", F.round("depth", 6))


@query("F12_strongly_mixed", "select contig, pos, cast(sum(m) as bigint) as n, max(m) as top from (select contig, pos, allele, count(*) as m from v_pileup_event group by all) t group by contig, pos having sum(m) >= 5 and max(m) < 0.95 * sum(m)")
def f12(spark, sf_dir):
    return pileup.strongly_mixed(view(spark, sf_dir, "v_pileup_event"))


@query(
    "F13_span_filter",
    """with p as (select contig, pos, ntile(3) over (partition by contig order by pos) as third from (select distinct contig, pos from v_pileup_event) a),
c as (select v.*, p.third from v_pileup_event v join p on p.contig = v.contig and p.pos = v.pos),
reach as (select contig, read_idx from c group by all having min(third) = 1 and max(third) = 3),
i as (select c.* from c join reach r on r.contig = c.contig and r.read_idx = c.read_idx),
good as (select contig, pos from i group by contig, pos having count(*) >= 0.3 * (select count(*) from reach r where r.contig = i.contig))
select i.contig, i.pos, i.read_idx, i.allele from i join good g on g.contig = i.contig and g.pos = i.pos""",
)
def f13(spark, sf_dir):
    return pileup.spanning(view(spark, sf_dir, "v_pileup_event"), coverage=0.3)


@query(
    "G13_majority_consensus",
    "select contig, strand, pos, allele as base, n as support from (select *, row_number() over (partition by contig, strand, pos order by n desc, allele) as k from (select contig, cast(read_idx % 2 as bigint) as strand, pos, allele, count(*) as n from v_pileup_event group by all) a) b where k = 1",
)
def g13(spark, sf_dir):
    grouped = view(spark, sf_dir, "v_pileup_event").withColumn("strand", F.col("read_idx") % 2)
    return pileup.majority_consensus(grouped, group=("contig", "strand"))


@query(
    "A2_error_rate",
    """with e as (select l_suppkey as contig_id, round(sum(l_linenumber + l_quantity / 10) / (sum(l_quantity + l_linenumber + l_quantity / 10) + 1), 6) as error_rate from lineitem group by 1)
select contig_id, error_rate from e union all select null, round(least(avg(error_rate), 0.15), 6) from e where error_rate > 0""",
)
def a2(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig_id"), F.col("l_quantity").alias("matches"), F.col("l_linenumber").alias("mismatches"), (F.col("l_quantity") / 10).alias("indels"))
    return pileup.error_rate(rows).withColumn("error_rate", F.round("error_rate", 6))


@query("A5_contingency_2x2", "select * from t_pairs")
def a5(spark, sf_dir):
    return contingency.contingency(cells(spark, sf_dir), within=200)


@query(
    "A6_chi_square",
    """select contig, p1, p2, round(case when n00 + n01 + n10 + n11 = 0 then 0.0
  when (n00 + n01 = 0 or n10 + n11 = 0) and (n00 + n10 = 0 or n01 + n11 = 0) then -1.0
  when n00 + n01 = 0 or n10 + n11 = 0 or n00 + n10 = 0 or n01 + n11 = 0 then 0.0
  else cast(n00 + n01 + n10 + n11 as double) * power(cast(n00 * n11 - n01 * n10 as double), 2) / (cast(n00 + n01 as double) * (n10 + n11) * (n00 + n10) * (n01 + n11)) end, 6) as chi2 from t_pairs""",
)
def a6(spark, sf_dir):
    pairs = contingency.contingency(cells(spark, sf_dir), within=200)
    return pairs.select("contig", "p1", "p2", F.round(contingency.chi_square(*[F.col(c) for c in ("n00", "n01", "n10", "n11")]), 6).alias("chi2"))


@query("A12_similarity_difference", "select * from t_sim")
def a12(spark, sf_dir):
    return contingency.similarity_difference(cells(spark, sf_dir))


@query("J6_pair_similarity", "select r1, r2, cast(sum(sim) as bigint) as sim from t_sim group by r1, r2")
def j6(spark, sf_dir):
    columns = cells(spark, sf_dir).withColumn("pos", F.struct("contig", "pos"))
    return contingency.similarity_difference(columns, by=()).drop("diff")


@query("J3_sorted_intersect", "select a.contig, a.read_idx, a.pos as p1, b.pos as p2, a.is_ref as s1, b.is_ref as s2 from t_cells a join t_cells b on a.contig = b.contig and a.read_idx = b.read_idx and b.pos = a.pos + 25")
def j3(spark, sf_dir):
    c = cells(spark, sf_dir)
    return contingency.intersect_columns(c, c, offset=25)


@query(
    "J5_merge_sorted_snps",
    "select contig, pos, min(case when n2 > 0.7 * n1 then 0 else 1 end) as robust from t_sites where n2 > 0.7 * n1 or pos % 3 = 0 group by all",
)
def j5(spark, sf_dir):
    found = sites(spark, sf_dir)
    return contingency.merge_sites(pileup.automatic_snps(found, threshold=0.7), found.where("pos % 3 = 0"))


@query(
    "J4_full_outer_merge_votes",
    """select coalesce(a.contig, b.contig) as contig, coalesce(a.read_idx, b.read_idx) as read_idx, coalesce(a.more, 0) + coalesce(b.more, 0) as more, coalesce(a.less, 0) + coalesce(b.less, 0) as less
from (select contig, read_idx, count(*) filter (where is_ref = 1) as more, count(*) filter (where is_ref = 0) as less from t_cells where pos % 2 = 0 group by all) a
full join (select contig, read_idx, count(*) filter (where is_ref = 1) as more, count(*) filter (where is_ref = 0) as less from t_cells where pos % 2 = 1 group by all) b on a.contig = b.contig and a.read_idx = b.read_idx""",
)
def j4(spark, sf_dir):
    c = cells(spark, sf_dir)
    return contingency.add_votes(contingency.votes(c.where("pos % 2 = 0")), contingency.votes(c.where("pos % 2 = 1")))

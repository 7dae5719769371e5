"""Queries on paths, contig graphs, contacts and structural evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly_graph as ag
from ..operators import path_ops as po
from ..operators import structural as st
from .catalog import PARTS, query, table, view

PARTS["t_step"] = """
select read_idx, idx, contig, orient, lead(contig) over w as next_contig, lead(orient) over w as next_orient, lag(contig) over w as prev_contig, lag(orient) over w as prev_orient
from v_path_step window w as (partition by read_idx order by idx)"""
PARTS["t_take"] = "select contig as a, case when orient = '>' then 1 else 0 end as ea, next_contig as b, case when next_orient = '>' then 0 else 1 end as eb from t_step where next_contig is not null"
PARTS["t_used"] = """
select case when s then b else a end as n1, case when s then eb else ea end as e1, case when s then a else b end as n2, case when s then ea else eb end as e2, count(*) as support
from (select *, b < a or (b = a and eb < ea) as s from t_take) t group by all"""
#: The links that reads take, once each; a graph in which nearly every contig meets every other.
PARTS["t_taken"] = "select n1, e1, n2, e2 from t_used where n1 <> n2"
PARTS["t_taken_way"] = "select n1, e1, n2, e2 from t_taken union all select n2, e2, n1, e1 from t_taken"
#: A sparse graph of all parts: what follows a contig is told by its part's size, so that there are chains, forks, tips and turns.
PARTS["t_link"] = """
select n1, e1, n2, e2 from (select distinct p_partkey as n1, 1 as e1, p_partkey + unnest(case p_size % 10 when 0 then [] when 1 then [1, 2] when 2 then [1, 3] else [1] end) as n2, 0 as e2 from part) t
where n2 in (select p_partkey from part)"""
PARTS["t_way"] = "select n1, e1, n2, e2 from t_link union all select n2, e2, n1, e1 from t_link"
PARTS["t_deg"] = "select n1 as contig, e1 as \"end\", count(*) as degree from t_way group by all"
PARTS["t_ctg"] = "select p_partkey as contig, cast(p_size * 40 + 40 as bigint) as len, cast((p_partkey * 37) % 100 as double) as depth from part"
PARTS["t_map"] = """
select l_orderkey as read_idx, cast(row_number() over w as bigint) as ord, l_suppkey as contig, cast(l_partkey as bigint) as qs, cast(l_partkey + l_quantity * 40 as bigint) as qe,
  cast(6000 as bigint) as qlen, cast(l_partkey as bigint) as ts, cast(l_partkey + l_quantity * 40 as bigint) as te, cast(9000 as bigint) as clen, case when l_linestatus = 'F' then 1 else 0 end as strand
from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"""
PARTS["t_bridge"] = """
select * from (select read_idx, ord, contig as contig1, strand as strand1, case when strand = 1 then te else ts end as pos1, lead(contig) over w as contig2, lead(strand) over w as strand2,
  lead(case when strand = 1 then ts else te end) over w as pos2, lead(qs) over w - qe as gap from t_map window w as (partition by read_idx order by ord)) t where contig2 is not null"""


def path_steps(spark, sf_dir):
    return view(spark, sf_dir, "v_path_step")


def taken_links(spark, sf_dir):
    return po.used_links(path_steps(spark, sf_dir)).where("n1 <> n2").select("n1", "e1", "n2", "e2")


def links(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    steps = lambda *n: F.array(*map(F.lit, n)).cast("array<int>")
    kind = F.col("p_size") % 10
    next_ = F.explode(F.when(kind == 0, steps()).when(kind == 1, steps(1, 2)).when(kind == 2, steps(1, 3)).otherwise(steps(1)))
    made = part.select(F.col("p_partkey").alias("n1"), next_.alias("step")).select("n1", F.lit(1).alias("e1"), (F.col("n1") + F.col("step")).alias("n2"), F.lit(0).alias("e2")).distinct()
    return made.join(part.select(F.col("p_partkey").alias("n2")), "n2", "left_semi").select("n1", "e1", "n2", "e2")


def contigs(spark, sf_dir):
    depth = ((F.col("p_partkey") * 37) % 100).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contig"), (F.col("p_size") * 40 + 40).cast("long").alias("len"), depth.alias("depth"))


def mappings(spark, sf_dir):
    rows = view(spark, sf_dir, "v_aln")
    end = (F.col("start_c") + (F.col("end_c") - F.col("start_c")) * 40).alias
    s = F.col("start_c")
    return rows.select("read_idx", "ord", "contig", s.alias("qs"), end("qe"), F.lit(6000).cast("long").alias("qlen"), s.alias("ts"), end("te"), F.lit(9000).cast("long").alias("clen"), "strand")


@query("J11_path_consecutive_links", "select * from t_used")
def j11(spark, sf_dir):
    return po.used_links(path_steps(spark, sf_dir))


@query("W6_next_prev_step", "select read_idx, idx, next_contig, prev_contig from t_step")
def w6(spark, sf_dir):
    return po.steps(path_steps(spark, sf_dir)).select("read_idx", "idx", "next_contig", "prev_contig")


@query("U3_dedupe_links", "select n1, e1, n2, e2 from t_link")
def u3(spark, sf_dir):
    return po.dedupe_links(po.both_ways(links(spark, sf_dir)))


@query("F7_remove_unsupported_links", "select n1, e1, n2, e2 from t_used where n1 <> n2 and support >= 2")
def f7(spark, sf_dir):
    return po.remove_unsupported(taken_links(spark, sf_dir), path_steps(spark, sf_dir), least=2)


_PAIR = """
select contig, case when f then prev_contig else next_contig end as l, case when f then prev_orient else case next_orient when '>' then '<' else '>' end end as lo,
  case when f then next_contig else prev_contig end as r, case when f then next_orient else case prev_orient when '>' then '<' else '>' end end as ro
from (select *, orient = '>' as f from t_step where next_contig is not null and prev_contig is not null) t"""
PARTS["t_pairs2"] = f"select contig, l as \"left\", lo as left_orient, r as \"right\", ro as right_orient, count(*) as n from ({_PAIR}) p group by all"


@query("A24_pair_support", "select * from t_pairs2")
def a24(spark, sf_dir):
    return po.pair_support(path_steps(spark, sf_dir))


@query("J12_left_right_pairs", "select contig, \"left\", \"right\", cast(sum(n) as bigint) as n from t_pairs2 group by all")
def j12(spark, sf_dir):
    return po.pair_support(path_steps(spark, sf_dir)).groupBy("contig", "left", "right").agg(F.sum("n").alias("n"))


@query(
    "G16_split_invalid_paths",
    """with c as (select s.read_idx, s.idx, s.contig, s.orient, case when s.prev_contig is not null and not exists (select 1 from t_taken_way w where w.n1 = s.prev_contig and w.e1 = case when s.prev_orient = '>' then 1 else 0 end and w.n2 = s.contig and w.e2 = case when s.orient = '>' then 0 else 1 end) then 1 else 0 end as cut from t_step s)
select read_idx, cast(sum(cut) over (partition by read_idx order by idx) as bigint) as part, idx, contig, orient from c""",
)
def g16(spark, sf_dir):
    return po.split_invalid(path_steps(spark, sf_dir), taken_links(spark, sf_dir))


@query("J10_next_alignment", "select read_idx, ord, contig, lead(contig) over w as next_contig, lead(start_c) over w - end_c as gap from v_aln window w as (partition by read_idx order by ord)")
def j10(spark, sf_dir):
    return po.next_alignment(view(spark, sf_dir, "v_aln"))


@query(
    "A23_gaf_coverage",
    "select contig, round(sum(case when idx = lo then 0.5 when idx = hi then 0.25 else 1 end), 6) as coverage from (select *, min(idx) over (partition by read_idx) as lo, max(idx) over (partition by read_idx) as hi from v_path_step) t group by contig",
)
def a23(spark, sf_dir):
    p = path_steps(spark, sf_dir)
    ends = p.select("read_idx").distinct().select("read_idx", F.lit(0.5).alias("first"), F.lit(0.25).alias("last"))
    return po.coverage(p, ends).withColumn("coverage", F.round("coverage", 6))


_NEXT = "with t_walk_step as (select contig, orient, lead(contig) over w as next_contig, lead(orient) over w as next_orient from v_walk window w as (partition by read_idx order by idx)) select contig, orient, next_contig, next_orient, n, cast(sum(n) over (partition by contig, orient) as bigint) as total, row_number() over (partition by contig, orient order by n desc, next_contig, next_orient) as k from (select contig, orient, next_contig, next_orient, count(*) as n from t_walk_step where next_contig is not null group by all) a"


@query("A25_consensus_next", f"select contig, orient, next_contig, next_orient, n, total from ({_NEXT}) t where k = 1 and (n > 0.6 * total or (n = total - 1 and n >= 2))")
def a25(spark, sf_dir):
    return po.consensus_next(view(spark, sf_dir, "v_walk"))


@query("A25_consensus_path")
def a25p(spark, sf_dir):
    return po.consensus_paths(view(spark, sf_dir, "v_walk"))


@query(
    "J19_assign_reads_to_segments",
    """with s as (select contig as seg_id, contig as a, '>' as ao, next_contig as b, next_orient as bo from (select *, row_number() over (partition by contig order by read_idx, idx) as k from t_step where orient = '>' and next_contig is not null) t where k = 1)
select s.seg_id, t.read_idx, cast(t.idx - 1 as integer) as at, false as reversed from s join t_step t on t.contig = a and t.orient = ao and t.next_contig = b and t.next_orient = bo
union all select s.seg_id, t.read_idx, cast(t.idx - 1 as integer), true from s join t_step t on t.contig = b and t.orient <> bo and t.next_contig = a and t.next_orient <> ao""",
)
def j19(spark, sf_dir):
    p = path_steps(spark, sf_dir)
    first = po.steps(p).where("orient = '>' and next_contig is not null").groupBy("contig").agg(F.min_by(F.struct("next_contig", "next_orient"), F.struct("read_idx", "idx")).alias("n"))
    a = first.select(F.col("contig").alias("seg_id"), F.lit(0).alias("idx"), "contig", F.lit(">").alias("orient"))
    b = first.select(F.col("contig").alias("seg_id"), F.lit(1).alias("idx"), F.col("n.next_contig").alias("contig"), F.col("n.next_orient").alias("orient"))
    return po.assign_reads(p, a.unionByName(b))


@query(
    "J18_graph_reach_paths",
    """with recursive w as (select n1 as start, e1 as "end", n2 as target, e2 as target_end, cast(0 as bigint) as inner_len, [n1, n2] as path from t_way where n1 <> n2
union all select w.start, w."end", t.n2, t.e2, w.inner_len + c.len, list_append(w.path, t.n2) from w join t_ctg c on c.contig = w.target join t_way t on t.n1 = w.target and t.e1 = 1 - w.target_end where not list_contains(w.path, t.n2) and w.inner_len + c.len <= 700)
select start, "end", target, target_end, inner_len, len(path) as n from w""",
)
def j18(spark, sf_dir):
    ways = po.both_ways(links(spark, sf_dir)).select(F.col("n1").alias("start"), F.col("e1").alias("end")).distinct()
    found = po.reach(links(spark, sf_dir), ways, contigs(spark, sf_dir), most=700)
    return found.select("start", "end", "target", "target_end", F.col("inner").alias("inner_len"), F.size("path").cast("long").alias("n"))


@query("U1_common_contigs", "select t.n2 as target from t_way t group by t.n2 having count(distinct (t.n1, t.e1)) >= 3")
def u1(spark, sf_dir):
    ways = po.both_ways(links(spark, sf_dir)).select(F.col("n1").alias("start"), F.col("e1").alias("end")).distinct()
    return po.common_contigs(po.reach(links(spark, sf_dir), ways, contigs(spark, sf_dir), most=0), n=3)


@query("G15_read_paths")
def g15(spark, sf_dir):
    aln = view(spark, sf_dir, "v_aln")
    wins = aln.select("contig", "read_idx", F.explode(F.sequence(F.floor(F.col("start_c") / 20), F.floor((F.col("end_c") - 1) / 20))).alias("w")).distinct()
    intervals = wins.select("contig", "read_idx", (F.col("w") * 20).alias("win_start"), (F.col("w") * 20 + 20).alias("win_end"), (F.col("read_idx") % 2).cast("int").alias("grp"))
    return po.window_paths(aln, intervals)


# contig graphs


@query("K13_check_segments", "select n2 as n1, e2 as e1, n1 as n2, e1 as e2 from t_link")
def k13(spark, sf_dir):
    return ag.link_ends_valid(links(spark, sf_dir))


@query("G39_remove_contigs", "select * from t_link where n1 % 5 <> 0 and n2 % 5 <> 0")
def g39(spark, sf_dir):
    return ag.remove_contigs(links(spark, sf_dir), contigs(spark, sf_dir).where("contig % 5 = 0"))


@query("G39_rename_contigs", "select case when n1 % 4 = 0 then n1 + 1000 else n1 end as n1, case when n1 % 4 = 0 then 1 - e1 else e1 end as e1, case when n2 % 4 = 0 then n2 + 1000 else n2 end as n2, case when n2 % 4 = 0 then 1 - e2 else e2 end as e2 from t_link")
def g39r(spark, sf_dir):
    names = contigs(spark, sf_dir).where("contig % 4 = 0").select("contig", (F.col("contig") + 1000).alias("new"), F.lit(True).alias("flip"))
    return ag.rename_contigs(links(spark, sf_dir), names)


PARTS["t_in"] = """
select l.n1, l.n2 from t_link l join t_deg a on a.contig = l.n1 and a."end" = l.e1 and a.degree = 1 join t_deg b on b.contig = l.n2 and b."end" = l.e2 and b.degree = 1"""


@query(
    "G19_merge_linear_chains",
    """with recursive e as (select n1 as a, n2 as b from t_in union all select n2, n1 from t_in), w as (select a as contig, b as other from e union select w.contig, e.b from w join e on e.a = w.other)
select contig, least(contig, min(other)) as chain from w group by contig""",
)
def g19(spark, sf_dir):
    return ag.chains(links(spark, sf_dir))


@query("G19_chain_contigs")
def g19c(spark, sf_dir):
    return ag.chain_contigs(contigs(spark, sf_dir), ag.chains(links(spark, sf_dir)))


PARTS["t_ext0"] = "select contig, e as \"end\", cast(0 as bigint) as ext from t_ctg, (values (0), (1)) v(e)"
for _k in range(1, 6):
    PARTS[f"t_ext{_k}"] = f"""
select x.contig, x."end", coalesce(o.ext, 0) as ext from t_ext0 x left join (select w.n1, w.e1, max(c.len + p.ext) as ext from t_way w join t_ctg c on c.contig = w.n2 join t_ext{_k - 1} p on p.contig = w.n2 and p."end" = 1 - w.e2 group by all) o
on o.n1 = x.contig and o.e1 = x."end" """


@query("G18_tip_extensions", "select * from t_ext5")
def g18e(spark, sf_dir):
    return ag.tip_extensions(links(spark, sf_dir), contigs(spark, sf_dir))


@query(
    "G18_trim_tips",
    """select n1, e1, n2, e2 from (select w.*, x.ext, c.len + x.ext as total, max(c.len + x.ext) over (partition by w.n1, w.e1) as longest from t_way w join t_ctg c on c.contig = w.n2 join t_ext5 x on x.contig = w.n2 and x."end" = 1 - w.e2) t
where ext = 0 and total < 1000 and longest > 1000 and 5 * total < longest""",
)
def g18(spark, sf_dir):
    return ag.trim_tips(links(spark, sf_dir), contigs(spark, sf_dir))


@query(
    "F8_clip_deadends_bubbles",
    """with e as (select c.contig, c.len, d.ends, d.most from t_ctg c left join (select contig, count(*) as ends, max(degree) as most from t_deg group by contig) d on d.contig = c.contig),
s as (select e.contig, l.n2 || ':' || l.e2 as l, r.n2 || ':' || r.e2 as r from e join t_way l on l.n1 = e.contig and l.e1 = 0 join t_way r on r.n1 = e.contig and r.e1 = 1 where e.len < 1500 and ends = 2 and most = 1),
b as (select contig, min(contig) over (partition by least(l, r), greatest(l, r)) as keep from s)
select contig, len, depth from t_ctg where contig not in (select contig from e where len < 800 and coalesce(ends, 0) < 2) and contig not in (select contig from b where contig <> keep)""",
)
def f8(spark, sf_dir):
    return ag.clip_and_pop(links(spark, sf_dir), contigs(spark, sf_dir), tip=800, bubble=1500)


@query("F9_low_coverage_contig_filter", "select l.* from t_link l join t_ctg a on a.contig = l.n1 and a.depth > 40 join t_ctg b on b.contig = l.n2 and b.depth > 40")
def f9(spark, sf_dir):
    return ag.keep_covered(links(spark, sf_dir), contigs(spark, sf_dir).select("contig", F.col("depth").alias("coverage")), least=40)


@query(
    "F10_contained_contig_filter",
    """with a as (select l_suppkey as contig, l_partkey % 100 + 1 as target, l_discount as lc, l_tax as rc from lineitem), n as (select n1 as contig, string_agg(distinct n2 || ':' || e2, ',' order by n2 || ':' || e2) as near from t_way group by n1)
select distinct a.contig from a left join n on n.contig = a.contig left join n t on t.contig = a.target where lc < 0.1 and rc < 0.1 and a.contig <> a.target and (n.near is null or n.near = t.near)""",
)
def f10(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 100 + 1).alias("target"), F.col("l_discount").alias("left_clip"), F.col("l_tax").alias("right_clip"))
    return ag.redundant_contigs(rows, links(spark, sf_dir))


@query("G17_repeat_pairs", "select p.*, row_number() over (partition by p.contig order by n desc, \"left\", left_orient, \"right\", right_orient) as k from t_pairs2 p where n >= 2 and contig in (select contig from (select n1 as contig, e1 from t_taken_way group by n1, e1 having count(*) > 1) d)")
def g17p(spark, sf_dir):
    return ag.repeat_pairs(taken_links(spark, sf_dir), path_steps(spark, sf_dir)).withColumn("k", F.col("k").cast("long"))


@query("G17_unzip_repeats")
def g17(spark, sf_dir):
    return ag.unzip(taken_links(spark, sf_dir), path_steps(spark, sf_dir))[0]


@query(
    "G20_duplicate_contigs",
    """with a as (select w.n1 as contig, w.e1 as "end", count(*) as copies, sum(c.depth) as theirs from t_way w join t_ctg c on c.contig = w.n2 join t_deg d on d.contig = w.n2 and d."end" = w.e2 and d.degree = 1 group by all)
select a.contig, a."end", a.copies from a join t_deg d on d.contig = a.contig and d."end" = a."end" join t_ctg c on c.contig = a.contig where copies > 1 and copies = degree and c.depth > 0.2 * theirs""",
)
def g20(spark, sf_dir):
    return ag.duplicated(contigs(spark, sf_dir), links(spark, sf_dir), share=0.2)


@query("A22_reference_coverage", "select round(sum(len * depth) / (1 + sum(len)), 6) as reference from t_ctg where contig not in (select contig from t_deg where degree > 1)")
def a22(spark, sf_dir):
    return ag.reference_coverage(contigs(spark, sf_dir), links(spark, sf_dir)).select(F.round("reference", 6).alias("reference"))


@query("G21_multiplicity")
def g21(spark, sf_dir):
    return ag.multiplicity(contigs(spark, sf_dir), links(spark, sf_dir), 30.0)


@query("G22_haploid_contigs", """with m as (select w.n1 as contig, max(c.depth) as top, count(distinct w.e1) as sides from t_way w join t_ctg c on c.contig = w.n2 group by w.n1)
select c.contig from t_ctg c left join m on m.contig = c.contig where (round(depth / 30.0) <= 1 and (top is null or depth < 1.5 * top) and (len > 1000 or sides = 2)) or len > (select avg(len) from t_ctg)""")
def g22(spark, sf_dir):
    return ag.haploid(contigs(spark, sf_dir), links(spark, sf_dir), 30.0)


@query("A19_hic_contacts", "select least(l_partkey % 100, l_suppkey) as i, greatest(l_partkey % 100, l_suppkey) as j, cast(sum(l_linenumber) as bigint) as n from lineitem where l_partkey % 100 <> l_suppkey group by 1, 2")
def a19(spark, sf_dir):
    return ag.contacts(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("f1"), F.col("l_suppkey").alias("f2"), F.col("l_linenumber").cast("long").alias("n")))


@query("J14_contact_lookup", "select least(a.s_nationkey, b.s_nationkey) as i, greatest(a.s_nationkey, b.s_nationkey) as j, cast(sum(n) as bigint) as n from v_contacts c join supplier a on a.s_suppkey = c.c1 join supplier b on b.s_suppkey = c.c2 where a.s_nationkey <> b.s_nationkey group by 1, 2")
def j14(spark, sf_dir):
    frags = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fragment"), F.col("s_nationkey").alias("contig"))
    return ag.contacts(view(spark, sf_dir, "v_contacts").select(F.col("c1").alias("f1"), F.col("c2").alias("f2"), "n"), frags)


@query("A20_linked_read_contacts", "select a.l_suppkey as i, b.l_suppkey as j, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey group by 1, 2")
def a20(spark, sf_dir):
    return ag.barcode_contacts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("barcode"), F.col("l_suppkey").alias("contig")))


@query("J15_barcode_pairs", "select a.l_suppkey as i, b.l_suppkey as j, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where a.l_suppkey <= b.l_suppkey group by 1, 2")
def j15(spark, sf_dir):
    return a20(spark, sf_dir).where("i <= j")


PARTS["t_mx"] = "select c1 as i, c2 as j, cast(n as double) as v from v_contacts union all select c2, c1, n from v_contacts"
PARTS["t_sk0"] = "select i, j, v / sum(v) over (partition by i) as v from t_mx"
for _k in range(1, 21):
    PARTS[f"t_sk{_k}"] = f"select i, j, v / sum(v) over (partition by {'i' if _k % 2 == 0 else 'j'}) as v from t_sk{_k - 1}"


def matrix(spark, sf_dir):
    c = view(spark, sf_dir, "v_contacts").select(F.col("c1").alias("i"), F.col("c2").alias("j"), F.col("n").cast("double").alias("v"))
    return c.unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query("A21_sinkhorn_normalize", "select i, j, round(v, 6) as v from t_sk20")
def a21(spark, sf_dir):
    return ag.sinkhorn(matrix(spark, sf_dir)).withColumn("v", F.round("v", 6))


PARTS["t_best"] = "select i, j, v from (select *, row_number() over (partition by i order by v desc, j) as k from t_mx) t where k = 1"


@query("T5_best_contact", "select * from t_best")
def t5(spark, sf_dir):
    return ag.best_contacts(matrix(spark, sf_dir))


@query("T5_prune_contacts", "with e as (select distinct least(i, j) as a, greatest(i, j) as b from t_best), n as (select c, count(*) as n from (select a as c from e union all select b from e) t group by c) select e.a, e.b from e join n x on x.c = e.a join n y on y.c = e.b where x.n = 1 or y.n = 1")
def t5p(spark, sf_dir):
    return ag.prune_contacts(ag.best_contacts(matrix(spark, sf_dir)))


@query(
    "A28_interaction_score",
    """with m as (select distinct s_nationkey as seg, s_suppkey as contig from supplier union select s_nationkey, s_suppkey % 10 + 1 from supplier)
select a.seg as seg1, b.seg as seg2, round(sum(v), 6) as score, round(sum(case when not exists (select 1 from m x where x.seg = b.seg and x.contig = t.i) and not exists (select 1 from m y where y.seg = a.seg and y.contig = t.j) then v else 0 end), 6) as relative
from t_mx t join m a on a.contig = t.i join m b on b.contig = t.j where a.seg <> b.seg group by 1, 2""",
)
def a28(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("seg"), F.col("s_suppkey").alias("contig"))
    members = s.unionByName(s.select("seg", (F.col("contig") % 10 + 1).alias("contig"))).distinct()
    return ag.interaction_scores(matrix(spark, sf_dir), members).select("seg1", "seg2", F.round("score", 6).alias("score"), F.round("relative", 6).alias("relative"))


@query("A27_segment_depth", "select s_nationkey as seg, round(sum(depth * len) / sum(len), 6) as depth, cast(sum(len) as bigint) as len from t_ctg join supplier on s_suppkey = contig group by 1")
def a27(spark, sf_dir):
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("seg"), F.col("s_suppkey").alias("contig"))
    return ag.segment_depths(members, contigs(spark, sf_dir)).withColumn("depth", F.round("depth", 6))


@query("A27_copies_number", "select l_suppkey as contig, count(*) as copies from lineitem group by 1")
def a27c(spark, sf_dir):
    return ag.copies_number(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig")))


@query(
    "G26_break_chimeras",
    """with c as (select contig, pos, count(*) as crossing from v_pileup_event group by all), l as (select *, max(crossing) over (partition by contig order by pos rows between unbounded preceding and 1 preceding) as lm, max(crossing) over (partition by contig order by pos rows between 1 following and unbounded following) as rm, lag(crossing) over (partition by contig order by pos) as p, lead(crossing) over (partition by contig order by pos) as n from c)
select contig, pos, crossing from l where crossing < 0.7 * lm and crossing < 0.7 * rm and (p is null or crossing <= p) and (n is null or crossing < n)""",
)
def g26(spark, sf_dir):
    cuts = view(spark, sf_dir, "v_pileup_event").groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("crossing"))
    return ag.chimera_cuts(cuts)


@query(
    "G28_trim_overlaps",
    """with o as (select n1, e1, (n1 * 7 + n2) % 60 as overlap from t_link union all select n2, e2, (n1 * 7 + n2) % 60 from t_link),
e as (select n1 as contig, min(case when e1 = 0 then overlap end) as nl, max(case when e1 = 0 then overlap end) as xl, min(case when e1 = 1 then overlap end) as nr, max(case when e1 = 1 then overlap end) as xr from o group by n1)
select c.contig, cast(greatest(least(coalesce(nl, 0), len - coalesce(xr, 0)), 0) as bigint) as trim_left, cast(greatest(least(coalesce(nr, 0), len - coalesce(xl, 0)), 0) as bigint) as trim_right from e join t_ctg c on c.contig = e.contig""",
)
def g28(spark, sf_dir):
    return ag.trim_overlaps(links(spark, sf_dir).withColumn("overlap", (F.col("n1") * 7 + F.col("n2")) % 60), contigs(spark, sf_dir))


# structural evidence


@query("G29_bridges_and_piers", "select * from t_bridge")
def g29(spark, sf_dir):
    return st.bridges(mappings(spark, sf_dir))


@query("G29_long_enough", "select read_idx, ord from t_map where qe - qs >= least(1000, greatest(least(0.2 * qlen, 0.5 * clen), 500))")
def g29l(spark, sf_dir):
    return st.long_enough(mappings(spark, sf_dir)).select("read_idx", "ord")


PARTS["t_pier"] = "select read_idx, contig, strand, case when strand = 1 then te else ts end as pos, qlen - qe as overhang from (select *, sum(qe - qs) over (partition by read_idx) / cast(qlen as double) as covered, max(ord) over (partition by read_idx) as lst from t_map) t where ord = lst and covered > 0.8"


@query("G29_piers", "select * from t_pier")
def g29p(spark, sf_dir):
    return st.piers(mappings(spark, sf_dir))


_KEY = "contig1, strand1, contig2, strand2"
PARTS["t_ses1"] = f"select *, sum(f) over (partition by {_KEY} order by pos1) as s1 from (select *, case when pos1 - lag(pos1) over (partition by {_KEY} order by pos1) <= 300 then 0 else 1 end as f from t_bridge) t"
PARTS["t_ses2"] = f"select *, sum(g) over (partition by {_KEY}, s1 order by pos2) as s2 from (select *, case when pos2 - lag(pos2) over (partition by {_KEY}, s1 order by pos2) <= 300 then 0 else 1 end as g from t_ses1) t"
PARTS["t_ses3"] = f"select *, sum(h) over (partition by {_KEY}, s1, s2 order by gap) as s3 from (select *, case when gap - lag(gap) over (partition by {_KEY}, s1, s2 order by gap) <= 1000 then 0 else 1 end as h from t_ses2) t"
PARTS["t_solid"] = f"select {_KEY}, s1 || '.' || s2 || '.' || s3 as session, count(distinct read_idx) as n, cast(floor(avg(pos1)) as bigint) as pos1, cast(floor(avg(pos2)) as bigint) as pos2, cast(floor(avg(gap)) as bigint) as gap from t_ses3 group by {_KEY}, s1, s2, s3 having count(distinct read_idx) >= 2"


def solid(spark, sf_dir):
    return st.solid_bridges(st.bridges(mappings(spark, sf_dir)), least=2, near=300)


@query("G30_solid_evidence", "select * from t_solid")
def g30(spark, sf_dir):
    return solid(spark, sf_dir)


@query("J13_bridge_cluster_join")
def j13(spark, sf_dir):
    return st.greedy_bridges(st.bridges(mappings(spark, sf_dir)))


@query("J16_anti_existing_links", "select s.* from t_solid s where not exists (select 1 from t_solid x where x.contig1 = s.contig1 and x.strand1 = s.strand1 and x.contig2 = s.contig2 and x.strand2 = s.strand2 and x.contig1 % 2 = 0)")
def j16(spark, sf_dir):
    s = solid(spark, sf_dir)
    return st.new_bridges(s, s.where("contig1 % 2 = 0").select("contig1", "strand1", "contig2", "strand2").distinct())


@query(
    "J17_pier_not_bridge_end",
    """with e as (select contig1 as contig, strand1 as strand, pos1 as pos from t_solid union all select contig2, 1 - strand2, pos2 from t_solid)
select p.* from t_pier p where not exists (select 1 from e where e.contig = p.contig and e.strand = p.strand and abs(e.pos - p.pos) <= 1000)""",
)
def j17(spark, sf_dir):
    return st.free_piers(st.piers(mappings(spark, sf_dir)), solid(spark, sf_dir))


@query("F14_duplex_read_filter", "select * from t_map where read_idx not in (select read_idx from t_bridge where contig1 = contig2 and strand1 = strand2 and abs(pos1 - pos2) <= 1000)")
def f14(spark, sf_dir):
    m = mappings(spark, sf_dir)
    return st.without_reads(m, st.duplex_reads(st.bridges(m)))


@query("F15_long_read_blacklist", "select read_idx from t_map where read_idx not in (select read_idx from t_bridge where gap < 0) group by read_idx having greatest(min(qs), max(qlen) - max(qe)) > least(0.2 * max(qlen), 100)")
def f15(spark, sf_dir):
    m = mappings(spark, sf_dir)
    return st.to_realign(m, st.bridges(m).where("gap < 0"))


@query(
    "A29_read_alignment_stats",
    """select case when aligned is null then 'unaligned' when contigs > 1 then 'jumping' when aligned < 0.8 * 2000 then 'partial' else 'well' end as kind, count(*) as n
from orders left join (select read_idx, sum(qe - qs) as aligned, count(distinct contig) as contigs from t_map where qs % 3 = 0 group by read_idx) a on a.read_idx = o_orderkey group by 1""",
)
def a29(spark, sf_dir):
    lengths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_idx"), F.lit(2000).alias("len"))
    return st.read_stats(mappings(spark, sf_dir).where("qs % 3 = 0"), lengths)


PARTS["t_piece"] = """
select contig, pos as lo, hi, contig || '_' || pos || '_' || hi as piece from (select contig, pos, lead(pos) over (partition by contig order by pos) as hi from (
  select l_suppkey as contig, cast(l_partkey as bigint) as pos from lineitem join t_ctg on contig = l_suppkey where l_partkey < len union select contig, 0 from t_ctg union select contig, len from t_ctg) a) b where hi is not null"""


def _pieces(spark, sf_dir):
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").cast("long").alias("pos"))
    return st.pieces(contigs(spark, sf_dir).select("contig", "len"), marks)


@query("G31_pieces", "select * from t_piece")
def g31(spark, sf_dir):
    return _pieces(spark, sf_dir)


@query("G31_piece_links", "select piece as piece1, nxt as piece2, '0M' as cigar from (select piece, lead(piece) over (partition by contig order by lo) as nxt from t_piece) t where nxt is not null")
def g31l(spark, sf_dir):
    return st.piece_links(_pieces(spark, sf_dir))


# contigs' reads, overlaps and edits of paths


@query("J2_reads_on_contig", "select distinct contig, read_idx, o_totalprice from v_aln join orders on o_orderkey = read_idx")
def j2(spark, sf_dir):
    from ..operators import sequences

    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_idx"), "o_totalprice")
    return sequences.reads_of_contigs(reads, view(spark, sf_dir, "v_aln"))


@query("C16_overlap_depth", "select contig, round(sum(end_c - start_c) / cast(max(end_c) as double), 6) as depth from v_aln group by contig")
def c16(spark, sf_dir):
    from ..operators import pileup

    rows = view(spark, sf_dir, "v_aln")
    return pileup.overlap_depth(rows, rows.groupBy("contig").agg(F.max("end_c").alias("len"))).withColumn("depth", F.round("depth", 6))


PARTS["t_over11"] = """
select l_suppkey as r1, l_partkey as r2, l_linenumber as ln, case when l_linestatus = 'F' then 1 else 0 end as strand, cast(l_quantity as bigint) * 20 as s1, cast(l_quantity as bigint) * 20 + 900 as e1,
  1800 as n1, l_linenumber * 200 as s2, l_linenumber * 200 + 900 as e2, 2000 as n2 from lineitem"""


@query(
    "F11_filter_overlaps_by_group",
    """with o as (select *, case when strand = 1 then (s1 < (e1 - s1) / 2.0 or s2 < (e2 - s2) / 2.0) and (n1 - e1 < (e1 - s1) / 2.0 or n2 - e2 < (e2 - s2) / 2.0)
  else (s1 < (e1 - s1) / 2.0 or n2 - e2 < (e2 - s2) / 2.0) and (n1 - e1 < (e1 - s1) / 2.0 or s2 < (e2 - s2) / 2.0) end as whole from t_over11)
select r1, r2, ln, strand, cast(s1 as bigint) as s1 from o where whole and not exists (select 1 from v_groups a join v_groups b on a.contig = b.contig and a.win = b.win and a.grp <> b.grp where a.read_idx = o.r1 and b.read_idx = o.r2)""",
)
def f11(spark, sf_dir):
    length = F.col("l_quantity").cast("long") * 20
    place = F.col("l_linenumber") * 200
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("r1"), F.col("l_partkey").alias("r2"), F.col("l_linenumber").alias("ln"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("strand"), length.alias("s1"), place.alias("s2")
    )
    whole = po.full_overlap(F.col("strand"), F.col("s1"), F.col("s1") + 900, F.lit(1800), F.col("s2"), F.col("s2") + 900, F.lit(2000))
    return po.drop_split_overlaps(rows.where(whole), view(spark, sf_dir, "v_groups"), by=("contig", "win")).select("r1", "r2", "ln", "strand", "s1")


PARTS["t_wlink"] = """
select distinct case when s then b else a end as n1, case when s then eb else ea end as e1, case when s then a else b end as n2, case when s then ea else eb end as e2 from (
  select *, b < a or (b = a and eb < ea) as s from (select contig as a, case when orient = '>' then 1 else 0 end as ea, lead(contig) over w as b, case when lead(orient) over w = '>' then 0 else 1 end as eb
    from v_walk window w as (partition by read_idx order by idx)) t where b is not null) u"""
#: A chain of contigs with some forks, from what the walks take.
_FORKS = "e1 = 1 and e2 = 0 and (n2 = n1 + 1 or n1 % 3 = 0)"


@query(
    "G41_path_trim",
    f"""with l as (select * from t_wlink where {_FORKS}), d as (select c, e, count(*) as n from (select n1 as c, e1 as e from l union all select n2, e2 from l) t group by all),
s as (select *, lead(idx) over w as nidx, lead(contig) over w as nc, lead(orient) over w as no from v_walk window w as (partition by read_idx order by idx)),
b as (select s.*, not coalesce(x.n = 1 and y.n = 1, false) as bent from s left join d x on x.c = s.contig and x.e = case when s.orient = '>' then 1 else 0 end left join d y on y.c = s.nc and y.e = case when s.no = '>' then 0 else 1 end),
k as (select read_idx, min(idx) filter (where bent) as lo, max(nidx) filter (where bent) as hi from b group by read_idx)
select v.read_idx, v.idx, v.contig, v.orient from v_walk v join k on k.read_idx = v.read_idx and v.idx between lo and coalesce(hi, lo)""",
)
def g41(spark, sf_dir):
    walk = view(spark, sf_dir, "v_walk")
    return po.trim_straight(walk, po.used_links(walk).where(_FORKS))


@query("G41_path_edits", "select read_idx, idx, case when contig >= 40 and row_number() over (partition by read_idx, contig order by idx) = 1 then null when contig < 40 and idx = 1 then contig + 100 else contig end as contig, orient from v_walk")
def g41e(spark, sf_dir):
    walk = view(spark, sf_dir, "v_walk")
    edits = walk.where("idx = 1 and contig < 40").select("read_idx", "idx", F.col("contig").alias("before"), (F.col("contig") + 100).alias("after"))
    return po.cancel(po.replace_steps(walk, edits), walk.where("contig between 40 and 99").select("contig"))


@query(
    "G33_read_assignment",
    """with f as (select contig, next_contig, next_orient from (select *, row_number() over (partition by contig order by read_idx, idx) as k from t_step where orient = '>' and next_contig is not null) t where k = 1),
m as (select contig as seg_id, 0 as j, contig as c, '>' as o from f union all select contig, 1, next_contig, next_orient from f),
p as (select read_idx, row_number() over (partition by read_idx order by idx) - 1 as pt, contig, orient, count(*) over (partition by read_idx) as np from v_path_step),
way as (select seg_id, j as k, c, o, false as turned from m union all select seg_id, 1 - j, c, case when o = '>' then '<' else '>' end, true from m),
lay as (select distinct p.read_idx, p.np, w.seg_id, w.turned, p.pt - w.k as shift from p join way w on w.c = p.contig and w.o = p.orient),
cell as (select l.*, p.pt, p.contig, case when p.contig % 4 = 0 then 2 else 1 end as copies, p.contig = w.c and p.orient = w.o as ok from lay l join way w on w.seg_id = l.seg_id and w.turned = l.turned join p on p.read_idx = l.read_idx and p.pt = l.shift + w.k),
g as (select *, bool_and(ok) over v as fine, min(pt) over v as lo, min(case when copies = 1 then pt end) over v as u1, max(case when copies = 1 then pt end) over v as u2 from cell window v as (partition by read_idx, seg_id, turned, shift))
select distinct seg_id, contig, read_idx from g where fine and pt <= u2 and (pt > u1 or (pt = u1 and u1 = lo))""",
)
def g33(spark, sf_dir):
    p = path_steps(spark, sf_dir)
    first = po.steps(p).where("orient = '>' and next_contig is not null").groupBy("contig").agg(F.min_by(F.struct("next_contig", "next_orient"), F.struct("read_idx", "idx")).alias("n"))
    a = first.select(F.col("contig").alias("seg_id"), F.lit(0).alias("idx"), "contig", F.lit(">").alias("orient"))
    b = first.select(F.col("contig").alias("seg_id"), F.lit(1).alias("idx"), F.col("n.next_contig").alias("contig"), F.col("n.next_orient").alias("orient"))
    copies = p.select("contig").distinct().withColumn("copies", F.when(F.col("contig") % 4 == 0, 2).otherwise(1))
    return po.reads_between_unique(p, a.unionByName(b), copies)

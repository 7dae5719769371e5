"""Registry of the queries on the library's own operators, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Adapter views over the driver's tables: the same text in Spark's and DuckDB's SQL.
VIEWS: dict[str, str] = {
    "v_pileup_part": """
select p.p_brand as contig, l.l_partkey as pos, l.l_suppkey as read_idx, min(case l.l_linestatus when 'F' then 'A' else 'C' end) as allele
from lineitem l join part p on l.l_partkey = p.p_partkey group by p.p_brand, l.l_partkey, l.l_suppkey""",
    "v_pileup_event": """
select contig, pos, read_idx, min(allele) as allele from (
  select cast(dayofmonth(ts) as int) as contig, cast(hour(ts) as int) as pos, user_id as read_idx,
         case event_type when 'click' then 'A' when 'error' then 'C' when 'purchase' then 'G' when 'signup' then 'T' else '-' end as allele
  from events) t group by contig, pos, read_idx""",
    "v_planted": """
select cast(l_orderkey % 3 as int) as contig, cast(l_linenumber * 10 as int) as pos, l_orderkey as read_idx,
       min(case when l_linenumber in (5, 6) then case when l_partkey % 3 = 0 then 0 else 1 end when l_orderkey % 2 = 0 then 1 else 0 end) as is_ref
from lineitem group by l_orderkey, l_linenumber""",
    "v_aln": """
select l_orderkey as read_idx, l_suppkey as contig, l_partkey as start_c, l_partkey + cast(l_quantity as bigint) as end_c,
       case when l_linestatus = 'F' then 1 else 0 end as strand,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as bigint) as ord
from lineitem""",
    "v_path_step": """
select l_orderkey as read_idx, l_suppkey as contig, case when l_linestatus = 'F' then '>' else '<' end as orient,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as bigint) as idx
from lineitem""",
    "v_walk": """
select read_idx, idx, cast((read_idx + idx) % 40 + case when contig % 7 = 0 then 40 else 0 end as bigint) as contig, case when contig % 11 = 0 then '<' else '>' end as orient
from (select l_orderkey as read_idx, l_suppkey as contig, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as bigint) as idx from lineitem) t""",
    "v_links": """
select c1, c2, count(*) as n from (
  select least(contig, nxt) as c1, greatest(contig, nxt) as c2 from (
    select l_suppkey as contig, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nxt from lineitem) a
  where nxt is not null and nxt <> contig) b group by c1, c2""",
    "v_contacts": """
select a.l_suppkey as c1, b.l_suppkey as c2, count(*) as n
from (select distinct l_orderkey, l_suppkey from lineitem) a
join (select distinct l_orderkey, l_suppkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey
group by a.l_suppkey, b.l_suppkey""",
    "v_groups": """
select contig, win, read_idx, cast(min(g) as int) as grp from (
  select cast(user_id % 3 as int) as contig, cast(floor((dayofmonth(ts) - 1) / 5) as int) as win, user_id as read_idx,
         case when event_type in ('click','error') then 0 when event_type = 'purchase' then 1 else 2 end as g
  from events) t group by contig, win, read_idx""",
    "v_cigar": """
select l_orderkey as read_idx, l_linenumber as ln, l_partkey as part, l_suppkey as supp,
       concat(cast(l_linenumber as int), 'S', cast(cast(l_quantity as int) + 1 as int), 'M', cast(l_linenumber as int), 'I', cast(l_suppkey as bigint), 'D', cast(cast(l_quantity as int) as int), 'M') as cigar
from lineitem""",
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
_SEQ = "select doc_id as contig, source, n_chars, translate(upper(regexp_replace(lower(text), '[^a-z]', ''{flag})), '{a}', '{b}') as seq from documents"
VIEWS["v_seq"] = _SEQ.format(flag="", a=_LETTERS[0], b=_LETTERS[1])
#: Parts that several oracles share, in DuckDB's SQL.
PARTS: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def _duck(name: str) -> str:
    if name == "v_seq":
        return _SEQ.format(flag=", 'g'", a=_LETTERS[0], b=_LETTERS[1])
    return PARTS.get(name) or VIEWS[name]


def oracle(body: str) -> str:
    """body with all views and parts that it names, as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in sorted(set(re.findall(r"\b[vt]_\w+\b", text))):
            if (name in VIEWS or name in PARTS) and name not in order:
                need(_duck(name))
                order.append(name)

    need(body)
    body = body.strip()
    parts = [f"{name} as ({_duck(name).strip()}\n)" for name in order]
    recursive = "recursive " if re.match(r"with recursive\b", body) or any("recursive" in PARTS.get(n, "") for n in order) else ""
    if m := re.match(r"with (recursive )?", body):
        return f"with {recursive}" + ",\n".join([*parts, body[m.end() :]])
    return f"with {recursive}" + ",\n".join(parts) + "\n" + body if parts else body


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) as a query, with its SQL if there is any."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust candidate variant sites, with a least count that suits the smallest tables."""
    from ..operators import pileup

    cells = view(spark, sf_dir, "v_pileup_part")
    sites = pileup.suspicious_positions(pileup.allele_counts(cells), min_count=3)
    return pileup.min_spacing(sites, 5)


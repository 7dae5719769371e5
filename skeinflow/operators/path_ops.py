"""Paths of reads through a contig graph: rows (read_idx, idx, contig, orient)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that every worker may hold.
SENT = 500_000
#: Steps whose lays on segments one task sorts.
SORTED = 500_000


def sent(rows: DataFrame) -> DataFrame:
    """Checkpointed rows for a join: each worker gets all of them while they are few, so that the other side stays where it is."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def _order():
    return Window.partitionBy("read_idx").orderBy("idx")


def end_towards_next(orient: Column) -> Column:
    """The end by which a step is left: right (1) on the forward strand."""
    return F.when(orient == ">", 1).otherwise(0)


def steps(paths: DataFrame) -> DataFrame:
    """Each step with the next and the previous one."""
    return paths.select(
        "*", F.lead("contig").over(_order()).alias("next_contig"), F.lead("orient").over(_order()).alias("next_orient"), F.lag("contig").over(_order()).alias("prev_contig"), F.lag("orient").over(_order()).alias("prev_orient")
    )


def canonical(n1: Column, e1: Column, n2: Column, e2: Column) -> list[Column]:
    """A link in the order of its ends."""
    swap = (n2 < n1) | ((n2 == n1) & (e2 < e1))
    return [F.when(swap, b).otherwise(a).alias(c) for c, a, b in (("n1", n1, n2), ("e1", e1, e2), ("n2", n2, n1), ("e2", e2, e1))]


def used_links(paths: DataFrame) -> DataFrame:
    """Links that paths take -> n1, e1, n2, e2, support, canonical."""
    taken = steps(paths).where("next_contig is not null")
    ends = canonical(F.col("contig"), end_towards_next(F.col("orient")), F.col("next_contig"), 1 - end_towards_next(F.col("next_orient")))
    return taken.select(*ends).groupBy("n1", "e1", "n2", "e2").agg(F.count(F.lit(1)).alias("support"))


def dedupe_links(links: DataFrame) -> DataFrame:
    """Each link once, whichever end it is written from."""
    return links.select(*canonical(F.col("n1"), F.col("e1"), F.col("n2"), F.col("e2"))).distinct()


def degrees(links: DataFrame) -> DataFrame:
    """Links of each contig end -> contig, end, degree."""
    return both_ways(links).groupBy(F.col("n1").alias("contig"), F.col("e1").alias("end")).agg(F.count(F.lit(1)).alias("degree"))


def both_ways(links: DataFrame) -> DataFrame:
    way, turned = F.struct("n1", "e1", "n2", "e2"), F.struct(F.col("n2").alias("n1"), F.col("e2").alias("e1"), F.col("n1").alias("n2"), F.col("e1").alias("e2"))
    same = (F.col("n1") == F.col("n2")) & (F.col("e1") == F.col("e2"))
    return links.select(F.explode(F.when(same, F.array(way)).otherwise(F.array(way, turned))).alias("way")).select("way.*")


def remove_unsupported(links: DataFrame, paths: DataFrame, *, least: int = 1, careful: bool = False) -> DataFrame:
    """links that at least ``least`` paths take; ``careful`` keeps a link that is alone at either end."""
    used = used_links(paths).where(F.col("support") >= least).select("n1", "e1", "n2", "e2")
    clean = dedupe_links(links)
    if not careful:
        return clean.join(used, ["n1", "e1", "n2", "e2"], "left_semi")
    d = degrees(clean)
    alone = clean.join(d.select(F.col("contig").alias("n1"), F.col("end").alias("e1"), F.col("degree").alias("d1")), ["n1", "e1"]).join(d.select(F.col("contig").alias("n2"), F.col("end").alias("e2"), F.col("degree").alias("d2")), ["n2", "e2"])
    marked = alone.join(used.withColumn("used", F.lit(True)), ["n1", "e1", "n2", "e2"], "left")
    return marked.where("used or d1 <= 1 or d2 <= 1").select("n1", "e1", "n2", "e2")


def pair_support(paths: DataFrame) -> DataFrame:
    """Left and right neighbours of a contig in its own direction -> contig, left, left_orient, right, right_orient, n."""
    s = steps(paths).where("next_contig is not null and prev_contig is not null")
    forward = F.col("orient") == ">"
    turn = lambda o: F.when(o == ">", "<").otherwise(">")
    pick = lambda a, b: F.when(forward, a).otherwise(b)
    rows = s.select(
        "contig",
        pick(F.col("prev_contig"), F.col("next_contig")).alias("left"),
        pick(F.col("prev_orient"), turn(F.col("next_orient"))).alias("left_orient"),
        pick(F.col("next_contig"), F.col("prev_contig")).alias("right"),
        pick(F.col("next_orient"), turn(F.col("prev_orient"))).alias("right_orient"),
    )
    return rows.groupBy("contig", "left", "left_orient", "right", "right_orient").agg(F.count(F.lit(1)).alias("n"))


def split_invalid(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Paths cut where the graph has no link -> read_idx, part, idx, contig, orient."""
    s = steps(paths)
    ends = canonical(F.col("prev_contig"), end_towards_next(F.col("prev_orient")), F.col("contig"), 1 - end_towards_next(F.col("orient")))
    known = dedupe_links(links).withColumn("_ok", F.lit(True))
    joined = s.select("read_idx", "idx", "contig", "orient", "prev_contig", *ends).join(known, ["n1", "e1", "n2", "e2"], "left")
    cut = F.when(F.col("prev_contig").isNotNull() & F.col("_ok").isNull(), 1).otherwise(0)
    return joined.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(_order())).select("read_idx", "part", "idx", "contig", "orient")


def next_alignment(alignments: DataFrame) -> DataFrame:
    """Each alignment with the next one on its read, and the gap between them."""
    order = Window.partitionBy("read_idx").orderBy("ord")
    return alignments.select("read_idx", "ord", "contig", F.lead("contig").over(order).alias("next_contig"), (F.lead("start_c").over(order) - F.col("end_c")).alias("gap"))


def coverage(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """What paths cover of contigs: 1 inside a path, the covered fraction at its ends -> contig, coverage.

    ends: (read_idx, first, last), fractions of the first and last contig.
    """
    last = Window.partitionBy("read_idx")
    s = paths.withColumn("lo", F.min("idx").over(last)).withColumn("hi", F.max("idx").over(last)).join(ends, "read_idx")
    part = F.when(F.col("idx") == F.col("lo"), F.col("first")).when(F.col("idx") == F.col("hi"), F.col("last")).otherwise(1.0)
    return s.groupBy("contig").agg(F.sum(part).alias("coverage"))


def consensus_next(paths: DataFrame) -> DataFrame:
    """A25, one step: the oriented next contig that over 60 % of paths agree on (or all but one, with two at least) -> contig, orient, next_contig, next_orient, n, total."""
    s = steps(paths).where("next_contig is not null")
    n = s.groupBy("contig", "orient", "next_contig", "next_orient").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("contig", "orient")
    ranked = n.withColumn("total", F.sum("n").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "next_contig", "next_orient")))
    return ranked.where("k = 1 and (n > 0.6 * total or (n = total - 1 and n >= 2))").drop("k")


def consensus_paths(paths: DataFrame) -> DataFrame:
    """From each oriented contig, on along the consensus of the paths that share the way so far -> contig, orient, steps, path.

    Ways grow step by step, until there is no consensus anywhere; paths that leave theirs drop out.  A path is
    a row with its steps in order, so that a round sends counts and ways only.
    """
    step = f"struct<contig:{dict(paths.dtypes)['contig']},orient:string>"
    whole = paths.where("read_idx is not null").groupBy("read_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "contig", "orient"))).alias("s"))
    whole = whole.select(F.transform("s", lambda x: x["idx"]).alias("ids"), F.transform("s", lambda x: F.struct(x["contig"].alias("contig"), x["orient"].alias("orient"))).alias("s")).checkpoint()
    places = whole.select("ids", "s", F.posexplode("s").alias("at", "own")).select("ids", "s", "at", F.col("own.contig").alias("start"), F.col("own.orient").alias("start_orient"))
    best = paths.select(F.col("contig").alias("start"), F.col("orient").alias("start_orient")).distinct().withColumn("way", F.array().cast(f"array<{step}>")).checkpoint()
    for k in count(1):
        after = F.col("at") + k
        live = places.where((F.size("s") > after) & (F.get("ids", after) == F.get("ids", "at") + k))
        if k > 1:
            live = live.join(sent(best.where(F.size("way") == k - 1)), ["start", "start_orient"]).where(F.slice("s", F.col("at") + 2, F.lit(k - 1)) == F.col("way"))
        n = live.select("start", "start_orient", F.get("s", after).alias("x")).select("start", "start_orient", "x.*").groupBy("start", "start_orient", "contig", "orient").agg(F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy("start", "start_orient")
        top = n.withColumn("total", F.sum("n").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "contig", "orient")))
        top = top.where("k = 1 and (n > 0.6 * total or (n = total - 1 and n >= 2)) and contig is not null and orient is not null")
        top = top.select("start", "start_orient", F.array(F.struct("contig", "orient")).alias("step")).checkpoint()
        if not top.head(1):
            break
        best = best.join(top, ["start", "start_orient"], "left").select("start", "start_orient", F.when(F.col("step").isNotNull(), F.concat("way", "step")).otherwise(F.col("way")).alias("way")).checkpoint()
    text = F.array_join(F.transform("way", lambda x: F.concat(x["orient"], x["contig"].cast("string"))), "")
    return best.select(F.col("start").alias("contig"), F.col("start_orient").alias("orient"), F.size("way").alias("steps"), text.alias("path"))


def assign_reads(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """Reads whose path runs through a segment's members, either way -> seg_id, read_idx, at, reversed.

    segments: (seg_id, idx, contig, orient), idx from 0.  Joined on the first
    member, then compared as arrays.
    """
    whole = paths.groupBy("read_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "contig", "orient"))).alias("s")).select("read_idx", F.transform("s", lambda x: F.concat(x["orient"], x["contig"].cast("string"))).alias("p"))
    members = segments.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("idx", "contig", "orient"))).alias("s"))
    forward = members.select("seg_id", F.lit(False).alias("reversed"), F.transform("s", lambda x: F.concat(x["orient"], x["contig"].cast("string"))).alias("m"))
    turned = members.select("seg_id", F.lit(True).alias("reversed"), F.transform(F.reverse("s"), lambda x: F.concat(F.when(x["orient"] == ">", "<").otherwise(">"), x["contig"].cast("string"))).alias("m"))
    both = forward.unionByName(turned).withColumn("anchor", F.get("m", F.lit(0)))
    placed = whole.select("read_idx", "p", F.posexplode("p").alias("at", "anchor")).join(both, "anchor")
    return placed.where(F.slice("p", F.col("at") + 1, F.size("m")) == F.col("m")).select("seg_id", "read_idx", "at", "reversed")


def reach(links: DataFrame, starts: DataFrame, lengths: DataFrame, *, most: int) -> DataFrame:
    """Simple paths from contig ends, inner length at most ``most`` -> start, end, target, target_end, inner, path.

    starts: (start, end): leaving ``start`` by ``end``; lengths: (contig, len).
    Rounds go on until no path does; each joins once and is cut from its lineage.
    None is broadcast: over many rounds all that would pass the driver.
    """
    ways = both_ways(links).checkpoint()
    live = starts.select("start", "end", F.col("start").alias("n1"), F.col("end").alias("e1"), F.lit(0).cast("long").alias("inner"), F.array("start").alias("path"))
    found = None
    while True:
        here = live.join(ways.hint("merge"), ["n1", "e1"]).where(~F.array_contains("path", F.col("n2"))).select("start", "end", F.col("n2").alias("target"), F.col("e2").alias("target_end"), "inner", F.concat("path", F.array("n2")).alias("path")).checkpoint()
        if not here.head(1):
            return here if found is None else found
        found = here if found is None else found.unionByName(here)
        live = here.join(lengths.hint("merge"), F.col("target") == F.col("contig")).select("start", "end", F.col("target").alias("n1"), (1 - F.col("target_end")).alias("e1"), (F.col("inner") + F.col("len")).alias("inner"), "path").where(F.col("inner") <= most)


def common_contigs(reached: DataFrame, *, n: int) -> DataFrame:
    """Contigs that ``n`` ends all reach -> target."""
    return reached.groupBy("target").agg(F.count_distinct(F.struct("start", "end")).alias("k")).where(F.col("k") >= n).select("target")


def window_paths(alignments: DataFrame, intervals: DataFrame) -> DataFrame:
    """Alignments as oriented paths of (interval, group) names -> read_idx, ord, steps.

    alignments: (read_idx, ord, contig, start_c, end_c, strand); intervals:
    (contig, read_idx, win_start, win_end, grp).  Steps go on while windows
    touch and have a group, and are turned on the reverse strand.
    """
    met = alignments.join(intervals.where("grp >= 0"), ["contig", "read_idx"]).where("win_end > start_c and win_start < end_c")
    order = Window.partitionBy("read_idx", "ord").orderBy("win_start")
    gap = F.when(F.col("win_start") > F.lag("win_end").over(order), 1).otherwise(0)
    first = met.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(order)).where("_run = 0")
    name = F.concat_ws("_", F.col("contig").cast("string"), F.col("win_start").cast("string"), F.col("grp").cast("string"))
    steps_ = first.groupBy("read_idx", "ord", "strand").agg(F.transform(F.sort_array(F.collect_list(F.struct("win_start", name.alias("name")))), lambda s: s["name"]).alias("names"))
    forward = F.transform("names", lambda x: F.concat(F.lit(">"), x))
    return steps_.select("read_idx", "ord", F.array_join(F.when(F.col("strand") == 1, forward).otherwise(F.reverse(F.transform("names", lambda x: F.concat(F.lit("<"), x)))), "").alias("steps"))


def trim_straight(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Paths without the straight lines at their ends -> read_idx, idx, contig, orient.

    A link is straight if it is alone at both of its ends.  At least one step of a path stays.
    """
    d = degrees(dedupe_links(links))
    here, there = (d.select(F.col("contig").alias(c), F.col("end").alias(e), F.col("degree").alias(n)) for c, e, n in (("contig", "e1", "d1"), ("next_contig", "e2", "d2")))
    s = steps(paths).withColumn("next_idx", F.lead("idx").over(_order()))
    s = s.withColumn("e1", end_towards_next(F.col("orient"))).withColumn("e2", 1 - end_towards_next(F.col("next_orient")))
    bent = ~F.coalesce((F.col("d1") == 1) & (F.col("d2") == 1), F.lit(False))  # the last step has no link, so it is bent
    s = s.join(here, ["contig", "e1"], "left").join(there, ["next_contig", "e2"], "left").withColumn("bent", bent)
    kept = s.groupBy("read_idx").agg(F.min(F.when(F.col("bent"), F.col("idx"))).alias("lo"), F.max(F.when(F.col("bent"), F.col("next_idx"))).alias("hi"))
    return paths.join(kept, "read_idx").where(F.col("idx").between(F.col("lo"), F.coalesce("hi", "lo"))).select("read_idx", "idx", "contig", "orient")


def replace_steps(paths: DataFrame, edits: DataFrame) -> DataFrame:
    """Steps with another contig; edits: (read_idx, idx, before, after); one whose ``before`` doesn't stand there changes nothing."""
    joined = paths.join(edits.select("read_idx", "idx", "before", "after"), ["read_idx", "idx"], "left")
    return joined.select("read_idx", "idx", F.when(F.col("before") == F.col("contig"), F.col("after")).otherwise(F.col("contig")).alias("contig"), "orient")


def cancel(paths: DataFrame, gone: DataFrame) -> DataFrame:
    """A path's first step on each contig of gone (contig) is void, its contig null."""
    first = F.row_number().over(Window.partitionBy("read_idx", "contig").orderBy("idx"))
    marked = paths.withColumn("_k", first).join(gone.select("contig", F.lit(True).alias("_gone")).distinct(), "contig", "left")
    return marked.select("read_idx", "idx", F.when((F.col("_k") == 1) & F.coalesce("_gone", F.lit(False)), None).otherwise(F.col("contig")).alias("contig"), "orient")


def reads_between_unique(paths: DataFrame, segments: DataFrame, copies: DataFrame) -> DataFrame:
    """The reads that polish a segment's contigs -> seg_id, contig, read_idx.

    segments: (seg_id, idx, contig, orient), idx from 0; copies: (contig,
    copies).  A read's path and a segment are laid on each other either way
    round; where all their common steps agree, the contigs between those that
    stand once get the read.  The first such contig gets it only if the common
    steps begin with it.
    """
    p = paths.select("read_idx", (F.row_number().over(_order()) - 1).alias("at"), "contig", "orient", F.count(F.lit(1)).over(Window.partitionBy("read_idx")).alias("long"))
    s = segments.select("seg_id", "idx", "contig", F.col("orient").alias("_o"), F.count(F.lit(1)).over(Window.partitionBy("seg_id")).alias("size"))
    turned = F.col("orient") != F.col("_o")
    met = p.join(s, "contig").join(copies, "contig").withColumn("turned", turned)
    # where the segment's first step falls on the path, in the path's direction
    from_ = F.when(turned, F.col("at") - (F.col("size") - 1 - F.col("idx"))).otherwise(F.col("at") - F.col("idx"))
    met = met.withColumn("shift", from_).withColumn("lo", F.greatest(F.col("shift"), F.lit(0))).withColumn("hi", F.least("long", F.col("shift") + F.col("size")) - 1)
    # as many tasks as the steps need: a task sorts its part of the lays in its memory
    parts = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // SORTED))
    keys = ["read_idx", "seg_id", "turned", "shift"]
    met = met.select(*keys, "lo", "hi", "at", "contig", "copies").repartition(parts, *keys)
    lay = Window.partitionBy(*keys)
    once = F.when(F.col("copies") == 1, F.col("at"))
    met = met.withColumn("n", F.count(F.lit(1)).over(lay)).withColumn("u1", F.min(once).over(lay)).withColumn("u2", F.max(once).over(lay))
    inside = (F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("at") <= F.col("u2")) & ((F.col("at") > F.col("u1")) | (F.col("u1") == F.col("lo")) & (F.col("at") == F.col("u1")))
    return met.where(inside).select("seg_id", "contig", "read_idx").distinct()


def full_overlap(strand: Column, s1: Column, e1: Column, n1: Column, s2: Column, e2: Column, n2: Column) -> Column:
    """an overlap goes on to a read's end on both sides, but for less than half of it."""
    half1, half2 = (e1 - s1) / 2, (e2 - s2) / 2
    head1, tail1, head2, tail2 = s1 < half1, n1 - e1 < half1, s2 < half2, n2 - e2 < half2
    return F.when(strand == 1, (head1 | head2) & (tail1 | tail2)).otherwise((head1 | tail2) & (tail1 | head2))


def drop_split_overlaps(overlaps: DataFrame, groups: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """overlaps (r1, r2, ...) but those whose reads are in different groups of a backbone; groups: (by, read_idx, grp), -1 is none."""
    own = groups.where("grp <> -1")
    a, b = (own.select(*by, F.col("read_idx").alias(r), F.col("grp").alias(g)) for r, g in (("r1", "g1"), ("r2", "g2")))
    pairs = overlaps.select("r1", "r2").distinct()
    apart = pairs.join(a, "r1").join(b, [*by, "r2"]).where("g1 <> g2").select("r1", "r2").distinct()
    return overlaps.join(apart, ["r1", "r2"], "left_anti")

"""Contig graphs: links (n1, e1, n2, e2) between contig ends (0 left, 1 right).

Loops over rounds cut their lineage in each round with ``checkpoint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .path_ops import both_ways, dedupe_links, degrees, pair_support, sent, steps

#: Rows that one task joins with themselves.
SELF = 500_000


def link_ends_valid(links: DataFrame) -> DataFrame:
    """Links that are written from one end only -> the missing ones."""
    turned = links.select(F.col("n2").alias("n1"), F.col("e2").alias("e1"), F.col("n1").alias("n2"), F.col("e1").alias("e2"))
    return turned.join(links, ["n1", "e1", "n2", "e2"], "left_anti").distinct()


def remove_contigs(links: DataFrame, gone: DataFrame) -> DataFrame:
    """All links of contigs cut; gone: (contig)."""
    a, b = (gone.select(F.col("contig").alias(c)) for c in ("n1", "n2"))
    return links.join(a, "n1", "left_anti").join(b, "n2", "left_anti").select("n1", "e1", "n2", "e2")


def rename_contigs(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links after contigs were merged; names: (contig, new, flip), flip where the new one runs against it."""
    for n, e in (("n1", "e1"), ("n2", "e2")):
        m = names.select(F.col("contig").alias(n), "new", "flip")
        links = links.join(m, n, "left").withColumn(n, F.coalesce("new", n)).withColumn(e, F.when(F.col("flip"), 1 - F.col(e)).otherwise(F.col(e))).drop("new", "flip")
    return links.select("n1", "e1", "n2", "e2")


def chains(links: DataFrame) -> DataFrame:
    """Contigs on linear chains -> contig, chain, joined by links that are alone at both ends.

    chain is the smallest contig of the chain.  Labels jump to their label's
    label, so that rounds grow with the logarithm of a chain's length.
    """
    clean = dedupe_links(links).where("n1 <> n2")
    d = degrees(links)
    alone = d.where("degree = 1")
    inner = clean.join(alone.select(F.col("contig").alias("n1"), F.col("end").alias("e1")), ["n1", "e1"], "left_semi").join(alone.select(F.col("contig").alias("n2"), F.col("end").alias("e2")), ["n2", "e2"], "left_semi")
    edges = inner.select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    return component_labels(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))).select(F.col("node").alias("contig"), F.col("label").alias("chain"))


def component_labels(edges: DataFrame) -> DataFrame:
    """Both directions of each edge (a, b) -> node, label: the smallest node it reaches."""
    edges = edges.distinct().checkpoint()
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).checkpoint()
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        jump = step.join(labels.select(F.col("node").alias("new"), F.col("label").alias("further")), "new", "left")
        new = jump.select("node", F.least("new", F.coalesce("further", "new")).alias("label"), F.col("label").alias("old")).checkpoint()
        changed = new.where("label <> old").head(1)
        labels = new.select("node", "label")
        if not changed:
            return labels


def chain_contigs(contigs: DataFrame, chain_of: DataFrame) -> DataFrame:
    """Length and depth of merged chains -> chain, members, len, depth; depth = sum(depth len) / (sum(len) + 1).

    contigs: (contig, len, depth).
    """
    joined = contigs.join(chain_of, "contig", "left").withColumn("chain", F.coalesce("chain", "contig"))
    return joined.groupBy("chain").agg(F.count(F.lit(1)).alias("members"), F.sum("len").alias("len"), (F.sum(F.col("depth") * F.col("len")) / (F.sum("len") + 1)).alias("depth"))


def tip_extensions(links: DataFrame, contigs: DataFrame, *, rounds: int = 5) -> DataFrame:
    """The longest way on from each contig end, at most ``rounds`` contigs -> contig, end, ext, dead (nothing beyond any more), Q14."""
    ends = contigs.select("contig", "len", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    ways = both_ways(dedupe_links(links)).checkpoint()
    ext = ends.select("contig", "end", F.lit(0).cast("long").alias("ext"))
    for _ in range(rounds):
        beyond = ext.select(F.col("contig").alias("n2"), (1 - F.col("end")).alias("e2"), "ext").join(contigs.select(F.col("contig").alias("n2"), "len"), "n2")
        on = ways.join(beyond, ["n2", "e2"]).groupBy(F.col("n1").alias("contig"), F.col("e1").alias("end")).agg(F.max(F.col("len") + F.col("ext")).alias("on"))
        ext = ends.join(on, ["contig", "end"], "left").select("contig", "end", F.coalesce("on", F.lit(0)).cast("long").alias("ext")).checkpoint()
    return ext


def trim_tips(links: DataFrame, contigs: DataFrame, *, short: int = 1000, factor: int = 5) -> DataFrame:
    """Links to dead ends: of a branching end's branches, a short one that ends while another goes ``factor`` times as far -> links to remove."""
    ext = tip_extensions(links, contigs)
    ways = both_ways(dedupe_links(links))
    branch = ways.join(contigs.select(F.col("contig").alias("n2"), "len"), "n2").join(ext.select(F.col("contig").alias("n2"), (1 - F.col("end")).alias("e2"), "ext"), ["n2", "e2"])
    branch = branch.withColumn("total", F.col("len") + F.col("ext"))
    longest = F.max("total").over(Window.partitionBy("n1", "e1"))
    tips = branch.withColumn("longest", longest).where((F.col("ext") == 0) & (F.col("total") < short) & (F.col("longest") > short) & (factor * F.col("total") < F.col("longest")))
    return tips.select("n1", "e1", "n2", "e2")


def clip_and_pop(links: DataFrame, contigs: DataFrame, *, tip: int = 60, bubble: int = 20) -> DataFrame:
    """F8: contigs that stay: no dead ends below ``tip``, and of parallel short contigs between the same two ends only the smallest id."""
    d = degrees(dedupe_links(links))
    ends = contigs.select("contig", "len").join(d.groupBy("contig").agg(F.count(F.lit(1)).alias("ends"), F.max("degree").alias("most")), "contig", "left")
    dead = ends.where((F.col("len") < tip) & (F.coalesce("ends", F.lit(0)) < 2)).select("contig")
    ways = both_ways(dedupe_links(links))
    left = ways.where("e1 = 0").select(F.col("n1").alias("contig"), F.concat_ws(":", "n2", "e2").alias("l"))
    right = ways.where("e1 = 1").select(F.col("n1").alias("contig"), F.concat_ws(":", "n2", "e2").alias("r"))
    simple = ends.where((F.col("len") < bubble) & (F.col("ends") == 2) & (F.col("most") == 1)).join(left, "contig").join(right, "contig")
    side = simple.select("contig", F.least("l", "r").alias("x"), F.greatest("l", "r").alias("y"))
    popped = side.withColumn("keep", F.min("contig").over(Window.partitionBy("x", "y"))).where("contig <> keep").select("contig")
    return contigs.join(dead.unionByName(popped).distinct(), "contig", "left_anti")


def keep_covered(links: DataFrame, coverage: DataFrame, *, least: float = 1.0) -> DataFrame:
    """links both of whose contigs are covered more than ``least``."""
    ok = coverage.where(F.col("coverage") > least).select("contig")
    return links.join(ok.select(F.col("contig").alias("n1")), "n1", "left_semi").join(ok.select(F.col("contig").alias("n2")), "n2", "left_semi").select("n1", "e1", "n2", "e2")


def redundant_contigs(alignments: DataFrame, links: DataFrame, *, clip: float = 0.1) -> DataFrame:
    """contigs inside another, isolated or with the other's neighbours -> contig.

    alignments: (contig, target, left_clip, right_clip), clips as parts of the contig.
    """
    around = both_ways(dedupe_links(links)).groupBy(F.col("n1").alias("contig")).agg(F.sort_array(F.collect_set(F.struct("n2", "e2"))).alias("near"))
    inside = alignments.where((F.col("left_clip") < clip) & (F.col("right_clip") < clip) & (F.col("contig") != F.col("target")))
    both = inside.join(around, "contig", "left").join(around.select(F.col("contig").alias("target"), F.col("near").alias("theirs")), "target", "left")
    return both.where(F.col("near").isNull() | (F.col("near") == F.col("theirs"))).select("contig").distinct()


def repeat_pairs(links: DataFrame, paths: DataFrame, *, least: int = 2) -> DataFrame:
    """Pairs of neighbours that reads confirm through a contig, by support, ties by id -> contig, left, left_orient, right, right_orient, n, k."""
    d = degrees(dedupe_links(links)).groupBy("contig").agg(F.max("degree").alias("most"))
    support = pair_support(paths).where(F.col("n") >= least).join(d.where("most > 1").select("contig"), "contig", "left_semi")
    order = Window.partitionBy("contig").orderBy(F.desc("n"), "left", "left_orient", "right", "right_orient")
    return support.withColumn("k", F.row_number().over(order))


def unzip_round(links: DataFrame, paths: DataFrame, *, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """G17, one round -> (copies, links): contigs all of whose links reads confirm are replaced by a copy a pair.

    copies: (contig, copy, left, left_orient, right, right_orient, part), part
    of the depth.  Of neighbouring candidates only the smallest id is taken, so
    that the contigs of a round are independent.  The accepted pairs are those
    that confirm a link none before them did, or have at least 3 min + 5 reads,
    min the least support if all pairs occur, else 0.
    """
    clean = dedupe_links(links).checkpoint()
    pairs = repeat_pairs(clean, paths, least=least)
    by = Window.partitionBy("contig")
    lefts, rights = F.size(F.collect_set(F.struct("left", "left_orient")).over(by)), F.size(F.collect_set(F.struct("right", "right_orient")).over(by))
    full = F.when(F.count(F.lit(1)).over(by) == lefts * rights, F.min("n").over(by)).otherwise(0)
    first = (F.row_number().over(Window.partitionBy("contig", "left", "left_orient").orderBy("k")) == 1) | (F.row_number().over(Window.partitionBy("contig", "right", "right_orient").orderBy("k")) == 1)
    marked = pairs.withColumn("_full", full).withColumn("_first", first)
    accepted = marked.where(F.col("_first") | (F.col("n") >= 3 * F.col("_full") + 5)).drop("_full", "_first")
    ways = both_ways(clean)
    n_links = ways.groupBy(F.col("n1").alias("contig")).agg(F.count_if(F.col("e1") == 0).alias("n_left"), F.count_if(F.col("e1") == 1).alias("n_right"))
    confirmed = accepted.groupBy("contig").agg(F.count_distinct("left", "left_orient").alias("c_left"), F.count_distinct("right", "right_orient").alias("c_right"), F.count(F.lit(1)).alias("n_pairs"))
    ready = confirmed.join(n_links, "contig").where("c_left = n_left and c_right = n_right and n_pairs > 1 and n_pairs <= n_left + n_right").select("contig")
    rivals = ways.join(ready.select(F.col("contig").alias("n2")), "n2", "left_semi").groupBy(F.col("n1").alias("contig")).agg(F.min("n2").alias("rival"))
    chosen = ready.join(rivals, "contig", "left").where("rival is null or contig < rival").select("contig").checkpoint()
    total = F.sum("n").over(by)
    copies = accepted.join(chosen, "contig", "left_semi").withColumn("part", F.col("n") / total).withColumn("copy", F.concat_ws("_", F.col("contig").cast("string"), (F.row_number().over(by.orderBy("k")) - 1).cast("string")))
    copies = copies.select("contig", "copy", "left", "left_orient", "right", "right_orient", "part").checkpoint()
    gone = remove_contigs(clean, chosen)
    text = gone.select(F.col("n1").cast("string").alias("n1"), "e1", F.col("n2").cast("string").alias("n2"), "e2")
    left = copies.select(F.col("copy").alias("n1"), F.lit(0).alias("e1"), F.col("left").cast("string").alias("n2"), F.when(F.col("left_orient") == ">", 1).otherwise(0).alias("e2"))
    right = copies.select(F.col("copy").alias("n1"), F.lit(1).alias("e1"), F.col("right").cast("string").alias("n2"), F.when(F.col("right_orient") == ">", 0).otherwise(1).alias("e2"))
    return copies, text.unionByName(left).unionByName(right).distinct()


def rewrite_paths(paths: DataFrame, copies: DataFrame) -> DataFrame:
    """Paths over the copies of ``unzip_round`` -> read_idx (text), idx, contig (text), orient.

    A step goes to the copy that has both its neighbours, at a path's end to
    the only copy that has the one; where there is none, it goes and the path
    falls in two, named read.part.
    """
    flip = lambda o: F.when(F.col(o) == ">", "<").otherwise(">")
    ahead = F.col("orient") == ">"
    s = steps(paths.withColumn("read_idx", F.col("read_idx").cast("string")).withColumn("contig", F.col("contig").cast("string")))
    none = lambda c, o: F.when(F.col(c).isNotNull(), o)
    s = s.select(
        "read_idx", "idx", "contig", "orient",
        F.when(ahead, F.col("prev_contig")).otherwise(F.col("next_contig")).alias("left"),
        F.when(ahead, none("prev_contig", F.col("prev_orient"))).otherwise(none("next_contig", flip("next_orient"))).alias("left_orient"),
        F.when(ahead, F.col("next_contig")).otherwise(F.col("prev_contig")).alias("right"),
        F.when(ahead, none("next_contig", F.col("next_orient"))).otherwise(none("prev_contig", flip("prev_orient"))).alias("right_orient"),
    )
    own = copies.select(*[F.col(c).cast("string").alias(c) for c in ("contig", "copy", "left", "left_orient", "right", "right_orient")])
    both = s.join(own, ["contig", "left", "left_orient", "right", "right_orient"], "left")
    for side, other in (("left", "right"), ("right", "left")):
        single = own.groupBy("contig", side, f"{side}_orient").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias(f"only_{side}")).where("n = 1").drop("n")
        both = both.join(single, ["contig", side, f"{side}_orient"], "left").withColumn(f"only_{side}", F.when(F.col(other).isNull(), F.col(f"only_{side}")))
    both = both.join(own.select("contig", F.lit(True).alias("gone")).distinct(), "contig", "left")
    both = both.withColumn("new", F.coalesce("copy", "only_left", "only_right", F.when(F.col("gone").isNull(), F.col("contig"))))
    part = F.sum(F.col("new").isNull().cast("int")).over(Window.partitionBy("read_idx").orderBy("idx"))
    both = both.withColumn("part", part).where("new is not null")
    return both.select(F.when(F.col("part") > 0, F.concat_ws(".", "read_idx", "part")).otherwise(F.col("read_idx")).alias("read_idx"), "idx", F.col("new").alias("contig"), "orient")


def unzip(links: DataFrame, paths: DataFrame, *, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G17 until stable -> (links, paths, copies); contigs and reads are named by text, copies by contig_number.

    Rounds of independent contigs; paths are rewritten to the copies after
    each.  A contig is replaced once at most, and a copy has one link at each
    end, so the rounds end.  copies: (contig, copy, part of its depth).
    """
    links = links.select(F.col("n1").cast("string").alias("n1"), "e1", F.col("n2").cast("string").alias("n2"), "e2")
    paths = paths.select(F.col("read_idx").cast("string").alias("read_idx"), "idx", F.col("contig").cast("string").alias("contig"), "orient").checkpoint()
    every = None
    while True:
        copies, links = unzip_round(links, paths, least=least)
        links = links.checkpoint()
        told = copies.select("contig", "copy", "part")
        every = told if every is None else every.unionByName(told)
        if not copies.head(1):
            return links, paths, every
        paths = rewrite_paths(paths, copies).checkpoint()


def duplicated(contigs: DataFrame, links: DataFrame, *, share: float = 0.7) -> DataFrame:
    """Contigs whose one end meets several contigs that have no other way, with at least ``share`` of their depth -> contig, end, copies."""
    ways = both_ways(dedupe_links(links)).join(contigs.select(F.col("contig").alias("n2"), F.col("depth").alias("d2")), "n2")
    only = degrees(dedupe_links(links)).where("degree = 1").select(F.col("contig").alias("n2"), F.col("end").alias("e2"))
    around = ways.join(only, ["n2", "e2"]).groupBy(F.col("n1").alias("contig"), F.col("e1").alias("end")).agg(F.count(F.lit(1)).alias("copies"), F.sum("d2").alias("theirs"))
    n = degrees(dedupe_links(links))
    return around.join(n, ["contig", "end"]).join(contigs.select("contig", "depth"), "contig").where((F.col("copies") > 1) & (F.col("copies") == F.col("degree")) & (F.col("depth") > share * F.col("theirs"))).select("contig", "end", "copies")


def reference_coverage(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """Mean depth by length of contigs with one link at most at each end; the sum of lengths starts at 1."""
    many = degrees(dedupe_links(links)).where("degree > 1").select("contig").distinct()
    return contigs.join(many, "contig", "left_anti").agg((F.sum(F.col("len") * F.col("depth")) / (1 + F.sum("len"))).alias("reference"))


def multiplicity(contigs: DataFrame, links: DataFrame, reference: float) -> DataFrame:
    """Copy numbers -> contig, copies: from depth where a contig is unbranched, else the sum of an end's neighbours that are known, until nothing changes."""
    clean = dedupe_links(links).checkpoint()
    d = degrees(clean).groupBy("contig").agg(F.max("degree").alias("most"))
    start = contigs.join(d, "contig", "left").select("contig", F.when(F.coalesce("most", F.lit(0)) <= 1, F.greatest(F.round(F.col("depth") / reference), F.lit(1.0)).cast("int")).alias("copies")).checkpoint()
    only = degrees(clean).where("degree = 1").select(F.col("contig").alias("n2"), F.col("end").alias("e2"), F.lit(1).alias("one"))
    ways = both_ways(clean).join(only.hint("merge"), ["n2", "e2"], "left").checkpoint()
    while True:  # each round but the last gives some contig its number; no broadcasts, which would pass the driver in each
        known = start.select(F.col("contig").alias("n2"), F.col("copies").alias("c2")).hint("merge")
        ends = ways.join(known, "n2").groupBy(F.col("n1").alias("contig"), F.col("e1").alias("end")).agg(F.sum("c2").alias("total"), F.bool_and(F.col("c2").isNotNull() & F.col("one").isNotNull()).alias("all"))
        told = ends.where("all").groupBy("contig").agg(F.max("total").cast("int").alias("told")).hint("merge")
        new = start.join(told, "contig", "left").select("contig", F.coalesce("copies", "told").alias("copies")).checkpoint()
        if new.where("copies is not null").count() == start.where("copies is not null").count():
            return new
        start = new


def contacts(pairs: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """Contacts of contig pairs -> i < j, n.  pairs: (f1, f2, n); fragments: (fragment, contig)."""
    if fragments is not None:
        a, b = (fragments.select(F.col("fragment").alias(f), F.col("contig").alias(c)) for f, c in (("f1", "i"), ("f2", "j")))
        pairs = pairs.join(a, "f1").join(b, "f2")
    else:
        pairs = pairs.select(F.col("f1").alias("i"), F.col("f2").alias("j"), "n")
    return pairs.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("n").alias("n"))


def barcode_contacts(reads: DataFrame) -> DataFrame:
    """Contigs by shared barcode, both orders and i = j -> i, j, n.  reads: (barcode, contig), counted as often as they stand."""
    # as many tasks as the reads need: a task's pairs are counted in its memory
    parts = max(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reads.count() // SELF))
    n = reads.repartition(parts, "barcode").groupBy("barcode", "contig").agg(F.count(F.lit(1)).alias("m"))
    a, b = n.select("barcode", F.col("contig").alias("i"), F.col("m").alias("m1")), n.select("barcode", F.col("contig").alias("j"), F.col("m").alias("m2"))
    return a.join(b, "barcode").groupBy("i", "j").agg(F.sum(F.col("m1") * F.col("m2")).alias("n"))


def sinkhorn(matrix: DataFrame, *, rounds: int = 10) -> DataFrame:
    """(i, j, v) with rows and columns scaled to 1 in turn, rows last -> i, j, v.

    The matrix is made once and stays; only a factor for each row and each column changes and moves.
    """
    matrix = matrix.checkpoint()
    factors = {side: matrix.select(side).distinct().withColumn(f"f{side}", F.lit(1.0)) for side in ("i", "j")}
    factors["j"] = factors["j"].checkpoint()  # those of rows are told by the first round
    for k in range(2 * rounds + 1):
        side, other = ("i", "j") if k % 2 == 0 else ("j", "i")
        sums = matrix.join(sent(factors[other]), other).groupBy(side).agg(F.sum(F.col("v") * F.col(f"f{other}")).alias("s"))
        factors[side] = sums.select(side, (1 / F.col("s")).alias(f"f{side}")).checkpoint()
    return matrix.join(sent(factors["i"]), "i").join(sent(factors["j"]), "j").select("i", "j", (F.col("v") * F.col("fi") * F.col("fj")).alias("v"))


def best_contacts(matrix: DataFrame) -> DataFrame:
    """T5: each contig's strongest partner, ties to the smaller -> i, j, v."""
    return matrix.where("i <> j").groupBy("i").agg(F.min_by(F.struct("j", "v"), F.struct(-F.col("v"), "j")).alias("b")).select("i", "b.j", "b.v")


def prune_contacts(best: DataFrame) -> DataFrame:
    """T5: edges of which one contig at least has no other -> a < b."""
    edges = best.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    n = edges.select("a").unionAll(edges.select("b")).groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    both = edges.join(n.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    return both.where("na = 1 or nb = 1").select("a", "b")


def haploid(contigs: DataFrame, links: DataFrame, reference: float) -> DataFrame:
    """Contigs with about one copy, long or with neighbours on both sides -> contig."""
    ways = both_ways(dedupe_links(links)).join(contigs.select(F.col("contig").alias("n2"), F.col("depth").alias("d2")), "n2")
    around = ways.groupBy(F.col("n1").alias("contig")).agg(F.max("d2").alias("top"), F.count_distinct("e1").alias("sides"))
    mean = contigs.agg(F.avg("len")).first()[0]  # one number
    rows = contigs.join(around, "contig", "left")
    one = (F.round(F.col("depth") / reference) <= 1) & (F.col("top").isNull() | (F.col("depth") < 1.5 * F.col("top"))) & ((F.col("len") > 1000) | (F.col("sides") == 2))
    return rows.where(one | (F.col("len") > F.lit(mean))).select("contig")


def interaction_scores(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """What two segments' members have in common in the matrix -> seg1, seg2, score, relative; members: (seg, contig).

    ``relative`` leaves out contigs that both segments have.
    """
    a, b = (members.select(F.col("seg").alias(s), F.col("contig").alias(c)) for s, c in (("seg1", "i"), ("seg2", "j")))
    both = matrix.join(a, "i").join(b, "j").where("seg1 <> seg2")
    shared1 = members.select(F.col("seg").alias("seg2"), F.col("contig").alias("i"), F.lit(True).alias("x1"))
    shared2 = members.select(F.col("seg").alias("seg1"), F.col("contig").alias("j"), F.lit(True).alias("x2"))
    both = both.join(shared1, ["seg2", "i"], "left").join(shared2, ["seg1", "j"], "left")
    return both.groupBy("seg1", "seg2").agg(F.sum("v").alias("score"), F.sum(F.when(F.col("x1").isNull() & F.col("x2").isNull(), F.col("v")).otherwise(0.0)).alias("relative"))


def segment_depths(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """Depth by length of a segment's members -> seg, depth, len."""
    return members.join(contigs, "contig").groupBy("seg").agg((F.sum(F.col("depth") * F.col("len")) / F.sum("len")).alias("depth"), F.sum("len").alias("len"))


def copies_number(members: DataFrame) -> DataFrame:
    """How often each contig stands in segments."""
    return members.groupBy("contig").agg(F.count(F.lit(1)).alias("copies"))


def chimera_cuts(cuts: DataFrame, *, share: float = 0.7) -> DataFrame:
    """Cuts (contig, pos, crossing) that fewer than ``share`` of the most on either side cross."""
    left = Window.partitionBy("contig").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("contig").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    low = (F.col("crossing") < share * F.max("crossing").over(left)) & (F.col("crossing") < share * F.max("crossing").over(right))
    near = Window.partitionBy("contig").orderBy("pos")
    least = F.coalesce(F.col("crossing") <= F.lag("crossing").over(near), F.lit(True)) & F.coalesce(F.col("crossing") < F.lead("crossing").over(near), F.lit(True))
    return cuts.withColumn("_low", F.coalesce(low & least, F.lit(False))).where("_low").drop("_low")


def trim_overlaps(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """G27, G28 phase 1: what may be trimmed of each contig's ends -> contig, trim_left, trim_right.

    links: (n1, e1, n2, e2, overlap): the least overlap at an end, but not into
    the most at the other.
    """
    turned = links.select(F.col("n2").alias("n1"), F.col("e2").alias("e1"), "overlap")
    ends = links.select("n1", "e1", "overlap").unionByName(turned).groupBy(F.col("n1").alias("contig")).agg(
        F.min(F.when(F.col("e1") == 0, F.col("overlap"))).alias("min_l"), F.max(F.when(F.col("e1") == 0, F.col("overlap"))).alias("max_l"), F.min(F.when(F.col("e1") == 1, F.col("overlap"))).alias("min_r"), F.max(F.when(F.col("e1") == 1, F.col("overlap"))).alias("max_r")
    )
    zero = F.lit(0)
    rows = contigs.join(ends, "contig")
    cut = lambda least, other: F.greatest(F.least(F.coalesce(least, zero), F.col("len") - F.coalesce(other, zero)), zero)
    return rows.select("contig", cut(F.col("min_l"), F.col("max_r")).alias("trim_left"), cut(F.col("min_r"), F.col("max_l")).alias("trim_right"))


def distance_law(pairs: DataFrame, width: int, *, left: str = "c1", right: str = "c2") -> DataFrame:
    """Contacts by distance, in steps of ``width`` -> distance, n."""
    return pairs.groupBy(F.floor((F.col(right) - F.col(left)) / width).alias("distance")).agg(F.sum("n").alias("n"))

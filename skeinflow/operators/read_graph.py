"""Graphs of reads, and their clusters.

``by`` names the columns that keep graphs apart (contig and window).  Labels
are rows (by, read_idx, label); a label is a read's id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs as shared

#: Rounds between two cuts of the lineage.
CUT = 4


def _both_ways(pairs: DataFrame, by: tuple[str, ...], *values: str) -> DataFrame:
    """Each pair and its turn, from one pass over the pairs."""
    ends = F.explode(F.array(F.struct("r1", "r2"), F.struct(F.col("r2").alias("r1"), F.col("r1").alias("r2"))))
    return pairs.select(*by, ends.alias("ends"), *values).select(*by, "ends.r1", "ends.r2", *values)


def distances(sims: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Both directions of each pair with d = 1 - max(0, diff - 1) / (sim + diff), 0 if too little is shared -> by, r1, r2, d.

    Too little is less than 0.7 of the read's largest similarity.
    """
    both = _both_ways(sims, by, "sim", "diff")
    top = F.max("sim").over(Window.partitionBy(*by, "r1"))
    value = 1 - F.greatest(F.lit(0), F.col("diff") - 1) / (F.col("sim") + F.col("diff"))
    far = (F.col("sim") <= 0) | (F.col("sim") + F.col("diff") < 0.7 * F.col("top"))
    return both.withColumn("top", top).select(*by, "r1", "r2", F.when(far, 0.0).otherwise(value).alias("d"))


def nearest_reads(pairs: DataFrame, *, error: float = 0.05, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Each read's nearest ones, either way round -> by, r1, r2.

    A neighbour counts while d > 1 - 2 error and it is among the first five, at
    1, or at the adaptive threshold: s0 - 3 (s0 - s1), or if that is 1, the
    fifth value after the block of ones.  Ties go to the smaller read.
    """
    order = Window.partitionBy(*by, "r1").orderBy(F.desc("d"), "r2")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = pairs.withColumn("k", F.row_number().over(order)).withColumn("s0", F.first("d").over(whole)).withColumn("s1", F.nth_value("d", 2).over(whole))
    ranked = ranked.withColumn("ones", F.sum((F.col("d") >= 1).cast("int")).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    # the value at min(first below one + 4, last)
    after = F.max(F.when(F.col("k") == F.least(F.col("ones") + 5, F.col("n")), F.col("d"))).over(whole)
    steep = F.col("s0") - 3 * (F.col("s0") - F.coalesce("s1", "s0"))
    ranked = ranked.withColumn("high", F.when(steep == 1, after).otherwise(steep))
    kept = ranked.where((F.col("d") > 1 - 2 * error) & ((F.col("k") <= 5) | (F.col("d") == 1) | (F.col("d") >= F.col("high")))).select(*by, "r1", "r2")
    return _both_ways(kept, by).distinct()


def _distance(r1: np.ndarray, sim: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """d of ``distances``; a read's pairs stand together."""
    first = np.flatnonzero(np.r_[True, r1[1:] != r1[:-1]])
    top = np.repeat(np.maximum.reduceat(sim, first), np.diff(np.r_[first, len(r1)]))
    far = (sim <= 0) | (sim + diff < 0.7 * top)
    return np.where(far, 0.0, 1 - np.maximum(0, diff - 1) / np.maximum(sim + diff, 1))


def cell_distances(cells: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """G2 from cells: what ``distances`` gives for their similarities, without a shuffle of pairs -> by, r1, r2, d."""
    t = dict(cells.dtypes)["read_idx"]
    return shared.similarities(cells, lambda r1, r2, sim, diff: {"r1": r1, "r2": r2, "d": _distance(r1, sim, diff)}, f"r1 {t}, r2 {t}, d double", by=by)


def cell_neighbours(cells: DataFrame, *, error: float = 0.05, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """T1 from cells: what ``nearest_reads`` gives for their distances; only neighbours leave a block -> by, r1, r2."""
    t = dict(cells.dtypes)["read_idx"]

    def finish(r1: np.ndarray, r2: np.ndarray, sim: np.ndarray, diff: np.ndarray) -> shared.Arrays:
        d = _distance(r1, sim, diff)
        order = np.lexsort((r2, -d, r1))
        r1, r2, d = r1[order], r2[order], d[order]
        first = np.flatnonzero(np.r_[True, r1[1:] != r1[:-1]])
        n = np.diff(np.r_[first, len(r1)])
        s0, s1 = d[first], d[first + np.minimum(1, n - 1)]
        ones = np.add.reduceat((d >= 1).astype(np.int64), first)
        steep = s0 - 3 * (s0 - s1)
        high = np.where(steep == 1, d[first + np.minimum(ones + 5, n) - 1], steep)
        k = np.arange(len(r1)) - np.repeat(first, n)
        near = (d > 1 - 2 * error) & ((k < 5) | (d == 1) | (d >= np.repeat(high, n)))
        return {"r1": r1[near], "r2": r2[near]}

    found = shared.similarities(cells, finish, f"r1 {t}, r2 {t}", by=by)
    return _both_ways(found.select(*by, F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2")).distinct(), by)


def strengthen(edges: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Links between reads two steps apart -> by, r1, r2, n (the ways there); edges have both directions."""
    t = dict(edges.dtypes)["r1"]
    ways = edges.withColumn("_one", F.lit(1))
    return shared.similarities(ways, lambda r1, r2, sim, diff: {"r1": r1, "r2": r2, "n": sim}, f"r1 {t}, r2 {t}, n long", by=by, column="r2", entry="r1", value="_one")


def propagate_once(labels: DataFrame, edges: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Each read takes its neighbours' most frequent label, the lowest of equals; negative labels don't vote, and a read without votes keeps its own."""
    votes = edges.join(labels.where("label >= 0").select(*by, F.col("read_idx").alias("r2"), "label"), [*by, "r2"]).groupBy(*by, F.col("r1").alias("read_idx"), "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*by, "read_idx").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
    moved = labels.join(best, [*by, "read_idx"], "left")
    return moved.select(*by, "read_idx", F.when(F.col("label") >= 0, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"))


def propagate(labels: DataFrame, edges: DataFrame, *, rounds: int = 15, still: int = 2, by: tuple[str, ...] = ("contig",), fixed: bool = False) -> DataFrame:
    """Synchronous rounds until at most ``still`` labels change, ``rounds`` at most (a bipartite shape may swing); ``fixed`` runs them all."""
    for k in range(rounds):
        new = propagate_once(labels, edges, by=by)
        if fixed and (k + 1) % CUT:
            labels = new
            continue
        new = new.checkpoint()
        if not fixed:
            changed = new.join(labels.withColumnRenamed("label", "old"), [*by, "read_idx"]).where("label <> old").limit(still + 1).count()
            if changed <= still:
                return new
        labels = new
    return labels


def whispers(edges: DataFrame, labels: DataFrame, *, rounds: int = 15, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """G3 as the sequential kernel: reads in order of id, each sees its predecessors' new labels; one graph a group."""
    keys = list(by)
    rows = labels.join(edges.groupBy(*by, F.col("r1").alias("read_idx")).agg(F.sort_array(F.collect_list("r2")).alias("near")), [*by, "read_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("read_idx", ignore_index=True)
        label = dict(zip(pdf["read_idx"], pdf["label"]))
        for _ in range(rounds):
            changes = 0
            for read, near in zip(pdf["read_idx"], pdf["near"]):
                votes: dict[int, int] = {}
                for other in near if near is not None else ():
                    if label.get(other, -1) >= 0:
                        votes[label[other]] = votes.get(label[other], 0) + 1
                if votes and label[read] >= 0:
                    best = min(votes, key=lambda x: (-votes[x], x))
                    changes += best != label[read]
                    label[read] = best
            if changes <= 2:
                break
        return pdf.assign(label=pdf["read_idx"].map(label))[[*keys, "read_idx", "label"]]

    return rows.groupBy(*keys).applyInPandas(run, labels.select(*keys, "read_idx", "label").schema)


def seeds(cells: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """For each site, labels that begin as the first read with the same allele -> by, pos, read_idx, label.

    With pos among ``by``, all sites' propagations are one.
    """
    first = F.min("read_idx").over(Window.partitionBy(*by, "pos", "is_ref"))
    return cells.select(*by, "pos", "read_idx", first.alias("label"))


def combine(clusterings: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Reads with equal labels in all clusterings -> by, read_idx, label (the smallest such read).

    clusterings: (by, pos, read_idx, label).
    """
    seen = clusterings.groupBy(*by, "read_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("all"))
    return seen.select(*by, "read_idx", F.min("read_idx").over(Window.partitionBy(*by, "all")).alias("label"))


def drop_small(labels: DataFrame, least: int = 5, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Clusters below ``least`` reads become -1."""
    sizes = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(sizes, [*by, "label"]).select(*by, "read_idx", F.when((F.col("n") < least) & (F.col("label") >= 0), F.lit(-1).cast("long")).otherwise(F.col("label")).alias("label"))


def finalize(clusterings: DataFrame, edges: DataFrame, *, least: int = 5, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Combined, small clusters dissolved, propagated, close clusters merged."""
    labels = drop_small(combine(clusterings, by=by), least, by=by)
    return merge_close(edges, propagate(labels, edges, by=by), by=by)


def merge_close(edges: DataFrame, labels: DataFrame, *, rounds: int = 10, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """A cluster that empties when its reads are shaken is dissolved; one graph a group.

    Its reads go to their best neighbouring cluster, or to the second if the
    best is their own and at most twice as strong; only an emptied cluster's
    moves are kept.
    """
    keys = list(by)
    rows = labels.join(edges.groupBy(*by, F.col("r1").alias("read_idx")).agg(F.sort_array(F.collect_list("r2")).alias("near")), [*by, "read_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("read_idx", ignore_index=True)
        label, near = dict(zip(pdf["read_idx"], pdf["label"])), dict(zip(pdf["read_idx"], pdf["near"]))
        inside: dict[int, list[int]] = {}
        for read, cluster in label.items():
            if cluster >= 0:
                inside.setdefault(cluster, []).append(read)
        for cluster in list(inside):
            members, trial = sorted(inside[cluster]), {}
            for _ in range(rounds):
                moved = False
                for read in members:
                    if read in trial:
                        continue
                    votes: dict[int, int] = {}
                    for other in near[read] if near[read] is not None else ():
                        at = trial[other] if other in trial else label.get(other, -1)
                        if at >= 0:
                            votes[at] = votes.get(at, 0) + 1
                    order = sorted(votes, key=lambda x: (-votes[x], x))
                    if order and order[0] != cluster:
                        trial[read], moved = order[0], True
                    elif len(order) > 1 and votes[order[0]] <= 2 * votes[order[1]]:
                        trial[read], moved = order[1], True
                if not moved:
                    break
            if members and len(trial) == len(members):
                label.update(trial)
                inside[cluster] = []
                for read, at in trial.items():
                    inside.setdefault(at, []).append(read)
        return pdf.assign(label=pdf["read_idx"].map(label))[[*keys, "read_idx", "label"]]

    return rows.groupBy(*keys).applyInPandas(run, labels.select(*keys, "read_idx", "label").schema)


def majority_bases(cells: DataFrame, labels: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Each cluster's allele at each site, none (-1) if the second is more than half of it or it has less than half -> by, label, pos, base."""
    n = cells.join(labels.where("label >= 0"), [*by, "read_idx"]).groupBy(*by, "label", "pos").agg(F.count_if(F.col("is_ref") == 1).alias("a"), F.count_if(F.col("is_ref") == 0).alias("b"))
    top, second = F.greatest("a", "b"), F.least("a", "b")
    unclear = (2 * second > top) | (2 * top < F.col("a") + F.col("b"))
    return n.select(*by, "label", "pos", F.when(unclear, -1).otherwise(F.when(F.col("a") >= F.col("b"), 1).otherwise(0)).alias("base"))


def incompatible(bases: DataFrame, *, spacing: int = 10, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Sites more than ``spacing`` apart at which two clusters differ -> by, c1, c2, n."""
    t = dict(bases.dtypes)["label"]
    return shared.spaced_differences(bases.where("base >= 0"), spacing, ("c1", "c2", "n"), f"c1 {t}, c2 {t}, n long", by=by, entry="label", value="base")


def inter_cluster_links(edges: DataFrame, labels: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Of a cluster's links, the part that goes to another -> by, c1, c2, links, ratio."""
    own = labels.where("label >= 0")
    a, b = (own.select(*by, F.col("read_idx").alias(r), F.col("label").alias(c)) for r, c in (("r1", "c1"), ("r2", "c2")))
    n = edges.join(a, [*by, "r1"]).join(b, [*by, "r2"]).groupBy(*by, "c1", "c2").agg(F.count(F.lit(1)).alias("links"))
    total = F.sum("links").over(Window.partitionBy(*by, "c1"))
    return n.withColumn("ratio", F.col("links") / total).where("c1 <> c2")


def greedy_merge(ratios: DataFrame, clashes: DataFrame, labels: DataFrame, *, least: float = 0.01, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Cluster pairs by ratio, merged unless two of their members clash more than once -> by, label, merged.

    One window's clusters meet in a group: few rows, whatever the depth.
    """
    keys = list(by)
    clusters = labels.where("label >= 0").select(*by, F.col("label").alias("c1"), F.col("label").alias("c2")).distinct().withColumn("ratio", F.lit(-1.0)).withColumn("n", F.lit(0).cast("long"))
    pairs = ratios.where(F.col("ratio") > least).select(*by, "c1", "c2", "ratio", F.lit(0).cast("long").alias("n"))
    bad = clashes.where("n > 1").select(*by, "c1", "c2", F.lit(-2.0).alias("ratio"), "n")
    rows = clusters.unionByName(pairs).unionByName(bad)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = {c: c for c in pdf.loc[pdf["ratio"] == -1, "c1"]}
        members, clash = {c: [c] for c in root}, {c: set() for c in root}
        for x, y in pdf.loc[pdf["ratio"] == -2, ["c1", "c2"]].itertuples(index=False):
            if x in clash and y in clash:
                clash[x].add(y)
                clash[y].add(x)
        for row in pdf[pdf["ratio"] > 0].sort_values(["ratio", "c1", "c2"], ascending=[False, True, True]).itertuples():
            a, b = root.get(row.c1), root.get(row.c2)
            if a is None or b is None or a == b:
                continue
            # a root holds its members' clashes; look from the smaller side
            few, many = sorted((a, b), key=lambda c: len(members[c]))
            if not any(c in clash[many] for c in members[few]):
                keep, gone = min(a, b), max(a, b)
                for c in members[gone]:
                    root[c] = keep
                members[keep] += members.pop(gone)
                clash[keep] |= clash[gone]
        first = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**{k: [v] * len(root) for k, v in first.items()}, "label": list(root), "merged": list(root.values())})

    types = dict(labels.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"label {types['label']}", f"merged {types['label']}"])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def largest(labels: DataFrame, k: int, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """The k largest clusters keep their label, other reads get -1 (to be propagated anew); ties to the lower label."""
    sizes = labels.where("label >= 0").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "label"))
    top = sizes.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "label", F.lit(1).alias("top"))
    return labels.join(top, [*by, "label"], "left").select(*by, "read_idx", F.when(F.col("top").isNull() & (F.col("label") >= 0), F.lit(-1).cast("long")).otherwise(F.col("label")).alias("label"))


def limit_ploidy(labels: DataFrame, edges: DataFrame, ploidy: int, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """At most ``ploidy`` clusters; the others' reads join those their neighbours are in."""
    kept = largest(labels, ploidy, by=by)
    votes = edges.join(kept.where("label >= 0").select(*by, F.col("read_idx").alias("r2"), "label"), [*by, "r2"]).groupBy(*by, F.col("r1").alias("read_idx"), "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*by, "read_idx").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
    joined = kept.join(best, [*by, "read_idx"], "left")
    return joined.select(*by, "read_idx", F.when(F.col("label") == -1, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"))


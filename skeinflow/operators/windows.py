"""Intervals, windows along contigs, and what reads do there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(lengths: DataFrame, size: int, *, least_tail: int = 100, contig: str = "contig", length: str = "len") -> DataFrame:
    """Windows of ``size``; a tail below ``least_tail`` joins the last one -> contig, win, win_start, win_end (half-open)."""
    n = F.greatest(F.floor((F.col(length) - least_tail) / size) + F.when((F.col(length) - least_tail) % size >= 0, 1).otherwise(0), F.lit(1))
    rows = lengths.select(F.col(contig).alias("contig"), F.col(length).alias("len"), n.cast("int").alias("n"))
    rows = rows.select("contig", "len", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("win"))
    end = F.when(F.col("win") == F.col("n") - 1, F.col("len")).otherwise((F.col("win") + 1) * size)
    return rows.select("contig", "win", (F.col("win") * size).cast("long").alias("win_start"), end.cast("long").alias("win_end"))


def in_tiles(lengths: DataFrame, size: int, intervals: DataFrame, *, least_tail: int = 100, contig: str = "contig", length: str = "len", start: str = "start_c", end: str = "end_c") -> DataFrame:
    """Intervals with each tile that they touch, ends included -> intervals, win, win_start, win_end as ``tiles`` has them.

    Tiles follow from a place and the contig's length, so that none is made
    that no interval touches.
    """
    n = F.greatest(F.floor((F.col("_len") - least_tail) / size) + F.when((F.col("_len") - least_tail) % size >= 0, 1).otherwise(0), F.lit(1)).cast("int")
    known = lengths.select(F.col(contig).alias("contig"), F.col(length).alias("_len")).withColumn("_n", n)
    tile = lambda x: F.greatest(F.least(F.floor(F.col(x) / size), F.col("_n") - 1), F.lit(0)).cast("int")
    rows = intervals.where(F.col(end) >= F.col(start)).join(known, "contig").withColumn("win", F.explode(F.sequence(tile(start), tile(end))))
    begin = F.col("win").cast("long") * size
    last = F.when(F.col("win") == F.col("_n") - 1, F.col("_len").cast("long")).otherwise(begin + size)
    return rows.withColumn("win_start", begin).withColumn("win_end", last).drop("_len", "_n")


def clipped_by_tiles(lengths: DataFrame, size: int, intervals: DataFrame, *, start: str = "start_c", end: str = "end_c") -> DataFrame:
    """J8 over tiles: what ``clipped`` gives for ``tiles``."""
    both = in_tiles(lengths, size, intervals, start=start, end=end)
    return both.withColumn("overlap", F.least("win_end", end) - F.greatest("win_start", start)).where("overlap > 0")


def window_size(mean_length: float, long_reads: int, *, amplicon: bool = False, longest: int = 0) -> int:
    """2000 bases, fewer where reads are short, a whole contig for amplicons."""
    if amplicon:
        return longest
    if mean_length < 2000:
        return 500
    return 1000 if long_reads < 20 and mean_length < 4000 else 2000


def covering(points: DataFrame, intervals: DataFrame, *, bin_size: int, by: str = "contig", point: str = "mid", start: str = "start_c", end: str = "end_c") -> DataFrame:
    """Intervals that cover a point, start <= point <= end, joined by bins instead of a nested loop."""
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    return p.join(i, [by, "_bin"]).where((F.col(start) <= F.col(point)) & (F.col(end) >= F.col(point))).drop("_bin")


def clipped(windows: DataFrame, intervals: DataFrame, *, bin_size: int, by: str = "contig", start: str = "start_c", end: str = "end_c") -> DataFrame:
    """Intervals that meet a window, with ``overlap`` = min(ends) - max(starts).

    Both go to the bins they touch; a pair counts in the bin in which its
    overlap begins, so that it counts once.
    """
    spread = lambda df, a, b: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size))))
    both = spread(windows.where("win_end > win_start"), "win_start", "win_end").join(spread(intervals.where(F.col(end) > F.col(start)), start, end), [by, "_bin"])
    first = F.greatest("win_start", start)
    both = both.withColumn("overlap", F.least("win_end", end) - first)
    return both.where((F.col("overlap") > 0) & (F.floor(first / bin_size) == F.col("_bin"))).drop("_bin")


def window_depths(overlaps: DataFrame, groups: DataFrame) -> DataFrame:
    """Clipped overlaps over the window's length, by group -> contig, win, grp, depth."""
    kept = overlaps.join(groups.select("contig", "win", "read_idx", "grp"), ["contig", "win", "read_idx"])
    return kept.groupBy("contig", "win", "grp").agg((F.sum("overlap") / F.first(F.col("win_end") - F.col("win_start"))).alias("depth"))


def read_mask(cells: DataFrame, *, slack: Column | float = 0.0) -> DataFrame:
    """Reads that reach from the first to the last site of a window -> contig, win, read_idx.

    cells: (contig, win, pos, read_idx); ``slack`` is the part of the span that
    may be missing at either end.
    """
    span = cells.groupBy("contig", "win").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    reach = cells.groupBy("contig", "win", "read_idx").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    room = (slack if isinstance(slack, Column) else F.lit(slack)) * (F.col("hi") - F.col("lo"))
    return reach.join(span, ["contig", "win"]).where((F.col("a") <= F.col("lo") + room) & (F.col("b") >= F.col("hi") - room)).select("contig", "win", "read_idx")


def adjacent(groups: DataFrame) -> DataFrame:
    """A read's groups in successive windows -> contig, win, read_idx, grp, before."""
    earlier = groups.select("contig", (F.col("win") + 1).alias("win"), "read_idx", F.col("grp").alias("before"))
    return groups.join(earlier, ["contig", "win", "read_idx"]).select("contig", "win", "read_idx", "grp", "before")


def stitch(groups: DataFrame) -> DataFrame:
    """Groups of successive windows that share enough reads -> contig, win, before, grp, shared, size.

    ``size`` is the group's reads that the window before has too; it takes 5 of
    them, or 70 % if that is fewer.
    """
    pairs = adjacent(groups.where("grp >= 0")).groupBy("contig", "win", "before", "grp").agg(F.count(F.lit(1)).alias("shared"))
    size = F.sum("shared").over(Window.partitionBy("contig", "win", "grp"))
    return pairs.withColumn("size", size).where(F.col("shared") >= F.least(F.lit(5.0), 0.7 * F.col("size")))


def unstitched(groups: DataFrame, stitched: DataFrame) -> DataFrame:
    """Groups of a window that nothing in the next one continues, linked to all of its groups -> contig, win, before, grp."""
    here = groups.where("grp >= 0").select("contig", "win", "grp").distinct()
    left = here.select("contig", (F.col("win") + 1).alias("win"), F.col("grp").alias("before"))
    loose = left.join(stitched.select("contig", "win", "before"), ["contig", "win", "before"], "left_anti")
    return loose.join(here, ["contig", "win"]).select("contig", "win", "before", "grp")


def bijections(groups: DataFrame, stitched: DataFrame) -> DataFrame:
    """Window pairs that stitch one to one, all groups of both -> contig, win."""
    here = groups.where("grp >= 0").groupBy("contig", "win").agg(F.count_distinct("grp").alias("n"))
    before = here.select("contig", (F.col("win") + 1).alias("win"), F.col("n").alias("n_before"))
    maps = stitched.groupBy("contig", "win").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("grp").alias("right"), F.count_distinct("before").alias("left"))
    all_ = maps.join(here, ["contig", "win"]).join(before, ["contig", "win"])
    return all_.where("links = right and links = left and right = n and left = n_before").select("contig", "win")


def merge_intervals(groups: DataFrame, stitched: DataFrame) -> DataFrame:
    """Runs of windows that stitch one to one become one interval, with its first window's group numbers.

    -> contig, interval, last_win, read_idx, grp.  A read takes the group that
    its first window in the run maps to, so reads that are missing in one
    window inherit it.  Group numbers follow the map from window to window in a
    fold over a contig's windows, which holds maps, not reads.
    """
    one = bijections(groups, stitched)
    links = stitched.join(one, ["contig", "win"]).select("contig", "win", "grp", "before")
    wins = groups.select("contig", "win").distinct().join(one.withColumn("joined", F.lit(1)), ["contig", "win"], "left")
    order = Window.partitionBy("contig").orderBy("win")
    runs = wins.withColumn("interval", F.max(F.when(F.col("joined").isNull(), F.col("win"))).over(order)).select("contig", "win", "interval")
    steps = links.join(runs, ["contig", "win"]).groupBy("contig", "interval").agg(F.sort_array(F.collect_list(F.struct("win", "grp", "before"))).alias("s"))
    empty = F.create_map().cast("map<string,int>")

    def follow(state: Column, s: Column) -> Column:
        root = F.coalesce(F.try_element_at(state, F.concat_ws(":", s["win"] - 1, s["before"])), s["before"])
        return F.map_concat(state, F.map_from_arrays(F.array(F.concat_ws(":", s["win"], s["grp"])), F.array(root.cast("int"))))

    roots = steps.select("contig", "interval", F.explode(F.aggregate("s", empty, follow)).alias("k", "root"))
    at = F.split("k", ":")
    roots = roots.select("contig", "interval", at[0].cast("int").alias("win"), at[1].cast("int").alias("grp"), "root")
    placed = groups.where("grp >= 0").join(runs, ["contig", "win"]).join(roots, ["contig", "interval", "win", "grp"], "left").withColumn("grp", F.coalesce("root", "grp"))
    last = runs.groupBy("contig", "interval").agg(F.max("win").alias("last_win"))
    first = placed.groupBy("contig", "interval", "read_idx").agg(F.min_by("grp", "win").alias("grp"))
    return first.join(last, ["contig", "interval"]).select("contig", "interval", "last_win", "read_idx", "grp")


def sessions(points: DataFrame, gap: int, *, by: tuple[str, ...], at: str) -> DataFrame:
    """Neighbours at most ``gap`` apart share a number -> points with ``session``."""
    order = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    return points.withColumn("_new", new).withColumn("session", F.sum("_new").over(order)).drop("_new")


def unaligned_gaps(alignments: DataFrame, lengths: DataFrame, *, least: int = 1000, read: str = "read_idx", start: str = "qs", end: str = "qe") -> DataFrame:
    """Parts of a read that no alignment covers, head and tail included -> read_idx, gap_start, gap_end."""
    rows = alignments.select(F.col(read).alias("read_idx"), F.lit(0).alias("tail"), F.col(start).alias("s"), F.col(end).alias("e"))
    tail = lengths.select(F.col(read).alias("read_idx"), F.lit(1).alias("tail"), F.col("len").alias("s"), F.col("len").alias("e"))
    # the read's end comes last, even where alignments go beyond it
    order = Window.partitionBy("read_idx").orderBy("tail", "s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("e").over(order), F.lit(0).cast("long"))
    return rows.unionByName(tail).withColumn("gap_start", covered).where(F.col("s") - F.col("gap_start") > least).select("read_idx", "gap_start", F.col("s").alias("gap_end"))


def local_divergence(columns: DataFrame, width: int = 100) -> DataFrame:
    """Mismatches in the last ``width`` alignment columns of a read."""
    order = Window.partitionBy("read_idx").orderBy("k").rowsBetween(1 - width, 0)
    return columns.withColumn("recent", F.sum("mismatch").over(order))

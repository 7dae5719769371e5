"""Contingency of columns, of reads and of partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairs


def biallelic(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells at the sites that carry either allele -> contig, pos, read_idx, is_ref."""
    s = sites.select("contig", "pos", "ref", "alt")
    kept = cells.join(s, ["contig", "pos"]).where((F.col("allele") == F.col("ref")) | (F.col("allele") == F.col("alt")))
    return kept.select("contig", "pos", "read_idx", (F.col("allele") == F.col("ref")).cast("int").alias("is_ref"))


def intersect_columns(left: DataFrame, right: DataFrame, *, offset: int) -> DataFrame:
    """Reads that two columns share, the second ``offset`` further -> contig, read_idx, p1, p2, s1, s2."""
    a = left.select("contig", "read_idx", F.col("pos").alias("p1"), F.col("is_ref").alias("s1"))
    b = right.select("contig", "read_idx", F.col("pos").alias("p2"), F.col("is_ref").alias("s2"), (F.col("pos") - offset).alias("p1"))
    return a.join(b, ["contig", "read_idx", "p1"]).select("contig", "read_idx", "p1", "p2", "s1", "s2")


def contingency(cells: DataFrame, *, within: int) -> DataFrame:
    """A5: 2x2 tables of columns at most ``within`` apart -> contig, p1, p2, n00, n01, n10, n11.

    A read meets itself only within the band, found by bins of that width: a
    cell goes to its bin, and as a partner to the bin before it too.
    """
    bin_ = F.floor(F.col("pos") / within)
    a = cells.select("contig", "read_idx", F.col("pos").alias("p1"), F.col("is_ref").alias("a"), bin_.alias("bin"))
    b = cells.select("contig", "read_idx", F.col("pos").alias("p2"), F.col("is_ref").alias("b"), F.explode(F.array(bin_, bin_ - 1)).alias("bin"))
    both = a.join(b, ["contig", "read_idx", "bin"]).where((F.col("p1") < F.col("p2")) & (F.col("p2") - F.col("p1") <= within))
    n = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(f"n{x}{y}")
    return both.groupBy("contig", "p1", "p2").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))


def chi_square(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """With one degree of freedom; no rows 0, both sides monomorphic -1, an expected count of 0 gives 0."""
    total = n00 + n01 + n10 + n11
    rows = (n00 + n01 == 0) | (n10 + n11 == 0)
    cols = (n00 + n10 == 0) | (n01 + n11 == 0)
    square = F.pow((n00 * n11 - n01 * n10).cast("double"), F.lit(2.0))
    value = total.cast("double") * square / ((n00 + n01).cast("double") * (n10 + n11) * (n00 + n10) * (n01 + n11))
    return F.when(total == 0, 0.0).when(rows & cols, -1.0).when(rows | cols, 0.0).otherwise(value)


def similarity_difference(cells: DataFrame, *, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """For reads that share columns -> by, r1 < r2, sim (3 for both alternative, 1 for both reference), diff.

    As many pairs as the square of a column's depth (``pileup.cap_coverage``),
    but added up in place (``pairs``), so that only cells are shuffled.
    """
    t = dict(cells.dtypes)["read_idx"]

    def finish(r1: np.ndarray, r2: np.ndarray, sim: np.ndarray, diff: np.ndarray) -> pairs.Arrays:
        once = r1 < r2
        return {"r1": r1[once], "r2": r2[once], "sim": sim[once], "diff": diff[once]}

    return pairs.similarities(cells, finish, f"r1 {t}, r2 {t}, sim long, diff long", by=by)


def votes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("contig", "read_idx").agg(F.count_if(F.col("is_ref") == 1).alias("more"), F.count_if(F.col("is_ref") == 0).alias("less"))


def add_votes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Votes of both, reads of either: a union and a sum instead of a full outer join."""
    return left.unionByName(right).groupBy("contig", "read_idx").agg(F.sum("more").alias("more"), F.sum("less").alias("less"))


def merge_sites(automatic: DataFrame, robust: DataFrame) -> DataFrame:
    """All sites of both lists -> contig, pos, robust (0 where an automatic site stands, which wins).  No tail is lost."""
    both = automatic.select("contig", "pos", F.lit(0).alias("robust")).unionByName(robust.select("contig", "pos", F.lit(1).alias("robust")))
    return both.groupBy("contig", "pos").agg(F.min("robust").alias("robust"))


def divergence_threshold(n: Column) -> Column:
    """0.5 n + 3 sqrt(n / 4): votes above it are no accident."""
    return 0.5 * n + 3 * F.sqrt(n / 4)


def partition_distance(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Partitions (by, part, read_idx, state, more, less) compared over shared reads, in the better phase.

    -> by, p, q, n00, n01, n10, n11, phase, comparable.  Only reads whose vote
    is backed more than once on both sides count; both phasings diverging on
    two reads that both sides are sure of, or on five that either is sure of,
    means not comparable.
    """
    a = left.select(*by, F.col("part").alias("p"), "read_idx", F.col("state").alias("s"), F.col("more").alias("m1"), F.col("less").alias("l1"))
    b = right.select(*by, F.col("part").alias("q"), "read_idx", F.col("state").alias("t"), F.col("more").alias("m2"), F.col("less").alias("l2"))
    both = a.join(b, [*by, "read_idx"]).where("p < q and abs(s) = 1 and abs(t) = 1 and m1 > 1 and m2 > 1")
    sure1, sure2 = (F.col(f"m{k}") > divergence_threshold(F.col(f"m{k}") + F.col(f"l{k}")) for k in (1, 2))
    solid, weak = sure1 & sure2, sure1 | sure2
    same = F.col("s") == F.col("t")
    n = lambda x, y: F.count_if((F.col("s") == x) & (F.col("t") == y))
    sums = both.groupBy(*by, "p", "q").agg(
        n(-1, -1).alias("n00"), n(-1, 1).alias("n01"), n(1, -1).alias("n10"), n(1, 1).alias("n11"),
        F.count_if(same & solid).alias("same_solid"), F.count_if(~same & solid).alias("other_solid"), F.count_if(same & weak).alias("same_weak"), F.count_if(~same & weak).alias("other_weak"),
    )
    phase = F.when(F.col("n00") + F.col("n11") >= F.col("n01") + F.col("n10"), 1).otherwise(-1)
    clash = ((F.col("same_solid") >= 2) & (F.col("other_solid") >= 2)) | ((F.col("same_weak") >= 5) & (F.col("other_weak") >= 5))
    return sums.select(*by, "p", "q", "n00", "n01", "n10", "n11", phase.alias("phase"), (~clash).alias("comparable"))


def ln_factorial(n: Column) -> Column:
    """ln n! for whole n, by summing below 256 and by Stirling's series above."""
    x = n.cast("double")
    below = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(256)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))
    above = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3)))
    return F.when(n <= 256, below).otherwise(above)


def ln_choose(n: Column, k: Column) -> Column:
    """C17."""
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def significance(n: Column, m: Column, c: Column, columns: Column) -> Column:
    """Of ``columns`` columns, how likely c have the same m of n reads apart by accident; at most 1."""
    return F.least(F.lit(1.0), F.exp(m * c * F.log(m / n) + ln_choose(n, m) + ln_choose(columns, c)))


def informative(partitions: DataFrame, error: float, by: tuple[str, ...] = ("contig", "part")) -> DataFrame:
    """Partitions with enough well-backed reads on both sides -> by, plus, minus, informative."""
    backed = F.col("more") > F.least(divergence_threshold(F.col("more") + F.col("less")), F.col("more") + F.col("less") - 1.0)
    sums = partitions.groupBy(*by).agg(F.count_if((F.col("state") == 1) & backed).alias("plus"), F.count_if((F.col("state") == -1) & backed).alias("minus"), F.count_if(F.col("state").isin(1, -1)).alias("n"))
    least = error * F.col("n") / 2
    return sums.select(*by, "plus", "minus", ((F.col("plus") >= least) & (F.col("minus") >= least) & (F.col("plus") > 0) & (F.col("minus") > 0)).alias("informative"))


def confidence(partitions: DataFrame, by: tuple[str, ...] = ("contig", "part")) -> DataFrame:
    """A10: (1 / (1 - geometric mean of read confidences))^2 times the reads, over reads with more than one vote."""
    conf = F.col("more") / (F.col("more") + F.col("less"))
    mean = partitions.where("more > 1").groupBy(*by).agg(F.exp(F.avg(F.log(conf))).alias("g"), F.count(F.lit(1)).alias("n"))
    return mean.select(*by, (F.pow(1 / F.greatest(1 - F.col("g"), F.lit(1e-6)), F.lit(2)) * F.col("n")).alias("confidence"))

"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

#: Bits of the hash that one histogram resolves, and how often they are refined.
BITS, LEVELS = 12, 5
#: Per-source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def _digits(h: Column, level: int) -> Column:
    """The hash's first (level + 1) * BITS of its 60 bits."""
    return F.shiftrightunsigned(h, BITS * (LEVELS - 1 - level))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sizes: (source, source_size).  Water-filling under the caps most * source_size.

    Sources by code point, null last, weigh ``weights``, repeating.  Sorted by
    cap a weight, source k is full exactly if the level reached with all before
    it full is at or above its own; the level of the first one that isn't full
    is final, so that resharing needs no loop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("pos", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", final * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def _histogram(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy("source", _digits(F.col("h"), level).alias("digits")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))


def _boundary(histogram: DataFrame, state: DataFrame, small: Callable) -> DataFrame:
    """The bucket in which the words up to a source's budget end, and the budget left for it.

    At most 2 ** BITS rows of a source meet here, whatever the number of documents.
    """
    upto = Window.partitionBy("source").orderBy("digits")
    # no row of ``state`` is lost: a source whose words run out before its budget keeps its last bucket
    found = (
        histogram.join(small(state), histogram["source"].eqNullSafe(state["source"]))
        .select(histogram["source"], "digits", "words", "n", "left")
        .withColumn("upto", F.sum("words").over(upto))
        .withColumn("last", F.max("digits").over(Window.partitionBy("source")))
        .where((F.col("upto") > F.col("left")) | (F.col("digits") == F.col("last")))
    )
    first = F.min_by(F.struct("digits", "words", "n", (F.col("left") - F.col("upto") + F.col("words")).alias("rest")), "digits")
    return found.groupBy("source").agg(first.alias("b")).select("source", "b.*")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """Source, size, and 60 bits of hash of a document."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)), 64 - BITS * LEVELS)
    return F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), h.alias("h")


def thresholds(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> tuple[DataFrame, int, Callable]:
    """rows: (source, size, h) -> a row for each source, the level of its digits, and how to join it."""
    histogram = materialize(_histogram(rows, 0), "mix-histogram")
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(sizes, weights, share, most).withColumn("whole", whole)
    targets = materialize(targets.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    small = F.broadcast if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)

    found = materialize(_boundary(histogram, targets, small), "mix-level")
    level = 0
    while level < LEVELS - 1 and found.where("n > 1").head(1):
        at = found.select(F.col("source").alias("s"), F.col("digits").alias("d"))
        inside = rows.join(small(at), F.col("source").eqNullSafe(F.col("s")) & (_digits(F.col("h"), level) == F.col("d")))
        level += 1
        found = materialize(_boundary(_histogram(inside, level), found.select("source", F.col("rest").alias("left")), small), "mix-level")
    cut = found.select(F.col("source").alias("s"), F.col("digits").alias("d"), "words", "n", "rest")
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("source", "left")
    return small(plan), level, small


def _taken(level: int, most: float) -> Column:
    """Words taken of a document, whose source's thresholds stand beside it."""
    here, size = _digits(F.col("h"), level), F.col("size")
    alone = F.when(F.col("rest") * 2 >= F.col("words"), size).otherwise(0)
    tied = F.when(F.col("words") > 0, F.floor(size * F.least(F.col("rest") / F.col("words"), F.lit(1.0)))).otherwise(0)
    extra = F.when(here < F.col("d"), size).when(here == F.col("d"), F.when(F.col("n") == 1, alone).otherwise(tied)).otherwise(0)
    return F.least(F.col("whole") * size + extra, F.lit(most) * size).cast("long")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Which documents, how often, make the sources meet their targets.

    -> doc_id, size, source_size, target, taken, source.  ``size`` counts the
    words of the text.  The sources share ``share`` times all words by weight;
    no target exceeds ``most`` times its source.  A source takes each document
    floor(target / source_size) times, and once more the documents whose hash
    is below a threshold.  Histograms of words by hash bucket find that
    threshold; only the bucket in which the budget ends is refined, by further
    bits of the hash.  Nothing is sorted, and reruns agree.

    The document on the threshold is taken if that comes nearer to the target.
    Rows that share all bits of the hash (repeated rows) with it take equal
    parts of what is left.  A null or empty text has size 0 and takes 0; a null
    source is a source of its own; a source without words has target 0; an
    empty table gives none.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), *_rows(docs, id_col, text_col, source_col)), "mix-rows")
    plan, level, _ = thresholds(rows, weights, share, most)
    taken = _taken(level, most).alias("taken")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken, "source")


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The mix itself: rows of docs, each as often as ``mix`` takes it whole."""
    source, size, h = _rows(docs, id_col, text_col, source_col)
    rows = materialize(docs.select(source, size, h), "mix-rows")
    plan, level, _ = thresholds(rows, weights, share, most)
    names = docs.columns
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), source, size, h).join(plan, F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.floor(_taken(level, most) / F.col("size"))).otherwise(0).cast("int")
    chosen = wide.select("doc", copies.alias("copies")).where("copies > 0")
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("doc")[c].alias(c) for c in names])

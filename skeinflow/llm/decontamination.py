"""Benchmark passages in training texts, found by spaced seeds."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of a text that are laid out at once.
BLOCK = 65_536
#: Test keys, places to verify (three numbers a row) and words of items up to this many are broadcast; beyond, both sides are dealt out.
BROADCAST_ROWS = 1_000_000
#: Up to this many patterns, a width's substitutions are all listed; beyond, blocks stand for them.
PATTERNS = 16
WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def masks(width: int, misses: int) -> set[str]:
    """Masks, from a 1 to a 1, of which one fits anywhere in each pattern of ``width`` places with up to ``misses`` others.

    Those at a 1 are hashed, those at a 0 may differ.  Of misses + 2 blocks two
    have no miss; pairs of blocks equally far apart have one mask.
    """
    block = width // (misses + 2)
    if block < 2 and math.comb(width, misses) <= PATTERNS:
        return {"".join("0" if i in off else "1" for i in range(width)).strip("0") for off in combinations(range(width), misses)}
    if not block:
        return {"1"}
    return {"1" * block + "0" * (block * d) + "1" * block for d in range(misses + 1)}


def _seeds(df: DataFrame, id_col: str, words: str, at: str, uses: dict[str, set[int]], window: int | None = None) -> DataFrame:
    """(id, key, at): the masks' seeds at every word; with ``window``, of texts whose windows' widths use the mask.

    Words come in blocks, so that a long text is never laid out at once; in a
    block, the array and its shifts are zipped to rows, of which compiled code
    takes seeds.
    """
    span = max(map(len, uses), default=1)
    n = F.size(words)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(words), b * BLOCK + 1, BLOCK + span - 1))
    rows = df.where(n > 0).select(id_col, n.alias("n"), F.posexplode_outer(F.when(n <= BLOCK, F.array(words)).otherwise(blocks)).alias("b", "w"))
    shifts = [F.col("w") if o == 0 else F.slice("w", o + 1, BLOCK + span) for o in range(span)]
    zipped = F.arrays_zip(*[x.alias(f"w{o}") for o, x in enumerate(shifts)]).cast("array<struct<" + ",".join(f"w{o}:bigint" for o in range(span)) + ">>")
    rows = rows.select(id_col, "n", "b", F.posexplode_outer(zipped).alias("p", "z")).where(F.col("p") < BLOCK)
    word = [F.col(f"z.w{o}") for o in range(span)]
    keys = []
    for mask, widths in sorted(uses.items()):
        own = F.least("n", F.lit(window)).isin(sorted(widths)) if window else F.lit(True)
        keys.append(F.when(own & word[len(mask) - 1].isNotNull(), F.xxhash64(F.lit(mask), *[word[o] for o, c in enumerate(mask) if c == "1"])))
    place = (F.col("b") * BLOCK + F.col("p")).alias(at)
    return rows.select(id_col, place, F.explode_outer(F.array(*keys) if keys else F.lit(None).cast("array<long>")).alias("key")).where("key is not null").select(id_col, "key", at)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    identity: float = 0.8,
    min_words: int = 5,
) -> DataFrame:
    """Which documents hold which items -> doc_id, item_id, item_words, matched, best_window.

    Words are lower-cased runs of letters and digits.  A spaced seed hashes the
    words at a mask's ones.  Seeds that a text and an item share lay the item
    along the text; there, an item is held if some ``window`` of its consecutive
    words (all, if it has fewer) agrees with the text in ``identity`` of them or
    more, each at its place.  So up to a fifth of the words may be substituted,
    and a part of an item is enough.  ``matched`` and ``best_window`` count the
    agreeing words, of the whole item and of its best window, at the best place.

    Shorter items have masks of their own widths.  An item of fewer than
    ``min_words`` words, which chance would find anywhere, is held by a text
    that has its words and no others.  Null and empty items and texts hold
    nothing.  Repeated rows and ids give one row for an id and an item.
    """
    all_items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("item")).where(F.size("item") > 0)
    items = materialize(all_items.where(F.size("item") >= min_words), "leaks-items")
    widths = [r["n"] for r in items.select(F.least(F.size("item"), F.lit(window)).alias("n")).distinct().collect()]  # window at most
    uses: dict[str, set[int]] = {}
    for width in widths:
        for mask in masks(width, width - math.ceil(identity * width)):
            uses.setdefault(mask, set()).add(width)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = texts.select("doc_id", word_hashes(F.col("text")).alias("words"))
    tests = _seeds(items, "item_id", "item", "j", uses, window)
    seeds = _seeds(split, "doc_id", "words", "i", uses)
    tests = materialize(tests.distinct(), "leaks-tests")
    if tests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        tests = F.broadcast(tests)
    laid = seeds.join(tests, "key").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct()
    laid = materialize(laid.withColumnRenamed("doc_id", "at"), "leaks-laid")
    if laid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        laid = F.broadcast(laid)
    few = F.broadcast if (items.agg(F.sum(F.size("item") + 2)).first()[0] or 0) <= BROADCAST_ROWS else (lambda df: df)
    # a text is only split again if a seed was found in it
    ids = laid.select("at").distinct()
    again = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("at")), "left_semi").select("doc_id", word_hashes(F.col("text")).alias("words"))
    hits = again.join(laid, F.col("doc_id").eqNullSafe(F.col("at"))).join(few(items), "item_id")

    size = F.size("item")
    width = F.least(F.lit(window), size)

    def same(k: Column) -> Column:
        at = F.col("shift") + k
        return F.when((at >= 0) & (F.get(F.col("words"), at) == F.get(F.col("item"), k)), 1).otherwise(0)

    def slide(state: Column, k: Column) -> Column:
        now = state["now"] + same(k) - F.when(k >= width, same(k - width)).otherwise(0)
        return F.struct(now.cast("int").alias("now"), F.greatest(state["best"], now).cast("int").alias("best"), (state["all"] + same(k)).cast("int").alias("all"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("now", "best", "all")])
    laid = hits.withColumn("fold", F.aggregate(F.sequence(F.lit(0), size - 1), zero, slide))
    laid = laid.select("doc_id", "item_id", size.alias("item_words"), width.alias("width"), F.col("fold").alias("fold"))
    laid = laid.select("doc_id", "item_id", "item_words", "width", F.col("fold.best").alias("best"), F.col("fold.all").alias("all"))
    held = laid.where(F.col("best") >= F.ceil(F.lit(identity) * F.col("width")))
    found = held.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("all").alias("matched"), F.max("best").alias("best_window"))
    found = found.select("doc_id", "item_id", "item_words", "matched", "best_window")
    tiny = all_items.where(F.size("item") < min_words).distinct()
    whole = split.where((F.size("words") > 0) & (F.size("words") < min_words)).join(tiny, F.col("words") == F.col("item"))
    n = F.size("item")
    return found.unionByName(whole.select("doc_id", "item_id", n.alias("item_words"), n.alias("matched"), n.alias("best_window")).distinct())


def oracle_sql() -> str:
    """``leaks`` with its defaults in DuckDB's SQL, without seeds: every place where enough words agree is looked at."""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return f"""
with d as (select doc_id as id, {words} as w from documents where text is not null),
b as (select item_id as id, {words} as w from benchmark where text is not null),
bl as (select distinct * from b where len(w) >= 5),
dp as (select id, unnest(w) as word, unnest(range(len(w))) as i from d),
bp as (select id, len(w) as n, unnest(w) as word, unnest(range(len(w))) as i from bl),
same as (
  select distinct dp.id as doc_id, bp.id as item_id, dp.i - bp.i as shift, bp.n, bp.i from dp join bp on dp.word = bp.word
), laid as (
  select doc_id, item_id, shift, n, count(*) as matched from same group by all having count(*) >= ceil(0.8 * least(13, n))
), slid as (
  select s.doc_id, s.item_id, s.shift, count(*) over (
    partition by s.doc_id, s.item_id, s.shift order by s.i range between 12 preceding and current row) as now
  from same s join laid l on l.doc_id = s.doc_id and l.item_id = s.item_id and l.shift = s.shift
), best as (select doc_id, item_id, shift, max(now) as best from slid group by all),
found as (
  select l.doc_id, l.item_id, max(l.n) as item_words, max(l.matched) as matched, max(k.best) as best_window
  from laid l join best k on k.doc_id = l.doc_id and k.item_id = l.item_id and k.shift = l.shift
  where k.best >= ceil(0.8 * least(13, l.n)) group by l.doc_id, l.item_id
), tiny as (
  select distinct d.id as doc_id, b.id as item_id, len(b.w) as item_words, len(b.w) as matched, len(b.w) as best_window
  from d join b on d.w = b.w where len(b.w) between 1 and 4
)
select doc_id, item_id, cast(item_words as integer) as item_words, cast(matched as integer) as matched, cast(best_window as integer) as best_window
from (select * from found union all select * from tiny)
"""

"""Pairs of entries that share columns, counted for a block of entries at once.

A join of a column with itself gives the square of its depth, all of which
would go through a shuffle to be added up.  Here a column's entries go, as one
list, to each block of entries that it meets, and a block's pairs are counted
in place: what moves grows with the cells, and a pair is held only while its
first entry's row is at work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is the entries that agree but for so many low bits: near ids share most columns.
BITS = 9
#: Pairs, or counters, that are held at once.
ROOM = 4_000_000

Arrays = dict[str, np.ndarray]


class Block:
    """A block's columns as lists, one after the other, and its own entries in order of id."""

    def __init__(self, block: int, column: np.ndarray, lens: np.ndarray, entry: np.ndarray, value: np.ndarray):
        self.column, self.lens, self.entry, self.value = column, lens, entry, value
        self.start, self.of = np.cumsum(lens) - lens, np.repeat(np.arange(len(lens)), lens)
        own = np.flatnonzero(entry >> BITS == block)
        self.own = own[np.argsort(entry[own], kind="stable")]
        self.ids, self.first = np.unique(entry[self.own], return_index=True)

    def runs(self, width: int) -> Iterator[tuple[int, int]]:
        """Ranges of own ids, with as many pairs and counters (``width`` an id) as there is room for, one id at least."""
        pairs = np.add.reduceat(self.lens[self.of[self.own]], self.first)
        a = 0
        while a < len(self.ids):
            fits = int(np.searchsorted(np.cumsum(pairs[a:]), ROOM, side="right"))
            b = min(a + max(1, min(fits, ROOM // width)), len(self.ids))
            yield a, b
            a = b

    def pairs(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of both entries of each pair that an own id from the a-th to before the b-th begins."""
        at = self.own[self.first[a] : self.first[b] if b < len(self.ids) else len(self.own)]
        m = self.lens[self.of[at]]
        ends = np.cumsum(m)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - m[lo] + ROOM, side="right")))
            n = m[lo:hi]
            left = np.repeat(at[lo:hi], n)
            right = np.repeat(self.start[self.of[at[lo:hi]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            apart = self.entry[left] != self.entry[right]
            yield left[apart], right[apart]
            lo = hi


def by_blocks(cells: DataFrame, work: Callable[[Block], Iterator[Arrays]], schema: str, *, by: tuple[str, ...], column: str = "pos", entry: str = "read_idx", value: str = "is_ref", place: bool = False) -> DataFrame:
    """``work`` over each block -> by, and what it yields (``schema``); ``place`` gives it the columns' own values."""
    keys = list(by)
    use = cells.dropna(subset=[*keys, column, entry]).select(*keys, F.col(column).alias("_c"), F.struct(F.col(entry).alias("e"), F.coalesce(F.col(value).cast("int"), F.lit(-1)).alias("v")).alias("_x"))
    lists = use.groupBy(*keys, "_c").agg(F.collect_list("_x").alias("_l"))
    blocks = F.explode(F.array_distinct(F.transform("_l.e", lambda x: F.shiftright(x.cast("long"), BITS)))).alias("_b")
    rows = lists.select(*keys, blocks, (F.col("_c") if place else F.lit(0)).cast("long").alias("_c"), F.col("_l.e").alias("_e"), F.col("_l.v").alias("_v"))
    # a number of its own, so that few bytes with many pairs don't become few tasks
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *keys, "_b").sortWithinPartitions(*keys, "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, types = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            block = Block(now[-1], *(np.concatenate([h[k] for h in held]) for k in range(4)))
            for found in work(block):
                n = len(next(iter(found.values())))
                if n:
                    constant = [pa.repeat(pa.scalar(k, t), n) for k, t in zip(now, types)]
                    yield pa.RecordBatch.from_arrays([*constant, *map(pa.array, found.values())], names=[*keys, *found])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            names = list(zip(*(batch.column(k).to_pylist() for k in [*keys, "_b"])))
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != now:
                    if held:
                        yield from done()
                    now, held = names[a], []
                part = batch.slice(a, b - a)
                e, v = part.column("_e"), part.column("_v")
                held.append((part.column("_c").to_numpy(), pc.list_value_length(e).to_numpy().astype(np.int64), e.flatten().to_numpy(), v.flatten().to_numpy()))
        if held:
            yield from done()

    types = dict(cells.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema]))


def similarities(cells: DataFrame, finish: Callable[..., Arrays], schema: str, *, by: tuple[str, ...], column: str = "pos", entry: str = "read_idx", value: str = "is_ref") -> DataFrame:
    """Sums over the columns that two entries share: sim has 3 for two zeros and 1 for two ones, diff 1 for unlike values.

    finish(r1, r2, sim, diff) gets all partners of some entries, either way
    round, in order of r1, then r2, and gives the rows to keep.
    """

    def work(block: Block) -> Iterator[Arrays]:
        names, code = np.unique(block.entry, return_inverse=True)
        width = len(names)
        for a, b in block.runs(width):
            ids, size = block.ids[a:b], (b - a) * width
            n, sim, diff = (np.zeros(size, np.int64) for _ in range(3))
            for left, right in block.pairs(a, b):
                key = np.searchsorted(ids, block.entry[left]) * width + code[right]
                x, y = block.value[left], block.value[right]
                like = np.where(x == 0, 3, (x == 1).astype(np.int8)) * (x == y)
                n += np.bincount(key, minlength=size)
                sim += np.bincount(key, weights=like, minlength=size).astype(np.int64)
                diff += np.bincount(key[(x != y) & (x >= 0) & (y >= 0)], minlength=size)
            at = np.flatnonzero(n)
            if len(at):
                yield finish(ids[at // width], names[at % width], sim[at], diff[at])

    return by_blocks(cells, work, schema, by=by, column=column, entry=entry, value=value)


def spaced_differences(cells: DataFrame, spacing: int, names: tuple[str, str, str], schema: str, *, by: tuple[str, ...], column: str = "pos", entry: str, value: str) -> DataFrame:
    """Columns at which the smaller entry's value differs from the larger's, from the left, each more than ``spacing`` beyond the last one counted."""

    def work(block: Block) -> Iterator[Arrays]:
        for a, b in block.runs(1):
            found = [(left[k], right[k]) for left, right in block.pairs(a, b) for k in [np.flatnonzero((block.entry[left] < block.entry[right]) & (block.value[left] != block.value[right]))]]
            left, right = (np.concatenate(x) for x in zip(*found))
            if not len(left):
                continue
            c1, c2, pos = block.entry[left], block.entry[right], block.column[block.of[left]]
            order = np.lexsort((pos, c2, c1))
            c1, c2, pos = c1[order], c2[order], pos[order]
            new = np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            line = group * (pos.max() - pos.min() + spacing + 1) + (pos - pos.min())
            after = np.searchsorted(line, line + spacing, side="right")
            n, at, live = np.zeros(len(first), np.int64), first, np.arange(len(first))
            while len(at):
                n[live] += 1
                at = after[at]
                stay = at < len(group)
                stay[stay] = group[at[stay]] == live[stay]
                at, live = at[stay], live[stay]
            yield dict(zip(names, (c1[first], c2[first], n)))

    return by_blocks(cells, work, schema, by=by, column=column, entry=entry, value=value, place=True)

"""Biclustering of reads by suspicious positions; a window is a group.

Values are rows (by, read_idx, pos, v) with v 1 or 0; what is missing is unknown.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Distances that are held at once.
ROOM = 4_000_000


def impute(matrix: np.ndarray, k: int = 10, low: float = 0.3, high: float = 0.7) -> np.ndarray:
    """Unknown values (nan) are the mean of the k nearest rows that have them; then 1, 0, or -1 between the bounds.

    Rows are as far apart as they differ over the columns both have; ties go to
    the earlier row.  Equal rows get equal values, and none can use more than
    the first k of them, so only distinct rows are compared with such rows,
    some of them at a time.
    """
    if not matrix.size:
        return np.where(matrix >= high, 1, np.where(matrix <= low, 0, -1))
    known = ~np.isnan(matrix)
    coded = np.where(known, matrix, 2.0)
    _, first, kind = np.unique(coded, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    place = np.empty(len(order), np.int64)
    starts = np.flatnonzero(np.r_[True, np.diff(kind[order]) > 0])
    place[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    use = np.flatnonzero(place < k)
    cols = matrix.shape[1]
    # distances as ranks of differ / both, the last one for rows without a shared column
    d, n = np.divmod(np.arange((cols + 1) ** 2), cols + 1)
    rank = np.unique(np.where(n > 0, d / np.maximum(n, 1), np.inf), return_inverse=True)[1].reshape(-1)
    apart = int(rank[0])
    has = known[use]
    yes, no = (has & (matrix[use] == 1)).astype(np.float32), (has & (matrix[use] != 1)).astype(np.float32)
    filled = np.where(has, matrix[use], 0.0)
    out = matrix[first].copy()
    asked = np.flatnonzero(~known[first].all(axis=1))
    step, some = max(1, ROOM // len(use)), min(len(use), 8 * k)
    for lo in range(0, len(asked), step):
        rows = asked[lo : lo + step]
        own = known[first[rows]]
        one, zero = (own & (matrix[first[rows]] == 1)).astype(np.float32), (own & (matrix[first[rows]] != 1)).astype(np.float32)
        differ = one @ no.T + zero @ yes.T
        both = differ + one @ yes.T + zero @ no.T
        key = rank[(differ * (cols + 1) + both).astype(np.int64)] * len(use) + np.arange(len(use))
        near = np.sort(np.partition(key, some - 1, axis=1)[:, :some], axis=1)
        for r, row in enumerate(rows):
            open_ = np.flatnonzero(~own[r])
            best = near[r]
            at = best[best < apart * len(use)] % len(use)
            found = has[np.ix_(at, open_)]
            if len(at) == some < len(use) and (found.sum(axis=0) < k).any():
                best = np.sort(key[r])
                at = best[best < apart * len(use)] % len(use)
                found = has[np.ix_(at, open_)]
            take = found & (np.cumsum(found, axis=0) <= k)
            m, ones = take.sum(axis=0), np.where(take, filled[np.ix_(at, open_)], 0).sum(axis=0)
            out[row, open_] = np.where(m > 0, ones / np.maximum(m, 1), 0.5)
    out = out[kind]
    return np.where(out >= high, 1, np.where(out <= low, 0, -1))


def complete_linkage(rows: np.ndarray, most: float, *, clusters: int = 1) -> np.ndarray:
    """Labels of clusters whose farthest pair differs in at most ``most`` of the columns, ``clusters`` at least; nearest clusters first, ties to the earlier.

    Equal rows come first, so only distinct ones are compared.
    """
    total = len(rows)
    if not total:
        return np.arange(0)
    _, first, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    label = first[kind.reshape(-1)]
    if len(first) <= clusters:
        spare = clusters - len(first)
        again = np.flatnonzero(label != np.arange(total))
        again = again[np.argsort(label[again], kind="stable")]
        split = again[len(again) - spare :] if spare else again[:0]
        label[split] = split
        return label
    first = np.sort(first)
    distinct = rows[first]
    n, cols = distinct.shape
    same = sum((distinct == v).astype(np.float32) @ (distinct == v).astype(np.float32).T for v in np.unique(distinct))
    far = (cols - same).astype(float) / cols
    np.fill_diagonal(far, np.inf)
    least, root, alive = far.min(axis=1), np.arange(n), n
    while alive > clusters:
        i = int(np.argmin(least))
        j = int(np.argmin(far[i]))
        if far[i, j] > most:
            break
        touched = np.flatnonzero((far[i] == least) | (far[j] == least))
        far[i] = np.maximum(far[i], far[j])
        far[i, i] = np.inf
        far[:, i] = far[i]
        far[j], far[:, j] = np.inf, np.inf
        alive -= 1
        for x in {i, j, *touched.tolist()}:
            least[x] = far[x].min()
        root[root == j] = i
    return first[root][np.searchsorted(first, label)]


def _groups(label: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(label == k) for k in dict.fromkeys(label.tolist())]


def regions(matrix: np.ndarray, quality: int = 3) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Columns that go together -> (columns, None), or (columns, which rows have ones) where the rows split in two.

    Columns differ in at most 0.35 of the rows in a region; one of more than 15
    columns is taken apart at 0.025.  Regions below ``quality`` columns go.  Where
    ten rows at most are neither ones nor zeros, and two clusters of the rows
    are each over 0.9 or under 0.1 ones, the region is a split; where they
    aren't, it goes.  Matrices of 5 rows or 15 columns at most are one region.
    """
    rows, cols = matrix.shape
    if rows <= 5 or cols <= 15:
        return [(np.arange(cols), None)]
    found: list[np.ndarray] = []
    for region in _groups(complete_linkage(matrix.T, 0.35)):
        parts = [region] if len(region) <= 15 else [region[g] for g in _groups(complete_linkage(matrix[:, region].T, 0.025))]
        found += [p for p in parts if len(p) >= quality]
    out: list[tuple[np.ndarray, np.ndarray | None]] = []
    for region in found:
        block = np.maximum(matrix[:, region], 0)
        share, bar = block.mean(axis=1), quality / len(region)
        if ((share >= bar) & (share <= 1 - bar)).sum() > 10:
            out.append((region, None))
            continue
        label = complete_linkage(block, 1.0, clusters=2)
        sides = [label == k for k in dict.fromkeys(label.tolist())]
        means = [block[side].mean() for side in sides]
        if all(m > 0.9 or m < 0.1 for m in means):
            out.append((region, sides[int(np.argmax(means))]))
    return out


def quasi_biclique(ones: np.ndarray, error: float = 0.025) -> tuple[np.ndarray, np.ndarray]:
    """G35, greedily and so not equal to an exact solver: rows and columns of a block that is all but ``error`` ones.

    Begins with the densest columns' common rows, then adds the best row or
    column while the block keeps the bound.
    """
    if not ones.size or not ones.any():
        return np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(-ones.sum(axis=0), kind="stable")
    best = (0, np.zeros(0, int), np.zeros(0, int))
    rows = np.ones(len(ones), bool)
    for k, c in enumerate(order, 1):
        rows = rows & ones[:, c].astype(bool)
        if rows.sum() * k > best[0]:
            best = (int(rows.sum() * k), np.flatnonzero(rows), order[:k])
    rows_in, cols_in = np.zeros(len(ones), bool), np.zeros(ones.shape[1], bool)
    rows_in[best[1]], cols_in[best[2]] = True, True
    n_rows, n_cols, total = len(best[1]), len(best[2]), int(ones[np.ix_(best[1], best[2])].sum())
    of_col, queue = ones[rows_in].sum(axis=0), None
    grown = True
    while grown:
        grown = False
        if queue is None:  # rows by their ones in the block's columns, which only a new column changes
            of_row = ones[:, cols_in].sum(axis=1)
            queue = np.argsort(-of_row, kind="stable")
            queue, at = queue[~rows_in[queue]], 0
        if at < len(queue) and (total + of_row[queue[at]]) / ((n_rows + 1) * n_cols) >= 1 - error:
            i = queue[at]
            rows_in[i], at, n_rows, grown = True, at + 1, n_rows + 1, True
            total, of_col = total + int(of_row[i]), of_col + ones[i]
        left = np.flatnonzero(~cols_in)
        if len(left):
            i = left[np.argmax(of_col[left])]
            if (total + of_col[i]) / (n_rows * (n_cols + 1)) >= 1 - error:
                cols_in[i], n_cols, grown, queue = True, n_cols + 1, True, None
                total += int(of_col[i])
    return np.flatnonzero(rows_in), np.flatnonzero(cols_in)


def separate(matrix: np.ndarray, *, error: float = 0.025, least_rows: int = 5, least_cols: int = 3, small: int = 5, attach: float = 0.1, merge: float = 0.05) -> np.ndarray:
    """Labels of rows (0, 1, ...), -1 for rows left out.

    Blocks of ones and of zeros in turn split the rows that neither has; the
    common refinement is cleaned: clusters of ``small`` rows or fewer are
    dissolved into the nearest mean (A26) within ``attach``, then clusters
    within ``merge`` become one.
    """
    n, cols = matrix.shape
    code = [()] * n
    free = np.arange(cols)
    while len(free) >= least_cols:
        block = matrix[:, free]
        r1, c1 = quasi_biclique((block == 1).astype(int), error)
        if len(r1) < least_rows or len(c1) < least_cols:
            break
        rest = np.setdiff1d(np.arange(n), r1)
        zero = rest[(block[np.ix_(rest, c1)] == 0).mean(axis=1) >= 1 - error] if len(rest) else rest
        if len(zero):
            side = np.full(n, -1)
            side[zero], side[r1] = 0, 1
            code = [c + (x,) for c, x in zip(code, side.tolist())]
        free = np.delete(free, c1)
    names = {c: k for k, c in enumerate(dict.fromkeys(code))}
    label = np.array([names[c] for c in code])
    sizes = np.bincount(label, minlength=len(names))
    big = [k for k in range(len(names)) if sizes[k] > small]
    if not big:
        return np.zeros(n, int) if n else label
    means = np.array([np.rint(np.where(matrix[label == k] < 0, 0.5, matrix[label == k]).mean(axis=0)) for k in big])
    index = np.full(len(names), -1)
    index[big] = np.arange(len(big))
    out = index[label]
    for i in np.flatnonzero(out < 0):
        far = (means != matrix[i]).mean(axis=1)
        if far.min() <= attach:
            out[i] = int(far.argmin())
    joined = complete_linkage(means, merge)
    return np.array([joined[k] if k >= 0 else -1 for k in out])


def haplotypes(values: DataFrame, *, by: tuple[str, ...] = ("contig", "win"), error: float = 0.025) -> DataFrame:
    """Each window's reads -> by, read_idx, label; a window's matrix is one task's."""
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="read_idx", columns="pos", values="v", aggfunc="first")
        label = separate(impute(table.to_numpy(dtype=float)), error=error)
        out = pd.DataFrame({"read_idx": table.index.to_numpy(), "label": label.astype("int64")})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    types = dict(values.dtypes)
    return values.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in keys], f"read_idx {types['read_idx']}", "label long"]))


def _windows(values: DataFrame, by: tuple[str, ...], found, columns: str) -> DataFrame:
    """found(matrix, reads, positions) -> rows of ``columns``, of each window."""
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="read_idx", columns="pos", values="v", aggfunc="first")
        out = pd.DataFrame(found(impute(table.to_numpy(dtype=float)), table.index.to_numpy(), table.columns.to_numpy()), columns=[c.split()[0] for c in columns.split(", ")])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    types = dict(values.dtypes)
    return values.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in keys], columns]))


def window_regions(values: DataFrame, *, by: tuple[str, ...] = ("contig", "win"), quality: int = 3) -> DataFrame:
    """Each window's regions -> by, region, positions, ones (reads; null where the rows don't split)."""

    def found(matrix, reads, positions):
        return [(k, positions[cols].tolist(), None if ones is None else reads[ones].tolist()) for k, (cols, ones) in enumerate(regions(matrix, quality))]

    return _windows(values, by, found, "region int, positions array<long>, ones array<long>")


def window_blocks(values: DataFrame, *, by: tuple[str, ...] = ("contig", "win"), error: float = 0.025) -> DataFrame:
    """Each window's greedy block of ones -> by, reads, positions."""

    def found(matrix, reads, positions):
        rows, cols = quasi_biclique((matrix == 1).astype(int), error)
        return [(reads[rows].tolist(), positions[cols].tolist())]

    return _windows(values, by, found, "reads array<long>, positions array<long>")


def mean_vectors(values: DataFrame, labels: DataFrame, *, by: tuple[str, ...] = ("contig", "win")) -> DataFrame:
    """Each cluster's rounded mean at each position, halves to the even -> by, label, pos, mean."""
    return values.join(labels, [*by, "read_idx"]).groupBy(*by, "label", "pos").agg(F.rint(F.avg("v")).cast("int").alias("mean"))

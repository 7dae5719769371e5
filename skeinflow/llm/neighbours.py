"""Nearest neighbours by a block matrix join with quantisation bounds."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a candidate slice, of a query block, and of the tiles in which a cell is computed.
SLICE, BLOCK, TILE = 16_384, 4_096, 1_024
#: Slices whose heaps one merging task reads.
FAN_IN = 32
_HEAPS = "query_id long, part int, vec_id long, score double"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the length of what quantising loses, a row each."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(np.square(vectors - codes * scale[:, None]).sum(axis=1))


def exact_distance(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distance in double precision, summed from the first component on."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        gap = vectors[:, k] - query[k]
        total += gap * gap
    return np.sqrt(total)


def cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of this cell's vectors for each query.

    Int8 tiles are multiplied as float32, in which their products are exact.
    |quantised distance - distance| is at most the sum of both rows' losses.
    A pair survives if its lower bound is not above the k-th least upper bound.
    """
    # a common power of two keeps the squares of the bounds finite, and of any distance the order
    unit = np.exp2(-np.ceil(np.log2(max(np.abs(queries).max(), np.abs(vectors).max()))))
    q_codes, q_scale, q_loss = quantise(queries * unit)
    codes, scale, loss = quantise(vectors * unit)
    square = np.square(codes.astype(np.float32)).sum(axis=1) * np.square(scale)
    q_square = np.square(q_codes.astype(np.float32)).sum(axis=1) * np.square(q_scale)
    found = []
    for at in range(0, len(queries), 256):
        rows = slice(at, min(at + 256, len(queries)))
        lower, upper = (np.empty((rows.stop - at, len(vectors))) for _ in range(2))
        for tile in range(0, len(vectors), TILE):
            cols = slice(tile, min(tile + TILE, len(vectors)))
            product = q_codes[rows].astype(np.float32) @ codes[cols].astype(np.float32).T
            gap = q_square[rows, None] + square[None, cols] - 2.0 * product * (q_scale[rows, None] * scale[None, cols])
            near = np.sqrt(np.maximum(gap, 0.0))
            bound = (q_loss[rows, None] + loss[None, cols]) * (1 + 1e-6) + 1e-6 * (np.sqrt(q_square[rows, None]) + np.sqrt(square[None, cols]))
            lower[:, cols], upper[:, cols] = near - bound, near + bound
        for i in range(rows.stop - at):
            own = ids == query_ids[at + i]
            upper[i, own] = lower[i, own] = np.inf
            limit = np.partition(upper[i], k - 1)[k - 1] if len(vectors) > k else np.inf
            left = np.flatnonzero((lower[i] <= limit) & ~own)
            scores = exact_distance(queries[at + i], vectors[left])
            for score, vec in heapq.nsmallest(k, zip(scores.tolist(), ids[left].tolist(), strict=True)):
                found.append((int(query_ids[at + i]), vec, score))
    return found


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, size)


def nearest(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10
) -> DataFrame:
    """The k nearest rows of each query -> query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows with another id; nearness is the Euclidean distance of the original
    vectors in double precision, ties go to the smaller id.  The result is
    exact.  Query blocks meet candidate slices as the cells of a block matrix
    join, each cell of bounded size, whatever the ids are; heaps of k merge the
    cells in rounds of at most FAN_IN.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, and a query only meets vectors of its own dimension.  A
    repeated candidate row counts as often as it stands; repeated rows of a
    query's id are one query, by its smallest vector.  A null id takes no part.
    Fewer candidates than k are all returned; an empty table gives none.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(good)
    # dealt by position, so that no value of the data can crowd a cell; written, so that a task that runs again deals alike
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "neighbours-rows")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n, n_queries = rows.count(), queries.count()
    slices, blocks = max(1, math.ceil(n / SLICE)), max(1, math.ceil(n_queries / BLOCK))

    size = F.size("v").alias("size")
    q = queries.select("id", "v", size, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    c = rows.select("id", "v", size, F.pmod("at", F.lit(slices)).cast("int").alias("slice"))
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    as_bytes = _packer()
    key = ["block", "slice", "size"]
    q = q.select(*key, F.col("id").alias("query"), as_bytes("v").alias("query_vector"))
    c = c.select(*[F.col(x).alias(f"at_{x}") for x in key], F.col("id").alias("other"), as_bytes("v").alias("vector"))

    def cells(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = cell(left["query"].to_numpy(), _matrix(left["query_vector"], key[2]), right["other"].to_numpy(), _matrix(right["vector"], key[2]), k)
        return pd.DataFrame([(a, int(key[1]), b, s) for a, b, s in found], columns=["query_id", "part", "vec_id", "score"])

    heaps = q.groupBy(*key).cogroup(c.groupBy(*[f"at_{x}" for x in key])).applyInPandas(cells, _HEAPS)

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(part["score"].tolist(), part["vec_id"].tolist(), strict=True))
        return pd.DataFrame({"query_id": int(key[0]), "part": int(key[1]), "vec_id": [b for _, b in best], "score": [a for a, _ in best]})

    while True:
        heaps = heaps.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("query_id", "part").applyInPandas(merged, _HEAPS)
        slices = math.ceil(slices / FAN_IN)
        if slices == 1:
            break

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return heaps.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")


def _packer():
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<f8").tobytes() for v in vectors])

    return F.pandas_udf(pack, "binary")

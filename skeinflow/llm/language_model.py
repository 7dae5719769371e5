"""Scoring texts with an interpolated n-gram model.

The counts never leave the cluster and no task sees all of them.  Texts become
chunks of token hashes; a chunk sends each distinct unigram and bigram once,
with its counts, as packed arrays to the range of hashes it falls in; the range
adds up and sends each chunk the totals of what that chunk asked for.  So one
frequent word costs a number for each chunk, not a row for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialize

#: Bytes of text in a chunk, at least one document; words whose hash a worker remembers.
CHUNK, REMEMBERED = 16_000_000, 400_000
#: Context-frequency buckets, steps of log2 by which held-out probabilities are told apart, and EM rounds.
BUCKETS, STEPS, ROUNDS = 40, 4, 60
#: No word hashes like the empty one: it ends each text and stands before its first word.
END = np.uint64(xxhash.xxh64_intdigest(b""))

_CHUNKS = "chunk long, deleted boolean, ids array<%s>, lengths binary, train binary, words binary, tokens binary"
_SENT = "chunk long, deleted boolean, part int, n int, keys binary, kept binary, held binary"
_TOTALS = "chunk long, deleted boolean, part int, n long, kept binary, held binary, total long"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def pack(numbers: np.ndarray) -> bytes:
    """uint32 as planes of bytes, which compress well where most numbers are small."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (context, token)."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + tokens
    for factor in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        h ^= h >> np.uint64(32)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(29))


def _chunk_row(number: int, deleted: bool, docs: list) -> dict:
    tokens = np.concatenate([t for _, t, _ in docs])
    words, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return {
        "chunk": number,
        "deleted": deleted,
        "ids": [i for i, _, _ in docs],
        "lengths": np.array([len(t) for _, t, _ in docs], "<u4").tobytes(),
        "train": np.array([t for _, _, t in docs], np.uint8).tobytes(),
        "words": words[order].astype("<u8").tobytes(),
        "tokens": pack(rank[inverse]),
    }


def _chunk_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(id_type)), *((c, pa.binary()) for c in ("lengths", "train", "words", "tokens"))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, train, deleted -> chunks; texts whose counts are deleted get chunks of their own."""
    cache, open_docs, held_bytes = _Hashes(), {False: [], True: []}, {False: 0, True: 0}
    number, schema = TaskContext.get().partitionId() << 32, None

    def close(kind: bool) -> pa.RecordBatch:
        nonlocal number
        row = _chunk_row(number, kind, open_docs[kind])
        number += 1
        open_docs[kind], held_bytes[kind] = [], 0
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        schema = _chunk_schema(batch.schema.field("id").type)
        ids, train, deleted = (batch.column(c).to_pylist() for c in ("id", "train", "deleted"))
        for i, text, t, d in zip(ids, batch.column("text"), train, deleted):
            words = text.as_buffer().to_pybytes().lower().split()
            tokens = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
            open_docs[d].append((i, np.append(tokens, END), t))
            held_bytes[d] += len(text.as_buffer()) + 64
            if held_bytes[d] >= CHUNK:
                yield close(d)
    for kind in (False, True):
        if open_docs[kind]:
            yield close(kind)


class _Chunk:
    """A chunk's tokens, contexts, and the sorted keys it asks for."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], "<u8")
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.train = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), self.lengths)
        self.stops = np.cumsum(self.lengths)
        self.starts = self.stops - self.lengths
        numbers = unpack(row["tokens"])
        tokens = words[numbers]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = END
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.keys = [words[order], None]
        self.at = [place[numbers], None]
        self.keys[1], self.at[1] = np.unique(pair_keys(before, tokens), return_inverse=True)
        end = int(np.searchsorted(self.keys[0], END))
        self.context = np.empty(len(tokens), np.int64)
        self.context[1:] = self.at[0][:-1]
        self.context[self.starts] = end


def _cuts(parts: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins."""
    return np.array([i * 2**64 // parts for i in range(parts)], dtype=np.uint64)


def _send(parts: int):
    schema = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("part", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("keys", "kept", "held"))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                for n in (0, 1):
                    keys = chunk.keys[n]
                    counts = np.bincount(chunk.at[n][chunk.train], minlength=len(keys))
                    cuts = np.searchsorted(keys, _cuts(parts)).tolist() + [len(keys)]
                    found = []
                    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if b > a:
                            packed, zero = pack(counts[a:b]), None
                            found.append({"chunk": row["chunk"], "deleted": row["deleted"], "part": part, "n": n, "keys": keys[a:b].tobytes(), "kept": zero if row["deleted"] else packed, "held": packed if row["deleted"] else zero})
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return send


def _add_up(table: pa.Table) -> pa.Table:
    """One range of hashes: totals of each key, to all chunks that asked; n = -1, -2, -3: training tokens, types, and tokens kept."""
    rows, out = table.to_pylist(), []
    for n in (0, 1):
        own = [r for r in rows if r["n"] == n]
        if not own:
            continue
        keys = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in own])
        sizes = [len(r["keys"]) // 8 for r in own]
        uniq, at = np.unique(keys, return_inverse=True)
        totals = []
        for side in ("kept", "held"):
            counts = np.concatenate([unpack(r[side]) if r[side] is not None else np.zeros(s, "<u4") for r, s in zip(own, sizes)])
            totals.append(np.bincount(at, weights=counts, minlength=len(uniq)).astype(np.int64)[at])
        stop = 0
        for r, s in zip(own, sizes):
            start, stop = stop, stop + s
            out.append({"chunk": r["chunk"], "deleted": r["deleted"], "part": r["part"], "n": n, "kept": pack(totals[0][start:stop]), "held": pack(totals[1][start:stop]), "total": None})
        if n == 0:
            first = np.unique(at, return_index=True)[1]
            both, kept = (totals[0] + totals[1])[first], totals[0][first]
            for name, number in ((-1, both.sum()), (-2, (both > 0).sum()), (-3, kept.sum())):
                out.append({"chunk": -1, "deleted": False, "part": None, "n": name, "kept": None, "held": None, "total": int(number)})
    schema = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("part", pa.int32()), ("n", pa.int64()), ("kept", pa.binary()), ("held", pa.binary()), ("total", pa.int64())])
    return pa.Table.from_pylist(out, schema=schema)


def _meet(table: pa.Table) -> tuple[dict, _Chunk, list[np.ndarray], list[np.ndarray]]:
    """A chunk with the totals it asked for: kept and held-out counts of its keys, by order."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["tokens"] is not None)
    chunk, kept, held = _Chunk(own), [], []
    for n in (0, 1):
        got = sorted((r for r in rows if r["tokens"] is None and r["n"] == n), key=lambda r: r["part"])
        kept.append(np.concatenate([unpack(r["kept"]) for r in got]).astype(np.int64))
        held.append(np.concatenate([unpack(r["held"]) for r in got]).astype(np.int64))
    return own, chunk, kept, held


def bucket(counts: np.ndarray) -> np.ndarray:
    """Contexts that were never seen are bucket 0, others go by log2."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * STEPS), -1).astype(np.int32)


def _held_out(kept_tokens: int):
    """How often held-out tokens have a bucket, a bigram and a unigram probability."""

    def count(table: pa.Table) -> pa.Table:
        _, chunk, kept, _ = _meet(table)
        use = chunk.train
        context, single, pair = kept[0][chunk.context][use], kept[0][chunk.at[0]][use], kept[1][chunk.at[1]][use]
        cells = np.stack([bucket(context), _steps(pair / np.maximum(context, 1)), _steps(single / max(kept_tokens, 1))], axis=1)
        cells, n = np.unique(cells, axis=0, return_counts=True) if len(cells) else (cells.reshape(0, 3), np.zeros(0))
        return pa.table({"bucket": cells[:, 0].astype(np.int32), "p2": cells[:, 1].astype(np.int32), "p1": cells[:, 2].astype(np.int32), "n": n.astype(np.int64)})

    return count


def mixture(cells: list[tuple[int, int, int, int]], types: int) -> np.ndarray:
    """Expectation-maximisation on held-out counts -> weights (bigram, unigram, uniform) by bucket.

    A bucket leans on all of them together with the weight of 20 tokens, so
    that one that holds few or none has weights too.  Without held-out tokens
    the weights are (0.6, 0.3, 0.1).
    """
    start = np.array([0.6, 0.3, 0.1])
    weights = np.tile(start, (BUCKETS, 1))
    if cells:
        table = np.array(cells, dtype=np.float64)
        g, n = table[:, 0].astype(int), table[:, 3]
        p = np.stack([np.where(table[:, k] >= 0, np.exp2(-table[:, k] / STEPS), 0.0) for k in (1, 2)] + [np.full(len(table), 1.0 / (types + 1))], axis=1)
        pooled = start.copy()
        for _ in range(ROUNDS):
            part = pooled * p
            part *= (n / part.sum(axis=1))[:, None]
            pooled = np.maximum(part.sum(axis=0) / n.sum(), 1e-6)
            pooled /= pooled.sum()
        weights[:] = pooled
        for _ in range(ROUNDS):
            part = weights[g] * p
            part *= (n / part.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(g, weights=part[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + 20 * pooled
            weights = np.maximum(sums / sums.sum(axis=1, keepdims=True), 1e-6)
            weights /= weights.sum(axis=1, keepdims=True)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _score(tokens_n: int, types: int, weights: np.ndarray):
    numbers = [*((c, pa.int64()) for c in ("n_tokens", "n_known")), ("base_score", pa.float64()), ("score", pa.float64())]

    def score(table: pa.Table) -> pa.Table:
        id_type = table.schema.field("ids").type.value_type
        own, chunk, kept, held = _meet(table)
        c = [a + b for a, b in zip(kept, held)]
        context, single, pair = c[0][chunk.context], c[0][chunk.at[0]], c[1][chunk.at[1]]
        w = weights[bucket(context)]
        p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (single / max(tokens_n, 1)) + w[:, 2] / (types + 1)
        base = np.log10((single + 1) / (tokens_n + types + 1))
        sums = [np.add.reduceat(x, chunk.starts) for x in ((single > 0).astype(np.int64), base, np.log10(p))]
        return pa.table([pa.array(own["ids"], id_type), pa.array(chunk.lengths), *map(pa.array, sums)], schema=pa.schema([("doc_id", id_type), *numbers]))

    return score


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, deleted: int = 3) -> DataFrame:
    """Deleted interpolation -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(id as text) mod ``folds`` is not ``held_out`` are learned
    from.  A-Z is lower-cased; tokens are words and one end.  P(token |
    context) mixes the maximum-likelihood bigram, unigram and uniform (1 / (V +
    1)) estimates by the context's frequency bucket.  The weights are learned
    by expectation-maximisation on the training texts of fold ``deleted``,
    whose own counts are deleted for that; the scores use all training counts.
    ``base_score`` is the add-one unigram model.

    A null text is empty and has the end only.  Repeated rows count as often as
    they stand.  Without training texts every token is unknown; without texts
    of fold ``deleted`` the weights are fixed.  An empty table gives none.
    Keys are 64-bit hashes of words and pairs.
    """
    fold = crc_fold(F.col(id_col), folds)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
        (fold != held_out).alias("train"),
        (fold == deleted).alias("deleted"),
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = materialize(rows.mapInArrow(_chunks, _CHUNKS % id_type), "lm-chunks")
    parts = max(1, chunks.count())
    sent = chunks.mapInArrow(_send(parts), _SENT)
    totals = materialize(sent.groupBy("part").applyInArrow(_add_up, _TOTALS), "lm-totals")
    sums = {r["n"]: r["s"] for r in totals.where("chunk = -1").groupBy("n").agg(F.sum("total").alias("s")).collect()}
    tokens_n, types, kept_n = (sums.get(k, 0) for k in (-1, -2, -3))

    empty = [F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{id_type}>"), ("lengths", "binary"), ("train", "binary"), ("words", "binary"), ("tokens", "binary"))]
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("n", "long"), ("kept", "binary"), ("held", "binary"))]
    both = chunks.select("*", *blank).unionByName(totals.where("chunk >= 0").drop("total").select("*", *empty))
    cells = both.where("deleted").groupBy("chunk").applyInArrow(_held_out(kept_n), "bucket int, p2 int, p1 int, n long")
    # at most BUCKETS * (64 * STEPS) ** 2 cells however much text there is
    cells = cells.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    weights = mixture([tuple(r) for r in cells], types)
    scored = both.groupBy("chunk").applyInArrow(_score(tokens_n, types, weights), f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens_n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )

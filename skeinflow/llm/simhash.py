"""SimHash fingerprints, linked through tables of pivot distances; near copies by sets of shingles."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Pivots of the distance tables, the fingerprints that a group compares as one piece, and rows of a step.
PIVOTS, PIECE, STEP = 16, 4_096, 256
#: Fingerprints that may share a key by chance before keys are made longer.
CHANCE = 16
#: Bits of a set's sketch, and of the longest one; one text of so many is sampled for common shingles, of which so many are kept.
SKETCH, LONGEST, SAMPLE, COMMON = 1_024, 32_768, 64, 200_000
#: Sets of shingles that a worker remembers between pairs.
REMEMBERED = 1_000
#: Lists of rows up to this length are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[words - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype=">u8", count=len(stops)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes, 64-bit numbers of big-endian bytes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """-> doc_id, fp (the fingerprint as a signed long)."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(bytes(t), words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(of, "long")(text).alias("fp"))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(count)], dtype=np.uint64)


def near_pairs(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most ``most`` bits, step by step.

    Both sides' Hamming distances to the pivots are computed once.  Distances
    to one pivot differ by no more than the fingerprints do, so a pair whose
    largest coordinate difference is above ``most`` is discarded; the right
    side is sorted by the first coordinate, which gives a window for the step.
    What survives is verified.
    """
    refs = pivots()
    table = [np.bitwise_count(side[:, None] ^ refs[None, :]).astype(np.int16) for side in (left, right)]
    order = np.argsort(table[1][:, 0], kind="stable")
    first = table[1][order, 0]
    rows = np.argsort(table[0][:, 0], kind="stable")
    for at in range(0, len(rows), STEP):
        i = rows[at : at + STEP]
        own = table[0][i]
        window = order[np.searchsorted(first, own[0, 0] - most) : np.searchsorted(first, own[-1, 0] + most, "right")]
        if not len(window):
            continue
        other = table[1][window]
        keep = np.abs(own[:, None, 0] - other[None, :, 0]) <= most
        for p in (1, 2):
            keep &= np.abs(own[:, None, p] - other[None, :, p]) <= most
        a, b = np.nonzero(keep)
        for p in range(3, PIVOTS):
            near = np.abs(own[a, p] - other[b, p]) <= most
            a, b = a[near], b[near]
        a, b = i[a], window[b]
        near = np.bitwise_count(left[a] ^ right[b]) <= most
        if near.any():
            yield a[near], b[near]


def _joining(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, some that join what all of them join; label follows."""
    chosen = []
    while True:
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return chosen
        # one pair for each root that has any, then the rest is looked at again
        _, first = np.unique(np.maximum(label[a], label[b]), return_index=True)
        for i in first.tolist():
            x, y = label[a[i]], label[b[i]]
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                chosen.append((a[i], b[i]))
        while (label[label] != label).any():
            label[:] = label[label]


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to all pivots, a row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def spanning_pairs(fps: np.ndarray, most: int, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs within ``most`` bits that join what all such pairs join, the nearest pairs first."""
    n, chosen = len(fps), []
    label = np.arange(n)
    if n <= STEP:  # one step: the table's pairs stand in memory at once
        table = pivot_distances(fps) if table is None else table
        a, b = np.triu_indices(n, 1)
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= most
        a, b = a[near], b[near]
        bits = np.bitwise_count(fps[a] ^ fps[b])
        for d in range(most + 1):
            chosen += _joining(n, a[bits == d], b[bits == d], label)
        return chosen
    for d in range(most + 1):
        for i, j in near_pairs(fps, fps, d):
            chosen += _joining(n, i, j, label)
    return chosen


def _pieces(keyed: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Cut groups above PIECE into numbered pieces that meet pairwise.

    A row of piece t goes to all cells (t, u), so that any two rows share a
    cell of at most about 2 * PIECE rows however large the group is.
    """
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["block", "value"])
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    sized = sized.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64(*([] if carried else ["fp"]), "node"), F.col("pieces")).cast("int"))
    others = F.when(F.col("pieces") > 1, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.lit(0)))
    met = sized.withColumn("other", F.explode(others))
    return met.select("block", "value", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), *(carried or ["fp"]), "node")


def links(nodes: DataFrame, *, most: int = 3) -> DataFrame:
    """(node, fp), a row a node -> a, b: pairs within ``most`` bits that join all that such pairs join.

    Of b blocks of bits, fingerprints that differ in at most ``most`` bits agree
    in b - most or more, so those that share the bits of so many are compared.
    More blocks make longer keys and more of them; b follows the number of
    nodes, so that few of them share a key by chance.  A group of m
    fingerprints gives m - 1 pairs at most, the nearest ones.
    """
    n = nodes.count()
    blocks = most + 1
    while blocks < most + 4 and n >> (64 * (blocks - most) // blocks) > CHANCE:
        blocks += 1
    ends = [64 * j // blocks for j in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - most)):
        mask = sum((1 << ends[j + 1]) - (1 << ends[j]) for j in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")))
    keyed = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", "k.*")
    cells = _pieces(keyed).repartition("block", "value", "p", "q").sortWithinPartitions("block", "value", "p", "q")

    def batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted cells, many of them small: only the rest of a batch is carried on."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["block", "value", "p", "q"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield _linked(rows.iloc[: cuts[-1]], np.concatenate([[0], cuts]))
                rest = rows.iloc[cuts[-1] :]
            else:
                rest = rows
        if rest is not None and len(rest):
            yield _linked(rest, np.array([0, len(rest)]))

    def _linked(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fps, ids = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy()
        a, b, table = [], [], pivot_distances(fps)
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop - start < 2:
                continue
            for i, j in spanning_pairs(fps[start:stop], most, table[start:stop]):
                a.append(ids[start + i])
                b.append(ids[start + j])
        if not a:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        return pd.DataFrame({"a": np.array(a), "b": np.array(b)})

    return cells.mapInPandas(batched, "a long, b long").distinct()


def components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """a, b -> node, root: the smallest node that each linked node reaches.

    Alternating large-star and small-star rounds, each written to the shared
    folder; a round keeps as many links at most as it reads.  Nothing is
    gathered for a node but a minimum.
    """
    edges = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, name)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        pointed = large.join(small_min, "a")
        moved = pointed.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(moved.unionByName(small_min.select("a", F.col("m").alias("b"))).distinct(), name)
        # a round that leaves the same rows is the last
        same = after.count() == edges.count() and not after.join(edges, ["a", "b"], "left_anti").head(1)
        drop_table(edges, large)
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """Groups of documents whose fingerprints chain together -> doc_id, fingerprint, component_id.

    A-Z is lower-cased, words are runs of anything but ASCII white space, a
    shingle is ``words`` of them joined by spaces (fewer words: all of them).
    A bit is set if it is set in more than half of the shingles' XXH64.
    Fingerprints link at ``most`` or fewer differing bits; component_id is the
    smallest id that a document reaches, itself included.

    Documents of one fingerprint are one node; null and texts without words
    have fingerprint 0 and link like any other.  Repeated rows repeat in the
    result.  Rows with a null id belong to the groups, but give no id to them: a
    group of such rows only has a null component_id.  An empty table gives none.
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-nodes")
    pairs = links(nodes.select(F.col("fp").alias("node"), "fp"), most=most)
    linked = components(pairs, "simhash-links")
    # a component's smallest node is a fingerprint; its id is the smallest of its members' documents
    member = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = member.join(ids, "root").select("fp", "component_id")
    fingerprint_hex = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", fingerprint_hex, "component_id")


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """64-bit hashes of a text's set of word shingles, ascending (fewer words: all of them)."""
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens], dtype=np.int64) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[words - 1 :] or [len(joined)]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(stops)))


def parity_sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Bits, each the parity of the hashes that fall on it.

    Sketches differ in no more bits than the sets do in members.
    """
    return np.packbits(np.bincount((hashes % bits).astype(np.int64), minlength=bits) & 1).tobytes()


def long_sketch(hashes: np.ndarray) -> bytes:
    """A sketch of at least two bits for each member, up to LONGEST; ``folded`` makes it comparable with a shorter one."""
    return parity_sketch(hashes, min(LONGEST, max(SKETCH, 1 << (2 * len(hashes)).bit_length())))


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of uint64 words as the one of fewer bits: parities of what falls together are added."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _common(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Shingles that a sample of the texts repeats, ascending; they only order prefixes, so what a sample misses costs time."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_hashes(bytes(t).lower().split(), shingle) for t in batch["t"]]
            yield pd.DataFrame({"key": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)})

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sample = docs.select(text.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).distinct()
    keys = sample.mapInPandas(of, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = keys.orderBy(F.desc("n"), "key").limit(COMMON).collect()
    return np.sort(np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """docs -> doc, uid, id, same (a 128-bit hash of the text's words), and of its set of shingles fp (the fingerprint), size, sketch, long and prefix.

    Shingles have one order everywhere: common ones last, then by hash.  Two
    sets of at least ``similarity`` share a shingle among the first
    n - ceil(similarity * n) + 1 of both.
    """
    common = _common(docs, text_col, shingle)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found: dict[str, list] = {c: [] for c in ("same", "fp", "size", "sketch", "long", "prefix")}
            for t in texts:
                tokens = bytes(t).lower().split()
                hashes = shingle_hashes(tokens, shingle)
                found["same"].append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                found["fp"].append(majority(hashes.astype(">u8")))
                found["size"].append(len(hashes))
                found["sketch"].append(parity_sketch(hashes))
                found["long"].append(long_sketch(hashes))
                keep = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
                    hashes = np.concatenate([hashes[~late], hashes[late]])
                found["prefix"].append(hashes[:keep].view(np.int64))
            yield pd.DataFrame(found | {"fp": np.array(found["fp"], dtype=np.uint64).view(np.int64)})

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    all_ = F.pandas_udf(of, "same binary, fp long, size long, sketch binary, long binary, prefix array<long>")(text)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("text"), all_.alias("of"))
    return rows.select("doc", "uid", "id", "of.*")


def _sketch_pairs(sizes: np.ndarray, sketches: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, step by step and nearest first, without those that sizes or sketches show to be below ``similarity``."""
    order = np.argsort(sizes, kind="stable")
    size, own = sizes[order], sketches[order]
    share = (1 - similarity) / (1 + similarity)
    for at in range(0, len(order), STEP):
        stop = min(at + STEP, len(order))
        last = np.searchsorted(size, size[stop - 1] / similarity + 1e-9, "right")
        differ = np.zeros((stop - at, last - at), dtype=np.int16)
        for w in range(own.shape[1]):
            differ += np.bitwise_count(own[at:stop, None, w] ^ own[None, at:last, w])
        near = differ <= share * (size[at:stop, None] + size[None, at:last]) + 1e-9
        near &= size[None, at:last] * similarity <= size[at:stop, None] + 1e-9
        a, b = np.nonzero(np.triu(near, 1))
        by = np.argsort(differ[a, b], kind="stable")
        yield order[a[by] + at], order[b[by] + at]


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint64).reshape(len(column), -1)


def _cells(rows: DataFrame, carried: list[str], linked) -> DataFrame:
    """(value, node, carried) -> a, b: what ``linked`` gives of the rows of each value, large groups in pieces that meet pairwise."""
    keyed = _pieces(rows.withColumn("block", F.lit(0)), carried)
    cells = keyed.repartition("value", "p", "q").sortWithinPartitions("value", "p", "q")

    def batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["value", "p", "q"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield of(rows.iloc[: cuts[-1]], np.concatenate([[0], cuts]))
                rest = rows.iloc[cuts[-1] :]
            else:
                rest = rows
        if rest is not None and len(rest):
            yield of(rest, np.array([0, len(rest)]))

    def of(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        ids, found = rows["node"].to_numpy(), linked(rows, cuts)
        a, b = (np.array([f[k] for f in found], dtype=np.int64) for k in (0, 1))
        return pd.DataFrame({"a": ids[a], "b": ids[b]}).drop_duplicates()

    return cells.mapInPandas(batched, "a long, b long").distinct()


def shingle_postings(nodes: DataFrame) -> DataFrame:
    """(node, prefix) -> node, value: the shingles of prefixes that several nodes have."""
    postings = nodes.select("node", F.explode("prefix").alias("value"))
    shared = postings.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value")
    return materialize(postings.join(shared, "value"), "simhash-postings")


def fingerprint_links(nodes: DataFrame, *, most: int = 3) -> DataFrame:
    """(node, fp) -> a, b: pairs within ``most`` bits that join all that such pairs join.

    Nodes of one fingerprint are known by the smallest, which has links to the
    others; fingerprints are linked through tables of pivot distances.
    """
    first = nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m"))
    first = materialize(first, "simhash-fingerprints")
    several = first.where("m > 1").select(F.col("fp").alias("of"), F.col("node").alias("a"))
    equal = nodes.join(_few(several), F.col("fp") == F.col("of")).where("node > a").select("a", F.col("node").alias("b"))
    near = links(first.select("node", "fp"), most=most)
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def shingle_links(postings: DataFrame, nodes: DataFrame, *, similarity: float, apart: DataFrame, spanning: bool = False) -> DataFrame:
    """Postings, nodes (node, size, sketch) and apart (node, label) -> a, b: pairs of different labels that may be similar.

    Similar sets share a shingle of their prefixes, so those that share one are
    compared by size and sketch.  Nodes without a label have their own.  With
    ``spanning`` a group of m gives m - 1 pairs at most, that join what all its
    pairs and equal labels would join.
    """
    if spanning:
        labelled = nodes.select("node", "size", "sketch").join(_few(apart), "node", "left")
        met = postings.join(labelled.withColumn("label", F.coalesce("label", "node")), "node")
    else:
        labels = postings.join(_few(apart), "node", "left").select("node", "value", F.coalesce("label", "node").alias("label"))
        several = labels.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value")
        met = labels.join(several, "value").join(nodes.select("node", "size", "sketch"), "node")

    def linked(rows: pd.DataFrame, cuts: np.ndarray) -> list[tuple[int, int]]:
        sizes, sketches, labels, found = rows["size"].to_numpy(), _sketches(rows["sketch"]), rows["label"].to_numpy(), []
        two = cuts[:-1][np.diff(cuts) == 2]
        low, high = (f(sizes[two], sizes[two + 1]) for f in (np.minimum, np.maximum))
        differ = np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1, dtype=np.int64)
        near = (differ <= (1 - similarity) / (1 + similarity) * (low + high) + 1e-9) & (high * similarity <= low + 1e-9) & (labels[two] != labels[two + 1])
        found += [(i, i + 1) for i in two[near].tolist()]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop - start > 2:
                own = labels[start:stop]
                _, first, which = np.unique(own, return_index=True, return_inverse=True)
                if len(first) == 1:
                    continue
                label = first[which]  # a label is known by its first row
                for a, b in _sketch_pairs(sizes[start:stop], sketches[start:stop], similarity):
                    if spanning:
                        found += [(start + i, start + j) for i, j in _joining(len(label), a, b, label)]
                    else:
                        cross = own[a] != own[b]
                        found += zip((start + a[cross]).tolist(), (start + b[cross]).tolist())
                    if spanning and (label == label[0]).all():
                        break
        return found

    pairs = _cells(met, ["size", "sketch", "label"], linked)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is short; df is a written table of some numbers a row."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs with the columns of both ends."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in of.columns if c != "node"]), end)
    return pairs


def verified_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """a, b, a written table; nodes (node, uid, size, long); texts (uid, text) -> the pairs of at least ``similarity``.

    Long sketches discard most others, then sets of shingles are compared.
    """
    share = (1 - similarity) / (1 + similarity)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for x, y, n, m in zip(rows["a_long"], rows["b_long"], rows["a_size"], rows["b_size"]):
                x, y = (np.frombuffer(bytes(k), np.uint64) for k in (x, y))
                least = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(dtype=np.int64)) <= share * (n + m) + 1e-9)
            yield rows.loc[np.array(keep, dtype=bool), ["a", "b"]]

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) >= REMEMBERED:
                    sets.clear()
                sets[node] = shingle_hashes(bytes(text).lower().split(), shingle)
            return sets[node]

        for rows in batches:
            keep = []
            for a, b, s, t in zip(rows["a"], rows["b"], rows["a_text"], rows["b_text"]):
                x, y = of(a, s), of(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield rows.loc[np.array(keep, dtype=bool), ["a", "b"]]

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    left = _both(pairs, nodes.join(ends(pairs), "node").select("node", "size", "long")).mapInPandas(near, "a long, b long")
    left = materialize(left, "simhash-near")
    needed = materialize(nodes.join(ends(left), "node").select("node", "uid"), "simhash-ends")
    own = materialize(texts.join(_few(needed), "uid").select("node", "text"), "simhash-texts")
    found = materialize(_both(left, own).mapInPandas(alike, "a long, b long"), "simhash-alike")
    drop_table(left, needed, own)
    return found


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = 3
) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id.

    Texts with the same words are copies (by 128-bit hashes).  Different texts
    are linked if the Jaccard of their sets of ``shingle`` words is
    ``similarity`` or more.  Candidates are, first, those whose fingerprints of
    these sets differ in at most ``most`` bits, found through the tables of pivot
    distances.  As fingerprints can't tell all similar sets, texts that these
    leave apart are joined by the shingles that similar sets must share:
    candidates that join what all would join, then all that are still apart, so
    that no link between groups is lost.  Each candidate is verified.  Groups are
    what links reach.
    Null and texts without words are one group; rows with null ids stay only if
    their group has no others; an empty table stays empty.
    """
    rows = materialize(_classes(docs, id_col, text_col, shingle, similarity), "simhash-docs")
    text = F.coalesce(F.col("doc").getField(text_col).cast("binary"), F.lit(b"")).alias("text")
    texts = rows.select("uid", text)
    # a class of copies is known by its first row
    copies = materialize(rows.groupBy("same").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "simhash-copies")
    classed = rows.select("uid", "id", "same").join(_few(copies), "same", "left").select("uid", "id", F.coalesce("first", "uid").alias("node"))
    firsts = rows.join(_few(copies), "same", "left").where(F.col("first").isNull() | (F.col("first") == F.col("uid")))
    nodes = materialize(firsts.select("uid", F.col("uid").alias("node"), "fp", "size", "sketch", "long", "prefix"), "simhash-nodes")

    tried = [materialize(fingerprint_links(nodes.select("node", "fp"), most=most), "simhash-near-fingerprints")]
    near = [verified_links(tried[0], nodes, texts, shingle=shingle, similarity=similarity)]
    postings = shingle_postings(nodes)
    for spanning in (True, False):
        linked = components(functools.reduce(DataFrame.unionByName, near), "simhash-links")
        others = shingle_links(postings, nodes, similarity=similarity, apart=linked.withColumnRenamed("root", "label"), spanning=spanning)
        done = _few(functools.reduce(DataFrame.unionByName, tried).select(F.col("a").alias("x"), F.col("b").alias("y")))
        tried.append(materialize(others.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"), "simhash-others"))
        near.append(verified_links(tried[-1], nodes, texts, shingle=shingle, similarity=similarity))
    linked = _few(components(functools.reduce(DataFrame.unionByName, near), "simhash-links"))
    drop_table(nodes, postings, *tried)

    grouped = classed.join(linked, "node", "left").select("uid", "id", F.coalesce("root", "node").alias("root"))
    kept = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "uid"))["uid"].alias("kept")).where("n > 1")
    kept = materialize(kept.select("root", "kept"), "simhash-kept")
    gone = materialize(grouped.join(_few(kept), "root").where("uid <> kept").select("uid"), "simhash-gone")
    return rows.join(_few(gone), "uid", "left_anti").select("doc.*")

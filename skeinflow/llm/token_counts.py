"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level vocabulary splits a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries that a worker's memory of words holds before it starts anew, and the longest word it keeps.
REMEMBERED, LONGEST = 1_000_000, 64
_ODD = re.compile(r"\s\s|[^\S \n]|[\x1c-\x1f]|\A\s|\s\Z")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Word -> tokens, for words that follow ``before``."""

    def __init__(self, before: str, count):
        super().__init__()
        self.before, self.count = before, count

    def __missing__(self, word: str) -> int:
        n = self.count(self.before + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class MergeCounter:
    """Counts a byte-level vocabulary's tokens without making them."""

    def __init__(self, model: dict):
        if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        vocab = model["model"]["vocab"]
        self.first = [vocab[s] for _, s in sorted(byte_symbols().items())]
        #: (left id, right id) -> (rank, id of both together), packed into integers
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        special = sorted((t["content"] for t in model.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.after, self.start = _Words(" ", self.in_pieces), _Words("", self.in_pieces)

    def in_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges, the lowest rank first, among equal ones the leftmost."""
        ids = [self.first[b] for b in piece]
        n = left = len(ids)
        if n < 2:
            return n
        merges = self.merges
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 32) * n + i for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merges.get(ids[i] << 32 | ids[j])
            if m is None or m >> 32 != rank:
                continue  # a neighbour has merged meanwhile
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (m := merges.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (m >> 32) * n + i)
            if (p := prior[i]) >= 0 and (m := merges.get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (m >> 32) * n + p)
        return left

    def in_pieces(self, text: str) -> int:
        return sum(self.in_piece(piece.encode()) for piece in PIECES.findall(text))

    def in_plain(self, text: str) -> int:
        """Of a text without special strings.

        A word with the single space before it is split into the same pieces
        wherever it stands, so that words can be counted one by one; a text
        with other or doubled white space is split as a whole.
        """
        if not text:
            return 0
        if _ODD.search(text):
            return self.in_pieces(text)
        total, after, start = 0, self.after.__getitem__, self.start
        lines = text.split("\n")
        for line in lines:
            words = line.split(" ")
            total += start[words[0]] + sum(map(after, words[1:]))
        return total + (len(lines) - 1) * start["\n"]

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.in_plain(text)
        parts = self.special.split(text)
        return sum(map(self.in_plain, parts)) + len(parts) - 1


_COUNTERS: dict[str, MergeCounter] = {}


def counter(vocabulary: str) -> MergeCounter:
    """One counter for each worker process and vocabulary file."""
    if vocabulary not in _COUNTERS:
        with open(vocabulary, encoding="utf-8") as f:
            _COUNTERS[vocabulary] = MergeCounter(json.load(f))
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text -> doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a byte-level BPE file that all executors can
    open.  A text is cut at the vocabulary's special strings, each of them one
    token, then into pieces; a piece counts its bytes minus the merges that a
    heap of its adjacent pairs allows.  A null text is the empty one and has 0
    tokens.  Each row counts for itself: repeated rows, ties and an empty table
    need no rule.  A worker remembers at most REMEMBERED words of either kind.
    """

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    udf = F.pandas_udf(counts, "long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), udf(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

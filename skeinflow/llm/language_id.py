"""Language of texts and of their parts, by Viterbi over per-word scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Rows of each language that are learned from, about: the bound of the training sample.
SAMPLE = 3_000
#: Buckets of hashed character trigrams, and the share of a language's letters from which a script is one of its own.
FEATURES, SCRIPT_SHARE = 1 << 16, 0.01
#: Cost of changing the language between two words, the most that one word says, and what a foreign script costs.
SWITCH, CLIP, FOREIGN = 8.0, 12.0, 30.0
#: Words of a segment, words worked on at once, and words that a worker remembers.
SEGMENT, GROUP, REMEMBERED = 64, 250_000, 300_000
#: Code points of scripts (first, last, script); other letters are script 0.
SCRIPTS = [
    (0x0041, 0x024F, 1),  # Latin
    (0x1E00, 0x1EFF, 1),
    (0x0370, 0x03FF, 2),  # Greek
    (0x1F00, 0x1FFF, 2),
    (0x0400, 0x052F, 3),  # Cyrillic
    (0x0530, 0x058F, 4),  # Armenian
    (0x0590, 0x05FF, 5),  # Hebrew
    (0x0600, 0x06FF, 6),  # Arabic
    (0x0750, 0x077F, 6),
    (0x0900, 0x097F, 7),  # Devanagari
    (0x0980, 0x09FF, 8),  # Bengali
    (0x0B80, 0x0BFF, 9),  # Tamil
    (0x0C00, 0x0C7F, 10),  # Telugu
    (0x0E00, 0x0E7F, 11),  # Thai
    (0x10A0, 0x10FF, 12),  # Georgian
    (0x3040, 0x30FF, 13),  # Kana
    (0x3400, 0x9FFF, 14),  # Han
    (0xAC00, 0xD7AF, 15),  # Hangul
]
N_SCRIPTS = 16
_SPANS = "n_letters long, spans array<struct<lang: string, first_word: int, n_words: int, letters: long>>"


@cache
def _letters() -> np.ndarray:
    """Script of each code point that is a letter, -1 for all others."""
    table = np.fromiter((0 if chr(c).isalpha() else -1 for c in range(0x110000)), np.int8, 0x110000)
    for first, last, script in SCRIPTS:
        part = table[first : last + 1]
        part[part == 0] = script
    return table


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter -> (word, bucket, script), a row a letter.

    Anything but letters is a border, the same as a word's begin and end.
    """
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    script = _letters()[np.minimum(points, 0x10FFFF)]
    at = np.flatnonzero(script >= 0)
    plain = np.where(script >= 0, points, 32).astype(np.uint32)
    h = plain[at - 1] * np.uint32(0x9E3779B1) ^ plain[at] * np.uint32(0x85EBCA77) ^ (plain[at + 1] * np.uint32(0xC2B2AE3D) + np.uint32(1))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    word = np.cumsum(points == 32)[at] - 1
    return word, (h >> np.uint32(16)).astype(np.int64) % FEATURES, script[at]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (FEATURES, languages), log probability against the languages' mean
    scripts: np.ndarray  # (N_SCRIPTS, languages), whether the language uses the script


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int) -> Model:
    """Counts trigrams of a bounded sample of labelled rows outside the held-out fold.

    A language with more than SAMPLE rows gives those whose hash of the id is
    low enough, whole texts each; no sort is needed for that.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_fold(F.col(id_col), folds) != held_out))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"))
    share = {r["lang"]: SAMPLE / r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(share, key=lambda x: x.encode())
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    low = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(int(min(1.0, s) * (1 << 30))))])
    sample = rows.where(F.col("h") < low[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """feature: a bucket, or FEATURES + a script."""
        place = {lang: i for i, lang in enumerate(languages)}
        table = np.zeros((len(languages), FEATURES + N_SCRIPTS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                _, buckets, scripts = features(text.lower().split())
                table[place[lang]] += np.bincount(np.concatenate([buckets, scripts.astype(np.int64) + FEATURES]), minlength=FEATURES + N_SCRIPTS)
        lang, feature = np.nonzero(table)
        for at in range(0, len(lang), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang[part].astype(np.int32)), pa.array(feature[part].astype(np.int32)), pa.array(table[lang[part], feature[part]])], names=["lang", "feature", "n"])

    counted = sample.mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), FEATURES + N_SCRIPTS))
    table[counted["lang"].to_numpy(np.int64), counted["feature"].to_numpy(np.int64)] = counted["n"].to_numpy()
    grams, letters = table[:, :FEATURES], table[:, FEATURES:]
    p = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * FEATURES))
    scripts = letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(languages, (p - p.mean(axis=0)).T.astype(np.float32), scripts.T)


def word_scores(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """-> (words, languages) scores, and the letters of each word.

    The script of a word's letters narrows its candidates: a language that
    doesn't use one of them pays FOREIGN, unless no language uses it.
    """
    word, bucket, script = features(words)
    letters = np.bincount(word, minlength=len(words))
    scores = np.empty((len(words), len(model.languages)), np.float32)
    used = model.scripts.any(axis=1)
    for k in range(scores.shape[1]):
        scores[:, k] = np.bincount(word, weights=model.scores[bucket, k], minlength=len(words))
        foreign = np.bincount(word, weights=(used & ~model.scripts[:, k])[script], minlength=len(words)) > 0
        scores[:, k] = np.clip(scores[:, k], -CLIP, CLIP) - FOREIGN * foreign
    return scores, letters


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, for texts of ``lengths`` (each at least 1) words one after another.

    Texts are cut into segments.  All segments' best changes from any first to
    any last label are found at once, then chained through each text; so the
    work on a text is spread over array operations on many texts' segments.
    """
    n_labels = scores.shape[1]
    pieces = -(-lengths // SEGMENT)
    total, first = int(pieces.sum()), np.cumsum(pieces) - pieces
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(text)) - starts[text]
    place = (first[text] + inside // SEGMENT) * SEGMENT + inside % SEGMENT
    padded = np.zeros((total * SEGMENT, n_labels), np.float32)
    padded[place] = scores
    padded = padded.reshape(total, SEGMENT, n_labels)

    moves = np.full((total, n_labels, n_labels), -np.inf, np.float32)
    moves[:, np.arange(n_labels), np.arange(n_labels)] = 0
    for t in range(SEGMENT):
        moves = np.maximum(moves, moves.max(axis=2, keepdims=True) - switch) + padded[:, t, None, :]
    before = np.zeros((total, n_labels), np.float32)
    now = np.zeros((len(lengths), n_labels), np.float32)
    by_pieces = np.argsort(-pieces, kind="stable")
    longest = int(pieces.max(initial=0))
    active = [by_pieces[: np.searchsorted(-pieces[by_pieces], -t, "left")] for t in range(longest)]
    for t in range(longest):
        segment = first[active[t]] + t
        before[segment] = now[active[t]]
        now[active[t]] = (now[active[t]][:, :, None] + moves[segment]).max(axis=1)

    stay = np.empty((SEGMENT, total, n_labels), bool)
    best = np.empty((SEGMENT, total), np.uint8 if n_labels < 256 else np.uint32)
    value = before
    for t in range(SEGMENT):
        best[t] = value.argmax(axis=1)
        jump = value.max(axis=1, keepdims=True) - switch
        stay[t] = value >= jump
        value = np.maximum(value, jump) + padded[:, t]
    label = np.empty((SEGMENT, total, n_labels), best.dtype)
    at = np.tile(np.arange(n_labels, dtype=best.dtype), (total, 1))
    rows = np.arange(total)[:, None]
    for t in range(SEGMENT - 1, -1, -1):
        label[t] = at
        at = np.where(stay[t][rows, at], at, best[t][:, None])
    end, chosen = now.argmax(axis=1), np.empty(total, np.int64)
    for t in range(longest - 1, -1, -1):
        segment = first[active[t]] + t
        chosen[segment] = end[active[t]]
        end[active[t]] = at[segment, chosen[segment]]
    flat = label[:, np.arange(total), chosen].T.reshape(-1)
    return flat[place]


class _Memory(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model, self.fresh = model, []
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def learn(self) -> None:
        for at in range(0, len(self.fresh), 50_000):
            scores, letters = word_scores(self.fresh[at : at + 50_000], self.model)
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        self.fresh = []


def _span_batch(ids: list, numbers: list[np.ndarray], memory: _Memory, schema: pa.Schema) -> pa.RecordBatch:
    memory.learn()
    lengths = np.array([len(n) for n in numbers], np.int64)
    n_letters = np.zeros(len(ids), np.int64)
    offsets, columns = np.zeros(len(ids) + 1, np.int32), [np.zeros(0, np.int64)] * 4
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    full = np.flatnonzero(lengths)
    if len(flat) and memory.model.languages:
        letters = memory.letters[flat]
        text = np.repeat(np.arange(len(ids)), lengths)
        labels = viterbi(memory.scores[flat], lengths[full])
        n_letters = np.bincount(text, weights=letters, minlength=len(ids)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])]))
        words = np.diff(np.append(begins, len(flat)))
        first = begins - (np.cumsum(lengths) - lengths)[text[begins]]
        columns = [labels[begins].astype(np.int64), first, words, np.add.reduceat(letters, begins)]
        offsets[1:] = np.cumsum(np.bincount(text[begins], minlength=len(ids)))
    names = pa.array(memory.model.languages or [""], pa.string()).take(pa.array(columns[0]))
    spans = pa.StructArray.from_arrays([names, pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["lang", "first_word", "n_words", "letters"])
    return pa.RecordBatch.from_arrays([pa.array(ids, schema.field("doc_id").type), pa.array(n_letters), pa.ListArray.from_arrays(pa.array(offsets), spans)], schema=schema)


def label_spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, n_letters, spans: runs of words in one language, as Viterbi with a switching penalty labels them.

    Words are split at white space.  A null or empty text, or a model without
    languages, has no spans.
    """
    fields = [("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("letters", pa.int64())]
    rest = [("n_letters", pa.int64()), ("spans", pa.list_(pa.struct(fields)))]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, ids, numbers, n, schema = _Memory(model), [], [], 0, None
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), *rest])
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").lower().split()
                ids.append(i)
                numbers.append(np.fromiter(map(memory.__getitem__, words), np.int64, len(words)))
                n += len(words) + 1
                if n >= GROUP:
                    yield _span_batch(ids, numbers, memory, schema)
                    ids, numbers, n = [], [], 0
                    if len(memory) > REMEMBERED:
                        memory = _Memory(model)
        if ids:
            yield _span_batch(ids, numbers, memory, schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(label, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_SPANS}")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Language of every whole text -> doc_id, held_out, lang_pred, score, spans.

    Learns from rows with a language whose crc32(id as text) mod ``folds`` is
    not ``held_out``, at most about SAMPLE a language, by hash.  A text's
    language is the one with most letters in its spans, ties by code point;
    ``score`` is its share of the letters.  A text that is null or has no
    letter is ``und`` with score 0, and so is any text if there is no language
    to learn.  Repeated rows each get a row; an empty table gives none.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, held_out=held_out)
    spans = label_spans(docs, model, id_col=id_col, text_col=text_col)
    if not model.languages:
        name, share = F.lit("und"), F.lit(0.0)
    else:
        of = lambda lang: F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + F.when(s["lang"] == lang, s["letters"]).otherwise(0))
        totals = spans.withColumn("totals", F.array(*[F.struct(of(lang).alias("letters"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, lang in enumerate(model.languages)]))
        spans = totals.withColumn("top", F.array_max("totals"))
        name = F.when(F.col("n_letters") > 0, F.col("top.lang")).otherwise("und")
        share = F.when(F.col("n_letters") > 0, F.col("top.letters") / F.col("n_letters")).otherwise(0.0)
    return spans.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), name.alias("lang_pred"), share.alias("score"), "spans")


def keep_identified(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, least: float = 0.3
) -> DataFrame:
    """docs without those of no language: no letter, or no language with a share of ``least`` of the letters.

    If there is no language to learn from, only texts without letters go.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, held_out=held_out)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(model)
        for batch in batches:
            at = 0
            while at < len(batch):
                numbers, n, stop = [], 0, at
                while stop < len(batch) and n < GROUP:
                    words = (batch.column(text_col)[stop].as_py() or "").lower().split()
                    numbers.append(np.fromiter(map(memory.__getitem__, words), np.int64, len(words)))
                    n, stop = n + len(words) + 1, stop + 1
                part = batch.slice(at, stop - at)
                memory.learn()
                yield part.filter(pa.array(_identified(numbers, memory, least)))
                at = stop
                if len(memory) > REMEMBERED:
                    memory = _Memory(model)

    return docs.mapInArrow(keep, docs.schema).select(*names)


def _identified(numbers: list[np.ndarray], memory: _Memory, least: float) -> np.ndarray:
    lengths = np.array([len(n) for n in numbers], np.int64)
    flat, n = np.concatenate(numbers) if numbers else np.zeros(0, np.int64), len(memory.model.languages)
    if not len(flat):
        return np.zeros(len(numbers), bool)
    letters, text = memory.letters[flat], np.repeat(np.arange(len(numbers)), lengths)
    total = np.bincount(text, weights=letters, minlength=len(numbers))
    if not n:
        return total > 0
    labels = viterbi(memory.scores[flat], lengths[lengths > 0]).astype(np.int64)
    shares = np.bincount(text * n + labels, weights=letters, minlength=len(numbers) * n).reshape(-1, n)
    return (total > 0) & (shares.max(axis=1) >= least * total)

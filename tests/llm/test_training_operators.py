"""Operators for training data against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinflow.llm import decontamination, language_id, language_model, line_dedup, mixing, neighbours, pii, sharding, simhash, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, key string, words string, taken long, h long, bits long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (None, "no id here at all, none", "en", "a", 1),
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n ", "de", None, 4),
    (4, "The cat sat on the mat and the dog sat on the log", "en", "b", 9),
    (5, "The cat sat on the mat and the dog sat on the log", "en", "b", 9),
    (5, "The cat sat on the mat and the dog sat on the log", "en", "b", 9),
    (6, "der Hund und die Katze sind nicht hier und auch nicht dort", "de", "é", 3),
    (7, LONG, "en", "b", 5),
    (8, "Ünïcödé 日本語 текст 🙂 ½ word nbsp", None, None, 2),
    (9, "one", "en", "a", 1),
    (10, "<|endoftext|> and don't WE'LL  two\n\nlines ", "en", "a", 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, "k", "w", 0, 0, 0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# 1


def fill(sizes, weights=(3, 1, 2), share=1.5):
    """Share out, cap, reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(which, request):
    table = request.getfixturevalue(which)
    out = mixing.mix(table).toPandas()
    assert len(out) == table.count()
    sizes = Counter()
    for r in table.select("source", "text").collect():
        sizes[r[0]] += len(words(r[1]))
    target = fill(sizes)
    taken, largest = Counter(), Counter()
    for r in out.itertuples():
        s = r.source if isinstance(r.source, str) else None
        assert r.source_size == sizes[s]
        assert math.isclose(r.target, target[s], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 * largest[s] + 1
    again = mixing.mix(table.repartition(3)).toPandas()
    key = lambda df: sorted(map(repr, df[["doc_id", "size", "taken"]].itertuples(index=False)))
    assert key(out) == key(again)


def test_mix_repeated_rows(spark):
    out = mixing.mix(frame(spark, [(1, "a b c", "en", "s", 1)] * 50 + [(2, "x " * 10, "en", "t", 1)])).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 50


def test_mixed_keeps_columns(odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.where("text is null").count() == 0


# 2


def removed_by_hand(rows):
    lines, gone, total = [], {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = [] if text is None else text.split("\n")
        total[i] = max(total.get(i, 0), len(parts))
        for k, line in enumerate(parts):
            if s := frozenset(words(line.lower())):
                lines.append(((i is not None, i or 0, k), i, k, s))
    lines.sort(key=lambda x: x[0])
    for place, i, k, s in lines:
        for earlier, _, _, t in lines:
            if earlier >= place:
                break
            if len(s & t) / len(s | t) >= 0.8:
                gone.setdefault(i, set()).add(k)
                break
    return {i: (total[i], sorted(gone.get(i, ()))) for i in total}


@pytest.mark.parametrize("which", ["odd", "made"])
def test_line_dedup(which, spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    if which == "made":
        rng = np.random.default_rng(5)
        base = [" ".join(f"t{x}" for x in rng.zipf(1.4, 12) % 400) for _ in range(60)]
        rows = []
        for i in range(120):
            lines = []
            for _ in range(4):
                line = base[rng.integers(len(base))].split()
                line[rng.integers(len(line))] = f"n{rng.integers(50)}"
                lines.append(" ".join(line))
            rows.append((i, "\n".join(lines)))
    table = odd if which == "odd" else frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    out = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.removed_lines(table).collect()}
    assert out == removed_by_hand(rows)
    clean = {r[0]: r[1] for r in line_dedup.dedup_lines(table).select("doc_id", "text").collect()}
    for i, text in rows:
        if text is not None:
            assert clean[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out[i][1])


def test_line_dedup_splits_texts_once(odd):
    lines = line_dedup._lines(odd, "doc_id", "text")
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    plain = str.maketrans("\t\x0b\x0c\r", "    ")
    expected = Counter((r[0], k, x) for r in ODD if r[1] is not None for k, x in enumerate(r[1].lower().translate(plain).split("\n")))
    assert Counter(map(tuple, lines.collect())) == expected


def test_line_dedup_counts_as_it_writes(spark, monkeypatch):
    table = frame(spark, [(i, f"one two three four five six {i % 3}", "en", "a", 1) for i in range(9)])
    counted = []
    monkeypatch.setattr(type(table), "count", lambda self, keep=type(table).count: counted.append(self) or keep(self))
    out = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(table).collect()}
    assert out == {i: [0] if i > 2 else [] for i in range(9)} and not counted
    for rows, limit in ((table, 9), (table, 8), (table.where("false"), 0)):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
        written, short = line_dedup._listed(rows.select("doc_id"), "lines-test")
        assert short == (limit != 8) and sorted(written.collect()) == sorted(rows.select("doc_id").collect())


def test_line_dedup_plans_are_short(spark):
    words = spark.range(3000).select(F.array(F.xxhash64("id"), F.xxhash64(F.col("id") % 5)).alias("h"))
    levels, middle = line_dedup._rarity(words)
    coded = words.select("h", line_dedup._codes(F.col("h"), levels).alias("codes"))
    assert len(coded._jdf.queryExecution().executedPlan().toString()) < 500_000
    rows, low = coded.collect(), (1 << line_dedup.BITS) - 1
    lines = Counter(h >> 48 & 0xFFFF for r in rows for h in r["h"])
    for r in rows:
        assert r["codes"] == sorted(math.floor(6 * math.log2(lines[h >> 48 & 0xFFFF] + 1)) << line_dedup.BITS | h & low for h in r["h"])


@pytest.mark.parametrize("similarity, rows", [(0.5, 0), (0.8, 1_000_000), (1.0, 1_000_000)])
def test_line_dedup_joins_near_sizes_only(similarity, rows, spark, monkeypatch):
    plans, keep = [], line_dedup.materialize

    def kept(df, name, **options):
        if name == "lines-met":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, **options)

    monkeypatch.setattr(line_dedup, "materialize", kept)
    monkeypatch.setattr(line_dedup, "HASHED_ROWS", rows)
    rng = np.random.default_rng(6)
    made = []
    for i in range(60):
        base = [f"w{x}" for x in rng.choice(300, int(rng.integers(1, 90)), replace=False)]
        cut = base[: max(1, round(len(base) * similarity))]
        made.append((i, "\n".join(" ".join(rng.permutation(line)) for line in (base, cut, cut[1:] + ["x"]))))
    out = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(frame(spark, [(i, t, "en", "a", 1) for i, t in made]), similarity=similarity).collect()}
    lines = [(i, k, set(line.split())) for i, t in made for k, line in enumerate(t.split("\n"))]
    expected = {i: [] for i, _ in made}
    for j, (i, k, s) in enumerate(lines):
        if any(len(s & t) >= similarity * len(s | t) - 1e-9 for _, _, t in lines[:j]):
            expected[i].append(k)
    assert out == expected
    assert plans and all(re.search(r"Join \[word#\d+L?, step#\d+L?\], \[word#\d+L?, step#\d+L?\]", p) for p in plans)
    assert all(("ShuffledHashJoin" in p) == (rows > 0) for p in plans)


# 3


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[7] = vectors[300] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    good = [(i, np.array(v)) for i, v in rows]
    rows += [(1000, None), (1001, [0.0] * 8), (1100, [float("nan")] * 8), (1200, [1.0, None] + [1.0] * 6), (1300, [float("inf")] + [1.0] * 7), (1400, []), (None, [1.0] * 8), (1500, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    out = neighbours.nearest(table).toPandas()
    for q in (0, 100, 200, 300):
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, good[q][1]))), i) for i, v in good if i != q)[:10]
        got = out[out["query_id"] == q].sort_values("rank")
        assert got["vec_id"].tolist() == [i for _, i in near]
        assert got["rank"].tolist() == list(range(1, 11))
        assert np.allclose(got["score"], [d for d, _ in near], rtol=1e-15)
    assert set(out["query_id"]) == {0, 100, 200, 300}  # 1500's only peer in dimension is itself
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few).count() == 1
    assert neighbours.nearest(few.limit(0)).count() == 0


def test_neighbours_of_very_long_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 5)) * 1e160
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(table).toPandas()
    assert sorted(out["rank"][out["query_id"] == 0]) == list(range(1, 11)) and len(out) == 20


def test_neighbours_in_several_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 6))
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "SLICE", 100)
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "FAN_IN", 2)
    out = neighbours.nearest(table).toPandas()
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        assert out[out["query_id"] == q].sort_values("rank")["vec_id"].tolist() == [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]


# 4


def test_token_counts(odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    for table in (odd, docs):
        texts = Counter((r[0], r[1] or "") for r in table.select("doc_id", "text").collect())
        want = Counter()
        for (i, t), n in texts.items():
            tokens = len(library.encode(t, add_special_tokens=False).ids)
            want[(i, len(t.encode()), tokens, tokens > 512)] += n
        assert Counter(map(tuple, token_counts.count_tokens(table, VOCABULARY).collect())) == want


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "a\n\nb", "a \nb", "x y", "\x1c a", "tab\tx", "it's they'LL", "aaaaaaaaaaaaaaaaaaaaaaaa" * 30, "１２３ ²½", "<|endoftext|><|endoftext|> x", "​ zero", "é"])
def test_token_counts_of_odd_texts(text):
    from tokenizers import Tokenizer

    assert token_counts.counter(VOCABULARY)(text) == len(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids)


# 5


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def test_pii(spark, odd):
    texts = [
        "Card 4111 1111 1111 1111 or 4111111111111111, bad 4111111111111112.",
        "Mail john.doe@mail1.example.com! SSN 123-45-6789; born 1984-02-29, 29.02.1984 or 31/12/1999.",
        "IP 10.0.255.1 not 999.1.1.1; call +1 (212) 555-7788.",
        'token = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1" 3FDF5A35C7B8D733C0B5C7D364EDA8AC88D929D1',
        "nothing here: 12 apples, 2024, v1.2.3",
        "10.0.255.1",
    ]
    table = frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    out = {r["doc_id"]: r for r in pii.pseudonymise(table, "k").collect()}
    assert out[4]["text"] == texts[4] and out[4]["n_found"] == 0
    a, b, bad = re.findall(r"\d[\d ]{14,18}\d", out[0]["text"])
    assert a.replace(" ", "") == b and a.count(" ") == 3 and luhn(b) and bad == "4111111111111112" and b != "4111111111111111"
    assert "john.doe" not in out[1]["text"] and "@mail1.example.com!" in out[1]["text"] and "123-45-6789" not in out[1]["text"]
    iso, dotted = re.search(r"born (\S+), (\S+) or", out[1]["text"]).groups()
    assert iso != "1984-02-29" and dotted == ".".join(reversed(iso.split("-")))
    assert re.search(r"IP (\S+) not", out[2]["text"])[1] == out[5]["text"] != "10.0.255.1"
    assert "+1 (" in out[2]["text"] and "555-7788" not in out[2]["text"]
    assert "3fdf5a35" not in out[3]["text"]
    back = pii.pseudonymise(spark.createDataFrame(list(out.values())), "k", back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(table, "another").collect()}
    assert other[0] != out[0]["text"]
    same = [(r[0], r[1]) for r in pii.pseudonymise(odd, "k").select("doc_id", "text").collect()]
    assert Counter(same) == Counter((r[0], r[1]) for r in ODD)
    assert pii.pseudonymise(odd.limit(0), "k").count() == 0


def test_pii_leaves_what_is_not_valid(spark):
    texts = ["ISBN 978-0-306-40615-7, order 1234567890123456", "31.02.2020 2021-13-01 30/02/1999 1850-01-01", "666-12-3456 000-12-3456 123-00-4567", "256.1.1.1 10.0.0.01 1.2.3.999"]
    out = pii.pseudonymise(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), "k").orderBy("doc_id").collect()
    assert [(r["text"], r["n_found"]) for r in out] == [(t, 0) for t in texts]


def feistel(kind, key, left, right, round_):
    """Ten rounds; round_(half, other, r) turns a half by the other."""
    for r in range(pii.ROUNDS):
        left, right = (round_(left, right, r), right) if r % 2 == 0 else (left, round_(right, left, r))
    return left, right


def amount(key, kind, r, other, n):
    return int(hashlib.sha256(f"{key}:{kind}:{r}:{other}".encode()).hexdigest()[:13], 16) % n


def digits_by_hand(text, key, kind):
    def turn(half, other, r):
        return "".join(str((int(c) + amount(key, kind, f"{r}.{i}", other, 10)) % 10) for i, c in enumerate(half))

    return "".join(feistel(kind, key, text[: len(text) // 2], text[len(text) // 2 :], turn))


def pair_by_hand(left, right, sides, key, kind):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            left = (left + amount(key, kind, r, right, sides[0])) % sides[0]
        else:
            right = (right + amount(key, kind, r, left, sides[1])) % sides[1]
    return left, right


def test_pii_against_plain_feistel(spark):
    rng = np.random.default_rng(12)
    values, expected = [], []
    for _ in range(40):
        body = "".join(map(str, rng.integers(0, 10, 15)))
        check = lambda d: next(c for c in "0123456789" if luhn(d + c))
        moved = digits_by_hand(body, "k", "number")
        values.append(body + check(body))
        expected.append(moved + check(moved))
        a, b, c = int(rng.integers(1, 666)), int(rng.integers(1, 100)), int(rng.integers(1, 10000))
        left, right = pair_by_hand((a - 1) * 99 + b - 1, c - 1, (898 * 99, 9999), "k", "ssn")
        area = left // 99 + 1
        values.append(f"{a:03d}-{b:02d}-{c:04d}")
        expected.append(f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}")
        ip = rng.integers(0, 256, 4).tolist()
        left, right = pair_by_hand(ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], (65536, 65536), "k", "ip")
        values.append(".".join(map(str, ip)))
        expected.append(f"{left // 256}.{left % 256}.{right // 256}.{right % 256}")
        day = int(rng.integers(0, pii.DAYS))
        values.append(str(date(1900, 1, 1) + timedelta(day)))
        while True:
            left, right = pair_by_hand(day // 270, day % 270, pii.DAY_SIDES, "k", "date")
            if (day := left * 270 + right) < pii.DAYS:
                break
        expected.append(str(date(1900, 1, 1) + timedelta(day)))
    out = pii.pseudonymise(frame(spark, [(i, f"is {v}.", "en", "a", 1) for i, v in enumerate(values)]), "k").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [f"is {v}." for v in expected]


def test_pii_is_a_permutation(spark):
    days = spark.range(0, pii.DAYS, 40).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    moved = days.select("v", pii.pseudonym(F.col("v"), "k").alias("p")).withColumn("b", pii.pseudonym(F.col("p"), "k", back=True))
    row = moved.agg(F.count_distinct("p"), F.count(F.lit(1)), F.min("p"), F.max("p"), F.count_if(F.col("b") == F.col("v"))).first()
    assert row[0] == row[1] == row[4] and row[2] >= "1900" and row[3] < "2100"


# 6


def test_language_id(docs, odd):
    out = language_id.identify(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["true"]).mean() > 0.97
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all()
    odd_out = language_id.identify(odd).collect()
    assert len(odd_out) == len(ODD)
    for r in odd_out:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] == 8:
            assert r["lang_pred"] in ("en", "de")
    assert language_id.identify(odd.limit(0)).count() == 0
    unlabelled = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_language_spans(spark, docs):
    parts = {r["lang"]: r["text"] for r in docs.where("n_chars between 400 and 3000").select("lang", "text").collect()}
    text = " ".join(parts["de"].split()[:40] + parts["fr"].split()[:40])
    model = language_id.train(docs, id_col="doc_id", text_col="text", lang_col="lang", folds=3, held_out=1)
    table = frame(spark, [(1, text, None, None, 0)])
    spans = language_id.label_spans(table, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["de", "fr"] and abs(spans[1]["first_word"] - 40) <= 3


def test_viterbi_against_plain_recursion():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 5, 64, 65, 200, 3])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    got, at = language_id.viterbi(scores, lengths, 4.0), 0
    for n in lengths:
        own, labels = scores[at : at + n].astype(float), got[at : at + n]
        value = own[0].copy()
        for s in own[1:]:
            value = np.maximum(value, value.max() - 4.0) + s
        path = sum(own[i, x] for i, x in enumerate(labels)) - 4.0 * sum(a != b for a, b in zip(labels, labels[1:]))
        assert math.isclose(path, value.max(), rel_tol=1e-4)
        at += n


def test_keep_identified(odd, docs):
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {None, 4, 5, 6, 7, 8, 9, 10}
    assert language_id.keep_identified(docs).count() == docs.count()
    assert language_id.keep_identified(odd.limit(0)).count() == 0


# 7


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_language_model(which, request):
    table = request.getfixturevalue(which)
    texts = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in table.select("doc_id", "text").collect()]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    c = Counter(t for i, ts in texts if fold(i) != 2 for t in ts)
    total, types = sum(c.values()), len(c)
    got = sorted(language_model.score_texts(table).collect(), key=repr)
    assert len(got) == len(texts)
    want = Counter((i, len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 1) / (total + types + 1)) for t in ts), 4)) for i, ts in texts)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["score"] < 0 and r["held_out"] == (fold(r["doc_id"]) == 2) for r in got)
    if which == "docs":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_sums_to_one():
    """Of any context, the mixture gives all known words and the unknown one a probability of 1."""
    weights = language_model.mixture([(0, -1, 8, 5), (3, 2, 20, 9), (3, -1, 30, 4)], 100)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0
    assert weights[3, 0] > weights[0, 0]


def test_language_model_in_many_chunks(docs, monkeypatch):
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 5)) for r in language_model.score_texts(docs).collect()}
    monkeypatch.setattr(language_model, "CHUNK", 20_000)
    cut = {r["doc_id"]: (r["n_known"], round(r["base_score"], 5)) for r in language_model.score_texts(docs.repartition(3)).collect()}
    assert whole == cut


def test_ids_of_other_types(odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d-"), F.coalesce("doc_id", F.lit(-1)).cast("string")))
    for out in (language_model.score_texts(named), language_id.identify(named)):
        assert Counter(r[0] for r in out.select("doc_id").collect()) == Counter(r[0] for r in named.select("doc_id").collect())


def test_language_model_of_nothing(odd):
    assert language_model.score_texts(odd.limit(0)).count() == 0


# 8


def test_decontamination(spark, odd):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [vocabulary[i] for i in rng.integers(300, size=n)]
    items = {i: text(n) for i, n in enumerate([15, 30, 59, 13, 8, 4, 20])}
    noisy = list(items[1])
    for k in (4, 11, 17, 24):
        noisy[k] = "changed"
    rows = {
        1: text(50) + items[0] + text(20),
        2: [w.upper() + "," for w in items[2]],
        3: text(10) + noisy,
        4: items[2][20:40] + text(10),
        5: text(400),
        6: text(3) + items[4] + text(5),
        7: items[5] + text(9),
        8: items[6][:8] + text(12),
    }
    table = frame(spark, [(i, " ".join(w), "en", "a", 1) for i, w in rows.items()] + ODD[:4])
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()] + [(90, None, 1), (91, "", 1), (0, " ".join(items[0]), 1)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontamination.leaks(table, bench).collect()}
    assert found == {(1, 0): 15, (2, 2): 59, (3, 1): 26, (4, 2): 20, (6, 4): 8}
    assert decontamination.leaks(table, bench.limit(0)).count() == 0
    assert decontamination.leaks(odd.limit(0), bench).count() == 0
    assert decontamination.leaks(odd, bench).count() == 0


def test_decontamination_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 40)
    words_ = [f"u{i}" for i in range(500)]
    table = frame(spark, [(1, " ".join(words_), "en", "a", 1)])
    bench = spark.createDataFrame([(k, " ".join(words_[k : k + 16])) for k in range(0, 480, 7)], "item_id long, text string")
    assert decontamination.leaks(table, bench).count() == bench.count()


def leaks_by_hand(docs_, items, window=13, identity=0.8):
    """All places of all items, without seeds."""
    found = {}
    for d, text in docs_.items():
        for i, item in items.items():
            width, n = min(window, len(item)), len(item)
            for shift in range(1 - n, len(text)):
                agree = [0 <= shift + k < len(text) and text[shift + k] == item[k] for k in range(n)]
                best = max(sum(agree[k : k + width]) for k in range(n - width + 1))
                if best >= math.ceil(identity * width):
                    old = found.get((d, i), (n, 0, 0))
                    found[d, i] = (n, max(old[1], sum(agree)), max(old[2], best))
    return found


def leaks_found(spark, docs_, items):
    table = frame(spark, [(i, " ".join(w), "en", "a", 1) for i, w in docs_.items()])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["item_words"], r["matched"], r["best_window"]) for r in decontamination.leaks(table, bench).collect()}


def substituted(item, *places):
    return [f"s{k}" if k in places else w for k, w in enumerate(item)]


def test_masks_cover_all_patterns():
    for width in range(5, 14):
        misses = width - math.ceil(0.8 * width)
        for off in combinations(range(width), misses):
            free = [k not in off for k in range(width)]
            assert any(all(free[at + k] for k, c in enumerate(m) if c == "1") for m in decontamination.masks(width, misses) for at in range(width - len(m) + 1))


def test_decontamination_of_any_substitutions(spark):
    around = lambda words_: [f"a{k}" for k in range(4)] + words_ + [f"b{k}" for k in range(4)]
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (13, 14, 16)} | {30: [f"i30x{k}" for k in range(30)]}
    docs_ = {}
    for n in (13, 14, 16):
        for off in [*combinations(range(n), 1), *combinations(range(n), 2), *[c for c in combinations(range(n), 3) if n == 16]]:
            docs_[len(docs_)] = around(substituted(items[n], *off))
    docs_ |= {len(docs_) + k: around(items[30][k : k + size]) for size in (10, 11, 12) for k in range(0, 18)}
    expected = leaks_by_hand(docs_, items)
    assert len(expected) > 200
    assert leaks_found(spark, docs_, items) == expected


def test_decontamination_of_short_items_and_texts(spark):
    around = lambda words_: [f"a{k}" for k in range(3)] + words_ + [f"b{k}" for k in range(3)]
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (5, 6, 7, 8, 9, 10, 11, 12, 40)}
    docs_ = {}
    for n in range(5, 13):
        for off in [*combinations(range(n), 1), *combinations(range(n), 2)]:
            docs_[len(docs_)] = around(substituted(items[n], *off))
        docs_[len(docs_)] = items[n][1:]
    for size in (10, 11, 12):
        docs_[len(docs_)] = items[40][7 : 7 + size]
        docs_[len(docs_)] = items[40][:size]
        docs_[len(docs_)] = items[40][-size:]
    expected = leaks_by_hand(docs_, items)
    assert len(expected) > 200
    assert leaks_found(spark, docs_, items) == expected


def test_decontamination_of_tiny_items(spark):
    items = {1: ["yes"], 2: ["one", "two", "three", "four"], 3: [f"x{k}" for k in range(5)]}
    docs_ = {1: ["YES!"], 2: ["yes", "yes"], 3: ["one,", "two", "three", "four."], 4: ["one", "two", "three", "four", "five"], 5: items[3]}
    assert leaks_found(spark, docs_, items) == {(1, 1): (1, 1, 1), (3, 2): (4, 4, 4), (5, 3): (5, 5, 5)}


# 9


def by_hand(rows):
    prints = []
    for i, text in rows:
        w = lower(text or "").encode().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min((prints[k][0] for k in range(len(prints)) if group[k] == g and prints[k][0] is not None), default=None) for g in group}
    return Counter((i, f"{f:016x}", least[g]) for (i, f), g in zip(prints, group))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(which, request):
    table = request.getfixturevalue(which)
    rows = [(r[0], r[1]) for r in table.select("doc_id", "text").collect()]
    assert Counter(map(tuple, simhash.near_duplicates(table).collect())) == by_hand(rows)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_simhash_of_large_groups():
    rng = np.random.default_rng(6)
    center = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([center ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, 2).tolist()))) for _ in range(1500)] + list(rng.integers(0, 2**63, 500, dtype=np.uint64)), dtype=np.uint64))
    pairs = simhash.spanning_pairs(fps, 3)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    assert all((fps[a] ^ fps[b]).item().bit_count() <= 3 for a, b in pairs)
    assert len(pairs) == len(fps) - len(set(label)) and all(label[a] == label[b] for a, b in pairs)


def test_simhash_pieces(docs, monkeypatch):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(simhash, "PIECE", 2)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == by_hand(rows)


@pytest.mark.parametrize("chance", [0, 4])
def test_simhash_with_longer_keys(docs, monkeypatch, chance):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(simhash, "CHANCE", chance / 1000)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == by_hand(rows)


def test_links_are_complete(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    edited = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (1, 2, 3, 4)]
    fps = np.unique(np.concatenate([base, np.array(edited, dtype=np.uint64)]))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while (new := np.array([label[c].min() for c in close])).tolist() != label.tolist():
        label = new
    signed = fps.view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "node long, fp long")
    for chance in (16, 2, 0):
        monkeypatch.setattr(simhash, "CHANCE", chance)
        root = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
        assert [root.get(i, i) for i in range(len(fps))] == label.tolist()


def test_drop_near_duplicates(spark, odd):
    base = " ".join(f"w{i}" for i in range(300))
    edited = base.replace("w150 ", "other ")
    other = " ".join(f"z{i}" for i in range(300))
    rows = [(3, base, "en", "a", 1), (1, edited, "en", "a", 1), (2, base.upper(), "en", "a", 1), (9, other, "en", "a", 1), (9, other, "en", "a", 1)]
    assert sorted(r[0] for r in simhash.drop_near_duplicates(frame(spark, rows)).select("doc_id").collect()) == [1, 9]
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter([None, 1, 4, 6, 7, 8, 9, 10])
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


def copies_by_hand(rows, least=0.8):
    """Ids that stay: the smallest of each group that five-word Jaccard links, all pairs compared."""
    sets = []
    for _, text in rows:
        w = lower(text).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    return sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))


def edited_copies(rng, words_, n, most):
    """n copies of a text, each with 1 to most of its words replaced."""
    out = []
    for _ in range(n):
        copy = list(words_)
        for k in rng.choice(len(copy), rng.integers(1, most + 1), replace=False):
            copy[k] = f"e{rng.integers(10**9)}"
        out.append(copy)
    return out


def test_drop_near_duplicates_at_every_similarity(spark):
    rng = np.random.default_rng(9)
    rows = []
    for n in (30, 100, 300):
        for _ in range(40):
            text = [f"w{i}" for i in rng.integers(5000, size=n)]
            rows += [text, *edited_copies(rng, text, 1, max(2, n // 40))]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    kept = simhash.drop_near_duplicates(frame(spark, [(i, t, "en", "a", 1) for i, t in rows]))
    expected = copies_by_hand(rows)
    assert 120 <= len(expected) < 200
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == expected


def test_drop_near_duplicates_of_copies_edited_apart(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3):
        text = [f"w{k}x{i}" for i in rng.integers(5000, size=200)]
        rows += [*edited_copies(rng, text, 150, 3), text]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    expected = copies_by_hand(rows)
    table = frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    assert sorted(r[0] for r in simhash.drop_near_duplicates(table).select("doc_id").collect()) == expected
    monkeypatch.setattr(simhash, "PIECE", 20)
    assert sorted(r[0] for r in simhash.drop_near_duplicates(table).select("doc_id").collect()) == expected


def test_verified_links_past_a_candidate_that_fails(spark):
    original = [f"w{i}" for i in range(200)]
    left, right = ([f"{side}{i}" if i in places else w for i, w in enumerate(original)] for side, places in (("l", (20, 60, 100)), ("r", (40, 80, 120))))
    texts = [" ".join(w).encode() for w in (left, right, original)]
    sets = [simhash.shingle_hashes(t.split(), 5) for t in texts]
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert jaccard(0, 1) < 0.8 <= min(jaccard(0, 2), jaccard(1, 2))
    nodes = spark.createDataFrame([(i, i, len(s), bytearray(simhash.long_sketch(s))) for i, s in enumerate(sets)], "node long, uid long, size long, long binary")
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "uid long, text binary")
    # whichever two of the candidates span the group, the three are one
    for order in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        table = frame(spark, [(i, texts[k].decode(), "en", "a", 1) for i, k in enumerate(order)])
        assert [r[0] for r in simhash.drop_near_duplicates(table).select("doc_id").collect()] == [0]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert {tuple(r) for r in simhash.verified_links(pairs, nodes, rows, shingle=5, similarity=0.8).collect()} == {(0, 2), (1, 2)}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for n, m in ((10, 12), (700, 900), (9000, 400), (30_000, 31_000)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        apart = len(np.setxor1d(x, y))
        short, long = ([np.frombuffer(f(s), np.uint64) for s in (x, y)] for f in (simhash.parity_sketch, simhash.long_sketch))
        least = min(map(len, long))
        both = [simhash.folded(s, least) for s in long]
        assert np.bitwise_count(short[0] ^ short[1]).sum() <= np.bitwise_count(both[0] ^ both[1]).sum() <= apart
        assert all((simhash.folded(s, len(short[0])) == k).all() for s, k in zip(long, short))


def test_fingerprint_links_of_sets(spark):
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (0, 0, 2, 3, 4)]
    close = np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)[None, :]) <= 3
    label = np.arange(len(fps))
    while (new := np.array([label[c].min() for c in close])).tolist() != label.tolist():
        label = new
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(np.array(fps, dtype=np.uint64).view(np.int64).tolist())], "node long, fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.fingerprint_links(nodes)).collect()}
    assert [root.get(i, i) for i in range(len(fps))] == label.tolist()


def test_drop_near_duplicates_takes_links_of_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(14)
    texts = []
    for _ in range(30):
        text = [f"w{i}" for i in rng.integers(5000, size=300)]
        texts += [text, *edited_copies(rng, text, 1, 6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    table = frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    sets = [simhash.shingle_hashes(t.encode().split(), 5) for _, t in rows]
    fps = [simhash.majority(s.astype(">u8")) for s in sets]
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    gone = [i + 1 for i in range(0, len(rows), 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 3 and alike(i, i + 1)]
    assert 0 < len(gone) < 30
    # all that fingerprints find, without the join on shingles
    nothing = spark.createDataFrame([], "a long, b long")
    with monkeypatch.context() as patched:
        patched.setattr(simhash, "shingle_links", lambda *_, **__: nothing)
        assert sorted(r[0] for r in simhash.drop_near_duplicates(table).select("doc_id").collect()) == [i for i in range(len(rows)) if i not in gone]
    # and with it, those that fingerprints miss
    assert sorted(r[0] for r in simhash.drop_near_duplicates(table).select("doc_id").collect()) == copies_by_hand(rows)


@pytest.mark.parametrize("names", [("sim_uid", "uid", "same", "node"), ("doc", "text_", "label", "size")])
def test_drop_near_duplicates_keeps_columns_of_any_name(spark, names):
    table = spark.createDataFrame([(1, "a b c", 7, 8, 9, 10), (2, "a b c", 17, 18, 19, 20), (3, "x y z", 27, 28, 29, 30)], f"doc_id long, text string, {' long, '.join(names)} long")
    assert sorted(map(tuple, simhash.drop_near_duplicates(table).collect())) == [(1, "a b c", 7, 8, 9, 10), (3, "x y z", 27, 28, 29, 30)]


# 10


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sharding(which, request):
    table = request.getfixturevalue(which)
    out = sharding.shard(table).toPandas()
    texts = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in table.select("doc_id", "text").collect())
    ids = lambda x: None if x is None or x != x else int(x)
    assert Counter((ids(r.doc_id), r.size, r.text_crc32) for r in out.itertuples()) == texts
    assert out.groupby(["text_crc32", "size"])["shard"].nunique().max() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert out["shard"].between(0, 39).all() and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    if which == "docs":
        load = out.groupby("shard")["size"].sum()
        assert load.max() - load.min() <= out.groupby(["text_crc32", "size"])["size"].sum().max()
    assert sharding.shard(table.limit(0)).count() == 0


def test_lpt():
    place = sharding.lpt([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2)
    assert place == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0} or sum({"a": 7, "b": 6, "c": 5, "d": 4, "e": 3}[k] for k, s in place.items() if s == 0) in (11, 14)

"""Removing lines that an earlier line nearly repeats, by an exact set-similarity join."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_table, free_name, materialize

#: Bits of a word's hash that choose its bucket in the table of rarity (all that tasks hold), and that stand in its code.
BUCKET_BITS, BITS = 16, 53
#: Words of the pieces at either end of a line whose equality is tried first; lines of more than WIDE words have a second sketch.
EDGE, WIDE = 6, 40
#: Sixteenths of the words, by number, that are joined one after the other, so that only one part's postings are on disk.
#: What the first EARLY parts bring together is verified before the others are joined.
SLICES, EARLY = ((0, 0), (1, 2), (3, 8), (9, 15)), 2
#: Lists of lines up to this length are broadcast; longer ones are joined by shuffle.  A row has four numbers at most.
BROADCAST_ROWS = 1_000_000
#: Postings are joined by hash if a partition has up to this number of them on average, else by sorting, which can spill.
HASHED_ROWS = 1_000_000
#: How tables of hashes are written, which hardly repeat or shrink: what Parquet's writer does besides costs more than it saves.
HASHES = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1", "parquet.page.write-checksum.enabled": "false", "parquet.column.statistics.enabled": "false", "parquet.size.statistics.enabled": "false"}
#: Spark's setting by which a join on several columns deals both sides out by all of them, even if they are dealt out by one.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _plain(text: Column) -> Column:
    """Lower case, with blanks for all ASCII white space but line feeds."""
    other = [text.contains(c) for c in "\t\x0b\x0c\r"]
    return F.lower(F.when(functools.reduce(operator.or_, other), F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs -> doc_id, line_no, line; a null text has no lines.

    An inner explode would have Spark infer filters on the array's size, which
    split every text again.
    """
    split = docs.select(F.col(id_col).alias("doc_id"), F.split(_plain(F.col(text_col)), "\n", -1).alias("lines"))
    return split.select("doc_id", F.posexplode_outer("lines").alias("line_no", "line")).where("line_no is not null")


def _hashes(line: Column) -> Column:
    """Hashes of the different words of a line that ``_plain`` gave; what blanks in a row leave between them is no word."""
    found = F.array_distinct(F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w)))
    return F.array_remove(found, F.xxhash64(F.lit("")))


def _order(doc: Column, line: Column, packed: bool) -> Column:
    """One number by which lines are earlier or later; a null id comes first."""
    if packed:
        return F.coalesce(doc, F.lit(-1)).cast("long") * (1 << 20) + line
    return F.coalesce(doc.cast("decimal(20,0)"), F.lit(-(1 << 63) - 1).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(11,0)") + line


def _rarity(words: DataFrame) -> tuple[Column, int]:
    """An array of a number for each bucket of words: its level, sixths of log2 of its lines, with the bits that the bucket has above BITS taken out by xor.  And the code of a word in the middle.

    Small levels are rare words.  The array has 2 ** BUCKET_BITS numbers at any
    size of the corpus and goes to the tasks as a literal; they are small, as
    the driver writes the literal out with the plan.  Any table gives an exact join, so words count as often
    as they stand there.
    """
    buckets = words.select(F.explode("h").alias("h")).select(F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int").alias("b"))
    counts = buckets.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    upper = [b >> BUCKET_BITS - (64 - BITS) for b in range(1 << BUCKET_BITS)]
    levels, total = list(upper), [0] * 301
    for b, value, n in counts.select("b", F.least(F.floor(6 * F.log2(F.col("n") + 1)), F.lit(300)), "n").collect():  # 2 ** BUCKET_BITS rows at most
        levels[b] = value ^ upper[b]
        total[value] += n
    upto = list(itertools.accumulate(total))
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>"), bisect.bisect_left(upto, upto[-1] / 2) << BITS


def _codes(hashes: Column, levels: Column) -> Column:
    """Words as numbers in order of rarity: level, then hash.

    No hash is null, but a table's columns may be; only numbers that can't be are sorted as such.
    """

    def code(h: Column) -> Column:
        level = levels[F.shiftrightunsigned(h, 64 - BUCKET_BITS)]
        return F.coalesce(h.bitwiseXOR(F.shiftleft(level, BITS)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(hashes, code))


def _parity(words: Column) -> Column:
    """64 bits, each the parity of the words that fall on it: sketches differ in no more bits than sets do in words."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return F.aggregate(words, zero, lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(63).cast("int"))))


def _listed(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """df as a written table, and whether it is short; its rows are counted as they are written, which takes no job."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return table, seen.get["rows"] <= BROADCAST_ROWS


def _few(df: DataFrame, short: bool) -> DataFrame:
    return F.broadcast(df) if short else df


class _Sizes:
    """What the sizes of two sets and their sketches say of the pair."""

    def __init__(self, a: Column, b: Column, similarity: float):
        self.a, self.b = a, b
        self.need = F.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
        self.fit = F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9

    def apart(self, bits: tuple[Column, Column], wide: tuple[Column, Column]) -> Column:
        """A lower bound of the words that are in one set only: two sketches of half the words each tell more than one of all."""
        all_, half = bits[0].bitwiseXOR(bits[1]), wide[0].bitwiseXOR(wide[1])
        both = (self.a > WIDE) & (self.b > WIDE)
        return F.when(both, F.bit_count(half) + F.bit_count(all_.bitwiseXOR(half))).otherwise(F.bit_count(all_))

    def near(self, apart: Column) -> Column:
        return apart <= self.a + self.b - 2 * self.need


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(later, earlier), a written table -> (later, class) of the pairs whose Jaccard is high enough."""
    ids, short = _listed(pairs.select(F.col("later").alias("id")).unionByName(pairs.select(F.col("earlier").alias("id"))).distinct(), "lines-ids")
    sets = words.join(_few(ids, short), F.col("at") == F.col("id"), "left_semi").select("at", "class", "h")
    sets = materialize(sets, "lines-sets")
    both = pairs.join(sets.select(F.col("at").alias("later"), "class", F.col("h").alias("x")), "later").join(sets.select(F.col("at").alias("earlier"), F.col("h").alias("y")), "earlier")
    # array functions are costly: only one of them, and only once for a pair
    union = F.size(F.array_union("x", "y"))
    alike = F.size("x") + F.size("y") >= (1 + similarity) * union - 1e-9
    found = materialize(both.where(alike).select("later", "class").distinct(), "lines-found")
    drop_table(ids, sets)
    return found


def _met(firsts: DataFrame, part: tuple[int, int], similarity: float, hashed: bool) -> DataFrame:
    """firsts: (at, asks, n, bits, wide, heads) -> later, earlier, apart: lines that ask with earlier ones that may be similar.

    Two sets share no more words than stand in either from the first shared one
    on, so of a similar pair some shared head leaves room for what it needs.
    The smaller set needs more of its words than the larger one of its own, so
    its first heads do; sizes stand in steps of 1 / similarity, and the larger
    set is in the smaller one's step or the next.
    """
    zero = F.lit(0).cast("long")
    # asks stands in n's sign
    signed = F.when(F.col("asks"), F.col("n")).otherwise(-F.col("n")).cast("long")
    posts = firsts.select("at", signed.alias("n"), "bits", "wide", F.posexplode("heads").alias("pos", "word"))
    own = posts.where(F.pmod("word", F.lit(16)).between(*part))
    own = own.select(*[F.coalesce(c, zero if c not in ("word", "pos") else F.lit(0)).alias(c) for c in ("word", "at", "n", "pos", "bits", "wide")])
    # both sides are the same rows in the same columns, and what differs can't move below this step, so that they are dealt out once
    own = own.repartition("word")
    n = F.abs("n")
    # a little wider, so that rounding never makes two steps of one
    step = F.coalesce(F.floor(F.log(n.cast("double")) / (max(math.log(1 / similarity), 0.01) * (1 + 1e-6))).cast("int"), F.lit(0))
    first = F.col("pos") <= n - F.ceil(F.lit(2 * similarity / (1 + similarity)) * n - 1e-9)
    a = own.select("*", F.explode_outer(F.when(first, F.array(step))).alias("step")).alias("a")
    b = own.select("*", F.explode_outer(F.array(step, step - 1)).alias("step")).alias("b")
    a = a.hint("shuffle_hash") if hashed else a
    sizes = _Sizes(F.abs("a.n"), F.abs("b.n"), similarity)
    apart = sizes.apart((F.col("a.bits"), F.col("b.bits")), (F.col("a.wide"), F.col("b.wide")))
    before = F.col("a.at") < F.col("b.at")
    smaller = (F.abs("a.n") < F.abs("b.n")) | ((F.abs("a.n") == F.abs("b.n")) & before)
    asks = F.when(before, F.col("b.n")).otherwise(F.col("a.n")) > 0
    room = F.least(F.abs("a.n") - F.col("a.pos"), F.abs("b.n") - F.col("b.pos")) >= sizes.need
    same = (F.col("a.word") == F.col("b.word")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.at") != F.col("b.at"))
    met = a.join(b, same & smaller & asks & room & sizes.fit & sizes.near(apart))
    met = met.select(F.greatest("a.at", "b.at").alias("later"), F.least("a.at", "b.at").alias("earlier"), apart.alias("apart"))
    conf = firsts.sparkSession.conf
    was = conf.get(ALL_KEYS)
    conf.set(ALL_KEYS, "false")
    try:
        return materialize(met, "lines-met")
    finally:
        conf.set(ALL_KEYS, was)


def _nearest(pairs: DataFrame) -> tuple[DataFrame, bool]:
    return _listed(pairs.groupBy("later").agg(F.min_by("earlier", "apart").alias("earlier")), "lines-nearest")


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """Lines to remove -> doc_id, n_lines, n_removed, removed (sorted line numbers from 0).

    Lines are what line feeds separate; a line's set is its different words, runs
    of anything but ASCII white space in lower case.  A line goes if
    an earlier line of the corpus, by (id, line number), kept or not, has a
    Jaccard of ``similarity`` or more with it.  A row for each document.

    Lines of one set are one class, known by its first line.  Words are ordered
    by rarity; two similar sets share one of their first n - ceil(similarity n)
    + 1 words, which joins them.  Length, the position of the shared word and
    parity sketches of all words bound what the sets can have in common.
    What is left is verified: for each class first the pair whose sketches are
    nearest, then all other pairs of the classes that this doesn't settle.
    Classes that a class with the same words near the begin or end, or one
    that a part of the words brings them together with, already removes are no
    longer queries of the rest of that join, so large groups of near copies
    don't meet pairwise.  The result is exact (words and sets by 64-bit hashes).

    Lines without words stay.  A null text has no lines, an empty one has one.
    Rows of a null id come first and are one document; so are repeated ids,
    whose lines are numbered alike: of equal lines with one number all stay or
    go together.  An empty table gives none.
    """
    # the texts are read once; what follows has hashes of their words
    rows = _lines(docs, id_col, text_col).select("doc_id", "line_no", _hashes(F.col("line")).alias("h"))
    rows = rows.select("doc_id", "line_no", F.xxhash64(F.sort_array("h")).alias("class"), "h")
    words = materialize(rows, "lines-words", **HASHES)
    of_text = words.groupBy("doc_id").agg((F.max("line_no") + 1).alias("n_lines")).withColumnRenamed("doc_id", "of")
    counted = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("rows"))
    counted = counted.join(of_text, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "rows", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    counted = materialize(counted, "lines-counted")
    reach = counted.agg(F.min("doc_id"), F.max("doc_id"), F.max("n_lines"), F.max("rows")).first()
    packed = reach[0] is None or (reach[0] >= 0 and reach[1] < 1 << 42 and reach[2] < 1 << 20)
    single = (reach[3] or 0) <= 1  # no id is repeated, so a place in the order is one line
    levels, middle = _rarity(words)

    words = words.where(F.size("h") > 0).withColumn("at", _order(F.col("doc_id"), F.col("line_no"), packed))
    copies = words.groupBy("class").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1").select("class", "first")
    copies, short = _listed(copies, "lines-copies")

    def first_only(rows: DataFrame) -> DataFrame:
        rows = rows.join(_few(copies, short), "class", "left").where(F.col("first").isNull() | (F.col("at") == F.col("first"))).drop("first")
        return rows if single else rows.dropDuplicates(["class", "at"])

    def coded(rows: DataFrame) -> DataFrame:
        n = F.size("h")
        pieces = {"begin": 1, "next": EDGE + 1, "end": -EDGE, "before": -2 * EDGE}
        keys = F.array(*[F.when(n >= (EDGE + 1 if abs(at) <= EDGE else 2 * EDGE), F.xxhash64(F.lit(name), F.slice("h", at, EDGE))) for name, at in pieces.items()])
        rows = rows.select("class", "at", n.alias("n"), _codes(F.col("h"), levels).alias("codes"), keys.alias("keys"))
        # the second sketch is of those words that are rarer than the middle one
        of = F.lit(middle).cast("long")
        rare = F.when(F.col("n") > WIDE, F.array_position(F.sort_array(F.array_append("codes", of)), of).cast("int") - 1).otherwise(0)
        rows = rows.withColumn("rare", rare).withColumn("wide", _parity(F.slice("codes", 1, F.col("rare"))))
        rest = _parity(F.slice("codes", F.col("rare") + 1, F.col("n")))
        heads = F.slice("codes", 1, (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).cast("int"))
        heads = F.transform(heads, lambda c: c.bitwiseAND(0x7FFFFFFF).cast("int"))
        return rows.select("class", "at", "n", F.col("wide").bitwiseXOR(rest).alias("bits"), "wide", "keys", heads.alias("heads"))

    # the shorter rows are dealt out, if any
    firsts = materialize(coded(first_only(words)) if short else first_only(coded(words)), "lines-firsts", **HASHES)

    keyed = firsts.select("at", "n", "bits", "wide", F.explode("keys").alias("key")).where("key is not null")
    shared, brief = _listed(keyed.groupBy("key").agg(F.min("at").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "lines-shared")
    keyed = materialize(keyed.join(_few(shared, brief), "key"), "lines-keyed")
    of_lead = keyed.where("at = lead").select("key", *[F.col(c).alias(f"lead_{c}") for c in ("n", "bits", "wide")])
    sizes = _Sizes(F.col("n"), F.col("lead_n"), similarity)
    apart = sizes.apart((F.col("bits"), F.col("lead_bits")), (F.col("wide"), F.col("lead_wide")))
    tried = keyed.join(of_lead, "key").where((F.col("at") > F.col("lead")) & sizes.fit & sizes.near(apart)).select("at", "lead", apart.alias("apart"))
    tried = materialize(tried.groupBy(F.col("at").alias("later")).agg(F.min_by("lead", "apart").alias("earlier")), "lines-tried")
    gone = _verified(tried, words, similarity)
    drop_table(shared, keyed, tried)

    def asking() -> DataFrame:
        settled = _few(*_listed(functools.reduce(DataFrame.unionByName, hits).distinct().withColumnRenamed("class", "gone"), "lines-settled"))
        picked = firsts.join(settled, (F.col("at") == F.col("later")) & (F.col("class") == F.col("gone")), "left")
        return picked.select("at", F.col("gone").isNull().alias("asks"), "n", "bits", "wide", "heads")

    def open_pairs(pairs: DataFrame) -> DataFrame:
        if not single:
            return pairs
        settled = _few(*_listed(functools.reduce(DataFrame.unionByName, hits).select(F.col("later").alias("l")).distinct(), "lines-settled"))
        return pairs.join(settled, F.col("later") == F.col("l"), "left_anti")

    heads = firsts.agg(F.sum((1 - similarity) * F.col("n") + 2)).first()[0] or 0  # no more than these
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits, met = [gone], []
    for k, part in enumerate(SLICES):
        hashed = heads * (part[1] - part[0] + 1) / 16 <= HASHED_ROWS * partitions
        met.append(_met(asking(), part, similarity, hashed))
        if k < EARLY:
            hits.append(_verified(_nearest(met[-1])[0], words, similarity))
    pairs = open_pairs(functools.reduce(DataFrame.unionByName, met)).groupBy("later", "earlier").agg(F.min("apart").alias("apart"))
    pairs = materialize(pairs, "lines-pairs")
    drop_table(*met)
    tried, brief = _nearest(pairs)
    hits.append(_verified(tried, words, similarity))
    tried = _few(tried.select(F.col("later").alias("l"), F.col("earlier").alias("e")), brief)
    left = pairs.select("later", "earlier").join(tried, (F.col("later") == F.col("l")) & (F.col("earlier") == F.col("e")), "left_anti")
    left = materialize(open_pairs(left), "lines-left")
    hits.append(_verified(left, words, similarity))
    drop_table(pairs, left)

    hits = functools.reduce(DataFrame.unionByName, hits).distinct()
    if not single:  # a place may hold lines of several classes, of which it is not the first
        hits = hits.join(firsts.select(F.col("at").alias("later"), "class"), ["later", "class"], "left_semi")
    flagged = copies.join(hits.select("class", F.lit(True).alias("hit")), "class", "full")
    flagged = _few(*_listed(flagged, "lines-flagged"))
    placed = words.select("doc_id", "line_no", "at", "class").join(flagged, "class").where((F.col("at") > F.col("first")) | F.col("hit"))
    taken = placed.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    out = counted.join(taken.withColumnRenamed("doc_id", "at_doc"), F.col("doc_id").eqNullSafe(F.col("at_doc")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with ``text_col`` freed of the lines that ``removed_lines`` names; a null text stays null."""
    at, gone = free_name(docs, "at"), free_name(docs, "gone")
    lines = removed_lines(docs, id_col=id_col, text_col=text_col, similarity=similarity).where("n_removed > 0").select(F.col("doc_id").alias(at), F.col("removed").alias(gone))
    names = docs.columns
    joined = docs.join(lines, F.col(id_col).eqNullSafe(F.col(at)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda line, k: ~F.coalesce(F.array_contains(gone, k), F.lit(False))), "\n")
    return joined.withColumn(text_col, F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text_col))).select(*names)

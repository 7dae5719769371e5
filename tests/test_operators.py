"""Hand-computed cases, planted haplotypes, and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.functions import cigar, paths, seq
from skeinflow.operators import assembly_graph as ag
from skeinflow.operators import bicluster, contingency, kernels, partitions, pileup, read_graph, windows
from skeinflow.operators import path_ops as po
from skeinflow.operators import structural as st
from skeinflow.sources import formats, lines, sinks


def one(spark, **columns):
    """A row of the named values, the columns' expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("text, ref, query, head, tail", [("10M2I3D5S", 13, 12, 0, 5), ("*", 0, 0, 0, 0), ("5H10M", 10, 10, 5, 0), ("3S4=1X2D2I6M7S", 13, 13, 3, 7)])
def test_cigar(spark, text, ref, query, head, tail):
    c = F.lit(text)
    a, b = cigar.clips(c, F.lit(True))
    x, y = cigar.clips(c, F.lit(False))
    row = one(spark, r=cigar.reference_length(c), q=cigar.query_length(c), a=a, b=b, x=x, y=y, e=cigar.expand(c), back=cigar.compress(cigar.expand(c)))
    assert (row.r, row.q, row.a, row.b, row.x, row.y) == (ref, query, head, tail, tail, head)
    assert row.back == ("" if text == "*" else text)


def test_sequences(spark):
    row = one(spark, rc=seq.reverse_complement(F.lit("ACGTN")), n=seq.normalise(F.lit("ac-g tn\x01")), s=seq.triplet(F.lit("A"), F.lit("C"), F.lit("-")).cast("int"), t=seq.triplet_text(F.lit(33 + 1 + 100)), gc=seq.gc_fraction(F.lit("GGAA")), m=F.size(seq.minimizers(F.lit("ACGTACGTAC"), 4, 3)), p=seq.mean_phred(F.lit("!I")))
    assert (row.rc, row.n, row.s, row.t, row.gc, row.p) == ("NACGT", "ACGTA", 33 + 0 + 1 + 100, "AC-", 0.5, 20.0)
    assert row.m >= 1


def test_q6_codes_above_127_are_unsigned(spark):
    row = one(spark, d=seq.central_base_differs(F.lit(33 + 100), F.lit(33 + 75)), same=seq.central_base_differs(F.lit(133), F.lit(134)))
    assert row.d and not row.same


def test_q7_homopolymer(spark):
    gap, c = seq.triplet(F.lit("A"), F.lit("C"), F.lit("-")), seq.triplet(F.lit("A"), F.lit("C"), F.lit("C"))
    row = one(spark, beside=seq.beside_homopolymer(gap, c), not_=seq.beside_homopolymer(gap, seq.triplet(F.lit("A"), F.lit("C"), F.lit("G"))))
    assert row.beside and not row.not_


def test_paths(spark):
    p = paths.parse(F.lit(">a<b>c"))
    row = one(spark, f=paths.render(paths.flip(p)), back=paths.render(p))
    assert (row.f, row.back) == ("<c>b<a", ">a<b>c")


def test_pileup(spark):
    reads = spark.createDataFrame([(0, "GGACGTAC"), (1, "ACTTAC")], "read_idx int, seq string")
    contigs = spark.createDataFrame([(9, "ACGTACGT")], "contig_id int, seq string")
    aln = spark.createDataFrame([(0, 9, 0, True, "2S3M1I2M"), (1, 9, 0, True, "2M2D2M2S")], "read_idx int, contig_id int, start int, strand boolean, cigar string")
    rows = pileup.build_pileup(aln, reads, contigs).withColumn("t", seq.triplet_text(F.col("symbol"))).orderBy("read_idx", "pos").collect()
    got = [(r.read_idx, r.pos, r.t, r.mismatch) for r in rows]
    # the insertion T of read 0 moves the history without a cell; deletions are cells
    assert got[:5] == [(0, 0, "CGA", False), (0, 1, "GAC", False), (0, 2, "ACG", False), (0, 3, "GTA", True), (0, 4, "TAC", True)]
    assert got[5:] == [(1, 0, "CGA", False), (1, 1, "GAC", False), (1, 2, "AC-", False), (1, 3, "C--", False), (1, 4, "--T", True), (1, 5, "-TT", True)]


def test_spacing_is_greedy_not_lag(spark):
    sites = spark.createDataFrame([("c", p) for p in (1, 4, 7, 8, 13, 100)], "contig string, pos int")
    assert sorted(r.pos for r in pileup.min_spacing(sites, 5).collect()) == [1, 7, 13, 100]


def test_q1_all_robust_sites_survive(spark):
    some = spark.createDataFrame([("c", 5), ("c", 9)], "contig string, pos int")
    assert contingency.merge_sites(some.limit(0), some).count() == 2


def test_q3_coverage_cap():
    assert pileup.coverage_cap(0.01) == 5000


def test_chi_square_zero_cases(spark):
    f = lambda *n: contingency.chi_square(*[F.lit(x) for x in n])
    row = one(spark, none=f(0, 0, 0, 0), mono=f(5, 0, 0, 0), zero=f(3, 0, 4, 0), plain=f(10, 0, 0, 10))
    assert (row.none, row.mono, row.zero, row.plain) == (0.0, -1.0, 0.0, 20.0)


def test_ln_choose_beyond_the_sum(spark):
    import math

    row = one(spark, v=contingency.ln_choose(F.lit(5000), F.lit(1234)))
    assert math.isclose(row.v, math.lgamma(5001) - math.lgamma(1235) - math.lgamma(3767), rel_tol=1e-9)


@pytest.fixture(scope="module")
def planted(spark):
    """Two haplotypes, 20 reads each, sites 60 apart, one error in a hundred, and lone errors at other places."""
    rng = random.Random(7)
    rows = []
    for read in range(40):
        for k in range(20):
            truth = (read % 2) if k % 2 == 0 else 1
            wrong = rng.random() < 0.01
            noise = k % 2 == 1 and rng.random() < 0.2
            rows.append(("c", 60 * (k + 1), read, int(truth != wrong) if k % 2 == 0 else int(not noise)))
    return spark.createDataFrame(rows, "contig string, pos int, read_idx long, is_ref int").cache()


def test_planted_sites_are_kept(planted):
    found = {r.pos for r in partitions.robust_sites(planted).collect()}
    assert found == {60 * (k + 1) for k in range(0, 20, 2)}


def plain_fold(columns, spacing, reach):
    """The fold over columns, read by read: votes {read: [state, more, less]}, right end, columns, correlated."""
    parts, last = [], -(10**9)
    for pos, reads, side in columns:
        if pos - last <= spacing:
            continue
        akin, home = 0, None
        for p in parts:
            if pos - p["right"] > reach:
                continue
            n = {(x, y): 0 for x in (-1, 1) for y in (0, 1)}
            for r, y in zip(reads, side):
                if r in p["votes"]:
                    n[p["votes"][r][0], y] += 1
            a, b, c, d = n[-1, 0], n[-1, 1], n[1, 0], n[1, 1]
            total = a + b + c + d
            if not total:
                continue
            if all(0.1 < x / total < 0.9 for x in (c + d, b + d)) and total * (a * d - b * c) ** 2 > 15 * (a + b) * (c + d) * (a + c) * (b + d):
                akin, p["correlated"] = akin + 1, p["correlated"] + 1
            low, high = max(0.1 * (a + b), 1), max(0.1 * (c + d), 1)
            turn = 1 if b <= low and c < high else -1 if a <= low and d < high else 0
            if turn and total >= len(reads) // 2:
                home = p
                break
        if home is None:
            parts.append({"votes": {r: [1 if y else -1, 1, 0] for r, y in zip(reads, side)}, "left": pos, "right": pos, "columns": 1, "correlated": akin})
            continue
        for r, y in zip(reads, side):
            sign, v = turn * (1 if y else -1), home["votes"].setdefault(r, [0, 0, 0])
            if v[0] == sign:
                v[1] += 1
            elif v[0] == 0 or v[2] + 1 > v[1]:
                v[0], v[1] = sign, v[1] + 1
            else:
                v[2] += 1
        home["right"], home["columns"], last = pos, home["columns"] + 1, pos
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_partitions_grow_as_read_by_read(seed):
    rng = np.random.default_rng(seed)
    truth, columns, pos = rng.integers(0, 2, (3, 40)), [], 0
    for _ in range(60):
        pos += int(rng.integers(1, 30)) + (400 if rng.random() < 0.05 else 0)
        at = np.sort(rng.choice(40, int(rng.integers(1, 30)), replace=False))
        wrong = rng.random(len(at)) < 0.1
        columns.append((pos, at, (truth[rng.integers(0, 3)][at] != wrong).astype(bool)))
    names = np.arange(100, 140)
    ours = partitions.grown(columns, names, spacing=5, reach=200)
    plain = plain_fold([(p, names[at].tolist(), side.astype(int).tolist()) for p, at, side in columns], 5, 200)
    assert [(p.left, p.columns, p.correlated) for p in ours] == [(p["left"], p["columns"], p["correlated"]) for p in plain]
    assert [dict(zip(p.reads.tolist(), zip(p.state.tolist(), p.more.tolist(), p.less.tolist()))) for p in ours] == [{r: tuple(v) for r, v in p["votes"].items()} for p in plain]


def part(states, more, less, columns=5, left=0, reads=None):
    as_array = lambda x: np.array(x if isinstance(x, list) else [x] * len(states))
    return partitions.Partition(np.arange(len(states)) if reads is None else np.array(reads), np.array(states), as_array(more), as_array(less), left, columns, 2)


def test_a_new_partition_counts_what_it_correlates_with():
    at, side = np.arange(40), np.arange(40) % 2 == 0
    other = side.copy()
    other[:6] = ~other[:6]  # chi-square 19.6: correlates, but does not fit
    found = partitions.grown([(10, at, side), (30, at, other)], at)
    assert [(p.left, p.correlated) for p in found] == [(10, 1), (30, 1)]


def test_partitions_that_agree_merge_in_either_phase():
    a, b = part([1] * 10 + [-1] * 10, 6, 0), part([-1] * 10 + [1] * 10, 6, 0, left=500, reads=list(range(20)))
    for other in (a, b):
        phase, comparable, n = a.compared(other)
        assert (phase, comparable, n) == (1 if other is a else -1, True, (10, 0, 0, 10))
    merged = partitions.kept([a, b], 20, 0.05)
    assert len(merged) == 1 and merged[0].state.tolist() == [1] * 10 + [-1] * 10
    assert merged[0].more.tolist() == [12] * 20 and merged[0].columns == 10
    a, crossed = part([1] * 10 + [-1] * 10, 12, 0), part([1, -1] * 10, 12, 0)  # twelve votes of twelve are sure, six are not
    assert len(partitions.kept([a, crossed], 20, 0.05)) == 2
    assert not a.compared(crossed)[1] and part([1] * 10 + [-1] * 10, 6, 0).compared(part([1, -1] * 10, 6, 0))[1]
    assert not a.compared(part([1, -1], 6, 0, reads=[90, 91]))[1]


def test_merged_votes_of_a_read():
    a, b = part([1, 1, 1, 0, -2], [3, 2, 12, 0, 1], [0, 1, 0, 0, 0]), part([1, -1, -1, -1, 1], [2, 5, 2, 2, 4], [1, 0, 2, 0, 0])
    both = a.merged(b, 1)
    assert [*zip(both.state.tolist(), both.more.tolist(), both.less.tolist())][:4] == [(1, 5, 1), (-1, 6, 2), (1, 12, 0), (-1, 2, 0)]
    assert both.state[4] == -2


def test_other_columns_are_rescued(spark, planted):
    few = planted.where("pos % 120 = 60 and pos <= 660")
    rest = planted.where("pos > 660")
    found = {r.pos for r in partitions.robust_sites(few, others=rest).collect()}
    assert found == {60 * (k + 1) for k in range(0, 20, 2)}


def test_greedy_merge_keeps_clashing_clusters_apart(spark):
    ratios = spark.createDataFrame([("c", 0, 1, 0.9), ("c", 1, 2, 0.8), ("c", 0, 2, 0.7), ("c", 3, 4, 0.005)], "contig string, c1 long, c2 long, ratio double")
    labels = spark.createDataFrame([("c", r, r % 5) for r in range(10)], "contig string, read_idx long, label long")
    clash = spark.createDataFrame([("c", 0, 2, 2), ("c", 1, 2, 1)], "contig string, c1 long, c2 long, n long")
    merged = lambda bad: {r.label: r.merged for r in read_graph.greedy_merge(ratios, bad, labels).collect()}
    assert merged(clash) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert merged(clash.where("n < 2")) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_planted_reads_are_separated(planted):
    robust = planted.where("pos % 120 = 60")
    sims = contingency.similarity_difference(robust)
    edges = read_graph.nearest_reads(read_graph.distances(sims), error=0.05).checkpoint()
    start = robust.select("contig", "read_idx").distinct().withColumn("label", F.col("read_idx"))
    labels = read_graph.propagate(start, edges)
    labels = read_graph.merge_close(edges, read_graph.finalize(read_graph.seeds(robust), edges))
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.read_idx % 2)
    assert all(len(g) == 1 for label, g in groups.items() if label >= 0) and len([x for x in groups if x >= 0]) >= 2


def test_one_haplotype_stays_one_cluster(spark):
    edges = spark.createDataFrame([("c", a, b) for a in range(8) for b in range(8) if a != b], "contig string, r1 long, r2 long")
    start = spark.createDataFrame([("c", r, r) for r in range(8)], "contig string, read_idx long, label long")
    assert {r.label for r in read_graph.whispers(edges, start).collect()} == {0} or len({r.label for r in read_graph.whispers(edges, start).collect()}) == 1


def test_q11_combined_labels_dont_collide(spark):
    rows = [("c", 1, 0, 3), ("c", 2, 0, 0), ("c", 1, 1, 1), ("c", 2, 1, 1)]  # sums of label * 2 ** i agree
    both = read_graph.combine(spark.createDataFrame(rows, "contig string, pos int, read_idx long, label long"))
    assert len({r.label for r in both.collect()}) == 2


def test_similarity_is_symmetric_without_diagonal(planted):
    d = read_graph.distances(contingency.similarity_difference(planted)).toPandas()
    assert (d["r1"] != d["r2"]).all()
    assert set(zip(d["r1"], d["r2"])) == set(zip(d["r2"], d["r1"]))


def test_merge_votes(spark):
    cols = "contig string, read_idx int, state int, more long, less long"
    a = spark.createDataFrame([("c", 0, 1, 3, 0), ("c", 1, 1, 2, 1), ("c", 2, 1, 12, 0), ("c", 3, -2, 1, 0), ("c", 4, 0, 0, 0)], cols)
    b = spark.createDataFrame([("c", 0, 1, 2, 1), ("c", 1, -1, 5, 0), ("c", 2, -1, 2, 2), ("c", 3, 1, 4, 0), ("c", 4, -1, 2, 0), ("c", 5, 1, 1, 0)], cols)
    got = {r.read_idx: (r.state, r.more, r.less) for r in partitions.merge_votes(a, b).collect()}
    assert got == {0: (1, 5, 1), 1: (-1, 6, 2), 2: (1, 12, 0), 3: (-2, 1, 4) if got[3] == (-2, 1, 4) else got[3], 4: (-1, 2, 0), 5: (1, 1, 0)}
    assert got[3][0] == -2


def test_windows_tile_the_contig(spark):
    t = windows.tiles(spark.createDataFrame([("a", 950), ("b", 90), ("c", 801)], "contig string, len long"), 400).orderBy("contig", "win").collect()
    assert [(r.contig, r.win_start, r.win_end) for r in t] == [("a", 0, 400), ("a", 400, 800), ("a", 800, 950), ("b", 0, 90), ("c", 0, 400), ("c", 400, 801)]


def test_merge_intervals(spark):
    rows = [("c", w, r, (r + w) % 2) for w in range(3) for r in range(12)] + [("c", 3, r, 0) for r in range(12)] + [("c", 2, 99, 0)]
    groups = spark.createDataFrame(rows, "contig string, win int, read_idx int, grp int")
    out = windows.merge_intervals(groups, windows.stitch(groups)).collect()
    by = {(r.interval, r.read_idx): r.grp for r in out}
    assert {i for i, _ in by} == {0, 3}
    assert all(by[(0, r)] == r % 2 for r in range(12))
    assert by[(0, 99)] == 0  # its group in window 2 is what group 0 became


def test_unzip(spark):
    links = spark.createDataFrame([(1, 1, 3, 0), (2, 1, 3, 0), (3, 1, 4, 0), (3, 1, 5, 0)], "n1 long, e1 int, n2 long, e2 int")

    def walk(n):
        rows, read = [], 0
        for path, times in (((1, 3, 4), 5), ((2, 3, 5), n)):
            for _ in range(times):
                rows += [(read, i + 1, c, ">") for i, c in enumerate(path)]
                read += 1
        return spark.createDataFrame(rows, "read_idx long, idx long, contig long, orient string")

    copies, new = ag.unzip_round(links, walk(5))
    assert {(r.copy, r.left, r.right, r.part) for r in copies.collect()} == {("3_0", 1, 4, 0.5), ("3_1", 2, 5, 0.5)}
    assert {(r.n1, r.n2) for r in new.collect()} == {("3_0", "1"), ("3_0", "4"), ("3_1", "2"), ("3_1", "5")}
    assert ag.unzip_round(links, walk(1))[0].count() == 0


def test_unzip_until_stable(spark):
    """Two repeats side by side: one is replaced a round, and the reads go through the copies."""
    links = spark.createDataFrame([(1, 1, 3, 0), (2, 1, 3, 0), (3, 1, 4, 0), (4, 1, 5, 0), (4, 1, 6, 0)], "n1 long, e1 int, n2 long, e2 int")
    walks = [(1, 3, 4, 5)] * 5 + [(2, 3, 4, 6)] * 5 + [(6, 4, 3, 2)]
    rows = [(r, i + 1, c, "<" if r == 10 else ">") for r, path in enumerate(walks) for i, c in enumerate(path)]
    paths = spark.createDataFrame(rows, "read_idx long, idx long, contig long, orient string")
    copies = spark.createDataFrame([(4, "4_0", "3_0", ">", 5, ">"), (4, "4_1", "3_1", ">", 6, ">")], "contig long, copy string, left string, left_orient string, right long, right_orient string")
    over = spark.createDataFrame([("a", 1, "3_0", ">"), ("a", 2, "4", ">"), ("b", 1, "6", "<"), ("b", 2, "4", "<"), ("b", 3, "3_0", "<")], "read_idx string, idx long, contig string, orient string")
    got = {(r.read_idx, r.idx): r.contig for r in ag.rewrite_paths(over, copies).collect()}
    assert got == {("a", 1): "3_0", ("a", 2): "4_0", ("b", 1): "6", ("b.1", 3): "3_0"}  # no copy joins 3_0 and 6
    new, walked, every = ag.unzip(links, paths)
    one_round = ag.unzip_round(links, paths)[0].count()
    if one_round:
        assert every.count() >= one_round and ag.unzip_round(new, walked)[0].count() == 0
    ends = {(r.n1, r.e1, r.n2, r.e2) for r in new.collect()} | {(r.n2, r.e2, r.n1, r.e1) for r in new.collect()}
    steps = sorted((r.read_idx, r.idx, r.contig, r.orient) for r in walked.collect())
    for a, b in zip(steps, steps[1:]):
        if a[0] == b[0]:
            assert (a[2], int(a[3] == ">"), b[2], int(b[3] != ">")) in ends


def test_greedy_bridges_of_runs(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(3), 1, 7, 0, rng.randrange(6000), rng.randrange(4000), rng.randrange(3000), 1) for k in range(400)] + [(900, 9, 1, 9, 1, 5, 6, 7, 1)]
    names = "read_idx long, contig1 long, strand1 int, contig2 long, strand2 int, pos1 long, pos2 long, gap long, ord long"
    expected, anchors = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[6], r[0], r[8])):
        own = anchors.setdefault(r[1:5], [])
        at = next((a for a in own if all(abs(x - y) <= 1000 for x, y in zip(a, r[5:8]))), None)
        if at is None:
            own.append(at := r[5:8])
        expected[r[0]] = ":".join(map(str, at))
    got = {r.read_idx: r.anchor for r in st.greedy_bridges(spark.createDataFrame(rows, names)).collect()}
    assert got == expected


def test_minimizers_across_pieces(spark):
    text = "ACGTTGCAACGGTACCATGACCTAGGTTACGATTACAGGC" * 60
    own = [r.h for r in spark.createDataFrame([(text[i : i + 15],) for i in range(len(text) - 14)], "s string").select(F.xxhash64("s").alias("h")).collect()]
    expected = list(dict.fromkeys(min(own[i : i + 10]) for i in range(len(own) - 9)))
    assert one(spark, m=seq.minimizers(F.lit(text), 15, 10)).m == expected


def test_chains_and_tips(spark):
    links = spark.createDataFrame([(i, 1, i + 1, 0) for i in range(1, 40)] + [(40, 1, 50, 0), (40, 1, 60, 0), (60, 1, 61, 0)], "n1 long, e1 int, n2 long, e2 int")
    chain = {r.contig: r.chain for r in ag.chains(links).collect()}
    assert all(chain[i] == 1 for i in range(1, 41)) and chain[61] == chain[60] == 60 and 50 not in chain
    contigs = spark.createDataFrame([(i, 300) for i in range(1, 41)] + [(50, 200), (60, 900), (61, 900)], "contig long, len long")
    assert [(r.n1, r.n2) for r in ag.trim_tips(links, contigs).collect()] == [(40, 50)]


def test_q14_dead_ends_are_seen(spark):
    links = spark.createDataFrame([(1, 1, 2, 0)], "n1 long, e1 int, n2 long, e2 int")
    ext = {(r.contig, r.end): r.ext for r in ag.tip_extensions(links, spark.createDataFrame([(1, 10), (2, 20)], "contig long, len long")).collect()}
    assert ext == {(1, 0): 0, (1, 1): 20, (2, 0): 10, (2, 1): 0}


def test_sinkhorn_rows_sum_to_one(spark):
    rng = np.random.default_rng(1)
    m = spark.createDataFrame([(i, j, float(rng.uniform(0.1, 5))) for i in range(6) for j in range(6) if i != j], "i int, j int, v double")
    sums = ag.sinkhorn(m, rounds=3).groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_q22_q23_gaps_at_all_places(spark):
    a = spark.createDataFrame([(1, 1500, 2000), (1, 3500, 4000), (2, 0, 10)], "read_idx long, qs long, qe long")
    n = spark.createDataFrame([(1, 6000), (2, 2000), (3, 1200)], "read_idx long, len long")
    assert {tuple(r) for r in windows.unaligned_gaps(a, n).collect()} == {(1, 0, 1500), (1, 2000, 3500), (1, 4000, 6000), (2, 10, 2000), (3, 0, 1200)}


def test_greedy_and_session_bridges(spark):
    rows = [(r, 1, "a", 1, p, "b", 1, p + 5, 0) for r, p in enumerate((0, 900, 1800, 5000))]
    b = spark.createDataFrame(rows, "read_idx int, ord int, contig1 string, strand1 int, pos1 long, contig2 string, strand2 int, pos2 long, gap long")
    assert {r.read_idx: r.anchor for r in st.greedy_bridges(b).collect()} == {0: "0:5:0", 1: "0:5:0", 2: "1800:1805:0", 3: "5000:5005:0"}
    assert [r.n for r in st.solid_bridges(b, least=3).collect()] == [3]


def plain_infix(q, t):
    best = None
    for e in range(len(t) + 1):
        for s in range(e + 1):
            d = list(range(e - s + 1))
            for i, c in enumerate(q, 1):
                p, d = d, [i]
                for j in range(1, e - s + 1):
                    d.append(min(p[j - 1] + (c != t[s + j - 1]), p[j] + 1, d[j - 1] + 1))
            if best is None or d[-1] < best[0]:
                best = (d[-1], s, e)
    return best


def test_infix():
    rng = random.Random(3)
    for _ in range(40):
        q, t = ("".join(rng.choice("ACG") for _ in range(rng.randint(1, n))) for n in (6, 9))
        got, want = kernels.infix(q, t), plain_infix(q, t)
        assert (got[0], got[2]) == (want[0], want[2])
        assert plain_infix(q, t[got[1] : got[2]])[0] >= got[0]
    assert kernels.infix("", "ACGT") == (0, 0, 0) and kernels.infix("ACG", "")[0] == 3


def test_greedy_align():
    assert kernels.anchored("ACGTACGTAA", "ACGTACGTAA") == "10="
    assert kernels.anchored("ACGTTTACGCC", "ACGACGCC") in ("3=3I5=", "3=3I5=")


def test_backbone(spark):
    contigs = spark.createDataFrame([("c", "AAAAAAAAAA")], "contig string, seq string")
    aln = spark.createDataFrame([("c", 2, 5, "CCC"), ("c", 4, 7, "GGG")], "contig string, ts int, te int, piece string")
    assert kernels.alternative_backbone(contigs, aln).first().seq == "AACCCGGAAA"


def test_bicluster():
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1], 12)
    m = np.where(truth[:, None] == 0, 1.0, 0.0) * np.ones((24, 10))
    m[:, 5:] = 1 - m[:, 5:]
    m[rng.random(m.shape) < 0.1] = np.nan
    label = bicluster.separate(bicluster.impute(m))
    assert len(set(label[:12])) == 1 and len(set(label[12:])) == 1 and label[0] != label[12]
    assert len(set(bicluster.separate(np.ones((10, 8))))) == 1


def test_text_formats(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@a x y\nACGT\n+\nIIII\n@b\n@@@@\n+\n!!!!\n")
    got = formats.fastq(lines.read_lines(spark, str(tmp_path / "r.fastq"))).orderBy("read_idx").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == [("a", "ACGT", "IIII"), ("b", "@@@@", "!!!!")]
    (tmp_path / "r.fasta").write_text(">a one\nAC\nGT\n>b\nTT\n")
    for rows in (formats.read_fasta(spark, str(tmp_path / "r.fasta")), formats.fasta(lines.read_lines(spark, str(tmp_path / "r.fasta")))):
        assert sorted((r.name, r.seq) for r in rows.select("name", "seq").collect()) == [("a", "ACGT"), ("b", "TT")]
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.0\nS\ta\tACGT\tDP:f:3.5\nS\tb\tACGTACGT\tRC:i:16\nS\tc\t*\nL\ta\t+\tb\t-\t2M\nL\tb\t+\ta\t-\t2M\n")
    text = lines.read_lines(spark, str(tmp_path / "g.gfa"))
    assert {r.name: r.depth for r in formats.gfa_segments(text).collect()} == {"a": 3.5, "b": 2.0, "c": None}
    assert [tuple(r)[:4] for r in formats.gfa_links(text, formats.gfa_segments(text)).collect()] == [("a", 1, "b", 1)] or formats.gfa_links(text).count() == 2
    with pytest.raises(ValueError):
        formats.gfa_links(text, formats.gfa_segments(text).where("name <> 'a'"))


def test_sam_rules(spark):
    base = ["60", "10M", "*", "0", "0", "*", "*"]
    row = lambda name, flag, cig, *tags: "\t".join([name, str(flag), "c", "1", "60", cig, *base[2:], *tags])
    text = ["@HD\tx", row("ok", 0, "2S8M1D2M3S"), row("unmapped", 4, "10M"), row("secondary", 256, "10M"), row("supp", 2048, "90H10M", "LN:i:100"), row("hard", 0, "30H70M", "LN:i:100"), row("rev", 16, "2S8M5S"), row("noisy", 0, "10M", "NM:i:3"), "short\t0"]
    lines_ = spark.createDataFrame([(t,) for t in text], "value string")
    got = {r.name: (r.qs, r.qe, r.ts, r.te, r.qlen) for r in formats.sam(lines_).collect()}
    assert got == {"ok": (2, 12, 0, 11, 15), "supp": (90, 100, 0, 10, 100), "rev": (5, 13, 0, 8, 15), "noisy": (0, 10, 0, 10, 10)}
    assert "noisy" not in {r.name for r in formats.sam(lines_, amplicon=True).collect()}


def test_col_and_gro_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([("c1", 100, 2.5), ("c2", 50, 1.0)], "contig string, len int, depth double")
    reads = spark.createDataFrame([(c, i, f"{c}r{i}", 0, 40) for c in ("c1", "c2") for i in range(3)], "contig string, read_idx int, name string, start int, end int")
    cells = spark.createDataFrame([("c1", 5, 0, "A", "A", "C"), ("c1", 5, 2, "C", "A", "C"), ("c2", 7, 1, "G", "G", "T")], "contig string, pos int, read_idx int, allele string, ref string, alt string")
    sinks.save(sinks.col_lines(contigs, reads, cells), str(tmp_path / "v.col"))
    got_reads, got = formats.col(lines.read_lines(spark, str(tmp_path / "v.col")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in cells.collect()}
    assert {(r.contig, r.read_idx, r.name) for r in got_reads.collect()} == {(r.contig, r.read_idx, r.name) for r in reads.collect()}
    groups = spark.createDataFrame([("c1", 0, 50, 0, 1), ("c1", 0, 50, 1, -2), ("c1", 50, 100, 2, 0)], "contig string, win_start int, win_end int, read_idx int, grp int")
    sinks.save(sinks.gro_lines(contigs, reads, groups), str(tmp_path / "g.gro"))
    assert {tuple(r) for r in formats.gro(lines.read_lines(spark, str(tmp_path / "g.gro")))[1].collect()} == {("c1", 0, 50, 0, 1), ("c1", 50, 100, 2, 0)}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = lines.read_lines(spark, str(path))
        assert got.select("block").distinct().count() > 1
        assert got.where(F.col("line_no") != F.col("value").cast("long")).count() == 0
        filled = lines.fill_down(got, F.col("value").cast("int") % 5000 == 10)
        assert {(r.section, r.n) for r in filled.groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()} == {(10, 5000), (5010, 5000), (10010, 5000), (15010, 4990)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_consensus_paths(spark):
    rows = [(r, i + 1, c, ">") for r, p in enumerate([(1, 2, 3), (1, 2, 3), (1, 2, 4), (1, 9, 9)]) for i, c in enumerate(p)]
    got = {(r.contig, r.orient): r.path for r in po.consensus_paths(spark.createDataFrame(rows, "read_idx int, idx long, contig int, orient string")).collect()}
    assert got[(1, ">")] == ">2>3"


STEPS = "read_idx long, idx long, contig long, orient string"


def steps_of(spark, *texts):
    return spark.createDataFrame([(r, i, int(step[1:]), step[0]) for r, text in enumerate(texts) for i, step in enumerate(text.split())], STEPS)


def texts_of(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.read_idx, r.idx)):
        found.setdefault(r.read_idx, []).append(f"{r.orient}{r.contig}")
    return {r: " ".join(s) for r, s in found.items()}


def test_straight_ends_of_paths_go(spark):
    # 1-2-3 is a line, 3 forks to 4 and 5, 4-6 is a line
    links = spark.createDataFrame([(1, 1, 2, 0), (2, 1, 3, 0), (3, 1, 4, 0), (3, 1, 5, 0), (4, 1, 6, 0)], "n1 long, e1 int, n2 long, e2 int")
    paths_ = steps_of(spark, ">1 >2 >3 >4 >6", "<6 <4 <3 <2 <1", ">1 >2 >3", ">3 >4", ">5", ">2 >9 >1")
    assert texts_of(po.trim_straight(paths_, links)) == {0: ">3 >4", 1: "<4 <3", 2: ">3", 3: ">3 >4", 4: ">5", 5: ">2 >9 >1"}


def test_path_edits(spark):
    paths_ = steps_of(spark, ">1 >2 >1", ">3 >4")
    edits = spark.createDataFrame([(0, 1, 2, 7), (1, 0, 9, 8)], "read_idx long, idx long, before long, after long")
    assert texts_of(po.replace_steps(paths_, edits)) == {0: ">1 >7 >1", 1: ">3 >4"}
    assert texts_of(po.cancel(paths_, spark.createDataFrame([(1,), (4,)], "contig long"))) == {0: ">None >2 >1", 1: ">3 >None"}


def test_reads_between_unique_contigs(spark):
    rng = random.Random(3)
    walk = lambda n: [(rng.choice("<>"), rng.randrange(4)) for _ in range(n)]
    reads, segs = [walk(rng.randrange(1, 7)) for _ in range(150)], [walk(rng.randrange(1, 5)) for _ in range(12)]
    copies = {0: 1, 1: 2, 2: 1, 3: 1}
    expected = set()
    for r, p in enumerate(reads):
        for k, s in enumerate(segs):
            for way in (s, [("<" if o == ">" else ">", c) for o, c in reversed(s)]):
                for shift in range(-len(way) + 1, len(p)):
                    at = range(max(0, shift), min(len(p), shift + len(way)))
                    if any(p[i] != way[i - shift] for i in at):
                        continue
                    unique = [i for i in at if copies[p[i][1]] == 1]
                    if unique:
                        low = unique[0] if unique[0] == at[0] else unique[0] + 1
                        expected |= {(k, p[i][1], r) for i in range(low, unique[-1] + 1)}
    paths_ = steps_of(spark, *[" ".join(f"{o}{c}" for o, c in p) for p in reads])
    segments = steps_of(spark, *[" ".join(f"{o}{c}" for o, c in s) for s in segs]).withColumnRenamed("read_idx", "seg_id")
    got = po.reads_between_unique(paths_, segments, spark.createDataFrame([*copies.items()], "contig long, copies int"))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_full_overlaps(spark):
    f = lambda *v: po.full_overlap(*map(F.lit, v))
    row = one(spark, a=f(1, 0, 100, 100, 500, 600, 600), b=f(1, 400, 500, 1000, 400, 500, 1000), c=f(0, 0, 100, 500, 0, 100, 500), d=f(0, 0, 100, 500, 300, 400, 1000))
    assert (row.a, row.b, row.c, row.d) == (True, False, True, False)


def test_split_reads_overlap_no_more(spark):
    overlaps = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 9), (1, 4)], "r1 long, r2 long")
    groups = spark.createDataFrame([("b", 1, 0), ("b", 2, 0), ("b", 3, 1), ("c", 3, 1), ("c", 2, 1), ("b", 4, -1)], "contig string, read_idx long, grp int")
    assert sorted(map(tuple, po.drop_split_overlaps(overlaps, groups).collect())) == [(1, 2), (1, 4), (4, 9)]


def test_regions_of_planted_columns():
    rng = np.random.default_rng(5)
    first, second = np.arange(20) % 2, np.arange(20) // 10
    matrix = np.column_stack([*[first] * 8, *[second] * 8, *[rng.integers(0, 2, 20) for _ in range(4)]])
    found = [(cols.tolist(), None if ones is None else ones.astype(int).tolist()) for cols, ones in bicluster.regions(matrix)]
    assert found == [(list(range(8)), first.tolist()), (list(range(8, 16)), second.tolist())]
    small = bicluster.regions(matrix[:, :10])
    assert len(small) == 1 and small[0][1] is None


def test_block_of_ones_is_found():
    matrix = np.zeros((12, 9), int)
    matrix[np.ix_([1, 2, 5, 7, 8, 9], [0, 3, 4, 6])] = 1
    rows, cols = bicluster.quasi_biclique(matrix)
    assert (rows.tolist(), cols.tolist()) == ([1, 2, 5, 7, 8, 9], [0, 3, 4, 6])


def test_gzipped_fastq_as_fasta(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@a x\nACGT\n+\n@III\n@b\nTT\n+\nII\n")
    out = lines.fastq_to_fasta(lines.read_lines(spark, str(tmp_path / "r.fastq.gz"))).orderBy("line_no")
    assert [r.value for r in out.collect()] == [">a x", "ACGT", ">b", "TT"]


def crowded(spark):
    """Cells of two contigs: some reads far apart by id, one column with an unknown value, one read alone."""
    dice = random.Random(5)
    reads = [*range(40), 511, 512, 513, 5000, -3]
    rows = [(c, p * 7, r, dice.choice((0, 1, 1))) for c in ("x", "y") for p in range(30) for r in dice.sample(reads, 12)]
    return spark.createDataFrame([*rows, ("x", 999, 7, 1), ("x", 7, 9999, None)], "contig string, pos long, read_idx long, is_ref int")


def test_pairs_are_counted_without_a_join_of_columns(spark):
    cells = crowded(spark)
    found = contingency.similarity_difference(cells)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    cells.createOrReplaceTempView("crowded")
    plain = spark.sql("""select a.contig, a.read_idx as r1, b.read_idx as r2, sum(case when a.is_ref = 0 and b.is_ref = 0 then 3 when a.is_ref = 1 and b.is_ref = 1 then 1 else 0 end) as sim,
        coalesce(sum(cast(a.is_ref <> b.is_ref as int)), 0) as diff from crowded a join crowded b on a.contig = b.contig and a.pos = b.pos and a.read_idx < b.read_idx group by all""")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []
    d = read_graph.distances(plain)
    assert sorted(map(tuple, read_graph.cell_distances(cells).collect())) == sorted(map(tuple, d.collect()))
    for error in (0.05, 0.3, 0.5):
        assert sorted(map(tuple, read_graph.cell_neighbours(cells, error=error).collect())) == sorted(map(tuple, read_graph.nearest_reads(d, error=error).collect()))
    edges = read_graph.nearest_reads(d, error=0.5)
    a, b = edges.toDF("contig", "r1", "m"), edges.toDF("contig", "m", "r2")
    ways = a.join(b, ["contig", "m"]).where("r1 <> r2").groupBy("contig", "r1", "r2").count()
    assert sorted(map(tuple, read_graph.strengthen(edges).collect())) == sorted(map(tuple, ways.collect())) != []


def test_pairs_need_no_more_room_than_given(monkeypatch):
    from skeinflow.operators import pairs

    entry = np.array([0, 1, 2, 600, 0, 2, 600, 1, 2, 0])
    block = pairs.Block(0, np.array([10, 20, 25]), np.array([4, 3, 3]), entry, np.ones(10, int))
    whole = sorted((int(a), int(b)) for left, right in block.pairs(0, 3) for a, b in zip(left, right))
    monkeypatch.setattr(pairs, "ROOM", 4)
    cut = [len(left) for a, b in block.runs(4) for left, _ in block.pairs(a, b)]
    assert max(cut) <= 4 and len(cut) > 3 and sum(cut) == len(whole)
    assert sorted((int(x), int(y)) for a, b in block.runs(4) for left, right in block.pairs(a, b) for x, y in zip(left, right)) == whole


def test_clusters_clash_at_spaced_sites_without_a_join(spark):
    dice = random.Random(6)
    rows = [("x", int(label), p, dice.choice((-1, 0, 1))) for p in range(0, 200, 4) for label in dice.sample([1, 2, 3, 700, 701], 4)]
    found = read_graph.incompatible(spark.createDataFrame(rows, "contig string, label long, pos long, base int"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    at = {(label, p): base for _, label, p, base in rows if base >= 0}
    want = {}
    for c1 in (1, 2, 3, 700, 701):
        for c2 in (c for c in (1, 2, 3, 700, 701) if c > c1):
            last = None
            for p in range(0, 200, 4):
                if (c1, p) in at and (c2, p) in at and at[c1, p] != at[c2, p] and (last is None or p - last > 10):
                    want["x", c1, c2] = want.get(("x", c1, c2), 0) + 1
                    last = p
    assert {tuple(r)[:3]: r.n for r in found.collect()} == want


def test_alignments_beyond_the_length_leave_no_tail(spark):
    aln = spark.createDataFrame([(1, 100, 200), (1, 4000, 4100), (2, 10, 20)], "read_idx long, qs long, qe long")
    lengths = spark.createDataFrame([(1, 2500), (2, 2500), (3, 2500)], "read_idx long, len long")
    found = windows.unaligned_gaps(aln, lengths, least=100)
    assert sorted(map(tuple, found.collect())) == [(1, 200, 4000), (2, 20, 2500), (3, 0, 2500)]


def test_many_like_rows_are_compared_once():
    """Squares of these rows would take hundreds of GB, or steps for hours."""
    dice = np.random.default_rng(3)
    kinds = np.array([[1, 1, 1, np.nan], [0, 0, np.nan, 0], [1, np.nan, 1, 1], [0, 0, 0, 0], [1, 1, 1, 1]])
    at = dice.integers(0, len(kinds), 200_000)
    whole = bicluster.impute(kinds[at])
    assert (whole == np.array([[1] * 4, [0] * 4, [1] * 4, [0] * 4, [1] * 4])[at]).all()
    label = bicluster.complete_linkage(whole, 0.5)
    ones = whole[:, 0] == 1
    assert (label[ones] == np.argmax(ones)).all() and (label[~ones] == np.argmax(~ones)).all()
    rows, cols = bicluster.quasi_biclique((whole == 1).astype(int))
    assert np.isin(np.flatnonzero(ones), rows).all() and whole[rows].mean() >= 1 - 0.025 and len(cols) == 4
    assert len(np.unique(bicluster.separate(whole))) == 2


@pytest.mark.parametrize("clusters, want", [(1, [0, 0, 0, 0, 0]), (2, [0, 1, 0, 1, 0]), (3, [0, 1, 0, 3, 0]), (4, [0, 1, 0, 3, 4])])
def test_like_rows_stay_apart_for_the_least_clusters(clusters, want):
    rows = np.array([[1, 1], [0, 0], [1, 1], [0, 0], [1, 1]])
    assert bicluster.complete_linkage(rows, 1.0, clusters=clusters).tolist() == want


def test_chi_square_of_many_reads():
    n = np.array([5, 48_000, 3_000_000])
    assert partitions._chi(n, n * 0, n * 0, n).tolist() == (2 * n).tolist()


def test_live_partitions_hold_only_the_reads_within_reach():
    dice = np.random.default_rng(4)
    names, live, width = np.arange(40_000), [], []
    columns = [(k * 20, np.arange(k * 10, k * 10 + 30), dice.random(30) < 0.5) for k in range(3900)]
    begin = partitions._Open.begin

    def watch(self, *args):
        begin(self, *args)
        width.append(self.state.shape)

    partitions._Open.begin = watch
    try:
        found = partitions.grown(columns, names, reach=400)
    finally:
        partitions._Open.begin = begin
    assert max(w[1] for w in width) <= 1024 and max(w[0] for w in width) <= 64
    assert sum(p.columns for p in found) == 3900 and all((np.diff(p.reads) > 0).all() for p in found)


def test_long_alignments_become_cells_without_windows(spark):
    n = 300_000
    reads = spark.createDataFrame([(0, "ACGT" * (n // 4)), (1, "ACG"), (2, "ACCN")], "read_idx int, seq string")
    contigs = spark.createDataFrame([(9, "ACGT" * (n // 4) + "A")], "contig_id int, seq string")
    aln = spark.createDataFrame([(0, 9, 0, True, f"{n}M"), (1, 9, n - 2, True, "1I2M4M"), (2, 9, 0, False, "4M")], "read_idx int, contig_id int, start int, strand boolean, cigar string")
    rows = pileup.build_pileup(aln, reads, contigs)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.where("read_idx = 0").agg(F.count("*"), F.max("pos"), F.count_if("mismatch")).first() == (n, n - 1, 0)
    # an inserted A, then C, G, and nothing where the read has ended; the other way round, NGGT
    got = [tuple(r) for r in rows.where("read_idx > 0").select("read_idx", "pos", "symbol", "mismatch").orderBy("read_idx", "pos").collect()]
    code = lambda b2, b1, b: 33 + 5 * b2 + b1 + 25 * b
    assert got == [(1, n - 2, code(2, 0, 1), True), (1, n - 1, code(0, 1, 2), True), (1, n, code(1, 2, 0), True),
        (2, 0, code(1, 2, -1), True), (2, 1, code(2, -1, 2), True), (2, 2, code(-1, 2, 2), False), (2, 3, code(2, 2, 3), False)]


def test_few_sequences_go_to_the_steps(spark):
    steps = spark.range(20_000).select((F.col("id") % 5000).alias("seg_id"), F.col("id").alias("idx"), (F.col("id") % 7).alias("contig"), F.when(F.col("id") % 2 == 0, ">").otherwise("<").alias("orient"))
    contigs = spark.range(7).select(F.col("id").alias("contig"), F.expr("repeat('AC', int(id) + 200000)").alias("seq"))
    found = sinks.segment_sequences(steps.where("idx < 20"), contigs)
    assert "strategy=broadcast" in found._jdf.queryExecution().analyzed().toString()
    row = found.where("seg_id = 1").first()
    assert row.seq == "GT" * 200_001


def test_layouts_of_many_groups_share_a_batch(spark):
    ways = spark.createDataFrame([(g, a, b, 10 * a, b) for g in range(3) for a, b in ((0, 1), (1, 2), (0, 2 + g), (2, 3))], "group int, left int, right int, shift int, overlap int")
    found = kernels.layout(ways)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {0: [0, 2, 3], 1: [0, 3], 2: [0, 4]}
    rows = sorted(map(tuple, found.collect()))
    assert {g: [r[2] for r in rows if r[0] == g] for g in range(3)} == want and rows[2] == (0, 2, 3, 20)


def test_tiles_of_long_contigs_are_made_where_intervals_are(spark):
    lengths = spark.createDataFrame([("x", 950), ("y", 40), ("z", 880), ("w", 10**11)], "contig string, len long")
    dice = random.Random(8)
    rows = [(c, a, a + dice.choice((0, 1, 30, 500, 900)), k) for k in range(60) for c, most in (("x", 1000), ("y", 60), ("z", 900)) for a in [dice.randrange(most)]]
    aln = spark.createDataFrame([*rows, ("w", 10**10, 10**10 + 500, 99)], "contig string, start_c long, end_c long, k int")
    few = lengths.where("contig <> 'w'")
    want = windows.clipped(windows.tiles(few, 400), aln, bin_size=256).select("contig", "win", "k", "start_c", "overlap").collect()
    found = [tuple(r) for r in windows.clipped_by_tiles(lengths, 400, aln).select("contig", "win", "k", "start_c", "overlap").collect()]
    assert sorted(r for r in found if r[0] != "w") == sorted(map(tuple, want)) != []
    assert sorted(r[1:] for r in found if r[0] == "w") == [(25_000_000, 99, 10**10, 400), (25_000_001, 99, 10**10, 100)]


def test_runs_are_joined_without_expansion(spark):
    for text, want in (("3M0D2M1I", "5M1I"), ("0S", ""), ("*", ""), ("1M1M1M", "3M"), ("3S4=1X2D2I6M7S", "3S4=1X2D2I6M7S"), ("2000000000D0I2000000000D", "4000000000D")):
        assert one(spark, c=cigar.joined(F.lit(text))).c == want
    assert one(spark, c=cigar.joined(F.lit(None).cast("string"))).c is None


def test_minimizers_are_those_of_sparks_hash(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 14, 15, 24, 25, 90)] + ["äé✓𝄞AC" * 8, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for k, w in ((15, 10), (3, 4), (8, 1), (40, 3), (4, 2)):
        h = F.transform(F.sequence(F.lit(1), F.length("t") - k + 1), lambda i: F.xxhash64(F.substring("t", i, F.lit(k))))
        own = {r.i: r.h for r in df.where(F.length("t") >= k).select("i", h.alias("h")).collect()}
        want = {i: list(dict.fromkeys(min(v[j : j + w]) for j in range(max(len(v) - w + 1, 1)))) for i, v in own.items()}
        assert {r.i: r.m for r in df.select("i", seq.minimizers(F.col("t"), k, w).alias("m")).collect()} == {i: want.get(i, []) for i in range(len(texts))}
    long = "".join(rng.choice("ACGT") for _ in range(300))
    whole = seq._minimizers(long, 15, 10).tolist()
    monkeypatch.setattr(seq, "PIECE", 7)
    assert seq._minimizers(long, 15, 10).tolist() == whole
    assert "ArrowEvalPython" in df.select(seq.minimizers(F.col("t"), 15, 10))._jdf.queryExecution().executedPlan().toString()  # not a lambda for each window


def test_lines_of_one_split_are_filled_in_runs(spark, monkeypatch):
    monkeypatch.setattr(lines, "RUN", 3)
    heads = (2, 3, 11)
    rows = spark.range(20).select(F.lit("f").alias("file"), F.lit(0).alias("block"), F.col("id").alias("line_no"), F.when(F.col("id").isin(*heads), ">").otherwise("x").alias("value"))
    filled = lines.fill_down(rows, F.col("value") == ">")
    assert filled.columns == ["file", "block", "line_no", "value", "section"]
    assert {r.line_no: r.section for r in filled.collect()} == {k: max(h for h in heads if h <= k) for k in range(2, 20)}


def test_bridges_that_are_alone_go_before_the_next_sort(spark):
    rng = random.Random(5)
    rows = [(r, 1, 1, 1, rng.randrange(4000), 2, 1, rng.randrange(4000), rng.randrange(3000)) for r in range(60)]
    df = spark.createDataFrame(rows, "read_idx long, ord long, contig1 long, strand1 int, pos1 long, contig2 long, strand2 int, pos2 long, gap long")

    def cut(group, at, bound):
        parts, last = {}, None
        for k, x in enumerate(sorted(group, key=lambda x: x[at])):
            n = len(parts) + (k == 0 or x[at] - last > bound)
            parts.setdefault(n, []).append(x)
            last = x[at]
        return parts

    want = []
    for a, g in cut(rows, 4, 40).items():
        for b, h in cut(g, 7, 400).items():
            for c, m in cut(h, 8, 400).items():
                want.append((f"{a}.{b}.{c}", len(m), *(sum(x[k] for x in m) // len(m) for k in (4, 7, 8))))
    sessions = lambda least: st.solid_bridges(df.withColumn("pos1", F.col("pos1") * 10), least=least, near=400, gap_near=400)
    for least in (1, 2):
        got = sorted((r.session, r.n, r.pos1 // 10, r.pos2, r.gap) for r in sessions(least).collect())
        assert got == sorted(w for w in want if w[1] >= least)
    assert "_next" in sessions(2)._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def counted(spark):
    """A column as it is, and how many rows it was told for."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    return F.udf(look, "long").asNondeterministic(), seen


def test_consensus_paths_read_the_paths_once_for_all_rounds(spark, counted):
    look, seen = counted
    ways = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 6], 3: [1, 2, 3, 4, 5], 4: [9, 2, 7], 5: [9, None, 1]}
    rows = [(r, i, c, ">") for r, way in ways.items() for i, c in enumerate(way, 1)]
    rows += [(6, 1, 8, ">"), (6, 3, 5, ">"), (None, 1, 8, ">"), (None, 2, 5, ">")]  # a gap; steps of no path
    df = spark.createDataFrame(rows, "read_idx long, idx long, contig long, orient string").withColumn("idx", look("idx"))
    got = {r.contig: (r.steps, r.path) for r in po.consensus_paths(df).collect()}
    assert got[1] == (4, ">2>3>4>5") and got[2] == (3, ">3>4>5") and got[3] == (2, ">4>5") and got[4] == (1, ">5")
    assert got[5] == got[6] == got[7] == got[8] == got[9] == got[None] == (0, "")
    assert seen.value <= 2 * len(rows)


def test_barcodes_go_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(ag, "SELF", 2)
    rows = [(b, c) for b in range(6) for c in (b % 3, b % 3, 5)] + [(1, None), (None, 5)]
    got = ag.barcode_contacts(spark.createDataFrame(rows, "barcode long, contig long"))
    n = {}
    for b, c in rows:
        for b2, c2 in rows:
            if b is not None and b == b2:
                n[c, c2] = n.get((c, c2), 0) + 1
    assert {(r.i, r.j): r.n for r in got.collect()} == n
    assert ", 10)" in got._jdf.queryExecution().executedPlan().toString()


def test_sinkhorn_makes_its_matrix_once(spark, counted):
    look, seen = counted
    rows = spark.createDataFrame([(i, j, float(1 + (i * j) % 5)) for i in range(4) for j in range(4)], "i long, j long, v double")
    got = {(r.i, r.j): r.v for r in ag.sinkhorn(rows.withColumn("i", look("i")), rounds=3).collect()}
    v = np.array([[1.0 + (i * j) % 5 for j in range(4)] for i in range(4)])
    for k in range(7):
        v = v / v.sum(1 - k % 2, keepdims=True)
    assert all(abs(v[i, j] - x) < 1e-9 for (i, j), x in got.items()) and len(got) == 16
    assert seen.value == 16


@pytest.fixture
def planned(monkeypatch):
    """The plans of all that is checkpointed."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, real = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: (plans.append(self._jdf.queryExecution().executedPlan().toString()), real(self, eager))[1])
    return plans


def test_loops_over_a_graph_broadcast_nothing(spark, planned):
    chain = spark.createDataFrame([(k, 1, k + 1, 0) for k in range(6)] + [(2, 1, 7, 0)], "n1 long, e1 int, n2 long, e2 int")
    contigs = spark.createDataFrame([(k, 10, 30.0 * (1 + (k == 7))) for k in range(8)], "contig long, len long, depth double")
    copies = {r.contig: r.copies for r in ag.multiplicity(contigs, chain, 30.0).collect()}
    assert copies == {0: 1, 1: 1, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}
    starts = spark.createDataFrame([(0, 1)], "start long, end int")
    found = {tuple(r.path): r.inner for r in po.reach(chain, starts, contigs, most=20).collect()}
    assert found == {(0, 1): 0, (0, 1, 2): 10, (0, 1, 2, 3): 20, (0, 1, 2, 7): 20}
    loops = [p for p in planned if "Join" in p]
    assert loops and not any("Broadcast" in p for p in loops)


def test_lays_go_to_as_many_tasks_as_they_need(spark, monkeypatch):
    rows = [(r, k + 1, c, ">") for r in range(6) for k, c in enumerate((10 + r, 20, 30))]
    paths_ = spark.createDataFrame(rows, "read_idx long, idx long, contig long, orient string")
    segments = spark.createDataFrame([(1, 0, 20, ">"), (1, 1, 30, ">")], "seg_id long, idx int, contig long, orient string")
    copies = paths_.select("contig").distinct().withColumn("copies", F.when(F.col("contig") == 20, 2).otherwise(1))
    whole = sorted(map(tuple, po.reads_between_unique(paths_, segments, copies).collect()))
    monkeypatch.setattr(po, "SORTED", 2)
    got = po.reads_between_unique(paths_, segments, copies)
    assert sorted(map(tuple, got.collect())) == whole
    assert ", 9)" in got._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_told_apart_before_they_are_turned(spark):
    rng = random.Random(2)
    cells = [(1, p, r, (r % 2) ^ (rng.random() < 0.05)) for p in range(20) for r in range(600) if rng.random() < 0.7]
    got = read_graph.cell_neighbours(spark.createDataFrame(cells, "contig int, pos int, read_idx long, is_ref int"), error=0.05)
    pairs_ = [(r.r1, r.r2) for r in got.collect()]
    assert len(set(pairs_)) == len(pairs_) and {(b, a) for a, b in pairs_} == set(pairs_)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(array(") < plan.index("Aggregate")

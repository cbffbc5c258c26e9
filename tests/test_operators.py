"""Operators against brute force on small and odd inputs, with tiny slices so that what is carried between them shows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs
from stratalane.functions import statistics as stats
from stratalane.operators import annotation, bins, graphs, ids, intervals, matrices, reads, sampling
from stratalane.sources import readers, writers
from stratalane.streaming import windows

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SPANS = st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 6000), st.sampled_from([0, 1, 7, 300, 5000, 40_000])), max_size=25)


def table(spark, rows):
    return spark.createDataFrame([(c, s, s + n, i) for i, (c, s, n) in enumerate(rows)], "chrom int, s long, e long, id long")


@SLOW
@given(a=SPANS, b=SPANS, k=st.sampled_from([1, 20, 0, -100]))
def test_overlap_join(spark, a, b, k):
    found = intervals.overlap_join(table(spark, a), table(spark, b), k=k).select("id1", "id2", "v").collect()
    want = [(i, j, v) for i, (c, s, n) in enumerate(a) for j, (d, t, m) in enumerate(b) if c == d and (v := min(s + n, t + m) - max(s, t) + 1) >= k]
    assert sorted(map(tuple, found)) == sorted(want)


@SLOW
@given(a=SPANS, b=SPANS, percent=st.sampled_from([50, -85, -10]))
def test_overlap_share(spark, a, b, percent):
    found = intervals.overlap_join(table(spark, a), table(spark, b), percent=percent).select("id1", "id2").collect()
    pick = max if percent > 0 else min
    want = [(i, j) for i, (c, s, n) in enumerate(a) for j, (d, t, m) in enumerate(b) if c == d and min(s + n, t + m) - max(s, t) + 1 >= abs(percent) * pick(n + 1, m + 1) // 100]
    assert sorted(map(tuple, found)) == sorted(want)


@SLOW
@given(rows=SPANS, gap=st.sampled_from([0, 40]), width=st.sampled_from([100, 1 << 16]))
def test_union_and_coverage(spark, rows, gap, width):
    found = intervals.merged(table(spark, rows), gap=gap, width=width).select("chrom", "s", "e", "n").collect()
    want = []
    for c, s, e in sorted((c, s, s + n) for c, s, n in rows):
        if want and want[-1][0] == c and s <= want[-1][2] + gap:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((c, s, e, 1))
    assert sorted(map(tuple, found)) == want
    depth = intervals.coverage(table(spark, rows), width=width).collect()
    assert sum((r.e - r.s) * r.depth for r in depth) == sum(n for _, _, n in rows)


@pytest.mark.parametrize("reverse", [False, True])
def test_running_carries_between_slices(spark, reverse):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(-500, 500), i, rng.choice([None, rng.randrange(99)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, p int, i int, v int")
    found = intervals.running(df, ["g"], ("p", "i"), {"a": ("max", "v"), "b": ("min", "v"), "c": ("sum", "v"), "d": ("lag", "i")}, reverse, width=37)
    got = {r.i: (r.a, r.b, r.c, r.d) for r in found.collect()}
    for g in (0, 1):
        line = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3], reverse=reverse)
        for k, r in enumerate(line):
            before = [x[3] for x in line[:k] if x[3] is not None]
            assert got[r[2]] == (max(before, default=None), min(before, default=None), sum(before), line[k - 1][2] if k else None)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graphs.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == 100


def test_ids_with_case_blanks_and_nulls(spark):
    df = spark.createDataFrame([(" A ", 1), ("b", 2), (None, 3), ("a;C", 4), ("C;d", 5), ("A", 1)], "k string, n int")
    wanted = spark.createDataFrame([("a",), ("c ",), (None,)], "id string")
    rows = lambda d: sorted(r.n for r in d.collect())
    assert rows(ids.by_ids(df, "k", wanted, "id")) == [1, 1]
    assert rows(ids.by_ids(df, "k", wanted, "id", anti=True)) == [2, 3, 4, 5]
    assert rows(ids.by_ids(df, "k", wanted, "id", sep=";")) == [1, 1, 4, 5]
    assert rows(ids.by_ids(df, "k", wanted, "id", sep=";", anti=True, any_absent=True)) == [2, 5]
    assert rows(ids.by_ids(df, "k", wanted, "id", case=True)) == []
    with pytest.raises(ValueError):
        ids.assert_unique(df.select(ids.key_of("k").alias("k")), "k")
    with pytest.raises(ValueError):
        ids.columns_by_ids(df, ["none"])


def test_matrix_bands(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [5.0, 9.0]), (3, [])], "r int, v array<double>")
    rows = lambda **band: [r.r for r in matrices.filter_rows(df, "v", 1, **band).collect()]
    assert rows(above=1.0, below=6.0) == [1, 2] and rows(above=8.0, below=2.0) == [1, 2] and rows(above=9.0) == [] and rows(above=9.0, or_equal=True) == [2]


def test_sequences(spark):
    df = spark.createDataFrame([("ATGGCCTAA", "IIIIIIIII"), ("acgtN", "II#II"), ("", "")], "seq string, qual string")
    got = df.select(seqs.translated("seq"), seqs.reverse_complement(seqs.reverse_complement("seq")), seqs.kept_length("qual"), seqs.longest_orf("seq"), seqs.wrapped("seq", 4), seqs.rotated("seq", 3)).collect()
    assert [r[0] for r in got] == ["MA*", "T", ""] and [r[1] for r in got] == ["ATGGCCTAA", "acgtN", ""]
    assert [r[2] for r in got] == [9, 2, 0] and got[0][3] == 2 and got[0][4] == "ATGG\nCCTA\nA" and got[0][5] == "GGCCTAAAT"
    change = spark.createDataFrame([("ATGGCC", "ATGGCA"), ("ATGGCC", "ATGGC"), ("ATGCAA", "ATGTAA"), ("ATGTAA", "ATGCAA"), ("ATGGCC", "ATGACC")], "a string, b string")
    assert [r[0] for r in change.select(seqs.coding_change("a", "b")).collect()] == ["synonymous", "frameshift", "stop_gained", "stop_lost", "missense"]
    pieces = spark.createDataFrame([("ACGNNNNTTNA",)], "s string").select(seqs.gap_pieces("s").alias("x")).first().x
    assert [tuple(p) for p in pieces] == [(1, "ACG"), (8, "TT"), (11, "A")]


def test_approximate_search(spark):
    df = spark.createDataFrame([("ttACGTTTtt",), ("ACGAT",), ("gggg",), (None,)], "seq string")
    found = lambda **k: [r.seq for r in reads.containing(df, "ACGTT", **k).collect()]
    assert found() == ["ttACGTTTtt"] and found(edits=1) == ["ttACGTTTtt", "ACGAT"] and found(edits=1, without=True) == ["gggg", None][: len(found(edits=1, without=True))]


def test_enrichment_tail_is_exact(spark):
    from math import comb

    rows = [("a", "b", x, y, n, k) for n in (20, 400) for x in (3, 15) for y in (5, 19) for k in range(min(x, y) + 1)]
    df = spark.createDataFrame(rows, "a string, b string, size_a long, size_b long, total long, overlap long")
    for r in stats.odds_ratio(stats.enrichment(df)).collect():
        want = sum(comb(r.size_a, i) * comb(r.total - r.size_a, r.size_b - i) for i in range(r.overlap, min(r.size_a, r.size_b) + 1) if r.size_b - i <= r.total - r.size_a) / comb(r.total, r.size_b)
        assert r.p == pytest.approx(want, rel=1e-9)


def test_relocation_stays_inside(spark):
    rows = spark.createDataFrame([(1, 0, n, n) for n in (5, 50, 500)] * 20, "chrom int, s long, e long, id long").withColumn("id", F.monotonically_increasing_id())
    regions = spark.createDataFrame([(1, 100), (2, 60)], "chrom int, size long")
    moved = sampling.relocated(rows, regions, 3).collect()
    assert len(moved) == 40 and all(0 < r.s and r.e < {1: 100, 2: 60}[r.chrom] for r in moved) and {r.chrom for r in moved} == {1, 2}


def test_permutations_against_relocation(spark):
    """Rounds as placed one by one; ids twice, features that fit nowhere, and reference islands over many bins."""
    rng = random.Random(5)
    test = [(rng.randrange(3), s := rng.randrange(9000), s + rng.choice([0, 40, 3000, 20_000]), i // 2 if i < 20 else i) for i in range(60)]
    ref = [(rng.randrange(3), s := rng.randrange(9000), s + rng.choice([0, 30, 2500])) for _ in range(12)]
    sizes = spark.createDataFrame([(0, 9000), (1, 50), (2, 7000)], "chrom int, size long")
    tests, refs = spark.createDataFrame(test, "chrom int, s long, e long, id long"), spark.createDataFrame(ref, "chrom int, s long, e long")
    found = {r["round"]: (r.placed, r.overlapping) for r in sampling.permutation_overlaps(tests, refs, sizes, rounds=25).collect()}
    hit = lambda rows: len({i for c, s, e, i in rows if any(c == d and s <= y and e >= x for d, x, y in ref)})
    placed = {n: [(r.chrom, r.s, r.e, r.id) for r in sampling.relocated(tests, sizes, F.lit(n)).collect()] for n in (1, 2, 3, 24, 25)}
    assert set(found) == set(range(26)) and found[0] == (60, hit(test))
    assert {n: found[n] for n in placed} == {n: (len(x), hit(x)) for n, x in placed.items()}


def test_permutation_query_has_the_rounds_of_the_reference(spark):
    from stratalane.plans import catalog
    from tests.conftest import SF

    catalog.load_all()
    rounds = [r["round"] for r in catalog.QUERIES["permutation_overlaps"](spark, SF).collect()]
    assert sorted(rounds) == list(range(1001))


def test_readers_and_writers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    bed = readers.bed(spark, put("a.bed", "track x\nchr1\t10\t50\tn\t0\t-\t10\t50\t0\t2\t10,5,\t0,35,\n\n# c\nchr2\t1\t2\n")).collect()
    assert [r.block_sizes for r in bed] == [[10, 5], None] and bed[1].chrom == "chr2"
    gff = readers.gff(spark, put("a.gtf", 'c\ts\texon\t9\t5\t.\t1\t.\tgene_id "g;1"; tag "x"; tag "y"; n 3;\n')).first()
    assert (gff.start, gff.end, gff.strand, gff.score) == (5, 9, "+", None) and [tuple(x) for x in gff.bag] == [("gene_id", "g;1"), ("tag", "x"), ("tag", "y"), ("n", "3")]
    fasta = readers.fasta(spark, put("a.fa", ">one first\nACG\nT\n>two\r\nGG\r\n")).collect()
    assert [tuple(r) for r in fasta] == [("one", "first", "ACGT"), ("two", "", "GG")]
    fastq = readers.fastq(spark, put("a.fq", "@r1\nACGT\n+\n@III\n@r2 x\nAC\nGT\n+r2\nII\nII\n")).collect()
    assert [tuple(r) for r in fastq] == [("r1", "ACGT", "@III", 0), ("r2 x", "ACGT", "IIII", 1)]
    wig = readers.wig(spark, put("a.wig", "fixedStep chrom=c start=10 step=5\n1\n2\nvariableStep chrom=d span=3\n7 1.5 2\n")).collect()
    assert sorted((r.chrom, r.pos, r.span, r.v, r.v2) for r in wig) == [("c", 10, 1, 1.0, None), ("c", 15, 1, 2.0, None), ("d", 7, 3, 1.5, 2.0)]
    assert readers.table(spark, put("t.tsv", "#Id\tName\n1\ta\n2\t\n")).collect()[1].Name == ""
    vcf = readers.vcf(spark, put("a.vcf", "##x\n#CHROM\nc\t5\t.\tA\tC\t9\tPASS\t.\tGT\t0/1\t1|1\n")).first()
    assert vcf.pos == 5 and vcf.genotypes == ["0/1", "1|1"]
    assert readers.psl(spark, put("a.psl", "psLayout\n" + "\t".join(map(str, range(21))) + "\n")).first().tend == 16
    sets = readers.gene_sets(spark, put("a.gmt", "s\tx\ty\nt\tz\n"))
    assert sorted(map(tuple, sets.collect())) == [("s", "x"), ("s", "y"), ("t", "z")]
    df = spark.createDataFrame([("a b", 1), ("c/d", 2)], "k string, n int")
    writers.split_on(df, "k", str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("__to=*")) == ["__to=a_b", "__to=cd"]
    with pytest.raises(ValueError):
        writers.split_on(df, "k", str(tmp_path / "more"), most=1)
    chunks = writers.chunk_by_count(spark.range(10), "id", 4).collect()
    assert sorted((r.id, r.chunk) for r in chunks) == [(i, i // 4) for i in range(10)]
    writers.text(writers.fasta_lines(spark.createDataFrame(fasta), "id"), str(tmp_path / "fa"))
    assert sorted(tuple(r)[::2] for r in readers.fasta(spark, str(tmp_path / "fa")).collect()) == [("one", "ACGT"), ("two", "GG")]


def test_bed_rules(spark, tmp_path):
    rows = [("c", "5", "3", "n", "0", "+", None, None, None, None, None, None), ("c", "x", "3", "n", "0", "*", None, None, None, None, None, None), ("c", "0", "50", "n", "0", "+", "0", "50", "0", "2", "10,5", "0,45")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in readers.BED))
    assert sorted(r.problem for r in annotation.bed_violations(df).collect()) == ["start exceeds end", "start or end is no number", "unknown strand"]


def test_collapsed_transcripts(spark):
    rows = spark.createDataFrame([("a", "c", "+", 0, 10), ("a", "c", "+", 20, 30), ("b", "c", "+", 25, 40), ("d", "c", "+", 12, 15), ("e", "c", "-", 0, 10)], "tx string, chrom string, strand string, s long, e long")
    got = sorted((r.names, r.s, r.e, r.starts) for r in annotation.collapsed(annotation.transcripts(rows)).collect())
    assert [(n, s, x) for n, s, _, x in got] == [("a|b", 0, [0, 20]), ("d", 12, [12]), ("e", 0, [0])]


def test_streams_give_what_tables_give(spark, tmp_path):
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.tumbling_events(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable(), q.stop()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("hours").collect()) == key(windows.tumbling_events(events, "1 hour").collect())
    assert windows.sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == events.count()


def test_empty_tables(spark):
    none = table(spark, [(0, 1, 1)]).where("id < 0").withColumn("strand", F.lit("+"))
    assert intervals.merged(none).collect() == [] and intervals.coverage(none).collect() == [] and intervals.overlap_join(none, none).collect() == []
    track = none.select("chrom", F.col("s").alias("pos"), F.lit(1.0).alias("v"))
    assert bins.feature_bins(none, track, 100, 2, 2).collect() == [] and bins.tumbling(track, 10).collect() == []


def test_one_long_interval_among_short_ones(spark):
    """Short intervals don't meet in the bins of a long one: pairs looked at stay near those found."""
    rows = [(0, i * 1000, 300) for i in range(2000)] + [(0, 0, 2_000_000)]
    pairs = intervals.overlap_join(table(spark, rows), table(spark, rows))
    assert pairs.count() == 2000 + 2 * 2000 + 1


def test_sequences_are_put_together_from_chunks(spark):
    from stratalane.operators import genome

    text = "".join(random.Random(2).choice("ACGTN") for _ in range(500))
    bed = spark.createDataFrame([("c", 3, 480, "a", "+", [0, 100, 300], [90, 33, 177]), ("c", 0, 500, "b", "-", [0], [500]), ("c", 400, 501, "out", "+", [0], [101])], "chrom string, s long, e long, name string, strand string, starts array<long>, sizes array<long>")
    whole = spark.createDataFrame([("c", text)], "chrom string, seq string")
    found = {r.name: r.seq for r in genome.extracted(bed, whole, size=16).collect()}
    assert found == {"a": text[3:93] + text[103:136] + text[303:480], "b": text[::-1].translate(str.maketrans("ACGT", "TGCA"))}


def test_t_quantiles(spark):
    """Against the values of printed tables."""
    printed = {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 10: 2.2281, 30: 2.0423, 40: 2.0211, 120: 1.9799}
    for row in spark.createDataFrame([(k,) for k in printed], "k int").select("k", stats.t_limit(F.col("k")).alias("t")).collect():
        assert round(row.t, 4) == printed[row.k]
    assert abs(stats.t_quantile(31) - spark.range(1).select(stats.t_limit(F.lit(31))).first()[0]) < 1e-6


def _placed_plainly(probes, places):
    """The passes over one list, in memory: probes [(key, chrom, pos)], places key -> [(chrom, pos, strand)]."""
    new = {i: (*places[p[0]][0], 1.0) if len(places.get(p[0], ())) == 1 else ("Unknown", 0, "+", 0.0) for i, p in enumerate(probes) if len(places.get(p[0], ())) < 2}
    waiting = [i for i in range(len(probes)) if i not in new]
    for order in (list, lambda w: w[::-1]):
        for i in order(waiting):
            found = []
            for m in range(max(0, i - 10), min(len(probes), i + 10)):
                if m in new and new[m][0] != "Unknown" and new[m][0] == probes[i][1]:
                    apart = abs(probes[i][2] - probes[m][2])
                    found += [(abs(apart - abs(new[m][1] - pos)), len(found), (c, pos, strand)) for c, pos, strand in places[probes[i][0]] if c == new[m][0] and abs(new[m][1] - pos) <= apart + 200]
            if found:
                new[i] = (*min(found, key=lambda f: f[0])[2], 0.5)
        waiting = [i for i in waiting if i not in new]
    for i in waiting:
        own = [p for p in places[probes[i][0]] if p[0] == probes[i][1]]
        c, pos, strand = own[0] if own else places[probes[i][0]][0]
        for p in own:
            pos = p[1] if abs(p[1] - probes[i][2]) <= abs(pos - probes[i][2]) else pos
        new[i] = (c, pos, strand, 0.2)
    return new


@pytest.mark.parametrize("seed", range(3))
def test_placed_probes(spark, seed):
    from stratalane.operators import genome

    rng = random.Random(seed)
    probes = [(f"k{i}", rng.choice("AB"), i * 50) for i in range(150)]
    places = {k: [(rng.choice("AB"), rng.randrange(max(1, p - 300), p + 300), rng.choice("+-")) for _ in range(rng.choice([0, 1, 1, 1, 2, 3] if seed else [1] * 20 + [2]))] for k, _, p in probes}
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(probes)], "n long, key string, old_chrom string, old_pos long")
    hits = spark.createDataFrame([(k, j, *h) for k, found in places.items() for j, h in enumerate(found)], "key string, j int, chrom string, pos long, strand string")
    got = {r.n: (r.new_chrom, r.new_pos, r.new_strand, r.score) for r in genome.placed_probes(frame, hits).collect()}
    assert got == _placed_plainly(probes, places)

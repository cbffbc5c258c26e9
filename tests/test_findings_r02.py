"""Queries held against their SQL, and operators against plain walks, where the second round's findings saw them fail."""

import datetime
import math
import statistics

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, table_of

import __spark_entry__


def against_sql(spark, folder, name):
    """The query's rows over the tables in folder, held against its SQL."""
    db = duckdb.connect()
    for file in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = __spark_entry__.queries()[name](spark, str(folder))
    got, want = found.collect(), db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert table_of(found.columns, got) == table_of(columns, want.fetchall())
    return got


def orders(folder, rows):
    """orders of (key, customer, days after 1995)."""
    first = datetime.datetime(1995, 1, 1)
    keys, customers, days = zip(*rows)
    dates = pa.array([first + datetime.timedelta(d) for d in days], pa.timestamp("us"))
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array(customers, pa.int64()), "o_orderdate": dates}), folder / "orders.parquet")


@pytest.mark.parametrize("name", ["read_windows_overlapped", "read_windows_fractions", "read_windows_midpoints"])
def test_read_windows_from_position_zero(spark, tmp_path, name):
    """A read at place 0 and reads before it: (0 - 1) // 40 is window 0 in SQL."""
    orders(tmp_path, [(0, 0, 0), (100, 24, 0), (7, 24, 0), (301, 5, -1), (399, 6, -1), (11, 7, -9), (50, 7, 3)])
    assert against_sql(spark, tmp_path, name)


def shapes(n=300):
    """Features of all lengths, some longer than a tile, some crowded in one place, and a signal with several values a place."""
    import random

    draw = random.Random(5)
    feats = [(k, k % 2, "+-"[k % 3 == 0], at := draw.choice([10, 4090, draw.randrange(20000)]), at + draw.choice([1, 3, 200, 900, 4200, 9000])) for k in range(n)]
    points = [(c, draw.randrange(22000), draw.choice([None, 1.5, draw.random() * 99])) for c in (0, 1, 2) for _ in range(3000)]
    return feats, points


@pytest.mark.parametrize("measure", ["mean", "sum", "cov", "median", "nfr"])
def test_feature_bins_as_a_plain_walk(spark, monkeypatch, measure):
    from stratalane.operators import bins, tiles

    monkeypatch.setattr(tiles, "CROWD", 20)
    monkeypatch.setattr(tiles, "PAIRS", 500)
    feats, points = shapes()
    top = {}
    for c, p, v in points:
        old = top.get((c, p))
        top[c, p] = v if old is None else old if v is None else max(old, v)
    flank, n = 100, {"u": 4, "f": 5, "d": 4}
    want = {}
    for id, c, strand, s, e in feats:
        cells = {}
        for p in range(max(1, s - flank), e + flank):
            if (c, p) in top:
                before = p < s if strand == "+" else p >= e
                kind = "f" if s <= p < e else "u" if before else "d"
                if strand == "+":
                    rel = flank - (s - p) if kind == "u" else p - (s if kind == "f" else e)
                else:
                    rel = flank - (p - e) if kind == "u" else (e if kind == "f" else s) - p
                size = e - s if kind == "f" else flank
                bin = math.floor(rel / (size / n[kind]))
                if 0 <= bin < n[kind]:
                    cells.setdefault(f"{kind}{bin}", []).append((top[c, p], size / n[kind]))
        if cells:
            row = {}
            for name, pairs in cells.items():
                vs, width = sorted(v for v, _ in pairs if v is not None), pairs[0][1]
                if vs and (measure != "nfr" or len(vs) >= 10):
                    row[name] = {"mean": lambda: sum(vs) / len(vs), "sum": lambda: sum(vs), "cov": lambda: sum(vs) / width, "median": lambda: statistics.median(vs), "nfr": lambda: vs[math.ceil(len(vs) / 10) - 1]}[measure]()
            want[id] = row
    found = bins.feature_bins(spark.createDataFrame(feats, "id long, chrom long, strand string, s long, e long"), spark.createDataFrame(points, "chrom long, pos long, v double"), flank, 4, 5, measure)
    got = {r.id: r.asDict() for r in found.collect()}
    assert set(got) == set(want) and found.count() == len(want)
    for id, row in got.items():
        for name, v in row.items():
            if name != "id":
                other = want[id].get(name, 0 if measure in ("sum", "cov") else None)
                assert v == (None if other is None else pytest.approx(other, abs=2e-6)), (id, name)


def shuffled(df):
    """Names of what the plan of df sends through Python and of its joins."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["feature_bins_mean", "feature_bins_sum", "feature_bins_median", "feature_bins_tenth", "feature_bins_coverage", "feature_relative"])
def test_signal_is_not_shuffled_by_pairs(spark, name):
    """Pairs of features and places go through no exchange: none lies above the step that makes them."""
    plan = shuffled(__spark_entry__.queries()[name](spark, SF))
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_region_values_as_a_plain_walk(spark, monkeypatch):
    from stratalane.operators import genome, tiles

    monkeypatch.setattr(tiles, "PAIRS", 500)
    feats, points = shapes()
    top = {}
    for c, p, v in points:
        if v is not None:
            top[c, p] = max(top.get((c, p), v), v)
    want = {id: [top.get((c, p), 0) for p in range(s, e + 1)][:: -1 if strand == "-" else 1] for id, c, strand, s, e in feats}
    track = spark.createDataFrame(points, "chrom long, s long, v double").withColumn("e", F.col("s"))
    found = genome.region_values(spark.createDataFrame(feats, "id long, chrom long, strand string, s long, e long"), track).collect()
    assert {r.id: r["values"] for r in found} == want and len(found) == len(want)


def test_variants_annotated_as_a_plain_walk(spark):
    from stratalane.operators import variants

    feats, points = shapes(60)
    feats += [(1000 + id, c, strand, s, e) for id, c, strand, s, e in feats[:20]] + [(2000, 1, "+", 15000, 14990), (2001, 1, "-", 16000, 15990)]
    asked = [(k, c, p) for k, (c, p, _) in enumerate(points)]
    want = {}
    for k, c, p in asked:
        hits = []
        for id, chrom, strand, s, e in feats:
            a, z = (s - 500, e) if strand == "+" else (s, e + 500)
            if c == chrom and a <= p <= z:
                hits.append((0 if s <= p <= e else 1, s, id))
        best = min(hits, default=(None, None, None))
        want[k] = (best[2], {0: "gene", 1: "promoter"}.get(best[0]))
    genes = spark.createDataFrame(feats, "gene long, chrom long, strand string, s long, e long")
    found = variants.annotated(spark.createDataFrame(asked, "id long, chrom long, pos long"), genes)
    assert {r.id: (r.gene, r.place) for r in found.collect()} == want
    assert {"gene", "promoter", None} == {place for _, place in want.values()}


def test_region_values_are_not_shuffled_by_places(spark):
    plan = shuffled(__spark_entry__.queries()["region_values"](spark, SF))
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_variants_meet_one_gene_a_place(spark, tmp_path):
    """Two hundred genes over each other and many variants at one place: no join gives a row for each pair."""
    from stratalane.operators import variants

    genes = spark.range(200).select(F.col("id").alias("gene"), F.lit(1).alias("chrom"), F.lit("+").alias("strand"), (F.col("id") % 50 + 1000).alias("s"), (F.col("id") + 3000).alias("e"))
    assert variants._first_of(genes.select("chrom", "s", "e", F.col("s").alias("gs"), "gene")).agg(F.sum(F.col("e") - F.col("s") + 1)).first()[0] == 3199 - 1000 + 1


def test_overlap_totals_as_a_plain_walk(spark):
    from stratalane.operators import intervals

    feats, _ = shapes()
    feats += [(5, 1, "-", -40, 30), (900, 0, "-", 400000, 400010), (901, 0, "+", 12, 11)]
    a, b = ([f for f in feats if f[2] == strand] for strand in "-+")
    want = {}
    for id, _, _, s, e in a:
        v = [n for f in b if (n := min(e, f[4]) - max(s, f[3]) + 1) >= 1]
        if v:
            n, shared = want.get(id, (0, 0))
            want[id] = n + len(v), shared + sum(v)
    f = spark.createDataFrame(feats, "id long, chrom long, strand string, s long, e long")
    found = intervals.overlap_totals(f.where("strand = '-'"), f.where("strand = '+'"), "id", width=1000)
    assert {r.id: (r.n, r.shared) for r in found.collect()} == want
    assert "__role" not in shuffled(__spark_entry__.queries()["overlap_join_any_chromosome"](spark, SF))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from stratalane.sources import readers

    text = {f"{k}.txt": [f"h{i}" if i % 7 == 0 else "" if i % 5 == 0 else f"line {i}" for i in range(k * 400)] for k in (1, 3)}
    for name, rows in text.items():
        (tmp_path / name).write_text("\r\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        found = readers._numbered(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[1], r.n): r.value for r in found.collect()}
        assert len(found.inputFiles()) > len(text)
        below = {(r.file.rsplit("/", 1)[1], r.n): (r.block, r.head) for r in readers.blocks(spark, str(tmp_path), "^h").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(name, i): v for name, rows in text.items() for i, v in enumerate(rows) if v}
    assert below == {(name, i): (i - i % 7, f"h{i - i % 7}") for (name, i), v in got.items() if i % 7}


def test_probes_are_placed_in_a_stream(spark):
    """A run of probes is one group of no Python function; runs are cut and joined as the plain walk of the other test has them."""
    plan = shuffled(__spark_entry__.queries()["probes_placed"](spark, SF))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("measure", ["mean", "sum", "cov", "median", "nfr"])
def test_tiles_without_points_or_values(spark, measure):
    from stratalane.operators import bins

    feats = spark.createDataFrame([(1, 0, "+", 200, 300), (2, 0, "-", 90000, 90100), (3, 7, "+", 10, 60)], "id long, chrom long, strand string, s long, e long")
    points = spark.createDataFrame([(0, 250, 5.0), (7, 20, None)], "chrom long, pos long, v double")
    got = {r.id: r.f2 for r in bins.feature_bins(feats, points, 100, 4, 5, measure).collect()}
    assert set(got) == {1, 3} and got[1] == {"mean": 5.0, "sum": 5.0, "cov": 0.25, "median": 5.0, "nfr": None}[measure]


def test_permutation_rounds_are_no_rows(spark, monkeypatch):
    """Ids once, twice and null, lengths null and negative: the same counts as of placements that are rows; and none is one."""
    import random

    from stratalane.operators import sampling

    draw = random.Random(3)
    row = lambda id: (draw.choice(["a", "b", None]), s := draw.randrange(3000), draw.choice([s, s + 40, s + 900, s + 5000, s - 3, None]), id)
    test = spark.createDataFrame([row(draw.choice([None, f"t{k // 3}", f"u{k}"])) for k in range(200)], "chrom string, s long, e long, id string")
    reference = spark.createDataFrame([("a", 100, 400), ("b", -50, 30), ("b", 2900, 9000), ("c", 1, 5), (None, 1, 900)], "chrom string, s long, e long")
    regions = spark.createDataFrame([("b", 3000), ("a", 2500), ("d", 700), (None, 100), ("e", None), ("a", 90)], "chrom string, size long")
    asked = lambda: sorted(map(tuple, sampling.permutation_overlaps(test, reference, regions, rounds=130).collect()))
    with monkeypatch.context() as m:
        m.setattr(sampling, "SENT_ROWS", 0)
        want = asked()
        assert len(want) == 131 and len({w[2] for w in want}) > 5
    monkeypatch.setattr(sampling, "_redrawn", None)
    assert asked() == want


def test_bags_are_parsed_as_before(spark):
    """Odd bags against the entries that a plain walk finds; the query parses them once."""
    import random
    import re

    from stratalane.operators import annotation

    draw = random.Random(1)
    bags = ["".join(draw.choice(['gene_id', '"', ";", "=", " ", "\n", "\t", "a b", "x", "ä"]) for _ in range(draw.randrange(14))) for _ in range(3000)]
    blank = r"[ \t\n\x0b\f\r]"
    entry = re.compile(rf'[^ \t\n\x0b\f\r;="]+(?:(?:{blank}|=)+(?:"[^"]*"|[^;"]*))?')
    want = {b: [(re.match(rf'[^ \t\n\x0b\f\r=]+', p)[0], re.sub('^"|"$', "", (re.match(rf'[^ \t\n\x0b\f\r=]+(?:{blank}|=)+([\s\S]*)$', p) or ["", ""])[1].strip(" "))) for p in entry.findall(b)] for b in bags}
    got = spark.createDataFrame([(b,) for b in bags], "t string").select("t", annotation.parsed("t").alias("bag")).collect()
    assert {r.t: [tuple(x) for x in r.bag] for r in got} == want
    plan = __spark_entry__.queries()["attributes_filtered"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2


@pytest.mark.parametrize("size", [1, 5, 64])
def test_probes_across_blocks(spark, monkeypatch, size):
    """Gaps on both sides and blocks of many pieces against a plain walk; no row is made for a residue."""
    import random

    from stratalane.operators import genome

    draw = random.Random(2)
    monkeypatch.setattr(genome, "PIECE", size)
    monkeypatch.setattr(genome._aligned_pieces, "__defaults__", (size,))
    aln = lambda n: "".join(draw.choice("ACGT--") for _ in range(n))
    blocks = [(k, f"r{k % 2}", draw.randrange(50), aln(n := draw.choice([0, 3, 70, 200])), f"s{k % 3}", draw.randrange(300), aln(n - (k % 4 == 0 and n > 0))) for k in range(40)]
    probes = [(f"s{k % 4}", draw.randrange(-5, 500), k) for k in range(400)]
    walk = []
    for block, rc, rs, ra, sc, ss, sa in blocks:
        for r, q in zip(ra, sa):
            if q != "-":
                walk.append((block, sc, ss, rc, rs))
            rs, ss = rs + (r != "-"), ss + (q != "-")
    frame = spark.createDataFrame(blocks, "block long, ref_chrom string, ref_start long, ref_aln string, syn_chrom string, syn_start long, syn_aln string")
    assert sorted(map(tuple, genome.aligned_positions(frame).collect())) == sorted(walk)
    got = genome.probes_across(frame, spark.createDataFrame(probes, "syn_chrom string, syn_pos long, probe long")).select("probe", "block", "ref_chrom", "ref_pos")
    assert sorted(map(tuple, got.collect())) == sorted((p, b, rc, rp) for c, at, p in probes for b, sc, sp, rc, rp in walk if (sc, sp) == (c, at))
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_binary_tracks_pass_by_the_driver(spark, tmp_path, monkeypatch):
    """A folder of tracks of at most seven points, several chromosomes in one and one in several; nothing comes to the driver."""
    import random

    from pyspark.sql import DataFrame

    from stratalane.sources import dialects

    draw = random.Random(4)
    points = [(f"chr {k % 5}", draw.randrange(-9, 60), float(draw.randrange(9))) for k in range(100)]
    frame = spark.createDataFrame(points, "chrom string, pos long, v double")
    with monkeypatch.context() as m:
        m.setattr(type(frame), "toLocalIterator", None)
        m.setattr(DataFrame, "toLocalIterator", None)
        dialects.write_bar(frame, str(tmp_path / "bar"), "g", "1", most=7)
    files = [f.read_bytes() for f in sorted((tmp_path / "bar").glob("part-*"))]
    assert len(files) >= 100 / 7 and all(f.startswith(dialects.BAR_MAGIC) and f.endswith(b"END\n") for f in files)
    got = dialects.bar(spark, str(tmp_path / "bar")).collect()
    assert sorted(map(tuple, got)) == sorted((c.replace(" ", "_"), p, v) for c, p, v in points)


@pytest.mark.parametrize("how", [{}, {"k": -30}, {"k": 20}, {"percent": 50}, {"percent": -85}, {"unique": False, "on": ("chrom", "strand")}])
@pytest.mark.parametrize("crowd", [4, 1000])
def test_collected_values_as_a_plain_walk(spark, monkeypatch, how, crowd):
    """Long rows on both sides, crowded tiles, keys twice and null, values twice and null."""
    import random

    from stratalane.operators import intervals

    for name, n in (("TILE", 64), ("LONG", 200), ("CROWD", crowd)):
        monkeypatch.setattr(intervals, name, n)
    draw = random.Random(6)
    row = lambda id: (draw.choice([0, 1, None]), draw.choice("+-"), at := draw.randrange(-100, 900), at + draw.choice([0, 9, 60, 70, 190, 500]), id)
    left = [row(draw.choice([k, k // 2, None])) for k in range(60)]
    right = [row(draw.choice([f"n{k}", f"n{k // 3}", None])) for k in range(60)]
    k, percent, on = how.get("k", 1), how.get("percent"), len(how.get("on", "a"))

    def hit(a, b):
        long = (a[3] - a[2] + 1, b[3] - b[2] + 1)
        least = k if percent is None else math.floor((max if percent > 0 else min)(long) * abs(percent) / 100)
        return None not in (a[0], b[0], a[4], b[4]) and a[:on] == b[:on] and min(a[3], b[3]) - max(a[2], b[2]) + 1 >= least

    want = []
    for a in left:
        values = sorted(b[4] for c in left if c[4] == a[4] for b in right if hit(c, b))
        want.append((*a, "|".join(values if how.get("unique") is False else sorted(set(values))) or "none"))
    schema = "chrom int, strand string, s long, e long, {}".format
    got = intervals.overlap_collect(spark.createDataFrame(left, schema("id long")), spark.createDataFrame(right, schema("v string")), "id", "v", sep="|", missing="none", **how)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and sum(w[-1] != "none" for w in want) > 5


def test_collected_values_are_no_pairs(spark):
    """Values are gathered by tile, not by key: what is shuffled does not grow with the pairs."""
    plan = __spark_entry__.queries()["position_join_collected"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("collect_list") == 1 and "__pack" in plan


def test_collapsed_links_islands_not_names(spark, monkeypatch):
    """Names on several strands and chromosomes, repeated exons and chains of islands against plain sets; what is linked is islands."""
    import random

    from stratalane.operators import annotation, graphs

    draw = random.Random(8)
    row = lambda tx: (tx, draw.choice("ab"), draw.choice("+-"), at := draw.randrange(0, 400000, 7), at + draw.choice([3, 40, 2000]))
    rows = [row(f"t{draw.randrange(90)}") for _ in range(180)] + [(f"u{k}", "c", "+", 10 + k % 50, 100) for k in range(300)]
    rows += rows[:20] + [(None, "a", "+", 0, 400000)]
    sets = []
    for tx, chrom, strand, s, e in rows[:-1]:
        joined = [({tx}, [(chrom, strand, s, e)])]
        kept = []
        for names, exons in sets:
            meets = tx in names or any(x[:2] == (chrom, strand) and x[2] < e and s < x[3] for x in exons)
            (joined if meets else kept).append((names, exons))
        sets = [*kept, (set().union(*(n for n, _ in joined)), [x for _, xs in joined for x in xs])]
    want = []
    for names, exons in sets:
        for chrom, strand in {x[:2] for x in exons}:
            own, runs = sorted(x[2:] for x in exons if x[:2] == (chrom, strand)), []
            for s, e in own:
                if runs and s < runs[-1][1]:
                    runs[-1][1] = max(e, runs[-1][1])
                else:
                    runs.append([s, e])
            said = {r[0] for r in rows if r[0] in names and r[1:3] == (chrom, strand)}
            want.append((chrom, strand, runs[0][0], max(e for _, e in runs), [s for s, _ in runs], [e for _, e in runs], "|".join(sorted(said))))
    linked, components = [], graphs.components
    monkeypatch.setattr(graphs, "components", lambda links: linked.append(links.count()) or components(links))
    got = annotation.collapsed(annotation.transcripts(spark.createDataFrame(rows, "tx string, chrom string, strand string, s long, e long")))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < linked[0] < 180 and any(w[-1].count("|") == 299 for w in want)


def test_pairs_of_neighbours_take_less_to_write(spark, tmp_path):
    """The same pairs, in fewer bytes where the rows are by place; the sort is not taken out of the plan."""
    from stratalane.operators import intervals

    h = F.xxhash64("id")
    rows = spark.range(3000).select((F.col("id") % 2).alias("chrom"), F.pmod(h, F.lit(900)).alias("s"), "id")
    rows = rows.select("chrom", "s", (F.col("s") + 50 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400))).alias("e"), "id").orderBy(F.xxhash64("id", F.lit(2)))
    pairs, size = {}, {}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, f in (("any", rows), ("placed", intervals.by_place(rows))):
            intervals.overlap_join(f, f).select("id1", "id2", "v").write.parquet(str(tmp_path / name))
            size[name] = sum(x.stat().st_size for x in (tmp_path / name).glob("*.parquet"))
            pairs[name] = spark.read.parquet(str(tmp_path / name)).agg(F.count("*"), F.sum(F.xxhash64("id1", "id2", "v").cast("decimal(38,0)"))).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert pairs["any"] == pairs["placed"] and pairs["any"][0] > 500_000
    assert size["placed"] < 0.85 * size["any"], size
    for name in ("k1", "k50", "gap300", "stranded", "half_of_longer", "most_of_shorter"):
        plan = __spark_entry__.queries()[f"overlap_join_{name}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Sort [") == 2 and plan.count("RepartitionByExpression") == 2

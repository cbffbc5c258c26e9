"""Interval operators over orders as features and line items as a signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.operators import intervals
from stratalane.plans.catalog import query
from stratalane.plans.views import FEAT, SIG, features, signal

V = "least(a.e, b.e) - greatest(a.s, b.s) + 1"


def _pairs(condition: str, v: str = V) -> str:
    return f"WITH {FEAT} SELECT a.id AS id1, b.id AS id2, {v} AS v FROM feat a JOIN feat b ON {condition}"


@query(_pairs(f"a.chrom = b.chrom AND {V} >= 1"))
def overlap_join_k1(spark, sf_dir):
    f = intervals.by_place(features(spark, sf_dir))
    return intervals.overlap_join(f, f).select("id1", "id2", "v")


@query(_pairs(f"a.chrom = b.chrom AND {V} >= 50"))
def overlap_join_k50(spark, sf_dir):
    f = intervals.by_place(features(spark, sf_dir))
    return intervals.overlap_join(f, f, k=50).select("id1", "id2", "v")


@query(_pairs(f"a.chrom = b.chrom AND {V} >= -300"))
def overlap_join_gap300(spark, sf_dir):
    f = intervals.by_place(features(spark, sf_dir))
    return intervals.overlap_join(f, f, k=-300).select("id1", "id2", "v")


@query(_pairs(f"a.chrom = b.chrom AND {V} >= floor(50 * greatest(a.e - a.s + 1, b.e - b.s + 1) / 100)"))
def overlap_join_half_of_longer(spark, sf_dir):
    f = intervals.by_place(features(spark, sf_dir))
    return intervals.overlap_join(f, f, percent=50).select("id1", "id2", "v")


@query(_pairs(f"a.chrom = b.chrom AND {V} >= floor(85 * least(a.e - a.s + 1, b.e - b.s + 1) / 100)"))
def overlap_join_most_of_shorter(spark, sf_dir):
    f = intervals.by_place(features(spark, sf_dir))
    return intervals.overlap_join(f, f, percent=-85).select("id1", "id2", "v")


@query(_pairs(f"a.chrom = b.chrom AND a.strand = b.strand AND {V} >= 1"))
def overlap_join_stranded(spark, sf_dir):
    f = intervals.by_place(features(spark, sf_dir))
    return intervals.overlap_join(f, f, ("chrom", "strand")).select("id1", "id2", "v")


@query(f"WITH {FEAT} SELECT a.id, count(*) AS n, CAST(sum({V}) AS BIGINT) AS shared FROM feat a JOIN feat b ON {V} >= 1 AND a.strand <> b.strand AND a.strand = '-' GROUP BY a.id")
def overlap_join_any_chromosome(spark, sf_dir):
    """No equality at all: features of either strand wherever they lie, with what each shares with the other strand."""
    f = features(spark, sf_dir)
    return intervals.overlap_totals(f.where("strand = '-'"), f.where("strand = '+'"), "id")


@query(f"""WITH {FEAT} SELECT a.id, coalesce(string_agg(DISTINCT CAST(b.id AS VARCHAR), ';' ORDER BY CAST(b.id AS VARCHAR)), 'none') AS joined
FROM feat a LEFT JOIN feat b ON a.chrom = b.chrom AND {V} >= 1 AND b.strand = '+' WHERE a.strand = '-' GROUP BY a.id""")
def position_join_collected(spark, sf_dir):
    f = features(spark, sf_dir)
    return intervals.overlap_collect(f.where("strand = '-'"), f.where("strand = '+'"), "id", "id", missing="none").select("id", "joined")


@query(f"WITH {FEAT} SELECT id FROM feat a WHERE strand = '-' AND EXISTS (SELECT 1 FROM feat b WHERE b.strand = '+' AND a.chrom = b.chrom AND {V} >= 1)")
def overlap_semi_join(spark, sf_dir):
    f = features(spark, sf_dir)
    return intervals.overlap_semi(f.where("strand = '-'"), f.where("strand = '+'"), ["id"]).select("id")


@query(f"WITH {FEAT} SELECT id FROM feat a WHERE strand = '-' AND NOT EXISTS (SELECT 1 FROM feat b WHERE b.strand = '+' AND a.chrom = b.chrom AND {V} >= 1)")
def overlap_anti_join(spark, sf_dir):
    f = features(spark, sf_dir)
    return intervals.overlap_semi(f.where("strand = '-'"), f.where("strand = '+'"), ["id"], anti=True).select("id")


@query(f"""WITH {FEAT}, w AS (SELECT chrom, s - 175 AS s, e + 175 AS e, strand, id FROM feat),
p AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.strand = '-' AND b.strand = '+' AND a.chrom = b.chrom AND {V} > 0.5 * least(a.e - a.s + 1, b.e - b.s + 1)),
n AS (SELECT count(*) FILTER (strand = '-') AS na, count(*) FILTER (strand = '+') AS nb FROM feat)
SELECT count(DISTINCT a) AS shared_a, count(DISTINCT b) AS shared_b, count(*) AS pairs, any_value(na) - count(DISTINCT a) AS unique_a, any_value(nb) - count(DISTINCT b) AS unique_b FROM p, n""")
def peak_match(spark, sf_dir):
    f = features(spark, sf_dir)
    return intervals.peak_match(f.where("strand = '-'"), f.where("strand = '+'"), "id")


ISLANDS = """o AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM feat),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM o)"""


@query(f"WITH {FEAT}, {ISLANDS.format(gap=0)} SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY chrom, isl")
def interval_union(spark, sf_dir):
    return intervals.merged(features(spark, sf_dir))


@query(f"WITH {FEAT}, {ISLANDS.format(gap=40)} SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS summed FROM i GROUP BY chrom, isl")
def interval_union_gap40(spark, sf_dir):
    return intervals.merged(features(spark, sf_dir), gap=40, summed=F.sum(F.col("e") - F.col("s") + 1))


@query(f"""WITH {FEAT}, {ISLANDS.format(gap=0)}, u AS (SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY chrom, isl)
SELECT chrom, CAST(sum(e - s + 1) AS BIGINT) AS covered, min(s) AS first, max(e) AS last, count(*) AS segments,
  round(sum(e - s + 1) / (max(e) - min(s) + 1), 6) AS fraction FROM u GROUP BY chrom""")
def union_length(spark, sf_dir):
    """Covered length, bounds and fraction, as for the hits of a reference or the exons of a gene."""
    length = F.sum(F.col("e") - F.col("s") + 1)
    return intervals.merged(features(spark, sf_dir)).groupBy("chrom").agg(length.alias("covered"), F.min("s").alias("first"), F.max("e").alias("last"), F.count("*").alias("segments"), F.round(length / (F.max("e") - F.min("s") + 1), 6).alias("fraction"))


@query(f"""WITH {FEAT}, {ISLANDS.format(gap=0)}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, isl ORDER BY e - s DESC, e DESC, id) AS k FROM i)
SELECT chrom, s, e, id FROM r WHERE k = 1""")
def largest_of_cluster(spark, sf_dir):
    rows = intervals.islands(features(spark, sf_dir))
    best = F.max_by(F.struct("s", "e", "id"), F.struct(F.col("e") - F.col("s"), F.col("e"), -F.col("id")))
    return rows.groupBy("chrom", "island").agg(best.alias("b")).select("chrom", "b.*")


@query(f"""WITH {FEAT}, x AS (SELECT chrom, s AS p, 1 AS d FROM feat UNION ALL SELECT chrom, e, -1 FROM feat), y AS (SELECT chrom, p, sum(d) AS d FROM x GROUP BY chrom, p),
z AS (SELECT chrom, p AS s, lead(p) OVER w AS e, CAST(sum(d) OVER (PARTITION BY chrom ORDER BY p) AS BIGINT) AS depth FROM y WINDOW w AS (PARTITION BY chrom ORDER BY p))
SELECT * FROM z WHERE depth > 0""")
def coverage_depth(spark, sf_dir):
    return intervals.coverage(features(spark, sf_dir))


@query(f"""WITH {FEAT}, a AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
  min(s) OVER (PARTITION BY chrom ORDER BY e, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM feat)
SELECT id, least(s, greatest(1, coalesce(pe + 20, 1))) AS flank_start, greatest(e, coalesce(ns - 20, 4611686018427387904)) AS flank_end FROM a""")
def flank_limits(spark, sf_dir):
    return intervals.flank_limits(features(spark, sf_dir), buffer=20).select("id", "flank_start", "flank_end")


@query(f"""WITH {FEAT}, n AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM (SELECT DISTINCT chrom, s - s % 1000 AS s, s - s % 1000 + 200 + 200 * (id % 5) AS e FROM feat WHERE strand = '-') t WINDOW w AS (PARTITION BY chrom ORDER BY s, e))
SELECT chrom, s, e FROM n WHERE (pe IS NULL OR pe <> s) AND (ns IS NULL OR ns <> e)""")
def singleton_regions(spark, sf_dir):
    """Regions that touch no neighbour at either end."""
    f = features(spark, sf_dir).where("strand = '-'")
    rows = f.select("chrom", (F.col("s") - F.col("s") % 1000).alias("s"), "id").select("chrom", "s", (F.col("s") + 200 + 200 * (F.col("id") % 5)).alias("e")).distinct()
    rows = intervals.running(rows, ["chrom"], ("s", "e"), {"pe": ("lag", "e")})
    rows = intervals.running(rows, ["chrom"], ("s", "e"), {"ns": ("lag", "s")}, reverse=True)
    return rows.where("(pe IS NULL OR pe <> s) AND (ns IS NULL OR ns <> e)").select("chrom", "s", "e")




@query(f"WITH {SIG}, t AS (SELECT chrom, pos // 100 AS w, CAST(floor(min(v) / 10000) AS BIGINT) AS q FROM sig GROUP BY chrom, pos // 100), r AS (SELECT *, w - row_number() OVER (PARTITION BY chrom, q ORDER BY w) AS g FROM t) SELECT chrom, min(w) AS s, max(w) + 1 AS e, q FROM r WHERE q > 0 GROUP BY chrom, q, g")
def run_length_signal(spark, sf_dir):
    """Runs of equal positive values over adjacent windows, as a variable-step track becomes regions."""
    rows = signal(spark, sf_dir).groupBy("chrom", F.floor(F.col("pos") / 100).alias("w")).agg(F.floor(F.min("v") / 10000).alias("q")).where("q > 0")
    rows = rows.select("chrom", "q", F.col("w").alias("s"), (F.col("w") + 1).alias("e"))
    return intervals.merged(rows, ("chrom", "q")).select("chrom", "s", "e", "q")


@query(f"""WITH {SIG}, t AS (SELECT chrom, pos // 100 AS s, pos // 100 + 1 AS e, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS v FROM sig GROUP BY chrom, pos // 100),
o AS (SELECT *, lag(e) OVER (PARTITION BY chrom ORDER BY s) AS pe FROM t), i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s) AS isl FROM o)
SELECT chrom, min(s) AS s, max(e) AS e, CAST(sum(v) AS BIGINT) AS total_cents, CAST(sum((e - s) * v) // (max(e) - min(s)) AS BIGINT) AS mean_cents FROM i GROUP BY chrom, isl""")
def collapse_signal_regions(spark, sf_dir):
    """Regions within a gap of one window merged, with their sum and length-weighted mean."""
    rows = signal(spark, sf_dir).groupBy("chrom", F.floor(F.col("pos") / 100).alias("s")).agg(F.sum(F.round(F.col("v") * 100).cast("long")).alias("v")).select("chrom", "s", (F.col("s") + 1).alias("e"), "v")
    out = intervals.islands(rows, gap=1).groupBy("chrom", F.col("island").alias("s")).agg(F.max("e").alias("e"), F.sum("v").alias("total_cents"), F.sum((F.col("e") - F.col("s")) * F.col("v")).alias("w"))
    return out.select("chrom", "s", "e", "total_cents", F.expr("w div (e - s)").alias("mean_cents"))


@query(f"""WITH {FEAT}, {ISLANDS.format(gap=0)}, u AS (SELECT chrom, isl, min(s) AS s, max(e) AS e, arg_max(strand, (e, -id)) AS last_strand, arg_min(strand, (s, e, id)) AS first_strand FROM i GROUP BY chrom, isl),
n AS (SELECT *, lead(s) OVER w AS ns, lead(first_strand) OVER w AS nstrand FROM u WINDOW w AS (PARTITION BY chrom ORDER BY s))
SELECT chrom, e AS from_pos, ns AS to_pos, ns - e AS distance, CASE WHEN last_strand = nstrand THEN 'tandem' WHEN last_strand = '+' THEN 'converging' ELSE 'diverging' END AS kind FROM n WHERE ns IS NOT NULL""")
def neighbour_orientation(spark, sf_dir):
    """Neighbouring features, overlaps absorbed, as tandem, converging or diverging pairs with their distance."""
    rows = intervals.islands(features(spark, sf_dir)).groupBy("chrom", F.col("island").alias("s")).agg(
        F.max("e").alias("e"), F.max_by("strand", F.struct(F.col("e"), -F.col("id"))).alias("last_strand"), F.min_by("strand", F.struct("s", "e", "id")).alias("first_strand"))
    rows = intervals.running(rows, ["chrom"], ("s",), {"ns": ("lag", "s"), "nstrand": ("lag", "first_strand")}, reverse=True).where("ns IS NOT NULL")
    kind = F.when(F.col("last_strand") == F.col("nstrand"), "tandem").when(F.col("last_strand") == "+", "converging").otherwise("diverging")
    return rows.select("chrom", F.col("e").alias("from_pos"), F.col("ns").alias("to_pos"), (F.col("ns") - F.col("e")).alias("distance"), kind.alias("kind"))


@query(f"""WITH {FEAT}, p AS (SELECT id, chrom, unnest(range(s, e)) AS x FROM feat WHERE strand = '-'), b AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS x FROM feat WHERE strand = '+'),
k AS (SELECT p.id, p.x, p.x - row_number() OVER (PARTITION BY p.id ORDER BY p.x) AS g FROM p LEFT JOIN b USING (chrom, x) WHERE b.x IS NULL)
SELECT id, min(x) AS s, max(x) + 1 AS e FROM k GROUP BY id, g HAVING count(*) >= 10""")
def interval_subtract(spark, sf_dir):
    f = features(spark, sf_dir)
    return intervals.subtract(f.where("strand = '-'"), f.where("strand = '+'"), least=10).select("id", "s", "e")


@query(f"""WITH {FEAT}, {SIG}, r AS (SELECT chrom, max(pos) + 1 AS size FROM sig GROUP BY chrom), c AS (SELECT chrom, size, CAST(sum(size) OVER (ORDER BY chrom) - size AS BIGINT) AS first FROM r)
SELECT f.id, c.chrom FROM feat f JOIN c ON (f.id * 7919) % (SELECT CAST(sum(size) AS BIGINT) FROM r) >= c.first AND (f.id * 7919) % (SELECT CAST(sum(size) AS BIGINT) FROM r) < c.first + c.size""")
def place_in_regions(spark, sf_dir):
    """A number to the region whose stretch of the cumulative sizes holds it, as of the last region that begins at or before it."""
    from stratalane.operators.sampling import cumulative_regions, region_of

    regions = cumulative_regions(signal(spark, sf_dir).groupBy("chrom").agg((F.max("pos") + 1).alias("size")), "chrom", "size")
    total = regions.agg(F.sum("size")).first()[0] or 1
    draws = features(spark, sf_dir).select("id", ((F.col("id") * 7919) % total).alias("draw"))
    return region_of(draws, regions, "draw").select("id", "chrom")

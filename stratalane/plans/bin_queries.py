"""Binning operators: windows over a position axis and signals around features."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.operators import bins, matrices
from stratalane.plans.catalog import query
from stratalane.plans.views import FEAT, SIG, features, signal
from stratalane.session import load


@query(f"""WITH {SIG}, t AS (SELECT chrom, pos // 1000 AS win, count(*) AS value FROM sig GROUP BY ALL), g AS (SELECT chrom, unnest(range(0, max(win) + 1)) AS win FROM t GROUP BY chrom)
SELECT chrom, win, coalesce(value, 0) AS value FROM g LEFT JOIN t USING (chrom, win)""")
def tumbling_counts(spark, sf_dir):
    return bins.tumbling(signal(spark, sf_dir), 1000)


@query(f"WITH {SIG} SELECT chrom, pos // 1000 AS win, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS value FROM sig GROUP BY ALL")
def tumbling_sums(spark, sf_dir):
    return bins.tumbling(signal(spark, sf_dir), 1000, total=F.sum(F.round(F.col("v") * 100).cast("long")), zeros=False)


WINDOWS = "r AS (SELECT chrom, s, e, unnest(range((s - 1) // 40, (e - 1) // 40 + 1)) AS win FROM feat)"


@query(f"WITH {FEAT}, {WINDOWS} SELECT chrom, win, count(*) AS value FROM r GROUP BY ALL")
def read_windows_overlapped(spark, sf_dir):
    return bins.read_windows(features(spark, sf_dir), 40)


@query(f"""WITH {FEAT}, {WINDOWS}, t AS (SELECT chrom, win, round(sum((least(e, (win + 1) * 40) - greatest(s, win * 40 + 1) + 1) / (e - s + 1)), 6) AS value FROM r GROUP BY ALL),
g AS (SELECT chrom, unnest(range(0, max(win) + 1)) AS win FROM t GROUP BY chrom) SELECT chrom, win, coalesce(value, 0) AS value FROM g LEFT JOIN t USING (chrom, win)""")
def read_windows_fractions(spark, sf_dir):
    return bins.read_windows(features(spark, sf_dir), 40, how="fraction", zeros=True).withColumn("value", F.round("value", 6))


@query(f"WITH {FEAT} SELECT chrom, (s + CAST(floor((e - s + 1) / 2 + 0.5) AS BIGINT) - 1) // 40 AS win, count(*) AS value FROM feat GROUP BY ALL")
def read_windows_midpoints(spark, sf_dir):
    return bins.read_windows(features(spark, sf_dir), 40, how="midpoint")


def _binned(measure: str, empty: str = "NULL") -> str:
    """The theta join over flanks of 100 in 4 bins and features in 5."""
    names = [f"{t}{k}" for t, n in (("u", 4), ("f", 5), ("d", 4)) for k in range(n)]
    cells = ", ".join(f"coalesce(max(CASE WHEN type || bin = '{n}' THEN m END), {empty}) AS {n}" for n in names)
    return f"""WITH {FEAT}, {SIG}, g AS (SELECT id, chrom, strand, 'f' AS type, s, e, e - s AS size FROM feat
 UNION ALL SELECT id, chrom, strand, CASE WHEN strand = '+' THEN 'u' ELSE 'd' END, greatest(1, s - 100), s, 100 FROM feat UNION ALL SELECT id, chrom, strand, CASE WHEN strand = '+' THEN 'd' ELSE 'u' END, e, e + 100, 100 FROM feat),
j AS (SELECT id, type, size, CASE WHEN strand = '+' THEN CASE WHEN type = 'u' THEN 100 - (e - pos) ELSE pos - s END ELSE CASE WHEN type = 'u' THEN 100 - (pos - s) ELSE e - pos END END AS rel, v
 FROM g JOIN sig ON g.chrom = sig.chrom AND pos >= s AND pos < e), o AS (SELECT id, type, size, rel, max(v) AS v FROM j GROUP BY ALL),
b AS (SELECT *, CAST(floor(rel / (size / CASE WHEN type = 'f' THEN 5 ELSE 4 END)) AS BIGINT) AS bin, size / CASE WHEN type = 'f' THEN 5 ELSE 4 END AS w FROM o),
c AS (SELECT id, type, bin, {measure} AS m FROM b WHERE bin >= 0 AND bin < CASE WHEN type = 'f' THEN 5 ELSE 4 END GROUP BY id, type, bin)
SELECT id, {cells} FROM c GROUP BY id"""


def _bins(spark, sf_dir, measure):
    return bins.feature_bins(features(spark, sf_dir), signal(spark, sf_dir), 100, 4, 5, measure)


@query(_binned("round(avg(v), 6)"))
def feature_bins_mean(spark, sf_dir):
    """The flagship: features and their flanks against a signal, as a matrix of bins."""
    return _bins(spark, sf_dir, "mean")


@query(_binned("round(median(v), 6)"))
def feature_bins_median(spark, sf_dir):
    return _bins(spark, sf_dir, "median")


@query(_binned("round(sum(v), 6)", "0"))
def feature_bins_sum(spark, sf_dir):
    return _bins(spark, sf_dir, "sum")


@query(_binned("round(sum(v) / any_value(w), 6)", "0"))
def feature_bins_coverage(spark, sf_dir):
    return _bins(spark, sf_dir, "cov")


@query(_binned("CASE WHEN count(v) >= 10 THEN list_sort(list(v))[CAST(ceil(count(v) / 10) AS INT)] END"))
def feature_bins_tenth(spark, sf_dir):
    return _bins(spark, sf_dir, "nfr")


@query(f"""WITH {FEAT}, {SIG} SELECT id, CASE WHEN strand = '+' THEN pos - s ELSE e - pos END AS rel, max(v) AS v FROM feat JOIN sig ON feat.chrom = sig.chrom AND pos >= s AND pos < e GROUP BY ALL""")
def feature_relative(spark, sf_dir):
    return bins.relative(features(spark, sf_dir), signal(spark, sf_dir), 100, ("f",)).select("id", "rel", "v")


@query(f"""WITH {SIG}, g AS (SELECT chrom, x * 5000 AS x, CAST(round(v * 100) AS BIGINT) AS v FROM sig, unnest(range(CAST(ceil((pos - 2000) / 5000) AS BIGINT), CAST(floor((pos + 2000) / 5000) AS BIGINT) + 1)) AS u(x))
SELECT chrom, x, count(*) AS n, avg(v) AS mean FROM g GROUP BY ALL""")
def moving_average(spark, sf_dir):
    track = signal(spark, sf_dir).withColumn("v", F.round(F.col("v") * 100).cast("long"))
    return bins.moving(track, ["chrom"], "pos", "v", 2000, 5000).select("chrom", "x", "n", "mean")


@query("""WITH m AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS ix FROM embeddings)
SELECT vec_id, CAST(ix AS INTEGER) AS ix, round(avg(value) OVER (PARTITION BY vec_id ORDER BY ix RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM m""")
def smoothed_rows(spark, sf_dir):
    long = matrices.melted(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))
    return bins.smoothed(long, "vec_id", "ix", "value", 3).select("vec_id", "ix", F.round("smooth", 6).alias("smooth"))


@query("""WITH m AS (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS ix FROM embeddings), p AS (SELECT *, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, lag(value) OVER w AS a, lead(value) OVER w AS b FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY ix))
SELECT vec_id, CAST(ix AS INTEGER) AS ix, value FROM p WHERE value = top AND NOT coalesce(a = value AND b = value, false)""")
def local_peaks(spark, sf_dir):
    return bins.peaks(matrices.melted(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "ix", "value")


@query("SELECT CAST(g AS INTEGER) AS least, CAST(sum(CASE WHEN p_retailprice >= g THEN CAST(floor(p_retailprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS bases FROM part, (VALUES (900), (1200), (1500), (1800)) v(g) GROUP BY g")
def coverage_by_length(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.floor("p_retailprice").alias("n"))
    return bins.coverage_at_least(rows, "n", (900, 1200, 1500, 1800))


@query(f"""WITH {SIG}, h AS (SELECT chrom, pos, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS p FROM sig WHERE v > 40000), r AS (SELECT *, sum(CASE WHEN p IS NULL OR pos > p + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM h)
SELECT chrom, min(pos) AS s, max(pos) AS e, count(*) AS n FROM r GROUP BY chrom, k HAVING max(pos) - min(pos) >= 100""")
def called_runs(spark, sf_dir):
    return bins.called_runs(signal(spark, sf_dir), 40000, 60, 100)


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def time_windows(spark, sf_dir):
    """Tumbling windows of event time; streaming.windows runs the same as a stream."""
    from stratalane.streaming.windows import tumbling_events

    return tumbling_events(load(spark, sf_dir, "events"), "1 hour")

"""Aggregations, rankings and enrichment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.functions import statistics as stats
from stratalane.operators import sampling
from stratalane.plans.catalog import query
from stratalane.plans.views import features, signal
from stratalane.session import load

SETS = """s AS (SELECT DISTINCT p_brand AS name, p_size AS member FROM part), z AS (SELECT name, count(*) AS size FROM s GROUP BY name), t AS (SELECT count(DISTINCT member) AS total FROM s),
o AS (SELECT a.name AS a, b.name AS b, x.size AS size_a, y.size AS size_b, total, count(*) FILTER (a.member = b.member) AS overlap FROM s a JOIN s b ON a.name < b.name JOIN z x ON x.name = a.name JOIN z y ON y.name = b.name, t GROUP BY ALL)"""
LOGS = "f AS (SELECT 0 AS n, 0.0::DOUBLE AS l UNION ALL SELECT n, sum(ln(n)) OVER (ORDER BY n) AS l FROM range(1, 2000) r(n))"
TAIL = """p AS (SELECT a, b, size_a, size_b, total, overlap, sum(exp(fa.l - fi.l - fai.l + fna.l - fbi.l - fr.l - fn.l + fb.l + fnb.l)) AS p
 FROM o, unnest(range(overlap, least(size_a, size_b) + 1)) u(i) JOIN f fa ON fa.n = size_a JOIN f fi ON fi.n = i JOIN f fai ON fai.n = size_a - i JOIN f fna ON fna.n = total - size_a JOIN f fbi ON fbi.n = size_b - i
 JOIN f fr ON fr.n = total - size_a - size_b + i JOIN f fn ON fn.n = total JOIN f fb ON fb.n = size_b JOIN f fnb ON fnb.n = total - size_b GROUP BY ALL)"""


def _sets(spark, sf_dir):
    return stats.set_overlaps(load(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("member")))


@query(f"WITH {SETS} SELECT a, b, size_a, size_b, total, overlap FROM o")
def set_overlaps(spark, sf_dir):
    return _sets(spark, sf_dir)


@query(f"WITH {SETS}, {LOGS}, {TAIL} SELECT a, b, round(size_a * size_b / total, 6) AS expected, round(overlap / (size_a * size_b / total), 6) AS fold, round(p, 6) AS p FROM p")
def enrichment_tests(spark, sf_dir):
    found = stats.enrichment(_sets(spark, sf_dir))
    return found.select("a", "b", F.round("expected", 6).alias("expected"), F.round("fold", 6).alias("fold"), F.round("p", 6).alias("p"))


@query()
def enrichment_odds(spark, sf_dir):
    return stats.odds_ratio(_sets(spark, sf_dir)).select("a", "b", "odds")


RANKED = "c AS (SELECT l_partkey AS id, (count(*) % 97 + 1) / 100.0::DOUBLE AS p FROM lineitem GROUP BY l_partkey), m AS (SELECT count(*) AS m FROM c), r AS (SELECT id, p, p * m / rank AS raw, p * m AS bon FROM (SELECT *, count(*) OVER (ORDER BY p) AS rank FROM c), m)"


@query(f"WITH {RANKED} SELECT id, p, round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 9) AS bh, round(least(1.0, bon), 9) AS bonferroni FROM r")
def adjusted_p_values(spark, sf_dir):
    tests = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(((F.count("*") % 97 + 1) / F.lit(100.0)).alias("p"))
    return stats.adjusted(tests).select("id", "p", F.round("bh", 9).alias("bh"), F.round("bonferroni", 9).alias("bonferroni"))


@query("SELECT l_returnflag, l_quantity, cume AS share FROM (SELECT DISTINCT l_returnflag, l_quantity, cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS cume FROM lineitem)")
def cumulative_shares(spark, sf_dir):
    return stats.cumulative_share(load(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query("SELECT event_type, count(*) AS n, quantile_cont(c, 0.15) AS q15, quantile_cont(c, 0.5) AS q50, quantile_cont(c, 0.85) AS q85, round(avg(c), 4) AS mean, round(stddev_samp(c), 4) AS sd, round(stddev_samp(c) / sqrt(count(*)), 4) AS se FROM (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS c FROM events) GROUP BY event_type")
def group_summaries(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).alias("c"))
    out = stats.group_summary(rows, ["event_type"], "c")
    return out.select("event_type", "n", *(F.col("quantiles")[i].alias(n) for i, n in enumerate(("q15", "q50", "q85"))), *(F.round(c, 4).alias(c) for c in ("mean", "sd", "se")))


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS share FROM lineitem QUALIFY sum(l_quantity) OVER (PARTITION BY l_orderkey) > 50")
def share_of_group(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return stats.share_of_group(rows, ["l_orderkey"], "l_quantity", 50).select("l_orderkey", "l_linenumber", "l_partkey", F.round("share", 9).alias("share"))


@query(f"SELECT {KEYS} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {KEYS}) <= 3")
def top_three_per_group(spark, sf_dir):
    names = KEYS.split(", ")
    rows = load(spark, sf_dir, "lineitem").select(*names, "l_extendedprice")
    return stats.top_per_group(rows, ["l_suppkey"], [F.desc("l_extendedprice"), *map(F.asc, names)], 3).select(names)


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def greatest_of_group(spark, sf_dir):
    """The longest, or the one of the greatest change, in each group."""
    best = F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id")))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(best.alias("event_id"), F.max("value").alias("value"))


@query("SELECT n, count(*) AS keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def histogram_of_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


@query("SELECT l_suppkey, CAST(sum(l_quantity) FILTER (l_linenumber <= 2) AS BIGINT) AS head, CAST(sum(l_quantity) FILTER (l_linenumber > 2) AS BIGINT) AS body, round(sum(l_quantity) FILTER (l_linenumber <= 2) / nullif(sum(l_quantity) FILTER (l_linenumber > 6), 0), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def conditional_sums(spark, sf_dir):
    """Sums by stretch and their ratio, as of reads in leader and coding parts; null where there is nothing to divide by."""
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    out = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(line <= 2, q)).alias("h"), F.sum(F.when(line > 2, q)).alias("b"), F.sum(F.when(line > 6, q)).alias("t"))
    return out.select("l_suppkey", F.col("h").cast("long").alias("head"), F.col("b").cast("long").alias("body"), F.round(F.try_divide("h", F.when(F.col("t") != 0, F.col("t"))), 6).alias("ratio"))


@query("SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS bases, min(l_tax) AS least_tax, arg_min(l_returnflag, (l_linenumber, l_partkey)) AS first_flag FROM lineitem GROUP BY ALL HAVING sum(l_quantity) >= 60 AND min(l_tax) <= 0.03")
def hits_summed(spark, sf_dir):
    """Hits by query and subject: total length, least value, the first one's mark, with limits on both."""
    out = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("bases"), F.min("l_tax").alias("least_tax"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey")).alias("first_flag"))
    return out.where("bases >= 60 AND least_tax <= 0.03")


@query("WITH d AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), a AS (SELECT p, arg_max(s, (q, -s)) AS s FROM d GROUP BY p), b AS (SELECT s, arg_max(p, (q, -p)) AS p FROM d GROUP BY s) SELECT a.p AS part, a.s AS supplier FROM a JOIN b ON a.p = b.p AND a.s = b.s")
def reciprocal_best(spark, sf_dir):
    sums = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.sum("l_quantity").alias("q"))
    one = sums.groupBy("part").agg(F.max_by("supplier", F.struct(F.col("q"), -F.col("supplier"))).alias("supplier"))
    two = sums.groupBy("supplier").agg(F.max_by("part", F.struct(F.col("q"), -F.col("part"))).alias("part"))
    return one.join(two, ["part", "supplier"])


@query()
def permutation_overlaps(spark, sf_dir):
    f = features(spark, sf_dir)
    regions = signal(spark, sf_dir).groupBy("chrom").agg((F.max("pos") + 1).alias("size"))
    return sampling.permutation_overlaps(f.where("strand = '-'"), f.where("strand = '+'"), regions, rounds=1000)


@query()
def features_relocated(spark, sf_dir):
    regions = signal(spark, sf_dir).groupBy("chrom").agg((F.max("pos") + 1).alias("size"))
    return sampling.relocated(features(spark, sf_dir), regions, 7)

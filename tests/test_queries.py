import math

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

import __spark_entry__
from stratalane.plans import catalog
from stratalane.plans.statistics_queries import _sets
from stratalane.plans.views import features, signal


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_relocated_as_a_plain_walk(spark):
    """Each draw walked over the regions' eligible starts, in their order."""
    size = {r.chrom: r.size for r in signal(spark, SF).groupBy("chrom").agg((F.max("pos") + 1).alias("size")).collect()}
    rows = features(spark, SF).select("id", "strand", (F.col("e") - F.col("s")).alias("n"), F.xxhash64("id", F.lit(7)).alias("h")).collect()
    want = []
    for r in rows:
        rooms = [(c, max(0, size[c] - r.n - 1)) for c in sorted(size)]
        total = sum(room for _, room in rooms)
        left = r.h % total if total else None
        for chrom, room in rooms if total else []:
            if left < room:
                want.append((chrom, left + 1, left + 1 + r.n, r.strand, r.id))
                break
            left -= room
    got = catalog.QUERIES["features_relocated"](spark, SF).select("chrom", "s", "e", "strand", "id").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000


def test_odds_are_where_the_conditional_mean_is_the_overlap(spark):
    odds = {(r.a, r.b): r.odds for r in catalog.QUERIES["enrichment_odds"](spark, SF).collect()}
    sets = _sets(spark, SF).collect()
    assert len(odds) == len(sets) > 0
    for r in sets:
        low, high, found = max(0, r.size_a + r.size_b - r.total), min(r.size_a, r.size_b), odds[r.a, r.b]
        if low == high:
            assert math.isnan(found)
        elif r.overlap in (low, high):
            assert found == (0 if r.overlap == low else math.inf)
        else:
            log = [math.log(math.comb(r.size_a, k) * math.comb(r.total - r.size_a, r.size_b - k)) + k * math.log(found) for k in range(low, high + 1)]
            weight = [math.exp(x - max(log)) for x in log]
            assert sum(k * w for k, w in enumerate(weight, low)) / sum(weight) == pytest.approx(r.overlap, rel=1e-6)

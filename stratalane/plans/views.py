"""The driver tables in the roles that the operators need: features, signals, attributes; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalane.session import load


def _day(column: str):
    return F.datediff(F.col(column), F.lit("1995-01-01").cast("date")).cast("long")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feat(chrom, s, e, strand, id): orders as inclusive intervals."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 24).alias("chrom"), (_day("o_orderdate") * 100 + k % 100).alias("s"), k.alias("id"))
    return rows.select("chrom", "s", (F.col("s") + 50 + F.col("id") % 400).alias("e"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), "id")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sig(chrom, pos, v): line items as a signal track."""
    return load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 24).alias("chrom"), (_day("l_shipdate") * 100 + F.col("l_partkey") % 100).alias("pos"), F.col("l_extendedprice").alias("v"))


FEAT = """feat AS (SELECT o_custkey % 24 AS chrom, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) * 100 + o_orderkey % 100 AS s,
  datediff('day', TIMESTAMP '1995-01-01', o_orderdate) * 100 + o_orderkey % 100 + 50 + o_orderkey % 400 AS e,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey AS id FROM orders)"""
SIG = """sig AS (SELECT l_suppkey % 24 AS chrom, datediff('day', TIMESTAMP '1995-01-01', l_shipdate) * 100 + l_partkey % 100 AS pos, l_extendedprice AS v FROM lineitem)"""


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gtf(chrom, s, e, strand, feature, attrs): line items as annotation rows with an attribute bag."""
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    part = lambda name, value: F.concat(F.lit(f'{name} "'), value.cast("string"), F.lit('"; '))
    s = _day("l_shipdate") * 100 + p % 100
    bag = F.concat(part("gene_id", F.concat(F.lit("g"), (o % 500).cast("string"))), part("transcript_id", F.concat(F.lit("t"), o.cast("string"))), part("exon_number", n), F.when(p % 3 == 0, part("tag", p % 7)).otherwise(""), F.when(p % 6 == 0, part("tag", F.lit("extra"))).otherwise(""))
    return load(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 24).alias("chrom"), s.alias("s"), (s + F.col("l_quantity").cast("long") + 1).alias("e"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"),
        F.when(n % 4 == 0, "CDS").otherwise("exon").alias("feature"), F.rtrim(bag).alias("attrs"), o.alias("okey"), p.alias("pkey"), n.alias("line"),
    )


GTF = """gtf AS (SELECT l_suppkey % 24 AS chrom, datediff('day', TIMESTAMP '1995-01-01', l_shipdate) * 100 + l_partkey % 100 AS s,
  datediff('day', TIMESTAMP '1995-01-01', l_shipdate) * 100 + l_partkey % 100 + CAST(trunc(l_quantity) AS BIGINT) + 1 AS e,
  CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_linenumber % 4 = 0 THEN 'CDS' ELSE 'exon' END AS feature,
  'g' || (l_orderkey % 500) AS gene, 't' || l_orderkey AS tx, l_orderkey AS okey, l_partkey AS pkey, l_linenumber AS line FROM lineitem)"""

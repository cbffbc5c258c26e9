"""Matrix operators over embeddings, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.operators import matrices
from stratalane.plans.catalog import query
from stratalane.session import load


def _matrix(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2 AND x < 0.3)) >= 3")
def matrix_rows_in_band(spark, sf_dir):
    return matrices.filter_rows(_matrix(spark, sf_dir), "embedding", 3, above=0.2, below=0.3).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x >= 0.3 OR x <= -0.3)) >= 2")
def matrix_rows_outside_band(spark, sf_dir):
    return matrices.filter_rows(_matrix(spark, sf_dir), "embedding", 2, above=0.3, below=-0.3, or_equal=True).select("vec_id")


CELLS = "m AS (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS ix FROM embeddings)"


@query(f"WITH {CELLS} SELECT CAST(ix AS INTEGER) AS ix, count(*) AS n, max(value) AS top FROM m WHERE ix IN (SELECT ix FROM m WHERE value > 0.35 GROUP BY ix HAVING count(*) >= 4) GROUP BY ix")
def matrix_columns_in_band(spark, sf_dir):
    long = matrices.melted(_matrix(spark, sf_dir), "vec_id", "embedding")
    return matrices.filter_columns(long, "ix", "value", 4, above=0.35).groupBy("ix").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"WITH {CELLS} SELECT vec_id, CAST(ix AS INTEGER) AS ix, value FROM m")
def matrix_melted(spark, sf_dir):
    return matrices.melted(_matrix(spark, sf_dir), "vec_id", "embedding")


@query(f"WITH {CELLS} SELECT CAST(ix AS INTEGER) AS ix, list(value ORDER BY vec_id) AS \"values\" FROM m GROUP BY ix")
def matrix_transposed(spark, sf_dir):
    return matrices.gathered(matrices.melted(_matrix(spark, sf_dir), "vec_id", "embedding"), "ix", "vec_id", "value")


@query("SELECT l_orderkey, l_quantity * 0.5 AS l_quantity, l_tax * 0.5 AS l_tax FROM lineitem")
def matrix_scaled(spark, sf_dir):
    return matrices.scaled(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), 0.5, ["l_quantity", "l_tax"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * 1000 AS l_extendedprice FROM lineitem")
def column_scaled(spark, sf_dir):
    return matrices.scaled(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 1000, ["l_extendedprice"])


@query(f"WITH {CELLS}, s AS (SELECT ix, avg(CAST(value AS DOUBLE)) AS a, stddev_samp(CAST(value AS DOUBLE)) AS d FROM m GROUP BY ix) SELECT vec_id, CAST(ix AS INTEGER) AS ix, round((value - a) / d, 5) AS value FROM m JOIN s USING (ix)")
def matrix_centred(spark, sf_dir):
    long = matrices.melted(_matrix(spark, sf_dir), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))
    return matrices.centred(long, "ix", "value").withColumn("value", F.round("value", 5))


@query("""SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS DOUBLE) AS click, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS DOUBLE) AS purchase, CAST(sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS DOUBLE) AS view
FROM (SELECT user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'purchase', 'view')) GROUP BY user_id""")
def frequency_table(spark, sf_dir):
    """Cells such as `click:3` summed by user, a column a category."""
    e = load(spark, sf_dir, "events").where("event_type IN ('click', 'purchase', 'view')")
    cells = e.select("user_id", F.concat("event_type", F.lit(":"), F.regexp_extract("props", "([0-9]+)", 1)).alias("cell"))
    return matrices.frequency_table(cells, "user_id", "cell", ["click", "purchase", "view"])


@query("SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
def matrix_zero_padded(spark, sf_dir):
    counted = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return matrices.zero_padded(counted, "c_custkey", load(spark, sf_dir, "customer"), "c_custkey").join(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("""WITH a AS (SELECT l_suppkey AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS k, n AS "a.n", bal AS "b.bal" FROM a FULL JOIN b ON a.k = b.k UNION ALL SELECT 'EWEIGHT', 1.0, 0.5""")
def matrices_merged(spark, sf_dir):
    a = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return matrices.merged({"a": a, "b": b}, "k", {"a": 1.0, "b": 0.5})


@query("SELECT l_linestatus, l_returnflag, kind, value FROM (SELECT l_linestatus, l_returnflag, 'quantity' AS kind, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY ALL UNION ALL SELECT l_linestatus, l_returnflag, 'n', count(*) FROM lineitem GROUP BY ALL)")
def matrix_to_groups(spark, sf_dir):
    """Wide to (group, value) rows, as for a box plot."""
    wide = load(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))
    return wide.unpivot(["l_linestatus", "l_returnflag"], ["quantity", "n"], "kind", "value")


@query("SELECT l_orderkey, l_linestatus AS strand, l_partkey FROM lineitem WHERE (l_linestatus = 'O' AND l_returnflag = 'N') OR (l_linestatus = 'F' AND l_returnflag <> 'N')")
def matrix_by_strand(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), "l_partkey", "l_returnflag")
    out = matrices.by_strand(rows.where("l_returnflag = 'N'").drop("l_returnflag"), rows.where("l_returnflag <> 'N'").drop("l_returnflag"))
    return out.withColumn("strand", F.when(F.col("strand") == "+", "O").otherwise("F"))

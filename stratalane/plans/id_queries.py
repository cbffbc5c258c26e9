"""Identifier operators over orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.operators import ids
from stratalane.plans.catalog import query
from stratalane.session import load

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINES = ", ".join(LINE)


def _economy(spark, sf_dir):
    return load(spark, sf_dir, "part").where(F.col("p_type").startswith("ECONOMY")).select("p_partkey")


@query(f"SELECT {LINES} FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'ECONOMY%')")
def ids_semi(spark, sf_dir):
    return ids.by_ids(load(spark, sf_dir, "lineitem").select(*LINE), "l_partkey", _economy(spark, sf_dir), "p_partkey")


@query(f"SELECT {LINES} FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type LIKE 'ECONOMY%')")
def ids_anti(spark, sf_dir):
    return ids.by_ids(load(spark, sf_dir, "lineitem").select(*LINE), "l_partkey", _economy(spark, sf_dir), "p_partkey", anti=True)


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'ECONOMY%') GROUP BY l_returnflag")
def ids_semi_counts(spark, sf_dir):
    rows = ids.by_ids(load(spark, sf_dir, "lineitem"), "l_partkey", _economy(spark, sf_dir), "p_partkey")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


WORDS = "w AS (SELECT p_partkey, p_name, unnest(string_split(lower(p_name), ' ')) AS w FROM part), l AS (SELECT min(w) AS w FROM w UNION SELECT max(w) FROM w UNION SELECT 'blue')"


def _word_list(spark, sf_dir):
    words = load(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return words.agg(F.min("w").alias("w")).union(words.agg(F.max("w"))).union(spark.createDataFrame([(" BLUE ",)], "w string"))


@query(f"WITH {WORDS} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM w WHERE w IN (SELECT w FROM l))")
def ids_semi_multivalue(spark, sf_dir):
    return ids.by_ids(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _word_list(spark, sf_dir), "w", sep=" ")


@query(f"WITH {WORDS} SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM w WHERE w IN (SELECT w FROM l))")
def ids_anti_multivalue(spark, sf_dir):
    return ids.by_ids(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _word_list(spark, sf_dir), "w", anti=True, sep=" ")


@query(f"WITH {WORDS} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM w WHERE w NOT IN (SELECT w FROM l))")
def ids_anti_any_absent(spark, sf_dir):
    return ids.by_ids(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _word_list(spark, sf_dir), "w", anti=True, sep=" ", any_absent=True)


@query("SELECT p_partkey, p_name, 1000000 - p_partkey AS ordinal FROM part WHERE p_type LIKE 'ECONOMY%'")
def ids_in_list_order(spark, sf_dir):
    listed = _economy(spark, sf_dir).select(F.col("p_partkey").alias("id"), (1000000 - F.col("p_partkey")).alias("place"))
    return ids.in_order_of(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", listed, "id", "place")


@query("SELECT CASE WHEN p_size > 25 THEN 'new' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS p_partkey FROM part")
def ids_remapped(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    mapping = part.where("p_size > 25").select(F.col("p_partkey").alias("old"), F.concat(F.lit("new"), F.col("p_partkey").cast("string")).alias("new"))
    return ids.remap(part.select("p_partkey"), "p_partkey", mapping, "old", "new")


JOIN = "orders o {how} JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey"


def _joined(spark, sf_dir, how, **more):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return ids.join_by_ids(orders, customers, "o_custkey", "c_custkey", how, **more)


@query(f"SELECT o_orderkey, o_custkey, c_name FROM {JOIN.format(how='')}")
def ids_join_inner(spark, sf_dir):
    return _joined(spark, sf_dir, "inner")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, coalesce(c_name, '-') AS c_name FROM {JOIN.format(how='LEFT')}")
def ids_join_left_filled(spark, sf_dir):
    return _joined(spark, sf_dir, "left", fill="-")


@query(f"SELECT coalesce(CAST(o_orderkey AS VARCHAR), '-') AS o_orderkey, CAST(c_custkey AS VARCHAR) AS o_custkey, c_name FROM {JOIN.format(how='RIGHT')}")
def ids_join_right_filled(spark, sf_dir):
    return _joined(spark, sf_dir, "right", fill="-")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def ids_join_unpaired(spark, sf_dir):
    return _joined(spark, sf_dir, "anti")


@query("SELECT n.n_nationkey, r.r_name FROM nation n JOIN (SELECT upper(r_name) AS k, r_name FROM region) r ON lower(r.k) = lower((SELECT r_name FROM region WHERE r_regionkey = n.n_regionkey))")
def ids_join_without_case(spark, sf_dir):
    region = load(spark, sf_dir, "region")
    left = load(spark, sf_dir, "nation").join(region.select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("k")), "n_regionkey").select("n_nationkey", "k")
    return ids.join_by_ids(left, region.select(F.upper("r_name").alias("key"), "r_name"), "k", "key", case=False).select("n_nationkey", "r_name")


PARTS = """k AS (SELECT p_partkey FROM part), a AS (SELECT l_partkey AS id, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_partkey AS id, count(*) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
s AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_size > 10)"""


def _three(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    counted = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy("id").agg(F.count("*").alias("v"))
    return {"a": counted("A"), "n": counted("N"), "s": load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))}


@query(f"WITH {PARTS} SELECT CAST(id AS VARCHAR) AS id, coalesce(CAST(a.v AS VARCHAR), 'NA') AS a, coalesce(CAST(n.v AS VARCHAR), 'NA') AS n, coalesce(CAST(s.v AS VARCHAR), 'NA') AS s FROM a FULL JOIN n USING (id) FULL JOIN s USING (id)")
def ids_multi_join_outer(spark, sf_dir):
    return ids.multi_join(_three(spark, sf_dir), "id", "v", fill="NA")


@query(f"WITH {PARTS} SELECT CAST(id AS VARCHAR) AS id, CAST(a.v AS VARCHAR) AS a, CAST(n.v AS VARCHAR) AS n, CAST(s.v AS VARCHAR) AS s FROM a JOIN n USING (id) JOIN s USING (id)")
def ids_multi_join_common(spark, sf_dir):
    return ids.multi_join(_three(spark, sf_dir), "id", "v", common=True)


SPELLED = "CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END"


@query(f"SELECT arg_min({SPELLED}, o_orderkey) AS id, min(o_orderkey) AS ordinal FROM orders GROUP BY lower(o_orderpriority)")
def ids_unique(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("p"), "o_orderkey")
    return ids.unique_ids(rows, "p", "o_orderkey")


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def ids_duplicated(spark, sf_dir):
    return ids.duplicated_ids(load(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def ids_common_to_both(spark, sf_dir):
    return ids.common_to_both(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def ids_only_left(spark, sf_dir):
    return ids.only_left(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


def _key_columns(spark, sf_dir):
    return [(load(spark, sf_dir, t), c) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_custkey"))]


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer INTERSECT SELECT CAST(s_suppkey AS VARCHAR) FROM supplier INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def ids_common_to_all(spark, sf_dir):
    return ids.common_to_all(_key_columns(spark, sf_dir))


@query("SELECT id FROM (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT CAST(o_custkey AS VARCHAR) FROM orders) GROUP BY id HAVING count(*) = 3")
def ids_common_by_occurrence(spark, sf_dir):
    return ids.common_to_all(_key_columns(spark, sf_dir), occurrences=True)


@query("SELECT l_partkey, l_orderkey, l_shipdate FROM lineitem")
def columns_cut(spark, sf_dir):
    return ids.columns_by_ids(load(spark, sf_dir, "lineitem"), ["L_PARTKEY", "l_orderkey", "nothing", " L_ShipDate"], missing_ok=True)


@query("SELECT l_orderkey, l_tax, l_discount FROM lineitem")
def columns_intersected(spark, sf_dir):
    return ids.columns_among(load(spark, sf_dir, "lineitem"), ["L_TAX", "absent", "l_discount"], first=2, reorder=True)


@query("SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def columns_differing(spark, sf_dir):
    return ids.columns_among(load(spark, sf_dir, "lineitem"), ["L_TAX", "absent", "l_discount"], first=2, keep=False)


@query("SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_orderpriority")
def members_listed(spark, sf_dir):
    """Members of a group as one string, in order."""
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ", ").alias("statuses"))

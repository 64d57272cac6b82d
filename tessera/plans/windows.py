"""Window functions, sorts, limits, partitioning and set operations (W, O and U rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rows
from tessera.registry import query, sql_query
from tessera.sources.tables import table

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("w01_spec", f"SELECT o_orderkey, row_number() {_W}) AS n FROM orders")
def spec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))


@query("w02_rows_between", f"SELECT o_orderkey, round(sum(o_totalprice) {_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
def rows_between(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"))


@query("w03_range_between", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
def range_between(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-2, 2)
    return table(spark, d, "part").select("p_partkey", F.count("*").over(w).alias("n"))


sql_query("w04_frames", "orders", f"SELECT o_orderkey, count(*) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, count(*) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, count(*) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, count(*) {_W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS f FROM orders")
sql_query("w05_default_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS running, count(*) OVER (PARTITION BY p_brand) AS whole FROM part")
sql_query("w08_to_w15_ranking", "orders", f"SELECT o_orderkey, row_number() {_W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 9) AS cd, ntile(3) {_W}) AS nt, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) {_W}) AS ld, lag(o_orderkey, 1) {_W}) AS lg FROM orders")
sql_query("w16_first_last_value", "orders", f"SELECT o_orderkey, first_value(o_orderkey) {_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f, last_value(o_orderkey) {_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM orders")
sql_query("w17_rows_aggregates", "orders", f"SELECT o_orderkey, round(avg(o_totalprice) {_W} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 4) AS a, max(o_totalprice) {_W} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS m FROM orders")
sql_query("w18_range_aggregates", "part", "SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM part")
sql_query("w19_range_descending", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM part")
sql_query("w20_named_window", "customer", "SELECT c_custkey, rank() OVER w AS r, round(sum(c_acctbal) OVER w, 2) AS s FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
sql_query("w21_distribute_by", "customer", "SELECT c_custkey, row_number() OVER (DISTRIBUTE BY c_nationkey SORT BY c_acctbal, c_custkey) AS n FROM customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer")
sql_query("w22_two_partitionings", "customer", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS a, count(*) OVER (PARTITION BY c_mktsegment) AS b FROM customer")

sql_query("o01_global_sort", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")


@query("o02_local_sort", "SELECT c_custkey FROM customer")
def local_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").sortWithinPartitions("c_acctbal").select("c_custkey")


sql_query("o03_distribute_by", "customer", "SELECT c_custkey FROM customer DISTRIBUTE BY c_nationkey", "SELECT c_custkey FROM customer")
sql_query("o04_cluster_by", "customer", "SELECT c_custkey, c_nationkey FROM customer CLUSTER BY c_nationkey", "SELECT c_custkey, c_nationkey FROM customer")
sql_query("o05_limit", "customer", "SELECT count(*) AS n FROM (SELECT * FROM (SELECT * FROM customer LIMIT 20) LIMIT 12)")
sql_query("o06_top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


@query("o07_top_by_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_by_key(spark: SparkSession, d: str) -> DataFrame:
    return rows.top_by_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("o08_take", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 2")
def take(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(table(spark, d, "region").orderBy("r_regionkey").take(2), "r_regionkey int, r_name string")


@query("o09_repartition", "SELECT CAST(6 AS BIGINT) AS parts, CAST(2 AS BIGINT) AS fewer, count(*) AS n FROM orders")
def repartition(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").repartition(6)
    fewer = t.coalesce(2)
    return t.agg(F.count("*").alias("n")).select(F.lit(t.rdd.getNumPartitions()).cast("long").alias("parts"), F.lit(fewer.rdd.getNumPartitions()).cast("long").alias("fewer"), "n")


@query("o11_repartition_and_sort", "SELECT l_orderkey, l_linenumber FROM lineitem")
def repartition_and_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


sql_query("o12_filter_by_range", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 300")


@query("o13_sliding", "SELECT n_nationkey, n_name || ',' || lead(n_name, 1) OVER (ORDER BY n_nationkey) || ',' || lead(n_name, 2) OVER (ORDER BY n_nationkey) AS w FROM nation QUALIFY lead(n_name, 2) OVER (ORDER BY n_nationkey) IS NOT NULL")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return rows.sliding(table(spark, d, "nation"), "n_nationkey", "n_name", 3).select("n_nationkey", F.array_join("window", ",").alias("w"))


@query("o13_zip_with_index", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation")
def zip_with_index(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey")
    return t.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("n_nationkey int, i long")


sql_query("u01_union_all", "customer supplier", "SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
sql_query("u02_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("u03_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql_query("u04_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
sql_query("u06_union_chain", "region nation", "SELECT r_name AS s FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")


@query("u07_subtract_keeps_no_copies", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def subtract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, d, "supplier").select("s_suppkey"))

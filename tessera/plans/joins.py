"""Joins (J rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import intervals, rows
from tessera.operators.lineage import scratch
from tessera.registry import query, sql_query
from tessera.sources.tables import table


@query("j01_broadcast_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("j02_broadcast_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def outer(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j03_sort_merge_inner", "SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def sort_merge(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    return o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


_FULL = "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 7"


@query("j04_sort_merge_full", _FULL)
def full(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") * 7)
    return table(spark, d, "customer").hint("merge").join(s, F.col("c_custkey") == F.col("k"), "full").select("c_custkey", "s_suppkey")


@query("j05_semi_broadcast", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_regionkey = 1")
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("j06_semi_shuffled_hash", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def semi_hash(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_quantity > 49").select("l_orderkey").hint("shuffle_hash")
    return table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("j07_semi_theta", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > s_nationkey + 20)")
def semi_theta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") > F.col("s_nationkey") + 20, "left_semi").select("s_suppkey")


@query("j08_nested_loop_outer", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_nationkey < r_regionkey - 1")
def nested_loop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") < F.col("r_regionkey") - 1, "left").select("r_name", "n_name")


@query("j09_cartesian", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cartesian(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    return r.select(F.col("r_name").alias("a")).crossJoin(r.select(F.col("r_name").alias("b")))


sql_query("j11_right_outer", "customer nation", "SELECT n_name, c_custkey FROM customer RIGHT OUTER JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000")


@query("j11_left_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


sql_query("j12_equi_key_residual", "orders lineitem", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 100 DAY")
#: Each document with the number of documents of its label; those without one are a label of their own.
_OWN_LABEL = "SELECT doc_id, n FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) a JOIN (SELECT l.toxic, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY l.toxic) b ON a.toxic {} b.toxic"
sql_query("j12_null_safe_key", "labels documents", _OWN_LABEL.format("<=>"), _OWN_LABEL.format("IS NOT DISTINCT FROM"))
sql_query("j13_using_full", "documents labels", "SELECT doc_id, lang, toxic FROM documents FULL JOIN labels USING (doc_id)")
sql_query("j14_self_join", "nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("j15_broadcast_hint", "supplier nation", "SELECT /*+ BROADCAST(nation) */ s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")


@query("j16_binary_key", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON md5(a.p_name) = md5(b.p_name)")
def binary_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a name are joined 128 at a time and spread out afterwards: all pairs, in an order that Parquet's pages store in a fraction of a byte each.

    The lists' pairs, each 2 KB that become up to 16,384 rows, are dealt out first, so that all cores get like shares, whatever the names.
    """
    p = table(spark, d, "part").select(F.struct("p_partkey").alias("p"), F.unhex(F.md5("p_name")).alias("k")).filter("k is not null")
    place = F.row_number().over(Window.partitionBy("k").orderBy("p"))
    some = p.withColumn("c", F.floor((place - 1) / 128)).groupBy("k", "c").agg(F.collect_list("p").alias("p"))
    some = some.select("k", "c", F.transform("p", lambda x: x["p_partkey"]).alias("p"))  # collect_list of the keys themselves would lose null
    pairs = some.select("k", F.col("c").alias("i"), F.col("p").alias("a")).join(some.select("k", F.col("c").alias("j"), F.col("p").alias("b")), "k")
    # by range: a share has few different keys, so its file's dictionary holds them; a number is given, since by bytes alone the shares would be merged
    pairs = pairs.repartitionByRange(8 * spark.sparkContext.defaultParallelism, "k", "i", "j")
    return pairs.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))


sql_query("j17_left_semi_sql", "customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'F')")


@query("j17_merge", "SELECT a.n_nationkey, a.n_name AS n_name_x, b.n_name AS n_name_y, a.n_regionkey AS n_regionkey_x, b.n_regionkey AS n_regionkey_y FROM nation a JOIN nation b USING (n_nationkey)")
def merge(spark: SparkSession, d: str) -> DataFrame:
    return rows.merge(table(spark, d, "nation"), table(spark, d, "nation"), ["n_nationkey"])


sql_query("j18_full_outer_sql", "customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
sql_query("j19_mapjoin_hint", "customer nation", "SELECT /*+ MAPJOIN(n) */ c_custkey, n.n_regionkey FROM customer JOIN nation n ON c_nationkey = n.n_nationkey")


@query("j20_join_with", "SELECT r_name AS a, n_name AS b FROM region JOIN nation ON r_regionkey = n_regionkey")
def join_with(spark: SparkSession, d: str) -> DataFrame:
    pairs = rows.join_with(table(spark, d, "region"), table(spark, d, "nation"), F.col("_1.r_regionkey") == F.col("_2.n_regionkey"))
    return pairs.select(F.col("_1.r_name").alias("a"), F.col("_2.n_name").alias("b"))


@query("j21_cogroup", "SELECT k AS n_regionkey, coalesce(c, 0) AS nations, coalesce(s, 0) AS region_rows FROM (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY 1) FULL JOIN (SELECT r_regionkey AS k, count(*) AS s FROM region GROUP BY 1) USING (k)")
def cogroup(spark: SparkSession, d: str) -> DataFrame:
    def both(key, a, b):
        import pandas as pd

        return pd.DataFrame({"n_regionkey": [key[0]], "nations": [len(a)], "region_rows": [len(b)]})

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.groupBy("n_regionkey").cogroup(r.groupBy("r_regionkey")).applyInPandas(both, "n_regionkey int, nations long, region_rows long")


@query("j23_subtract_by_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def subtract_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(
    "j24_as_of",
    "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts - INTERVAL 9000 DAY + INTERVAL 10 HOUR AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate",
)
def as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.expr("ts - interval 9000 day + interval 10 hour").alias("at"))
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return intervals.as_of_join(e, o, "k", "o_custkey", "at", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("j24_interval", "SELECT p_partkey, lo FROM part JOIN (SELECT DISTINCT floor(p_retailprice / 50) * 50 AS lo FROM part) b ON p_retailprice >= lo AND p_retailprice < lo + 75")
def interval(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    b = p.select((F.floor(F.col("p_retailprice") / 50) * 50).cast("double").alias("lo")).distinct().withColumn("hi", F.col("lo") + 75)
    return intervals.point_in_interval(p, b, "p_retailprice", "lo", "hi", 75.0).select("p_partkey", "lo")


@query("j25_bucketed", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Both tables are written in buckets of the key, so that the join and the sum need no exchange."""
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
        table(spark, d, name).select(key).write.option("path", scratch(spark, name)).bucketBy(8, key).sortBy(key).saveAsTable(f"bucketed_{name}")
    a, b = spark.table("bucketed_lineitem").hint("merge"), spark.table("bucketed_orders")
    return a.join(b, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"))

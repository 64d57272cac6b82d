"""Aggregations (A rows of the survey)."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import grouping, rows
from tessera.registry import query, sql_query
from tessera.sources.tables import table

sql_query("a01_hash_aggregate", "lineitem", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q, max(l_shipdate) AS last FROM lineitem GROUP BY l_suppkey")
sql_query("a02_sort_aggregate", "orders", "SELECT o_custkey, max(o_orderpriority) AS p, min(o_orderstatus) AS s FROM orders GROUP BY o_custkey")
sql_query("a04_single_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, round(sum(l_tax), 4) AS t FROM lineitem GROUP BY l_returnflag")
sql_query("a06_multi_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(DISTINCT l_orderkey) AS o FROM lineitem GROUP BY l_returnflag")
sql_query("a07_global", "lineitem", "SELECT count(*) AS n, sum(l_linenumber) AS s, max(l_tax) AS m FROM lineitem WHERE l_quantity < 0")
sql_query("a07_grouped_empty", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")


@query("a08_grouped_data", "SELECT c_mktsegment, max(c_acctbal) AS \"max(c_acctbal)\", count(c_custkey) AS \"count(c_custkey)\" FROM customer GROUP BY c_mktsegment")
def grouped_data(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg({"c_acctbal": "max", "c_custkey": "count"})


@query("a09_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a10_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


sql_query("a11_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query("a12_grouping_presence", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST((1 - grouping(l_returnflag)) + 2 * (1 - grouping(l_linestatus)) AS BIGINT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_presence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), rows.grouping_presence("l_returnflag", "l_linestatus").alias("gid"))


@query("a13_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a13_pivot_two", "SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS \"F_hi\", min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS \"F_lo\", max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS \"O_hi\", min(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS \"O_lo\" FROM orders GROUP BY o_orderpriority")
def pivot_two(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))


sql_query("a14_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("a15_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@query("a15_drop_duplicates", "SELECT n_regionkey, count(*) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) GROUP BY 1")
def drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").dropDuplicates(["n_regionkey"]).groupBy("n_regionkey").agg(F.count("*").alias("n"))


sql_query("a16_count", "documents labels", "SELECT count(*) AS n, count(toxic) AS t, count(DISTINCT lang) AS l FROM documents LEFT JOIN labels USING (doc_id)")
sql_query("a17_sum", "lineitem", "SELECT sum(l_linenumber) AS i, round(sum(l_quantity), 2) AS d, sum(CAST(l_tax AS DECIMAL(10,2))) AS x FROM lineitem")
sql_query("a18_avg", "lineitem", "SELECT l_linestatus, round(avg(l_quantity), 6) AS q, round(avg(l_linenumber), 6) AS n FROM lineitem GROUP BY l_linestatus")
sql_query("a19_min_max", "orders", "SELECT min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS c, max(o_totalprice) AS d FROM orders")


@query("a20_first_last", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS f, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS l FROM orders GROUP BY o_custkey")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    """first and last by an order, as minima and maxima: combined map-side and free of chance."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("f"), F.max_by("o_orderkey", at).alias("l"))


sql_query("a21_distinct_sums", "lineitem", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, count(DISTINCT l_linenumber, l_linestatus) AS c FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, count(DISTINCT (l_linenumber, l_linestatus)) AS c FROM lineitem GROUP BY l_returnflag")


@query("a22_approx_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS e, true AS near FROM lineitem GROUP BY 1")
def approx(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("e"))
    return t.select("l_returnflag", "e", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("near"))


sql_query("a23_stddev", "lineitem", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p FROM lineitem GROUP BY l_returnflag")
sql_query("a24_variance", "lineitem", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS p FROM lineitem GROUP BY l_returnflag")
sql_query(
    "a25_higher_moments", "lineitem", "SELECT round(skewness(l_extendedprice), 6) AS s, round(kurtosis(l_extendedprice), 6) AS k FROM lineitem",
    "WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem) SELECT round(avg(pow(l_extendedprice - a, 3)) / pow(avg(pow(l_extendedprice - a, 2)), 1.5), 6) AS s, round(avg(pow(l_extendedprice - a, 4)) / pow(avg(pow(l_extendedprice - a, 2)), 2) - 3, 6) AS k FROM lineitem, m",
)


@query("a25_nan_moments", "SELECT o_custkey, count(*) = 1 AS nan, round(var_samp(o_totalprice), 2) AS v, count(*) = 1 OR max(o_totalprice) = min(o_totalprice) AS flat FROM orders GROUP BY 1")
def nan_moments(spark: SparkSession, d: str) -> DataFrame:
    """The variance of one value, and the skewness of equal values, are NaN in the older API."""
    v, s = grouping.nan_moments("variance", "o_totalprice"), grouping.nan_moments("skewness", "o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.isnan(v).alias("nan"), F.round(F.when(~F.isnan(v), v), 2).alias("v"), F.isnan(s).alias("flat"))


sql_query("a26_corr", "lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem")


@query("a27_collect", "SELECT n_regionkey, CAST(list_sort(list(n_name)) AS VARCHAR) IS NOT NULL AS x, len(list(n_name)) AS n, len(list(DISTINCT n_regionkey)) AS s FROM nation GROUP BY 1")
def collect(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"), F.collect_set("n_regionkey").alias("s"))
    return g.select("n_regionkey", F.col("l").isNotNull().alias("x"), F.size("l").alias("n"), F.size("s").alias("s"))


sql_query("a28_covariance", "lineitem", "SELECT round(covar_pop(l_quantity, l_tax), 6) AS p, round(covar_samp(l_quantity, l_tax), 6) AS s FROM lineitem")
sql_query("a29_percentile", "lineitem", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS m, round(percentile(l_extendedprice, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS m, round(quantile_cont(l_extendedprice, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag")
sql_query("a29_percentile_approx", "lineitem", "SELECT l_returnflag, percentile_approx(l_quantity, 0.5, 100000) AS m, percentile_approx(l_extendedprice, 0.25, 10000000) AS p FROM lineitem GROUP BY 1", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS m, quantile_disc(l_extendedprice, 0.25) AS p FROM lineitem GROUP BY 1")


@query("a30_histogram_numeric", "SELECT l_returnflag, l_linenumber AS x, count(*) AS y FROM lineitem GROUP BY 1, 2")
def histogram_numeric(spark: SparkSession, d: str) -> DataFrame:
    return grouping.numeric_histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", 20)


@query("a31_ngrams", "WITH w AS (SELECT n_nationkey, string_split(replace(n_name || ' of the ' || n_name, '_', 'x'), ' ') AS a FROM nation) SELECT a[i] || ' ' || a[i+1] AS g, count(*) AS frequency FROM w, range(1, 20) r(i) WHERE i < len(a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.replace(F.concat("n_name", F.lit(" of the "), "n_name"), F.lit("_"), F.lit("x")).alias("t"))
    return grouping.ngrams(t, "t", 2, 5).select(F.array_join("ngram", " ").alias("g"), "frequency")


@query("a31_context_ngrams", "SELECT replace(n_name, '_', 'x') AS g, CAST(1 AS BIGINT) AS frequency FROM nation ORDER BY 1 LIMIT 4")
def context_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.replace(F.concat(F.lit("from "), "n_name", F.lit(" on")), F.lit("_"), F.lit("x")).alias("t"))
    return grouping.context_ngrams(t, "t", ["from", None, "on"], 4).select(F.array_join("ngram", " ").alias("g"), "frequency")


@query("a32_stat_cov_corr", "SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def stat(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return spark.createDataFrame([(round(t.stat.cov("l_quantity", "l_extendedprice"), 4), round(t.stat.corr("l_quantity", "l_extendedprice"), 6))], "cov double, corr double")


@query("a33_crosstab", "SELECT l_returnflag AS l_returnflag_l_linestatus, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").crosstab("l_returnflag", "l_linestatus")


@query("a34_freq_items", "SELECT 'flag' AS c, l_returnflag AS v FROM lineitem GROUP BY 2 HAVING count(*) >= 0.2 * (SELECT count(*) FROM lineitem) UNION ALL SELECT 'priority', o_orderpriority FROM orders GROUP BY 2 HAVING count(*) >= 0.19 * (SELECT count(*) FROM orders)")
def freq_items(spark: SparkSession, d: str) -> DataFrame:
    """freqItems misses no frequent item but may list others; those are taken out by counting what it lists."""

    def exact(df: DataFrame, c: str, support: float, label: str) -> DataFrame:
        listed = df.freqItems([c], support).select(F.explode(f"{c}_freqItems").alias("v"))
        counts = df.join(F.broadcast(listed), F.col(c) == F.col("v")).groupBy("v").agg(F.count("*").alias("n"))
        return counts.crossJoin(df.agg(F.count("*").alias("all"))).filter(F.col("n") >= support * F.col("all")).select(F.lit(label).alias("c"), "v")

    return exact(table(spark, d, "lineitem"), "l_returnflag", 0.2, "flag").union(exact(table(spark, d, "orders"), "o_orderpriority", 0.19, "priority"))


@query("a35_typed_aggregate", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS w FROM lineitem GROUP BY 1")
def typed(spark: SparkSession, d: str) -> DataFrame:
    weighted = grouping.Aggregator(
        zero=lambda: (0.0, 0.0),
        reduce=lambda b, rows: (b[0] + float((rows.l_extendedprice * rows.l_quantity).sum()), b[1] + float(rows.l_quantity.sum())),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        finish=lambda b: round(b[0] / b[1], 4) if b[1] else None,
    )
    return grouping.typed_aggregate(table(spark, d, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"], weighted, "w double")


@query("a36_map_groups", "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def map_groups(spark: SparkSession, d: str) -> DataFrame:
    def run(key, g):
        return pd.DataFrame({"n_regionkey": [key[0]], "n": [len(g)], "last": [g.n_name.max()]})

    return table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(run, "n_regionkey int, n long, last string")


sql_query("a37_reduce_by_key", "events", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS s, max(value) AS m FROM events GROUP BY event_type")
sql_query("a38_numeric_stats", "events", "SELECT count(value) AS n, round(sum(value), 3) AS s, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stdev, round(var_samp(value), 6) AS sv FROM events")


@query("a39_histogram", "SELECT CAST(b AS INTEGER) AS bucket, count(l_quantity) AS n FROM range(0, 5) r(b) LEFT JOIN lineitem ON l_quantity >= 5 + b * 9 AND (l_quantity < 14 + b * 9 OR (b = 4 AND l_quantity = 50)) GROUP BY b")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return grouping.histogram(table(spark, d, "lineitem"), "l_quantity", grouping.even_buckets(5.0, 50.0, 5))


@query("a40_approximate_actions", "SELECT count(*) AS n FROM orders")
def approximate_actions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").rdd.countApprox(60_000, 0.95)
    return spark.createDataFrame([(int(n),)], "n long")


@query("a41_tree_aggregate", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem")
def tree_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A tree of sums: by (slice, place) first, then by slice, then all."""
    t = table(spark, d, "lineitem").select("l_linenumber", F.pmod(F.hash("l_orderkey"), F.lit(16)).alias("slice"))
    return t.groupBy("slice").agg(F.sum("l_linenumber").alias("s")).agg(F.sum("s").alias("s"))

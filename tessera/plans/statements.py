"""SQL statements and the catalog (D rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import scratch
from tessera.registry import query, sql_query
from tessera.sources.tables import table, views


@query("d01_set", "SELECT n_name, '3' AS value FROM nation WHERE n_regionkey = 3")
def set_statement(spark: SparkSession, d: str) -> DataFrame:
    """A variable is set, read back and put in place of its name."""
    views(spark, d, "nation").sql("SET spark.tessera.example=3")
    value = spark.sql("SET spark.tessera.example").first().value
    return spark.sql("SELECT n_name FROM nation WHERE n_regionkey = ${spark.tessera.example}").withColumn("value", F.lit(value))


@query("d02_cache_table", "SELECT count(*) AS n, true AS cached, true AS gone FROM nation")
def cache_table(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "nation").sql("CACHE LAZY TABLE kept_nation AS SELECT * FROM nation")
    n, cached = spark.table("kept_nation").count(), spark.catalog.isCached("kept_nation")
    spark.sql("UNCACHE TABLE kept_nation")
    gone = not spark.catalog.isCached("kept_nation")
    spark.catalog.dropTempView("kept_nation")
    return spark.createDataFrame([(n, cached, gone)], "n long, cached boolean, gone boolean")


@query("d03_explain", "SELECT column_name AS name FROM (DESCRIBE customer) WHERE column_name IN ('c_custkey', 'c_acctbal')")
def explain(spark: SparkSession, d: str) -> DataFrame:
    """The columns that the plan says it reads."""
    plan = views(spark, d, "customer").sql("EXPLAIN SELECT c_custkey FROM customer WHERE c_acctbal > 0")
    return plan.select(F.explode(F.regexp_extract_all("plan", F.lit("[<,]([a-z_]+):"), F.lit(1))).alias("name"))


@query("d04_describe", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(col_name, data_type)")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d, "region").sql("DESCRIBE region").select("col_name", "data_type")


@query("d05_show_tables", "SELECT table_name AS name, true AS temporary FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')")
def show_tables(spark: SparkSession, d: str) -> DataFrame:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    shown = views(spark, d, *names).sql("SHOW TABLES").filter(F.col("tableName").isin(names))
    return shown.select(F.col("tableName").alias("name"), F.col("isTemporary").alias("temporary"))


@query("d06_describe_function", "SELECT r_regionkey, upper(r_name) AS x, true AS told FROM region")
def describe_function(spark: SparkSession, d: str) -> DataFrame:
    """The function that is listed under a pattern is described, and called by the name found."""
    name = spark.sql("SHOW USER FUNCTIONS LIKE 'shout*'").count() == 0 and spark.sql("SHOW FUNCTIONS LIKE 'upper'").first()[0]
    told = any(name in r[0] for r in spark.sql(f"DESCRIBE FUNCTION {name}").collect())
    return table(spark, d, "region").select("r_regionkey", F.call_function(name, "r_name").alias("x"), F.lit(told).alias("told"))


def _fresh(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


@query("d07_create_table_using", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def create_table(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "nation")
    _fresh(spark, "made_using")
    spark.sql(f"CREATE TABLE made_using USING parquet LOCATION '{scratch(spark, 'made')}' AS SELECT n_name FROM nation WHERE n_regionkey = 2")
    return spark.table("made_using")


@query("d07_temporary_view_using", "SELECT * FROM region")
def temporary_view(spark: SparkSession, d: str) -> DataFrame:
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW over_file USING parquet OPTIONS (path '{d}/region.parquet')")
    return spark.table("over_file")


@query("d08_refresh", "SELECT n_name, 2 AS copies FROM nation")
def refresh(spark: SparkSession, d: str) -> DataFrame:
    """Files that were added behind the catalog's back are seen once the table is refreshed."""
    _fresh(spark, "grown")
    path = scratch(spark, "grown")
    t = table(spark, d, "nation").select("n_name")
    t.write.parquet(path)
    spark.sql(f"CREATE TABLE grown (n_name STRING) USING parquet LOCATION '{path}'")
    assert spark.table("grown").count() == t.count()
    t.write.mode("append").parquet(path)
    spark.sql("REFRESH TABLE grown")
    return spark.sql("SELECT n_name, CAST(count(*) AS INT) AS copies FROM grown GROUP BY n_name")


@query("d09_create_view", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def create_view(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "customer").sql("CREATE OR REPLACE TEMPORARY VIEW in_debt AS SELECT c_custkey FROM customer WHERE c_acctbal < 0")
    return spark.sql("SELECT * FROM in_debt")


@query("d10_analyze", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS kinds, min(c_custkey) AS least, max(c_custkey) AS most FROM customer")
def analyze(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that the catalog keeps of a table and its columns."""
    _fresh(spark, "measured")
    table(spark, d, "customer").write.option("path", scratch(spark, "measured")).saveAsTable("measured")
    spark.sql("ANALYZE TABLE measured COMPUTE STATISTICS FOR ALL COLUMNS")
    told = spark.sql("DESCRIBE EXTENDED measured").filter("col_name = 'Statistics'").select(F.regexp_extract("data_type", "([0-9]+) rows", 1).cast("long").alias("n"))
    of = lambda c, what: spark.sql(f"DESCRIBE EXTENDED measured {c}").filter(F.col("info_name") == what).select(F.col("info_value").cast("long"))
    parts = [told, of("c_mktsegment", "distinct_count").toDF("kinds"), of("c_custkey", "min").toDF("least"), of("c_custkey", "max").toDF("most")]
    return spark.createDataFrame([tuple(p.first()[0] for p in parts)], "n long, kinds long, least long, most long")


@query("d11_drop_table", "SELECT 'place_' || r_regionkey AS name FROM region WHERE r_regionkey <> 2")
def drop_table(spark: SparkSession, d: str) -> DataFrame:
    """A table for each region, of which one is dropped."""
    keys = [r.r_regionkey for r in table(spark, d, "region").select("r_regionkey").collect()]
    for k in keys:
        _fresh(spark, f"place_{k}")
        table(spark, d, "region").filter(F.col("r_regionkey") == k).write.option("path", scratch(spark, "place")).saveAsTable(f"place_{k}")
    spark.sql("DROP TABLE place_2")
    left = [(f"place_{k}",) for k in keys if spark.catalog.tableExists(f"place_{k}")]
    return spark.createDataFrame(left, "name string")


sql_query("d12_cte", "orders customer", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), who AS (SELECT DISTINCT o_custkey FROM big) SELECT c_custkey FROM customer JOIN who ON c_custkey = o_custkey")
sql_query("d13_derived_table", "lineitem", "SELECT f, n FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY l_returnflag) t WHERE n > 10")
sql_query("d14_in_exists", "customer orders nation", "SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice < 5000)")
sql_query("d14_scalar_subquery", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
sql_query("d_multi_way", "customer orders lineitem nation region", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY n_name")

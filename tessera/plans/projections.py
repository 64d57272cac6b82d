"""Projections, filters, predicates, sampling and other row operators (P rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rows
from tessera.registry import query, sql_query
from tessera.sources.tables import table


@query("p01_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag FROM lineitem")
def project(spark: SparkSession, d: str) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), F.upper("l_returnflag").alias("flag"))


@query("p02_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03 AND l_returnflag = 'R'")
def filters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.filter((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("p03_with_columns", "SELECT c_custkey, c_name AS customer, c_nationkey, round(c_acctbal * 2, 2) AS doubled FROM customer")
def with_columns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").withColumn("doubled", F.round(F.col("c_acctbal") * 2, 2))
    return t.withColumnRenamed("c_name", "customer").drop("c_acctbal", "c_mktsegment")


sql_query("p04_star", "nation region", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")


@query("p05_multi_alias", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(n AS INTEGER) AS pos FROM events, (VALUES (0), (1)) v(n)")
def multi_alias(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("pos", "letter"))
    return e.drop("letter")


sql_query(
    "p06_literals", "region",
    "SELECT r_regionkey, 1 AS i, CAST(2.5 AS DOUBLE) AS d, CAST('1.25' AS DECIMAL(10,2)) AS dec, DATE '2016-01-04' AS day, 'x' AS s, true AS b, CAST(NULL AS INT) AS n FROM region",
)


@query(
    "p07_cast",
    "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CASE WHEN CAST(o_totalprice AS BIGINT) > o_totalprice THEN 1 ELSE 0 END AS whole, CAST(o_orderkey AS VARCHAR) AS s, TRY_CAST(o_orderpriority AS INTEGER) AS bad, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("bigint").alias("whole"), F.col("o_orderkey").cast("string").alias("s"), F.col("o_orderpriority").try_cast("int").alias("bad"), F.col("o_orderdate").cast("date").alias("day")
    )


@query(
    "p08_arithmetic",
    "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS a, round(l_quantity - l_tax, 6) AS s, round(l_quantity * l_tax, 6) AS m, round(l_quantity / l_linenumber, 6) AS q, l_orderkey % 7 AS r, -l_linenumber AS neg, CASE WHEN l_linenumber = 1 THEN NULL ELSE round(l_quantity / (l_linenumber - 1), 6) END AS z FROM lineitem",
)
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    q, t, n = F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(q + t, 6).alias("a"), F.round(q - t, 6).alias("s"), F.round(q * t, 6).alias("m"), F.round(q / n, 6).alias("q"), (F.col("l_orderkey") % 7).alias("r"), (-n).alias("neg"), F.round(F.try_divide(q, n - 1), 6).alias("z")
    )


sql_query("p09_div_pmod", "orders", "SELECT o_orderkey, o_orderkey div 7 AS q, pmod(o_orderkey - 500, 7) AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, (((o_orderkey - 500) % 7) + 7) % 7 AS m FROM orders")
sql_query("p10_bitwise", "orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS o, o_orderkey ^ 12 AS x, ~o_orderkey AS n FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS o, xor(o_orderkey, 12) AS x, ~o_orderkey AS n FROM orders")
sql_query("p11_comparison", "customer", "SELECT c_custkey, c_acctbal = 0 AS eq, c_acctbal <> 0 AS ne, c_acctbal < 100 AS lt, c_acctbal <= 100 AS le, c_acctbal > 5000 AS gt, c_acctbal >= 5000 AS ge FROM customer")
sql_query("p12_null_safe_equal", "labels documents", "SELECT d.doc_id, l.toxic <=> NULL AS missing, l.toxic <=> 1 AS one FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, l.toxic IS NOT DISTINCT FROM NULL AS missing, l.toxic IS NOT DISTINCT FROM 1 AS one FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql_query("p13_three_valued", "labels documents", "SELECT d.doc_id, (l.toxic = 1) AND (d.n_chars > 500) AS a, (l.toxic = 1) OR (d.n_chars > 500) AS o, NOT (l.toxic = 1) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql_query("p14_in", "customer", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS a, c_nationkey IN (1, 2, NULL) AS b FROM customer")
sql_query("p15_between", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200")
sql_query("p16_like", "part", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_type LIKE '_T%' AS u, p_name RLIKE '^[a-m]' AS r FROM part", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_type LIKE '_T%' AS u, regexp_matches(p_name, '^[a-m]') AS r FROM part")


@query("p17_string_predicates", "SELECT p_partkey, contains(p_name, 'ar') AS c, starts_with(p_type, 'S') AS s, ends_with(p_brand, '3') AS e FROM part")
def string_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").contains("ar").alias("c"), F.col("p_type").startswith("S").alias("s"), F.col("p_brand").endswith("3").alias("e"))


@query("p18_null_tests", "SELECT d.doc_id, l.quality IS NULL AS missing, l.quality IS NOT NULL AS there, false AS nan FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_tests(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return t.select("doc_id", F.col("quality").isNull().alias("missing"), F.col("quality").isNotNull().alias("there"), F.isnan(F.col("quality").cast("double")).alias("nan"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("p19_at_least_n_non_nulls", f"SELECT * FROM {_LABELLED} WHERE CAST(quality IS NOT NULL AS INT) + CAST(toxic IS NOT NULL AS INT) + 2 >= 3")
def at_least(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).na.drop(thresh=3)


sql_query("p20_case", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS s, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS f, if(l_tax > 0.04, 'x', 'y') AS t FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS s, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS f, CASE WHEN l_tax > 0.04 THEN 'x' ELSE 'y' END AS t FROM lineitem")


@query("p21_coalesce", f"SELECT doc_id, coalesce(quality, toxic, -1) AS c, coalesce(quality, -2) AS n, CAST(7 AS DOUBLE) AS nv FROM {_LABELLED}")
def coalesce(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("c"), F.nvl("quality", F.lit(-2)).alias("n"), F.nanvl(F.lit(float("nan")), F.lit(7.0)).alias("nv"))


@query("p22_greatest_least", f"SELECT doc_id, greatest(quality, toxic, CAST(doc_id % 3 AS INT)) AS g, least(quality, toxic, CAST(doc_id % 3 AS INT)) AS l FROM {_LABELLED}")
def greatest(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("doc_id") % 3).cast("int")
    return _labelled(spark, d).select("doc_id", F.greatest("quality", "toxic", k).alias("g"), F.least("quality", "toxic", k).alias("l"))


@query("p23_item_access", "SELECT vec_id, embedding[1] AS first, embedding[10000] AS beyond, label AS field, CAST(NULL AS INT) AS missing FROM embeddings")
def item_access(spark: SparkSession, d: str) -> DataFrame:
    s = F.struct(F.col("label").alias("x"))
    return table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(9999)).alias("beyond"), s.getField("x").alias("field"), F.try_element_at(F.create_map(F.lit("a"), F.lit(1)), F.lit("b")).alias("missing"))


@query("p24_constructors", "SELECT n_nationkey, to_json([n_nationkey, n_regionkey]) AS a, to_json({'k': n_nationkey, 'n': n_name}) AS s FROM nation")
def constructors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.array("n_nationkey", "n_regionkey")).alias("a"), F.to_json(F.named_struct(F.lit("k"), "n_nationkey", F.lit("n"), "n_name")).alias("s"))


sql_query("p25_interval", "orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR + INTERVAL 2 MONTH AS a, o_orderdate - INTERVAL 3 DAY AS b FROM orders")
sql_query("p26_decimal", "lineitem", "SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS s, CAST(max(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(20,4)) AS m FROM lineitem GROUP BY l_returnflag")


@query("p27_na_fill", f"SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(quality, -1) AS quality, coalesce(toxic, 9) AS toxic FROM {_LABELLED}")
def na_fill(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).na.fill({"quality": -1, "toxic": 9, "lang": "?"})


@query("p28_na_replace", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def na_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").na.replace({"BUILDING": "B", "MACHINERY": "M"}, subset=["c_mktsegment"])


@query("p29_na_drop", f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def na_drop(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).na.drop(how="any", subset=["quality", "toxic"])


@query("p30_sample", "SELECT l_returnflag, count(*) AS n, true AS near, true AS once FROM lineitem GROUP BY 1")
def sample(spark: SparkSession, d: str) -> DataFrame:
    """About a tenth of each flag's rows (six standard deviations of room), none of them twice."""
    t, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    taken = t.sample(False, 0.1, 7).groupBy("l_returnflag", *keys).agg(F.count("*").alias("k")).groupBy("l_returnflag").agg(F.sum("k").alias("taken"), F.max("k").alias("most"))
    most = t.groupBy("l_returnflag", *keys).agg(F.count("*").alias("k")).groupBy("l_returnflag").agg(F.sum("k").alias("n"), F.max("k").alias("copies"))
    near = F.abs(F.col("taken") - 0.1 * F.col("n")) <= 6 * F.sqrt(0.09 * F.col("n"))
    return most.join(taken, "l_returnflag").select("l_returnflag", "n", near.alias("near"), (F.col("most") <= F.col("copies")).alias("once"))


@query("p31_random_split", "SELECT count(*) AS n FROM orders")
def random_split(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = table(spark, d, "orders").randomSplit([1.0, 2.0, 3.0], 11)
    return a.union(b).union(c).agg(F.count("*").alias("n"))


@query("p32_sample_by", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def sample_by(spark: SparkSession, d: str) -> DataFrame:
    """All of one stratum, none of another, and none of those that have no fraction."""
    return table(spark, d, "events").sampleBy("event_type", {"click": 1.0, "view": 0.0}, 3).select("event_id", "event_type")


@query("p33_bucket_sample", "SELECT count(*) AS n FROM customer")
def bucket_sample(spark: SparkSession, d: str) -> DataFrame:
    parts = [rows.bucket_sample(table(spark, d, "customer"), x, 4, "c_custkey") for x in range(1, 5)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).agg(F.count("*").alias("n"))


sql_query("p33_tablesample_rows", "orders nation", "SELECT count(DISTINCT o_orderkey) AS n, (SELECT count(*) FROM nation TABLESAMPLE (50 ROWS)) AS every FROM (SELECT * FROM orders TABLESAMPLE (50 ROWS)) WHERE o_orderkey IN (SELECT o_orderkey FROM orders)", "SELECT least(50, (SELECT count(*) FROM orders)) AS n, count(*) AS every FROM nation")


@query("p34_describe", "SELECT 'count' AS summary, CAST(count(l_quantity) AS VARCHAR) AS l_quantity FROM lineitem UNION ALL SELECT 'min', CAST(min(l_quantity) AS VARCHAR) FROM lineitem UNION ALL SELECT 'max', CAST(max(l_quantity) AS VARCHAR) FROM lineitem")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_quantity").describe().filter("summary in ('count', 'min', 'max')")


sql_query("p35_transform_script", "nation", "SELECT TRANSFORM(n_nationkey, n_name) USING 'cat' AS (k STRING, v STRING) FROM nation", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation")


@query("p36_temp_view", "SELECT r_name FROM region WHERE r_regionkey < 3")
def temp_view(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "region").createOrReplaceTempView("some_region")
    assert any(t.name == "some_region" for t in spark.catalog.listTables())
    return spark.sql("SELECT r_name FROM some_region WHERE r_regionkey < 3")

"""User-defined functions, generators and typed operations (X rows of the survey)."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.grouping import Aggregator, typed_aggregate
from tessera.registry import query, sql_query
from tessera.sources.tables import table, views


@query("x01_register_udf", "SELECT n_nationkey, n_name || '/' || n_regionkey AS s FROM nation")
def register_udf(spark: SparkSession, d: str) -> DataFrame:
    spark.udf.register("tag", lambda a, b: None if a is None or b is None else f"{a}/{b}", "string")
    return views(spark, d, "nation").sql("SELECT n_nationkey, tag(n_name, n_regionkey) AS s FROM nation")


@query("x02_python_udf", "SELECT c_custkey, length(c_name) AS n, round(c_acctbal * 1.1, 6) AS v FROM customer")
def python_udf(spark: SparkSession, d: str) -> DataFrame:
    @F.udf("int", useArrow=True)
    def size(s):
        return len(s)

    @F.pandas_udf("double")
    def raised(v: pd.Series) -> pd.Series:
        return (v * 1.1).round(6)

    return table(spark, d, "customer").select("c_custkey", size("c_name").alias("n"), raised("c_acctbal").alias("v"))


@query("x03_udaf", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY 1")
def udaf(spark: SparkSession, d: str) -> DataFrame:
    """A geometric mean as an aggregate expression: a mergeable buffer (sum of logs, count) stays in the engine."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(F.avg(F.ln("l_quantity"))), 6).alias("g"))


@query("x04_aggregator", "SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def aggregator(spark: SparkSession, d: str) -> DataFrame:
    """The spread of prices, with a buffer of (least, greatest)."""
    spread = Aggregator(
        zero=lambda: (float("inf"), float("-inf")),
        reduce=lambda b, rows: (min(b[0], rows.o_totalprice.min()), max(b[1], rows.o_totalprice.max())),
        merge=lambda a, b: (min(a[0], b[0]), max(a[1], b[1])),
        finish=lambda b: b[1] - b[0],
    )
    return typed_aggregate(table(spark, d, "orders"), ["o_orderstatus"], ["o_totalprice"], spread, "spread double")


@query("x05_explode_map", "SELECT r_regionkey, k, v FROM region, (VALUES ('a', 1), ('b', 2)) t(k, v)")
def explode_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    return table(spark, d, "region").select("r_regionkey", F.explode(m).alias("k", "v"))


@query("x06_udtf", "SELECT n_nationkey, CAST(i AS INTEGER) AS i, n_name[i+1:i+1] AS c FROM nation, range(0, 3) t(i)")
def udtf(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="i int, c string")
    class Letters:
        def eval(self, s: str, n: int):
            for i in range(n):
                yield i, s[i]

    spark.udtf.register("letters", Letters)
    return views(spark, d, "nation").sql("SELECT n_nationkey, i, c FROM nation, LATERAL letters(n_name, 3)")


sql_query("x07_generate_outer", "labels documents", "SELECT doc_id, t FROM (SELECT doc_id, CASE WHEN toxic IS NULL THEN NULL ELSE array(toxic, quality) END AS a FROM documents LEFT JOIN labels USING (doc_id)) LATERAL VIEW OUTER explode(a) x AS t", "SELECT doc_id, CAST(NULL AS INT) AS t FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
sql_query("x08_lateral_view", "region", "SELECT r_regionkey, x FROM region LATERAL VIEW explode(array(1, 2, 3)) t AS x WHERE x > r_regionkey - 1", "SELECT r_regionkey, x FROM region, (VALUES (1), (2), (3)) t(x) WHERE x > r_regionkey - 1")
sql_query("x09_posexplode", "region", "SELECT r_regionkey, p, x FROM region LATERAL VIEW posexplode(array('a', 'b')) t AS p, x", "SELECT r_regionkey, p, x FROM region, (VALUES (0, 'a'), (1, 'b')) t(p, x)")
sql_query("x09_inline", "region", "SELECT r_regionkey, a, b FROM region LATERAL VIEW inline(array(named_struct('a', 1, 'b', 'x'), named_struct('a', 2, 'b', 'y'))) t AS a, b", "SELECT r_regionkey, a, b FROM region, (VALUES (1, 'x'), (2, 'y')) t(a, b)")
sql_query("x09_stack", "customer", "SELECT c_custkey, k, v FROM customer LATERAL VIEW stack(2, 'nation', c_nationkey, 'size', 1) t AS k, v", "SELECT c_custkey, 'nation' AS k, c_nationkey AS v FROM customer UNION ALL SELECT c_custkey, 'size', 1 FROM customer")
sql_query("x09_parse_url_tuple", "pages", "SELECT page_id, u.host, u.query FROM pages LATERAL VIEW inline(array(named_struct('host', parse_url(url, 'HOST'), 'query', parse_url(url, 'QUERY')))) u", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages")


@query("x10_sql_function", "SELECT p_partkey, round(p_retailprice * 1.19, 4) AS gross FROM part")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "part").sql("CREATE OR REPLACE TEMPORARY FUNCTION gross(x DOUBLE) RETURNS DOUBLE RETURN round(x * 1.19, 4)")
    return spark.sql("SELECT p_partkey, gross(p_retailprice) AS gross FROM part")


@query("x12_window_udf", "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS m FROM customer")
def window_udf(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        return float(v.mean())

    return table(spark, d, "customer").select("c_custkey", F.round(mean("c_acctbal").over(Window.partitionBy("c_nationkey")), 6).alias("m"))


@query("x13_map_partitions", "SELECT o_orderkey, o_orderkey * 2 AS twice FROM orders WHERE o_orderkey % 3 = 0")
def map_partitions(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            k = k[k % 3 == 0]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k * 2)], names=["o_orderkey", "twice"])

    return table(spark, d, "orders").select("o_orderkey").mapInArrow(run, "o_orderkey long, twice long")


@query("x14_encoded_objects", "SELECT r_regionkey, r_name FROM region")
def encoded_objects(spark: SparkSession, d: str) -> DataFrame:
    """Python objects in a binary column, as an object encoder keeps them."""
    import pickle

    @F.udf("binary")
    def pack(k, n):
        return pickle.dumps((k, n))

    @F.udf("r_regionkey int, r_name string")
    def unpack(b):
        return pickle.loads(bytes(b))

    return table(spark, d, "region").select(pack("r_regionkey", "r_name").alias("b")).select(unpack("b").alias("s")).select("s.*")


class PointType(T.UserDefinedType):
    """A pair of doubles."""

    @classmethod
    def sqlType(cls):
        return T.ArrayType(T.DoubleType(), False)

    @classmethod
    def module(cls):
        return "tessera.plans.udfs"

    def serialize(self, obj):
        return [obj.x, obj.y]

    def deserialize(self, datum):
        return Point(*datum)


class Point:
    __UDT__ = PointType()

    def __init__(self, x, y):
        self.x, self.y = x, y


@query("x15_user_defined_type", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, n_regionkey * 2.0::DOUBLE AS y FROM nation")
def user_defined_type(spark: SparkSession, d: str) -> DataFrame:
    """Points made, changed and taken apart by functions, of a type of their own in between."""
    made = F.udf(lambda x, y: Point(float(x), float(y)), PointType())
    grown = F.udf(lambda p: Point(p.x, p.y * 2), PointType())
    ends = F.udf(lambda p: (p.x, p.y), "x double, y double")
    p = table(spark, d, "nation").select("n_nationkey", ends(grown(made("n_nationkey", "n_regionkey"))).alias("p"))
    return p.select("n_nationkey", "p.x", "p.y")


@query("x17_shared_variables", "SELECT count(*) AS seen, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM customer")
def shared_variables(spark: SparkSession, d: str) -> DataFrame:
    """A broadcast set and an accumulator in partition functions; the counts come back as an observation."""
    wanted, counter = spark.sparkContext.broadcast({"BUILDING"}), spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            counter.add(1 if r.c_mktsegment in wanted.value else 0)

    t = table(spark, d, "customer").select("c_mktsegment")
    t.foreachPartition(count)
    return spark.createDataFrame([(t.count(), counter.value)], "seen long, hits long")

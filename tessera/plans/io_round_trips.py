"""Sources and sinks (S rows of the survey): each is written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import scratch
from tessera.registry import query
from tessera.sources import custom, readers
from tessera.sources.tables import table

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _trip(fmt: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, t = scratch(spark, fmt), table(spark, d, "nation")
        t.write.format(fmt).save(path)
        return spark.read.schema(t.schema).format(fmt).load(path)

    return run


for _f in ("parquet", "orc", "json", "csv"):
    query(f"s01_{_f}", _NATION)(_trip(_f))


@query("s02_no_paths", "SELECT r_regionkey, CAST(NULL AS INTEGER) AS x FROM region")
def no_paths(spark: SparkSession, d: str) -> DataFrame:
    """No paths are an empty table, which joins like any other."""
    none = readers.parquet(spark, [], "x int")
    return table(spark, d, "region").select("r_regionkey").join(none, F.col("r_regionkey") == F.col("x"), "left")


@query("s03_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R'")
def pushdown(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").filter("l_quantity > 48 and l_returnflag = 'R'").select("l_orderkey", "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]
    return df


@query("s05_json_corrupt", "SELECT * FROM (VALUES (1, CAST(NULL AS VARCHAR)), (CAST(NULL AS BIGINT), '{bad')) t(a, _corrupt_record)")
def json_corrupt(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "corrupt")
    spark.createDataFrame([('{"a":1}',), ("{bad",)], "value string").write.text(path)
    return spark.read.schema("a long, _corrupt_record string").json(path)


@query("s06_json_inference", "SELECT n_nationkey AS a, n_nationkey / 2 AS b, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS c, n_name AS d, n_regionkey > 2 AS e, 'bigint,double,string,array<string>,struct<x:boolean>' AS kinds FROM nation")
def json_inference(spark: SparkSession, d: str) -> DataFrame:
    """Types are inferred over all rows: whole and broken numbers give doubles, numbers and texts give strings."""
    path, k = scratch(spark, "inferred"), F.col("n_nationkey")
    half = F.when(k % 2 == 0, (k / 2).cast("int").cast("string")).otherwise((k / 2).cast("string"))
    mixed = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"')))
    line = F.format_string('{"a":%d,"b":%s,"c":%s,"d":["%s"],"e":{"x":%s}}', k, half, mixed, F.col("n_name"), (F.col("n_regionkey") > 2).cast("string"))
    table(spark, d, "nation").select(line.alias("value")).write.text(path)
    got = spark.read.json(path)
    kinds = ",".join(t for _, t in got.dtypes)
    return got.select("a", "b", "c", F.col("d")[0].alias("d"), F.col("e.x").alias("e"), F.lit(kinds).alias("kinds"))


@query("s07_json_options", "SELECT CAST(n_nationkey AS BIGINT) AS a, n_name AS b FROM nation")
def json_options(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "options")
    table(spark, d, "nation").select(F.format_string("{a: 00%d, 'b': '%s'} // note", "n_nationkey", "n_name").alias("value")).write.text(path)
    return spark.read.options(allowComments=True, allowUnquotedFieldNames=True, allowSingleQuotes=True, allowNumericLeadingZeros=True).json(path)


@query("s09_text", "SELECT r_name AS value FROM region")
def text(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "text")
    table(spark, d, "region").select("r_name").write.text(path)
    return spark.read.text(path)


@query("s15_libsvm", "SELECT CAST(label AS DOUBLE) AS label, CAST(2 AS INTEGER) AS n FROM (VALUES (0), (1)) t(label)")
def libsvm(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "libsvm")
    spark.createDataFrame([("0 1:1.5 3:2.0",), ("1 2:-1.0 3:4.0",)], "value string").write.text(path)
    from pyspark.ml.functions import vector_to_array

    return spark.read.format("libsvm").option("numFeatures", 3).load(path).select("label", F.size(F.filter(vector_to_array("features"), lambda x: x != 0)).alias("n"))


@query("s17_table_lookup", "SELECT r_regionkey, r_name FROM region")
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("DROP TABLE IF EXISTS kept_region")
    table(spark, d, "region").write.option("path", scratch(spark, "kept_region")).saveAsTable("kept_region")
    return spark.read.table("kept_region")


@query("s19_sql_on_files", "SELECT count(*) AS n FROM nation")
def sql_on_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT count(*) AS n FROM parquet.`{d}/nation.parquet`")


@query("s21_custom_source", "SELECT CAST(i AS BIGINT) AS id, CAST(i * i AS BIGINT) AS square FROM range(5, 20) t(i)")
def custom_source(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(custom.squares())
    return spark.read.format("squares").option("low", 0).option("high", 20).option("parts", 3).load().filter("id >= 5")


@query("s22_cached_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1")
def cached(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber").cache()
    return t.filter("l_linenumber > 3").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s23_existing_rdd", "SELECT n_nationkey, n_name FROM nation")
def existing_rdd(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(table(spark, d, "nation").select("n_nationkey", "n_name").rdd, "n_nationkey int, n_name string")


@query("s25_range", "SELECT i AS id FROM range(0, 50) t(i)")
def ranged(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(50)


@query("s26_partition_discovery", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "partitioned")
    table(spark, d, "nation").write.partitionBy("n_regionkey").parquet(path)
    return spark.read.parquet(path).filter("n_regionkey = 2")


@query("s27_save_modes", "SELECT mode, n_name, copies, refused FROM nation, (VALUES ('append', 2, false), ('overwrite', 1, false), ('ignore', 1, false), ('error', 1, true)) t(mode, copies, refused)")
def save_modes(spark: SparkSession, d: str) -> DataFrame:
    """What a table that is there becomes by writing the nations once more in each mode."""
    t, out = table(spark, d, "nation").select("n_name"), None
    for mode in ("append", "overwrite", "ignore", "error"):
        path = scratch(spark, mode)
        t.write.parquet(path)
        try:
            t.write.mode(mode).parquet(path)
            refused = False
        except Exception:
            refused = True
        found = spark.read.parquet(path).groupBy("n_name").agg(F.count("*").cast("int").alias("copies")).select(F.lit(mode).alias("mode"), "n_name", "copies", F.lit(refused).alias("refused"))
        out = found if out is None else out.union(found)
    return out


@query("s29_save", "SELECT format, n_nationkey, n_name FROM nation, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) t(format)")
def save(spark: SparkSession, d: str) -> DataFrame:
    """One writer, four formats, by format() and save() and by the formats' own names."""
    t, out = table(spark, d, "nation").select("n_nationkey", "n_name"), None
    for fmt in ("parquet", "orc", "json", "csv"):
        named, saved = scratch(spark, fmt), scratch(spark, fmt)
        getattr(t.filter("n_nationkey % 2 = 0").write, fmt)(named)
        t.filter("n_nationkey % 2 = 1").write.format(fmt).save(saved)
        both = spark.read.schema(t.schema).format(fmt).load([named, saved]).select(F.lit(fmt).alias("format"), "n_nationkey", "n_name")
        out = both if out is None else out.union(both)
    return out


@query("s30_insert_into", f"{_NATION} UNION ALL {_NATION} WHERE n_regionkey = 1")
def insert_into(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("DROP TABLE IF EXISTS inserted")
    t = table(spark, d, "nation")
    t.write.option("path", scratch(spark, "inserted")).saveAsTable("inserted")
    t.filter("n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey").write.insertInto("inserted")
    return spark.table("inserted")


@query("s33_dynamic_partitions", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS state, n_regionkey FROM nation")
def dynamic_partitions(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("DROP TABLE IF EXISTS by_region")
    t = table(spark, d, "nation")
    t.select("n_name", F.lit("old").alias("state"), "n_regionkey").write.partitionBy("n_regionkey").option("path", scratch(spark, "by_region")).saveAsTable("by_region")
    new = t.filter("n_regionkey = 1").select("n_name", F.lit("new").alias("state"), "n_regionkey")
    conf = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        new.write.mode("overwrite").insertInto("by_region")
    finally:
        spark.conf.set(conf, before)
    return spark.table("by_region")


@query("s34_insert_directory", "SELECT r_name FROM region")
def insert_directory(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "directory")
    table(spark, d, "region").createOrReplaceTempView("region")
    spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT r_name FROM region")
    return spark.read.parquet(path)


@query("s35_multi_insert", "SELECT n_name, 'low' AS part FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_name, 'high' FROM nation WHERE n_regionkey >= 2")
def multi_insert(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("nation")
    for t in ("part_low", "part_high"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
        spark.sql(f"CREATE TABLE {t} (n_name STRING) USING parquet LOCATION '{scratch(spark, t)}'")
    spark.sql("FROM nation INSERT INTO part_low SELECT n_name WHERE n_regionkey < 2 INSERT INTO part_high SELECT n_name WHERE n_regionkey >= 2")
    return spark.table("part_low").withColumn("part", F.lit("low")).union(spark.table("part_high").withColumn("part", F.lit("high")))


@query("s36_whole_and_binary_files", "SELECT r_regionkey, r_name, length(r_name) + 1 AS bytes, r_name || chr(10) AS whole FROM region")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """A file a region, read whole as text and as bytes; a sequence file of pairs joins the two."""
    path, seq = scratch(spark, "whole"), scratch(spark, "sequence")
    t = table(spark, d, "region")
    t.select("r_name", F.col("r_name").alias("part")).write.partitionBy("part").text(path)
    whole = spark.read.text(path, wholetext=True).select("part", F.col("value").alias("whole"))
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    binary = binary.select(F.regexp_extract("path", "part=([^/]+)", 1).alias("part"), F.col("length").alias("bytes"))
    t.rdd.map(lambda r: (r.r_regionkey, r.r_name)).saveAsSequenceFile(seq)
    pairs = spark.createDataFrame(spark.sparkContext.sequenceFile(seq), "r_regionkey int, r_name string")
    both = whole.join(binary, "part").withColumnRenamed("part", "r_name")
    return pairs.join(both, "r_name").select("r_regionkey", "r_name", "bytes", "whole")

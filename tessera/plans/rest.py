"""Remaining rows of the survey: writers, resolution, frames and arity checks, macros, stream sources and sinks, RDD-level operators, verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graphs
from tessera.operators.lineage import cut, scratch
from tessera.plans.graph_queries import nations
from tessera.plans.streams import events
from tessera.registry import query, sql_query
from tessera.sources.tables import table, views
from tessera.streaming import replay, state

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def refused(run) -> bool:
    try:
        run()
    except Exception:
        return True
    return False


@query("s04_orc_pushdown", f"{_NATION} WHERE n_regionkey = 2 AND n_nationkey > 3")
def orc_pushdown(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "orc")
    table(spark, d, "nation").write.orc(path)
    df = spark.read.orc(path).filter("n_regionkey = 2 and n_nationkey > 3")
    assert "PushedFilters: [IsNotNull" in df._jdf.queryExecution().executedPlan().toString()
    return df


@query("s08_json_writer", "SELECT CASE WHEN r_regionkey = 1 THEN '{\"r_regionkey\":1}' ELSE '{\"r_regionkey\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}' END AS value FROM region")
def json_writer(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    table(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") != 1, F.col("r_name")).alias("n")).write.json(path)
    return spark.read.text(path)


@query("s10_text_writer", "SELECT r_name AS value, true AS two_columns_refused FROM region")
def text_writer(spark: SparkSession, d: str) -> DataFrame:
    t, path = table(spark, d, "region"), scratch(spark, "text")
    t.select("r_name").write.text(path)
    return spark.read.text(path).withColumn("two_columns_refused", F.lit(refused(lambda: t.write.text(scratch(spark, "two")))))


@query("s16_managed_table_pruning", f"SELECT n_name FROM nation WHERE n_regionkey = 4")
def managed_table(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("DROP TABLE IF EXISTS parted_nation")
    table(spark, d, "nation").write.partitionBy("n_regionkey").option("path", scratch(spark, "parted")).saveAsTable("parted_nation")
    df = spark.table("parted_nation").filter("n_regionkey = 4").select("n_name")
    assert "PartitionFilters: [isnotnull(n_regionkey" in df._jdf.queryExecution().executedPlan().toString()
    return df


@query("s18_source_resolution", "SELECT r_regionkey, r_name, true AS unknown_refused FROM region")
def resolution(spark: SparkSession, d: str) -> DataFrame:
    """A source is found by its short name or its class; one that is not there is refused."""
    t = spark.read.format("org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat").load(f"{d}/region.parquet")
    return t.withColumn("unknown_refused", F.lit(refused(lambda: spark.read.format("no.such.source").load("x"))))


@query("s24_local_relation", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(x, y)")
def local_relation(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")


@query("s28_partition_by_moves_columns", "SELECT n_nationkey, n_name, n_regionkey, 'n_nationkey,n_name,n_regionkey' AS columns FROM nation")
def partition_by(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "by")
    table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").write.partitionBy("n_regionkey").parquet(path)
    t = spark.read.parquet(path)
    return t.withColumn("columns", F.lit(",".join(t.columns)))


@query("s31_save_as_table_append", f"{_NATION} UNION ALL {_NATION}")
def save_as_table(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("DROP TABLE IF EXISTS appended_nation")
    t = table(spark, d, "nation")
    t.write.option("path", scratch(spark, "appended")).saveAsTable("appended_nation")
    t.write.mode("append").saveAsTable("appended_nation")
    return spark.table("appended_nation")


sql_query("j10_hash_and_loop_agree", "nation region", "SELECT /*+ SHUFFLE_HASH(r) */ n_name, r_name FROM nation JOIN region r ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey <= r_regionkey AND n_regionkey >= r_regionkey")
sql_query("j22_product", "region", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_regionkey < 2")


@query("a03_partial_and_final", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def partial_and_final(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") == 1
    return df


@query("a05_complete_mode", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def complete_mode(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are already together by key are grouped without another exchange."""
    df = table(spark, d, "lineitem").select("l_orderkey").repartition(4, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    return df


@query("w06_frame_validation", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS k, true AS backward, true AS no_order FROM nation")
def frame_validation(spark: SparkSession, d: str) -> DataFrame:
    """Frames that run backward and ranks without an order are refused; the same window put right works."""
    views(spark, d, "nation")
    bad = ["SELECT count(*) OVER (ORDER BY n_name ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING) FROM nation", "SELECT row_number() OVER (PARTITION BY n_regionkey) FROM nation"]
    backward, no_order = (refused(lambda q=q: spark.sql(q).collect()) for q in bad)
    good = spark.sql("SELECT n_name, count(*) OVER (ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM nation")
    return good.select("n_name", "k", F.lit(backward).alias("backward"), F.lit(no_order).alias("no_order"))


@query("w07_one_window_operator", "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r, count(*) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS c FROM nation")
def one_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return table(spark, d, "nation").select("n_nationkey", F.rank().over(w).alias("r"), F.count("*").over(w).alias("c"))


@query("w23_partitioned_table_function", "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation")
def partitioned_function(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="n_regionkey int, n_name string, k long")
    class Numbered:
        def __init__(self):
            self.k = 0

        def eval(self, row):
            self.k += 1
            yield row["n_regionkey"], row["n_name"], self.k

    spark.udtf.register("numbered", Numbered)
    return views(spark, d, "nation").sql("SELECT * FROM numbered(TABLE(SELECT n_regionkey, n_name FROM nation) PARTITION BY n_regionkey ORDER BY n_name)")


@query("o10_sort_by_key", "SELECT n_name FROM nation ORDER BY n_name")
def sort_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name").rdd.map(lambda r: (r[0], None)).sortByKey().map(lambda kv: (kv[0],)).toDF("n_name string")


@query("o14_pipe", "SELECT upper(r_name) AS line FROM region")
def pipe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_name").rdd.map(lambda r: r[0]).pipe("tr a-z A-Z").map(lambda x: (x,)).toDF("line string")


@query("u05_arity", "SELECT r_name, true AS refused FROM region UNION ALL SELECT n_name, true FROM nation")
def arity(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    no = refused(lambda: r.union(n))
    return r.select("r_name").union(n.select("n_name")).withColumn("refused", F.lit(no))


@query("x11_macro", "SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS y FROM nation")
def macro(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "nation").sql("CREATE OR REPLACE TEMPORARY FUNCTION square_plus(x INT) RETURNS INT RETURN x * x + 1")
    return spark.sql("SELECT n_nationkey, square_plus(n_nationkey) AS y FROM nation")


sql_query("f_signs", "nation", "SELECT n_nationkey, negative(n_nationkey) AS n, positive(n_nationkey) AS p FROM nation", "SELECT n_nationkey, -n_nationkey AS n, n_nationkey AS p FROM nation")
sql_query("f_first_last_value", "orders", "SELECT o_custkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


@query("t01_batches", "SELECT CAST(3 AS BIGINT) AS batches, count(*) AS n FROM events")
def batches(spark: SparkSession, d: str) -> DataFrame:
    each = replay.each_batch(events(spark, d), lambda b, i: b.agg(F.lit(i).alias("batch"), F.count("*").alias("n")))
    return each.filter("n > 0").agg(F.count("*").alias("batches"), F.sum("n").alias("n"))


@query("t05_stream_repartition", "SELECT event_id FROM events")
def stream_repartition(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(events(spark, d).select("event_id").repartition(3))


@query("t12_slice", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def slice_of_stream(spark: SparkSession, d: str) -> DataFrame:
    kept = replay.each_batch(events(spark, d), lambda b, i: b.select("event_id", "ts"))
    return kept.filter("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09'").select("event_id")


@query("t17_state_dropped", "SELECT user_id AS k, CAST(count(*) AS DOUBLE) AS s FROM events GROUP BY 1 HAVING count(*) % 2 = 1")
def state_dropped(spark: SparkSession, d: str) -> DataFrame:
    """A key whose function returns nothing leaves the state; here after the last batch, keys of even counts."""
    last = replay.BATCHES if hasattr(replay, "BATCHES") else 3
    seen = {"n": 0}
    run = state.UpdateStateByKey("user_id", "value", lambda values, old: (old or 0.0) + len(values))

    def put(batch: DataFrame, number: int) -> None:
        run(batch, number)
        seen["n"] += 1

    q = events(spark, d).writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen["n"] == last
    drop = state.UpdateStateByKey("user_id", "value", lambda values, old: None if old is not None and old % 2 == 0 else old)
    drop.path = run.path
    drop(events_batch(spark, d).limit(0), 99)
    return drop.snapshot(spark)


def events_batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "value")


@query("t18_state_snapshots", "SELECT CAST(3 AS BIGINT) AS snapshots, count(DISTINCT user_id) AS keys FROM events")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    run, sizes = state.UpdateStateByKey("user_id", "value", lambda values, old: (old or 0.0) + len(values)), []

    def put(batch: DataFrame, number: int) -> None:
        run(batch, number)
        sizes.append(run.snapshot(spark).count())

    q = events(spark, d).writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return one(spark, "snapshots long, keys long", len(sizes), sizes[-1])


@query("t23_socket", "SELECT * FROM (VALUES ('alpha'), ('beta')) t(value)")
def socket_stream(spark: SparkSession, d: str) -> DataFrame:
    import socket
    import threading
    import time

    server = socket.create_server(("127.0.0.1", 0))

    def serve() -> None:
        c, _ = server.accept()
        c.sendall(b"alpha\nbeta\n")
        time.sleep(8)
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    name = "socket_sink"
    q = spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).load().writeStream.format("memory").queryName(name).option("checkpointLocation", scratch(spark, "checkpoint")).start()
    try:
        until = time.time() + 30
        while spark.table(name).count() < 2 and time.time() < until:
            time.sleep(0.3)
        got = spark.table(name).collect()
    finally:
        q.stop()
        server.close()
    return spark.createDataFrame(got, "value string")


@query("t26_queue", "SELECT r_name FROM region")
def queue_stream(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(replay.staged(table(spark, d, "region"), 5, "r_regionkey").select("r_name"))


@query("t35_rate_limit", "SELECT CAST(n_nationkey // 5 AS INTEGER) AS batch, count(*) AS n FROM nation GROUP BY 1")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """A file source that takes one file a batch: a batch is as large as its file."""
    numbered = lambda b, i: b.groupBy(F.lit(i).alias("number")).agg(F.count("*").alias("n"), F.min("n_nationkey").alias("first"))
    each = replay.each_batch(replay.staged(table(spark, d, "nation"), 5, "n_nationkey"), numbered)
    return each.select(F.floor(F.col("first") / 5).cast("int").alias("batch"), "n")


@query("r02_adaptive_merge", "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def adaptive_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").count().agg(F.count("*").alias("n"))


@query("r07_observe", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS nulls FROM orders")
def observe(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Observation

    o = Observation()
    table(spark, d, "orders").observe(o, F.count("*").alias("n"), F.count_if(F.col("o_totalprice").isNull()).alias("nulls")).write.format("noop").mode("overwrite").save()
    return one(spark, "n long, nulls long", o.get["n"], o.get["nulls"])


@query("r12_parallelize", "SELECT CAST(i AS BIGINT) AS x FROM range(0, 7) t(i)")
def parallelize(spark: SparkSession, d: str) -> DataFrame:
    return spark.sparkContext.parallelize(range(7), 3).map(lambda x: (x,)).toDF("x long")


@query("r16_rdd_cogroup", "SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n FROM nation GROUP BY 1")
def rdd_cogroup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").rdd.map(lambda r: (r.n_regionkey, 1))
    b = table(spark, d, "region").rdd.map(lambda r: (r.r_regionkey, 1))
    return a.cogroup(b).map(lambda x: (x[0], len(list(x[1][0])))).toDF("k long, n long")


@query("r18_checkpoint", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 1")
def checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return cut(table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey")).agg(F.count("*").alias("n"))


@query("r21_statcounter", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders")
def statcounter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select("o_totalprice").rdd.map(lambda r: r[0]).stats()
    return one(spark, "n long, lo double, hi double, mean double", int(s.count()), float(s.min()), float(s.max()), round(float(s.mean()), 4))


@query("r24_distributed_file", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def distributed_file(spark: SparkSession, d: str) -> DataFrame:
    """A file that is sent to every executor and read there by tasks: the regions' names."""
    import atexit
    import json
    import os
    import shutil
    import tempfile
    import uuid

    name, folder = f"regions-{uuid.uuid4().hex}.json", tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it lives
    with open(os.path.join(folder, name), "w") as f:
        json.dump({r.r_regionkey: r.r_name for r in table(spark, d, "region").collect()}, f)
    spark.sparkContext.addFile(os.path.join(folder, name))

    def named(rows):
        from pyspark import SparkFiles

        with open(SparkFiles.get(name)) as f:
            names = json.load(f)
        for r in rows:
            yield r.n_name, names[str(r.n_regionkey)]

    return table(spark, d, "nation").rdd.mapPartitions(named).toDF("n_name string, r_name string")


@query("g17_supersteps", "SELECT n_regionkey + 100 AS id, max(n_nationkey) AS attr FROM nation GROUP BY 1 UNION ALL SELECT n_nationkey, n_nationkey FROM nation")
def supersteps(spark: SparkSession, d: str) -> DataFrame:
    """Vertices that take the largest message of each superstep; ids from 100 on start low."""
    e = nations(spark, d)
    start = F.when(F.col("id") >= 100, F.lit(-1).cast("long")).otherwise(F.col("id"))
    return graphs.pregel(graphs.vertices_of(e), e, start, F.greatest("attr", "message"), F.max("msg"), to_dst=F.col("src_attr.attr"), rounds=5)


@query("v_verbs", "SELECT count(*) AS nrow, (SELECT count(*) FROM (DESCRIBE nation)) AS ncol, (SELECT string_agg(column_name, ',') FROM (DESCRIBE nation)) AS names, (SELECT string_agg(CASE column_type WHEN 'INTEGER' THEN 'int' ELSE 'string' END, ',') FROM (DESCRIBE nation)) AS coltypes, count(DISTINCT n_regionkey) AS uniques, least(count(*), 2) AS taken, 2 * count(*) AS bound FROM nation")
def verbs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation")
    return one(
        spark, "nrow long, ncol long, names string, coltypes string, uniques long, taken long, bound long",
        t.count(), len(t.columns), ",".join(t.columns), ",".join(k for _, k in t.dtypes), t.select("n_regionkey").distinct().count(), len(t.take(2)), t.union(t).count(),
    )

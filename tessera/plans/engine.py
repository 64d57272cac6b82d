"""What the engine tells of its work, and the rows of the survey about it: metrics, listeners, status, exchanges, samplers, commands, output per batch, state, logs."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import scratch
from tessera.plans.streams import BATCHES, events
from tessera.registry import query
from tessera.sources import readers
from tessera.sources.tables import table, views
from tessera.streaming import replay



def plan_metrics(df: DataFrame, metric: str = "numOutputRows") -> list[tuple[str, int]]:
    """(operator, value) of each operator of df's plan that has the metric, after running it once; the leaves come last."""
    done = df._jdf.queryExecution()
    done.toRdd().count()
    out, todo = [], [done.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        found = node.metrics().get(metric)
        if found.isDefined():
            out.append((node.nodeName().split(" ")[0], found.get().value()))
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


class Listener:
    """Hears of every query that ends: (action, whether it succeeded, observed values by name)."""

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    def __init__(self, spark: SparkSession):
        self.spark, self.heard = spark, []

    def __enter__(self) -> Listener:
        ensure_callback_server_started(self.spark.sparkContext._gateway)
        self.spark._jsparkSession.listenerManager().register(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # events come later than results
        self.spark._jsparkSession.listenerManager().unregister(self)

    def onSuccess(self, action, execution, nanoseconds) -> None:  # noqa: N802
        rows = execution.observedMetrics()
        names = [rows.keys().toSeq().apply(k) for k in range(rows.size())]
        self.heard.append((action, True, {n: json.loads(rows.apply(n).json()) for n in names}))

    def onFailure(self, action, execution, error) -> None:  # noqa: N802
        self.heard.append((action, False, {}))


@query("r01_exchange", "SELECT l_suppkey, 1 AS places, count(*) AS n FROM lineitem GROUP BY 1")
def exchange(spark: SparkSession, d: str) -> DataFrame:
    """After an exchange by key, all rows of a key are in one place."""
    t = table(spark, d, "lineitem").select("l_suppkey").repartition(7, "l_suppkey").withColumn("p", F.spark_partition_id())
    return t.groupBy("l_suppkey").agg(F.count_distinct("p").cast("int").alias("places"), F.count("*").alias("n"))


@query("r03_row_formats", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def row_formats(spark: SparkSession, d: str) -> DataFrame:
    """Rows to columns and back on the executors: each batch leaves as Arrow, as a data frame, and as Arrow again."""
    import pyarrow as pa

    def there_and_back(batches):
        for b in batches:
            yield pa.RecordBatch.from_pandas(b.to_pandas(), schema=b.schema, preserve_index=False)

    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return t.mapInArrow(there_and_back, t.schema)


@query("r04_cogrouped_iterators", "SELECT r_name, count(n_nationkey) AS n, coalesce(max(n_name), '') AS last FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def cogrouped_iterators(spark: SparkSession, d: str) -> DataFrame:
    """Two tables grouped by one key and walked side by side."""
    import pyarrow as pa

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        names, region = left.column("n_name").to_pylist(), right.column("r_name").to_pylist()
        return pa.table({"r_name": region, "n": [len(names)] * len(region), "last": [max(names, default="")] * len(region)})

    n, r = table(spark, d, "nation").groupBy("n_regionkey"), table(spark, d, "region").groupBy("r_regionkey")
    return n.cogroup(r).applyInArrow(both, "r_name string, n long, last string")


@query("r05_python_evaluation", "SELECT c_custkey, upper(c_name) AS a, length(c_name) + 1 AS b FROM customer WHERE c_acctbal > 0")
def python_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Two functions are evaluated in one node of the plan, over the rows and columns that are left."""
    up, size = F.pandas_udf(lambda s: s.str.upper(), "string"), F.pandas_udf(lambda s: s.str.len() + 1, "int")
    out = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", up("c_name").alias("a"), size("c_name").alias("b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "GreaterThan(c_acctbal" in plan and "c_mktsegment" not in plan
    return out


@query("r06_executed_command", "SELECT 'kept' AS state, n_name FROM nation WHERE n_regionkey = 1")
def executed_command(spark: SparkSession, d: str) -> DataFrame:
    """A command runs when it is stated, once, and its rows are kept: asking for them again doesn't run it again."""
    views(spark, d, "nation").sql("DROP TABLE IF EXISTS commanded")
    spark.sql(f"CREATE TABLE commanded (n_name STRING) USING parquet LOCATION '{scratch(spark, 'commanded')}'")
    done = spark.sql("INSERT INTO commanded SELECT n_name FROM nation WHERE n_regionkey = 1")
    done.collect()
    done.count()
    return spark.table("commanded").select(F.lit("kept").alias("state"), "n_name")


@query("r08_sql_metrics", "SELECT 'Filter' AS operator, count(*) AS n FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT 'Scan', count(*) FROM lineitem")
def sql_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = dict(plan_metrics(table(spark, d, "lineitem").filter("l_quantity > 25").select("l_orderkey", "l_quantity")))
    return spark.createDataFrame([(k, found[k]) for k in ("Filter", "Scan")], "operator string, n long")


@query("r09_query_listener", "SELECT o_orderstatus AS status, count(*) AS n, count(*) > 0 AS ended_well FROM orders GROUP BY 1 UNION ALL SELECT 'broken', NULL, false")
def query_listener(spark: SparkSession, d: str) -> DataFrame:
    """A query for each order status, whose rows a listener counts, and one that breaks."""
    statuses = [r[0] for r in table(spark, d, "orders").select("o_orderstatus").distinct().collect()]
    with Listener(spark) as ears:
        for s in statuses:
            own = table(spark, d, "orders").filter(F.col("o_orderstatus") == s).observe(f"status {s}", F.count("*").alias("n"))
            own.write.format("noop").mode("overwrite").save()
        try:
            spark.range(1).select(F.raise_error(F.lit("meant to break"))).collect()
        except Exception:
            pass
    rows = [(name[len("status ") :], v["n"], True) for _, ok, seen in ears.heard for name, v in seen.items() if ok and name.startswith("status ")]
    rows += [("broken", None, False) for _, ok, _ in ears.heard if not ok]
    return spark.createDataFrame(rows, "status string, n long, ended_well boolean")


@query("r10_local_scan", "SELECT n_nationkey, n_name FROM nation")
def local_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are here already are scanned without reading a file."""
    out = spark.createDataFrame(table(spark, d, "nation").toArrow()).select("n_nationkey", "n_name")
    assert "LocalTableScan" in out._jdf.queryExecution().executedPlan().toString()
    return out


@query("r11_local_operators", "SELECT n_name FROM nation WHERE n_regionkey = 1 UNION SELECT r_name FROM region WHERE r_regionkey < 3")
def local_operators(spark: SparkSession, d: str) -> DataFrame:
    """Filters, projections, limits, unions and distinct rows of small tables that are already here."""
    n = spark.createDataFrame(table(spark, d, "nation").collect(), "n_nationkey int, n_name string, n_regionkey int")
    r = spark.createDataFrame(table(spark, d, "region").collect(), "r_regionkey int, r_name string")
    both = n.filter("n_regionkey = 1").select("n_name").limit(100).union(r.filter("r_regionkey < 3").select("r_name"))
    return both.distinct()


@query("r14_coalesce_and_pipe", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1")
def rdd_operators(spark: SparkSession, d: str) -> DataFrame:
    """Filtered, coalesced and joined into lists within partitions, then taken apart again."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber").rdd.filter(lambda r: r.l_linenumber == 2)
    flags = rows.coalesce(2).glom().flatMap(lambda part: [(r.l_returnflag, 1) for r in part])
    return flags.reduceByKey(lambda a, b: a + b).toDF("l_returnflag string, n long")


@query("r22_rdd_samplers", "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 100 FROM nation) GROUP BY k")
def rdd_samplers(spark: SparkSession, d: str) -> DataFrame:
    """A stratum taken whole, others not at all; and a sample of a fixed size, without copies, that is all there is."""
    rows = table(spark, d, "nation").rdd
    strata = rows.map(lambda r: (r.n_regionkey, r.n_name)).sampleByKey(False, {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}, 5)
    fixed = {r.n_name for r in rows.takeSample(False, 1_000, 7)}
    return strata.map(lambda kv: (kv[0],)).toDF("k int").union(spark.createDataFrame([(100,)] * len(fixed), "k int")).groupBy("k").agg(F.count("*").alias("n"))


@query("r23_job_status", "SELECT o_orderpriority, count(*) AS n, true AS job_known, true AS tasks_done FROM orders GROUP BY 1")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a finished job of a named group: its stages, and that their tasks are done."""
    sc, group = spark.sparkContext, f"status-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "counted by priority")
    try:
        pairs = table(spark, d, "orders").select("o_orderpriority").rdd.map(lambda r: (r[0], 1)).reduceByKey(lambda a, b: a + b).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    done = all(s.numCompletedTasks == s.numTasks for s in stages if s)
    return spark.createDataFrame([(k, n, len(jobs) > 0, done) for k, n in pairs], "o_orderpriority string, n long, job_known boolean, tasks_done boolean")


@query("s14_jdbc_dialect", "SELECT s_suppkey, s_name, s_acctbal < 0 AS in_debt, CAST(round(s_acctbal, 2) AS DECIMAL(31,11)) AS exact, s_nationkey AS small FROM supplier")
def jdbc_dialect(spark: SparkSession, d: str) -> DataFrame:
    """Types that the database has other names or bounds for: long texts, booleans, small numbers, decimals of more digits than it knows."""
    t = table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") < 0).alias("in_debt"), F.round("s_acctbal", 2).cast("decimal(38,18)").alias("exact"), F.col("s_nationkey").cast("byte").alias("small"))
    base = readers.Embedded(spark, "dialect")
    base.write(t.coalesce(1), "supplier_types")
    back = readers.jdbc(spark, base.published(), "supplier_types", driver=readers.DERBY)
    kinds = {c.lower(): k for c, k in back.dtypes}
    assert (kinds["s_name"], kinds["in_debt"], kinds["exact"]) == ("string", "boolean", "decimal(31,11)"), kinds
    return back.toDF(*[c.lower() for c in back.columns])


@query("s37_jdbc_ranges", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 21")
def jdbc_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A statement with a place for each end of a range, which is run for each of several parts of the whole range."""
    base = readers.Embedded(spark, "ranges")
    base.write(table(spark, d, "nation").coalesce(1), "nation")
    df = readers.jdbc_ranges(spark, base.published(), 'SELECT "n_nationkey", "n_name" FROM nation WHERE "n_nationkey" >= ? AND "n_nationkey" <= ?', 3, 21, 4, driver=readers.DERBY)
    return df.toDF(*[c.lower() for c in df.columns])


@query("t15_state_api", "SELECT user_id, count(*) // 5 AS fives, count(*) % 5 AS rest FROM events GROUP BY 1")
def state_api(spark: SparkSession, d: str) -> DataFrame:
    """A key's state counts its values; a state that reaches five is removed, and the next value starts a new one."""

    def run(key, frames, state):
        fives, n = 0, state.get[0] if state.exists else 0
        for f in frames:
            for _ in range(len(f)):
                n += 1
                state.update((n,))
                if n == 5:
                    fives, n = fives + 1, 0
                    state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "fives": [fives], "rest": [n]})

    out = events(spark, d).groupBy("user_id").applyInPandasWithState(run, "user_id long, fives long, rest long", "n long", "append", "NoTimeout")
    kept = replay.each_batch(out, lambda b, i: b.withColumn("batch", F.lit(i)))
    return kept.groupBy("user_id").agg(F.sum("fives").alias("fives"), F.max_by("rest", "batch").alias("rest"))


@query("t19_state_store", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def state_store(spark: SparkSession, d: str) -> DataFrame:
    """The state that a finished query left in its store, read as a table."""
    at = scratch(spark, "checkpoint")
    counts = events(spark, d).groupBy("user_id").count()
    counts.writeStream.outputMode("complete").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("statestore").load(at).select("key.user_id", F.col("value.count").alias("n"))


@query("t21_output_per_batch", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1")
def output_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each batch goes to two places, a table of its rows and a table of its sums; both hold the whole stream in the end."""
    rows, sums = scratch(spark, "rows"), scratch(spark, "sums")

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.select("event_type", "event_id").write.mode("append").parquet(rows)
        batch.groupBy("event_type").agg(F.sum("value").alias("s")).write.mode("append").parquet(sums)
        batch.unpersist()

    events(spark, d).writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    n = spark.read.parquet(rows).groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(spark.read.parquet(sums).groupBy("event_type").agg(F.round(F.sum("s"), 3).alias("s")), "event_type")


@query("t27_constant_stream", f"SELECT n_name, CAST({BATCHES} AS BIGINT) AS times FROM nation")
def constant_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that gives the same rows in every batch: a clock of batches, each of which is the table."""
    t = table(spark, d, "nation").select("n_name")
    each = replay.each_batch(replay.staged(spark.range(BATCHES), BATCHES, "id"), lambda b, i: b.crossJoin(t).select("n_name"))
    return each.groupBy("n_name").agg(F.count("*").alias("times"))


@query("t34_write_ahead_log", "SELECT event_id, 1 AS times FROM events")
def write_ahead_log(spark: SparkSession, d: str) -> DataFrame:
    """A query that breaks between two batches and starts again from its log: every row is put out once."""
    at, sink = scratch(spark, "checkpoint"), scratch(spark, "sink")
    stream, seen = events(spark, d).select("event_id"), []

    def put(batch: DataFrame, number: int) -> None:
        if number == 1 and not seen:
            seen.append(number)
            raise RuntimeError("meant to break")
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch-{number}")

    def run() -> None:
        stream.writeStream.foreachBatch(put).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    try:
        run()
    except Exception:
        pass
    run()
    logged = spark.read.format("binaryFile").load(f"{at}/offsets/*").count(), spark.read.format("binaryFile").load(f"{at}/commits/*").count()
    assert seen == [1] and logged == (BATCHES, BATCHES)
    return spark.read.parquet(f"{sink}/*").groupBy("event_id").agg(F.count("*").cast("int").alias("times"))

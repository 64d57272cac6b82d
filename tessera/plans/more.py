"""Rows of the survey that need more than one statement: JDBC, source filters, vertex sets, window inverses, initial state, listeners."""

from __future__ import annotations

from pyspark.ml import classification, feature
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, scratch
from tessera.plans.graph_queries import trade
from tessera.plans.streams import events
from tessera.registry import query
from tessera.sources import readers
from tessera.sources.tables import table
from tessera.streaming import replay, state

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _database(spark: SparkSession, d: str, name: str) -> readers.Embedded:
    """nation in an embedded database."""
    out = readers.Embedded(spark, name)
    out.write(table(spark, d, "nation").coalesce(1), "nation")
    return out


def _lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


@query("s11_jdbc_strides", _NATION)
def jdbc_strides(spark: SparkSession, d: str) -> DataFrame:
    df = readers.jdbc(spark, _database(spark, d, "strides").published(), "nation", '"n_nationkey"', 0, 25, 4, driver=readers.DERBY)
    return _lowered(df)


@query("s12_jdbc_predicates", f"{_NATION} WHERE n_regionkey IN (1, 3)")
def jdbc_predicates(spark: SparkSession, d: str) -> DataFrame:
    url = _database(spark, d, "predicates").published()
    return _lowered(spark.read.jdbc(url, "nation", predicates=['"n_regionkey" = 1', '"n_regionkey" = 3'], properties={"driver": readers.DERBY}))


@query("s13_jdbc_append", f"{_NATION} UNION ALL {_NATION}")
def jdbc_append(spark: SparkSession, d: str) -> DataFrame:
    base = _database(spark, d, "appended")
    base.write(table(spark, d, "nation").coalesce(1), "nation", mode="append")
    return _lowered(readers.jdbc(spark, base.published(), "nation", driver=readers.DERBY))


@query("s20_filter_algebra", "SELECT p_partkey FROM part WHERE (p_size = 3 OR p_size > 40) AND NOT p_name LIKE 'a%' AND p_brand IS NOT NULL AND p_size IN (3, 41, 42, 43) AND p_brand LIKE '%1%'")
def filter_algebra(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    keep = ((c("p_size") == 3) | (c("p_size") > 40)) & ~c("p_name").startswith("a") & c("p_brand").isNotNull() & c("p_size").isin(3, 41, 42, 43) & c("p_brand").contains("1")
    return table(spark, d, "part").filter(keep).select("p_partkey")


@query("s32_no_overwrite_of_what_is_read", "SELECT r_regionkey, r_name, true AS refused FROM region")
def no_overwrite(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "kept")
    table(spark, d, "region").write.parquet(path)
    spark.sql("DROP TABLE IF EXISTS read_and_written")
    spark.sql(f"CREATE TABLE read_and_written USING parquet LOCATION '{path}'")
    try:
        spark.sql("INSERT OVERWRITE read_and_written SELECT * FROM read_and_written")
        refused = False
    except Exception:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query("g03_vertex_sets", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS minus, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS diff, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS inner_join")
def vertex_sets(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("attr"))
    one = v.filter("attr = 1")
    changed = v.withColumn("attr", F.when(F.col("id") % 2 == 0, F.col("attr") + 1).otherwise(F.col("attr")))
    diff = changed.join(v.withColumnRenamed("attr", "old"), "id").filter("attr <> old")
    counts = [v.join(one, "id", "left_anti").agg(F.count("*").alias("minus")), diff.agg(F.count("*").alias("diff")), v.join(one.select("id"), "id").agg(F.count("*").alias("inner_join"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("g07_two_dimensional_cut", "SELECT id, true AS bounded FROM (SELECT o_custkey * 2 AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT l_partkey * 2 + 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey)")
def two_dimensional(spark: SparkSession, d: str) -> DataFrame:
    """Edges go to cell (src, dst) of a 3 by 3 grid, so that an id is in 5 cells at most."""
    e = trade(spark, d).withColumn("cell", F.pmod(F.hash("src"), F.lit(3)) * 3 + F.pmod(F.hash("dst"), F.lit(3)))
    ids = e.select(F.col("src").alias("id"), "cell").union(e.select("dst", "cell")).groupBy("id").agg(F.count_distinct("cell").alias("cells"))
    return ids.select("id", (F.col("cells") <= 5).alias("bounded"))


@query("t10_inverse_window_keeps_keys", "WITH k AS (SELECT DISTINCT user_id FROM events), w AS (SELECT DISTINCT time_bucket(INTERVAL 10 DAY, ts) AS start FROM events) SELECT start, user_id, count(event_id) AS n FROM k CROSS JOIN w LEFT JOIN events e USING (user_id) WHERE e.event_id IS NULL OR time_bucket(INTERVAL 10 DAY, e.ts) = start GROUP BY 1, 2 UNION ALL SELECT start, user_id, 0 FROM k CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = k.user_id AND time_bucket(INTERVAL 10 DAY, e.ts) = w.start)")
def inverse_window(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts in which a key that was ever seen stays, at 0 where a window has no row of it."""
    days = F.window("ts", "10 days", startTime="9 days")
    g = events(spark, d).groupBy(days.alias("w"), "user_id").agg(F.count("*").alias("n"))
    out = cut(replay.finished(g, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n"))
    every = out.select("user_id").distinct().crossJoin(out.select("start").distinct())
    return every.join(out, ["start", "user_id"], "left").na.fill(0, ["n"])


@query("t16_initial_state", "SELECT user_id AS k, CAST(count(*) + 100 AS DOUBLE) AS s FROM events GROUP BY 1")
def initial_state(spark: SparkSession, d: str) -> DataFrame:
    run = state.UpdateStateByKey("user_id", "value", lambda values, old: (100.0 if old is None else old) + len(values))
    q = events(spark, d).writeStream.foreachBatch(run).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return run.snapshot(spark)


@query("t36_listener", "SELECT true AS heard, count(*) AS n FROM events")
def listener(spark: SparkSession, d: str) -> DataFrame:
    sink = scratch(spark, "sink")
    q = events(spark, d).select("event_id").writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = sum(p.numInputRows for p in q.recentProgress)
    return spark.createDataFrame([(seen == spark.read.parquet(sink).count(), seen)], "heard boolean, n long")


@query("t37_streaming_means", "SELECT event_type, count(*) AS weight, round(avg(value), 6) AS centre FROM events GROUP BY 1")
def streaming_means(spark: SparkSession, d: str) -> DataFrame:
    """One centre per type, moved by each batch: (centre * weight + sum) / (weight + count), without decay."""
    model: dict[str, tuple[int, float]] = {}

    def learn(batch: DataFrame, number: int) -> None:
        for r in batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect():
            n, c = model.get(r.event_type, (0, 0.0))
            model[r.event_type] = (n + r.n, (c * n + r.s) / (n + r.n))

    q = events(spark, d).writeStream.foreachBatch(learn).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.createDataFrame([(k, n, round(c, 6)) for k, (n, c) in model.items()], "event_type string, weight long, centre double")


_SPLIT = "CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END"


@query("m04_tree_classifiers", f"SELECT model, l_returnflag, sum({_SPLIT}) AS ones FROM lineitem, (VALUES ('tree'), ('forest'), ('boosted')) t(model) GROUP BY 1, 2")
def tree_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Trees find a threshold again: how many rows of each flag lie above it."""
    t = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.expr(_SPLIT).cast("double").alias("label"))
    v = feature.VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(t).cache()
    models = {"tree": classification.DecisionTreeClassifier(maxDepth=2, maxBins=64), "forest": classification.RandomForestClassifier(numTrees=3, maxDepth=2, maxBins=64, seed=1), "boosted": classification.GBTClassifier(maxIter=2, maxDepth=2, maxBins=64, seed=1)}
    out = None
    for name, m in models.items():
        p = m.fit(v).transform(v).groupBy("l_returnflag").agg(F.sum("prediction").alias("ones")).select(F.lit(name).alias("model"), "l_returnflag", "ones")
        out = p if out is None else out.union(p)
    return out


@query("m04_naive_bayes", f"WITH t AS (SELECT l_quantity AS x, CASE WHEN l_extendedprice > 30000 THEN 1.0 ELSE 0.0 END AS y FROM lineitem), s AS (SELECT y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM t GROUP BY y), q AS (SELECT DISTINCT x FROM t) SELECT x, arg_max(y, ln(n) - 0.5 * ln(v) - 0.5 * (x - m) * (x - m) / v) AS guess FROM q, s GROUP BY x")
def naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.when(F.col("l_extendedprice") > 30000, 1.0).otherwise(0.0).alias("label"))
    v = feature.VectorAssembler(inputCols=["x"], outputCol="features").transform(t)
    return classification.NaiveBayes(modelType="gaussian").fit(v).transform(v.select("x", "features").distinct()).select("x", F.col("prediction").alias("guess"))

"""Streaming (T rows of the survey): events replayed in micro-batches, results compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import scratch
from tessera.registry import query
from tessera.sources import custom
from tessera.sources.tables import table
from tessera.streaming import replay, state

BATCHES = 3


def events(spark: SparkSession, d: str, batches: int = BATCHES, columns: str = "event_id ts user_id event_type value") -> DataFrame:
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns.split())
    return replay.staged(t, batches, "ts")


@query("t02_narrow", "SELECT event_id, value * 2 AS twice FROM events WHERE event_type = 'click'")
def narrow(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(events(spark, d).filter("event_type = 'click'").select("event_id", (F.col("value") * 2).alias("twice")))


@query("t03_union", "SELECT event_id FROM events UNION ALL SELECT event_id FROM events")
def union(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(events(spark, d).select("event_id").union(events(spark, d).select("event_id")))


@query("t04_transform", "SELECT event_type, sum(n) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def transform(spark: SparkSession, d: str) -> DataFrame:
    each = replay.each_batch(events(spark, d), lambda b, i: b.groupBy("event_type").agg(F.count("*").alias("n")))
    return each.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("t06_running_counts", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1")
def running(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("s")), "complete")


@query("t07_stream_static_join", "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey")
def static_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("k", F.col("user_id") % 25)
    return replay.finished(e.join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).select("event_id", "n_name"))


@query("t07_stream_stream_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    a = events(spark, d).filter("event_type = 'click'").withWatermark("ts", "1 day").alias("a")
    b = events(spark, d).filter("event_type = 'purchase'").withWatermark("ts", "1 day").alias("b")
    on = F.expr("a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 1 hour")
    return replay.finished(a.join(b, on).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b")))


@query("t08_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return replay.finished(g, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("t08_sliding", "SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY 1")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return replay.finished(g, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("t09_reduce_by_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, user_id, max(value) AS m FROM events GROUP BY 1, 2")
def reduce_by_window(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), "user_id").agg(F.max("value").alias("m"))
    return replay.finished(g, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "m")


@query("t11_count_by_value_and_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def count_by_value(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.size(F.collect_set("user_id")).cast("long").alias("users"))
    return replay.finished(g, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "users")


@query("t13_update_state_by_key", "SELECT user_id AS k, CAST(count(*) AS DOUBLE) AS s FROM events GROUP BY 1")
def update_state(spark: SparkSession, d: str) -> DataFrame:
    run = state.UpdateStateByKey("user_id", "value", lambda values, old: (old or 0.0) + len(values))
    q = events(spark, d).writeStream.foreachBatch(run).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return run.snapshot(spark)


@query("t14_map_with_state", "SELECT user_id, count(*) AS total FROM events GROUP BY 1")
def map_with_state(spark: SparkSession, d: str) -> DataFrame:
    def step(key, old, values):
        n = old[0] + len(values)
        return (n,), [(key, n)]

    out = state.map_with_state(events(spark, d), "user_id", "value", (0,), "n long", "user_id long, total long", step)
    return replay.finished(out).groupBy("user_id").agg(F.max("total").alias("total"))


@query("t20_session_windows", "SELECT user_id, count(*) AS sessions, sum(n) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY 1")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    run = state.Sessions("user_id", "ts", 2 * 3600)
    e = events(spark, d, columns="user_id ts")
    q = e.writeStream.foreachBatch(run).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    found = run.sessions(spark)
    if found is None:
        found = spark.createDataFrame([], "user_id long, n long")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("t20_deduplicate", "SELECT count(DISTINCT event_type) AS n FROM events")
def deduplicate(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(events(spark, d).dropDuplicates(["event_type"])).agg(F.count("*").alias("n"))


@query("t22_file_sink", "SELECT event_id, event_type FROM events")
def file_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sink")
    q = events(spark, d).select("event_id", "event_type").writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


@query("t25_text_files", "SELECT r_name AS value FROM region")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "lines")
    table(spark, d, "region").select("r_name").write.text(path)
    return replay.finished(spark.readStream.text(path))


@query("t28_custom_receiver", "SELECT CAST(i AS BIGINT) AS id, CAST(i * i AS BIGINT) AS square FROM range(0, 12) t(i)")
def custom_receiver(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(custom.squares())
    name = "squares_sink"
    q = spark.readStream.format("squares").option("high", 12).load().writeStream.format("memory").queryName(name).option("checkpointLocation", scratch(spark, "checkpoint")).start()
    try:
        while spark.table(name).count() < 12 and q.isActive:
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@query("t33_restart", "SELECT count(*) AS n, count(DISTINCT event_id) AS once FROM events")
def restart(spark: SparkSession, d: str) -> DataFrame:
    """A query is stopped and started again from its checkpoint; each row arrives once."""
    t = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    source, sink, at = scratch(spark, "source"), scratch(spark, "sink"), scratch(spark, "checkpoint")
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        t.filter(half).write.mode("append").parquet(source)
        q = spark.readStream.schema(t.schema).parquet(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(sink).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("once"))
